"""Views of the driver's tables in the shape of the reference's inputs, as columns that Spark and DuckDB read alike.

`rows` gives a view as a DataFrame, `cte` the same as a common table expression for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .adapters import table


def pick(index: str, values: list[str]) -> str:
    """The value at an index expression (0 on)."""
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


CLASSES = ["vehicle.car", "human.pedestrian.adult", "vehicle.truck", "movable_object.barrier", "vehicle.bicycle", "static.sign"]
SCENE = "CAST((l_orderkey - l_orderkey % 64) / 64 AS BIGINT)"

#: Objects of frames: 64 orders are a scene, an order is a frame, a line number an object that may be seen in each of them.
DRIVING = {
    "scene": SCENE,
    "frame": "l_orderkey % 64",
    "obj": "CAST(l_linenumber AS BIGINT)",
    "cls": pick(f"({SCENE} + l_linenumber) % 6", CLASSES),
    "x": "l_partkey % 50 - 25",
    "y": "l_suppkey % 50 - 25",
    "z": "l_partkey % 3",
    "heading": "CAST((l_partkey * 37) % 360 AS DOUBLE) + 0.25",
    "activity": pick("(CAST((l_orderkey % 64 - l_orderkey % 8) / 8 AS BIGINT) + l_linenumber) % 3", ["moving", "parked", "turning"]),
    "description": "CASE l_returnflag WHEN 'A' THEN 'near the curb' WHEN 'N' THEN 'in the left lane' ELSE '' END",
    "visibility": "l_suppkey % 4 + 1",
    "vx": "l_partkey % 3",
    "vy": "l_suppkey % 2",
    "x1": "(l_partkey * 7) % 1900",
    "y1": "(l_suppkey * 31) % 1060",
    "x2": "(l_partkey * 7) % 1900 + 20 + l_partkey % 300",
    "y2": "(l_suppkey * 31) % 1060 + 30 + (l_suppkey * 3) % 300",
}
_ONE = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate)"

# Activity ids, of persons and vehicles.
PERSON_ACTS = "person_opens_trunk person_closes_trunk person_opens_vehicle_door person_closes_vehicle_door person_enters_vehicle person_exits_vehicle person_loads_vehicle person_unloads_vehicle person_picks_up_object person_puts_down_object person_enters_scene_through_structure person_sits_down person_stands_up person_talks_on_phone".split()
VEHICLE_ACTS = "vehicle_starts vehicle_stops vehicle_turns_left vehicle_reverses".split()
_MS = "(CAST(substr(CAST(ts AS STRING), 12, 2) AS BIGINT) * 3600 + CAST(substr(CAST(ts AS STRING), 15, 2) AS BIGINT) * 60 + CAST(substr(CAST(ts AS STRING), 18, 2) AS BIGINT)) * 1000"

#: Annotated activities: a day is a slot, eight cameras, one actor for each user.
ACTS = {
    "slot": "substr(CAST(ts AS STRING), 1, 10)",
    "event_id": "event_id",
    "activity": pick("event_id % 18", PERSON_ACTS + VEHICLE_ACTS),
    "camera": "'G' || CAST(300 + user_id % 8 AS STRING)",
    "actor": "user_id",
    "start_ms": _MS,
    "end_ms": f"{_MS} + 500 + (event_id * 977) % 29500",
    "described": "user_id % 4 <> 0",
    "other": pick("(event_id * 5 + 3) % 18", PERSON_ACTS + VEHICLE_ACTS),
    "verb": pick("event_id % 16", "leaves purchases transfers runs sits dies sees makes walk hop passes pushes tie flee taxes stops".split()),
    "told": "'a person wearing a ' || " + pick("user_id % 6", ["unknown", "blue", "indigo", "orange", "gray", "olive"]) + " || ' ' || " + pick("event_id % 5", ["upper body garment with a hood", "upper body garment", "hooded jacket", "top", "Upper body garment"]) + " || ' and ' || " + pick("event_id % 4", ["blue lower body clothing", "lower body shorts", "black pants", "a unknown lower body garment"]) + " || " + pick("event_id % 6", [", sitting on a chair near the wall.", "", ", with their back turned to us, alone.", ", while ascending a staircase. ", ",  sitting there", "."]),
    "spoken": "'Someone ' || " + pick("event_id % 5", ["enters scene through structure", "entering a scene through structure", "exits scene through structure", "leaving scene through structure", "sits down"]) + " || ' now'",
    "clip": "substr(CAST(ts AS STRING), 1, 10) || '.' || replace(substr(CAST(ts AS STRING), 12, 8), ':', '-') || '.' || replace(substr(CAST(ts AS STRING), 12, 8), ':', '-') || '.' || " + pick("user_id % 4", ["school", "bus", "admin", "hospital"]) + " || '.G' || CAST(300 + user_id % 8 AS STRING) || '.r13.avi'",
    "reply": "'Here: ' || chr(10) || '```json' || chr(10) || props || chr(10) || '```'",
    "lines": "'ACTIVITY:  walks' || CAST(event_id % 7 AS STRING) || chr(10) || 'DESCRIPTION: in blue ' || chr(10) || 'x'",
    "description": "CASE WHEN user_id % 4 = 0 THEN 'a person' ELSE 'a person wearing a ' || " + pick("user_id % 5", ["blue", "red", "gray", "green", "black"]) + " || ' top' END",
}

def _say(index: str, texts: list[str]) -> str:
    return pick(index, [t.replace("'", "''") for t in texts])


#: Generated questions with what their checks look for, right and wrong ones alike.
QUESTIONS = {
    "slot": "substr(CAST(ts AS STRING), 1, 10)",
    "n": "event_id",
    "category": pick("event_id % 6", ["temporal", "event_ordering", "spatial", "summarization", "counting", "best_camera"]),
    "question": _say(
        "(event_id * 7 + user_id) % 10",
        [
            "Which came first: a person opens a door or a person close the trunk?",
            "How do a orange car and the the person move?",
            "What happens at 127s on camera G300?",
            "What does someone do around the 5 mark, leavesing the {slot}?",
            "How many times does a person wearing a blue top sit down? person_sits_down",
            "Which event is first, frame 381 or 12.10-13.20s?",
            "Identify the order of evt_12 and cluster_3 for entity_a.",
            "Which camera shows a person who opens the door?",
            "How long is a unique event of 42 seconds for a user?",
            "Who is missing after crossing the street?",
        ],
    ),
    "naturalized": "event_id % 2 = 0",
    "correct_idx": "CAST(event_id % 5 AS INT)",
    "cnt": "event_id % 23",
    "reasoning": _say("event_id % 5", ["", "The action was observed 3 times.", "the blue door occurred first, as seen.", "It was observed 12 times across cameras.", "Both are seen once."]),
    "a_camera": "'G' || CAST(300 + user_id % 8 AS STRING)",
    "b_camera": "'G' || CAST(300 + event_id % 8 AS STRING)",
    "a_start": "event_id % 300",
    "a_end": "event_id % 300 + user_id % 7",
    "b_start": "(event_id * 3) % 300",
    "gap_ds": "event_id % 250 - 5",
    "a_desc": pick("user_id % 5", ["a person", "a person in a blue top", "a person in a red top", "someone", ""]),
    "b_desc": pick("event_id % 4", ["a person", "a person in a blue top", "a vehicle", "a person in black pants"]),
    "distance_dm": "CASE WHEN event_id % 37 = 0 THEN NULL ELSE (event_id * 13) % 250 END",
    "proximity": pick("event_id % 3", ["near", "moderate", "far"]),
    "crosses": "event_id % 11 = 0",
    "n_ordered": "2 + event_id % 3",
    "o1": "event_id % 40",
    "o2": "(event_id * 7) % 40",
    "o3": "(event_id * 11) % 40",
    "min_gap_ds": "event_id % 60",
    "question_type": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'first' END",
    "correct_camera": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'G300' END",
}
_ANSWERS = {
    **{f"option_{i}": f"CASE category WHEN 'counting' THEN CAST(cnt + {i} - CASE WHEN n % 17 = 0 AND {i} = 3 THEN 1 ELSE 0 END AS STRING) ELSE 'Camera G' || CAST(300 + (n * {i + 1}) % 9 AS STRING) END" for i in range(4)},
    "question_id": "'final_' || category || '_' || lpad(CAST(n AS STRING), 6, '0')",
}
_RIGHT = {"answer": "CASE WHEN n % 7 = 0 THEN 'a wrong answer' ELSE coalesce(CASE correct_idx " + " ".join(f"WHEN {i} THEN option_{i}" for i in range(4)) + " END, '') END"}

_COLOURS = ["unknown", "blue", "navy", "dark red", "olive", "black", "indigo", "khaki", "white"]
#: People as cameras describe them; four sightings are of one person.
PEOPLE = {
    "id": "p_partkey",
    "cluster": "CAST((p_partkey - p_partkey % 4) / 4 AS BIGINT)",
    "camera": "'G' || CAST(300 + (p_partkey * 7) % 8 AS STRING)",
    "hair": pick("(p_partkey * 5) % 4", ["unknown", "black", "brown", "gray"]),
    "upper": pick("(p_partkey * 5) % 9", _COLOURS),
    "lower": pick("(p_partkey * 11) % 9", _COLOURS),
    "lower_type": pick("p_partkey % 3", ["pants", "shorts", "skirt"]),
    "shoe": pick("(p_partkey * 3) % 5", ["unknown", "white", "black", "unknown", "brown"]),
    "upper_brightness": pick("p_partkey % 4", ["", "dark", "medium", "light"]),
    "lower_brightness": pick("(p_partkey * 3) % 5", ["", "dark", "unknown", "light", ""]),
    "upper_texture": pick("(p_partkey * 7) % 5", ["", "striped", "solid", "patterned", ""]),
    "lower_texture": pick("(p_partkey * 3) % 4", ["", "solid", "patterned", ""]),
    "accessories": pick("(p_partkey * 13) % 6", ["", "hat", "backpack,hat", "bag", "", "hat,umbrella"]),
    "height": "60 + (p_partkey * 37) % 200",
    "seen": pick("(p_partkey * 17) % 6", ["a person", "a person in a blue top and black pants", "a person wearing a red top", "a person in black shorts", "a person", "a person in navy top and khaki pants"]),
    "gpt": pick("(p_partkey * 19) % 7", ["", "wearing a coat", "", "", "", "", ""]),
    "vlm": pick("(p_partkey * 23) % 5", ["", "a man in a dark jacket", "a person", "", ""]),
    "h": "(p_partkey * 29) % 181",
    "s": "(p_partkey * 31) % 256",
    "v": "(p_partkey * 41) % 256",
    "dress": "(p_partkey * 3) % 120",
    "skirt": "(p_partkey * 7) % 120",
    "pants": "(p_partkey * 11) % 120",
}

#: Name of a view: its table, its columns in steps that may use those of the step before, and what makes rows one.
VIEWS = {"obj": ("lineitem", [DRIVING], _ONE), "acts": ("events", [ACTS], None), "people": ("part", [PEOPLE], None), "qa": ("events", [QUESTIONS, _ANSWERS, _RIGHT], None)}


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, steps, one = VIEWS[name]
    got = table(spark, sf_dir, source).selectExpr(*[f"{e} AS {a}" for a, e in steps[0].items()], *([f"{one} AS r"] if one else []))
    for step in steps[1:]:
        got = got.selectExpr("*", *[f"{e} AS {a}" for a, e in step.items()])
    return got.where("r = 1").drop("r") if one else got


def cte(name: str) -> str:
    source, steps, one = VIEWS[name]
    sql = f"SELECT {', '.join(f'{e} AS {a}' for a, e in steps[0].items())}{f', {one} AS r' if one else ''} FROM {source}"
    for step in steps[1:]:
        sql = f"SELECT *, {', '.join(f'{e} AS {a}' for a, e in step.items())} FROM ({sql})"
    return f"{name} AS (SELECT * EXCLUDE (r) FROM ({sql}) WHERE r = 1)" if one else f"{name} AS ({sql})"
