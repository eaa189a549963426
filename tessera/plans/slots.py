"""Queries over the events of slots: entities, duplicates, candidates and the questions made of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import wording as w
from tessera.functions.dialect import DUCK, SPARK
from tessera.operators import selection, slots, sweeps
from tessera.operators.intervals import band_join
from tessera.sources.views import cte, rows

from .catalogue import query

ACTS = cte("acts")
_X, _Y = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id * 7) % 12 END", "(event_id * 11) % 12"
PLACED = f"{ACTS}, pl AS (SELECT *, {_X} AS x, {_Y} AS y FROM acts)"
ENT = f"""{ACTS}, ent AS (SELECT slot, camera, actor, arg_min(activity, (start_ms, event_id)) AS "primary", arg_min(described, (start_ms, event_id)) AS described, arg_min(description, (start_ms, event_id)) AS description, count(*) AS n_events,
 min(start_ms) AS first_ms, max(end_ms) AS last_ms, CASE WHEN bool_and(activity LIKE 'vehicle_%') THEN 'vehicle' ELSE 'person' END AS kind FROM acts GROUP BY slot, camera, actor)"""


def acts(spark, sf_dir):
    return rows(spark, sf_dir, "acts")


def placed(spark, sf_dir):
    return acts(spark, sf_dir).selectExpr("*", f"{_X} AS x", f"{_Y} AS y")


@query(f"WITH {ACTS}, ty AS (SELECT DISTINCT camera, actor, CASE WHEN actor % 6 = 0 THEN 'vehicle' ELSE 'person' END AS kind FROM acts WHERE actor % 7 <> 0) SELECT event_id, a.actor, coalesce(kind, 'unknown') AS kind FROM acts a LEFT JOIN ty ON ty.camera = a.camera AND ty.actor = a.actor")
def j01_actor_types(spark, sf_dir):
    """Each event's actor with its type; every seventh actor has none."""
    a = acts(spark, sf_dir)
    ty = a.where("actor % 7 <> 0").select("camera", "actor", F.expr("case when actor % 6 = 0 then 'vehicle' else 'person' end").alias("t")).distinct()
    return a.join(ty, ["camera", "actor"], "left").select("event_id", "actor", F.coalesce("t", F.lit("unknown")).alias("kind"))


@query(f"""WITH {ENT} SELECT event_id, a.camera || '_actor_' || a.actor AS entity_id, e."primary" AS primary_activity, kind, a.event_id IS NOT NULL AND e.n_events > 1 AS again FROM acts a JOIN ent e ON e.slot = a.slot AND e.camera = a.camera AND e.actor = a.actor""")
def j02_event_entities(spark, sf_dir):
    a, e = acts(spark, sf_dir), slots.entities(acts(spark, sf_dir))
    return a.select("slot", "camera", "actor", "event_id").join(e, ["slot", "camera", "actor"]).select("event_id", F.concat_ws("_", "camera", F.lit("actor"), F.col("actor").cast("string")).alias("entity_id"), F.col("primary").alias("primary_activity"), "kind", (F.col("n_events") > 1).alias("again"))


@query(f"""WITH {ENT} SELECT slot, camera, actor, "primary" AS primary_activity, kind, n_events, kind = 'person' AND NOT {w.is_visual(DUCK, 'description')} AS fallback FROM ent""")
def w11_entities(spark, sf_dir):
    """Entities with their first activity, type by their activities (F6), and whether they lack a visual description."""
    e = slots.entities(acts(spark, sf_dir))
    return e.select("slot", "camera", "actor", F.col("primary").alias("primary_activity"), "kind", "n_events", F.expr(f"kind = 'person' and not {w.is_visual(SPARK, 'description')}").alias("fallback"))


@query(f"""WITH {PLACED.replace("pl AS (SELECT *,", "pl AS (SELECT * REPLACE (split_part(activity, '_', 1) AS activity),")} SELECT a.event_id AS a_event_id, b.event_id AS b_event_id FROM pl a JOIN pl b ON a.slot = b.slot AND a.activity = b.activity AND a.camera <> b.camera AND b.start_ms - a.start_ms BETWEEN 0 AND 8000 AND (b.start_ms > a.start_ms OR b.event_id > a.event_id)
 WHERE (a.camera IN ('G300', 'G301') AND b.camera IN ('G300', 'G301')) OR coalesce((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 25, b.start_ms - a.start_ms <= 3000)""")
def j08_same_events(spark, sf_dir):
    """Pairs of events of one kind of actor that are one, by overlapping views, place and time."""
    return slots.duplicates(placed(spark, sf_dir).withColumn("activity", F.split_part("activity", F.lit("_"), F.lit(1))))


@query()
def g02_event_clusters(spark, sf_dir):
    return slots.same_events(acts(spark, sf_dir))


@query()
def a02_dedup_counts(spark, sf_dir):
    """How often each activity of a slot happened, events of two cameras that are one counted once, with the range guard (F12), score
    (T3), difficulty and question (Q5)."""
    a = acts(spark, sf_dir)
    n = slots.same_events(a).groupBy("slot", "activity").agg(F.count_distinct("cluster").alias("n"), F.count("*").alias("n_raw"))
    cams = a.groupBy("slot", "activity").agg(F.count_distinct("camera").alias("n_cameras"))
    got = n.join(cams, ["slot", "activity"]).where("n between 2 and 20")
    score = F.expr("case when n between 3 and 10 then 30 when n < 3 then 15 else 5 end + case when n_cameras >= 2 then 20 else 0 end + 5")
    text = F.expr(f"'How many times does someone perform the action of ' || {slots.question_gerund('activity')} || ' across all cameras in this slot?'")
    return got.select("slot", "activity", "n", (F.col("n_raw") - F.col("n")).alias("n_removed"), score.alias("score_tenths"), F.expr("case when n <= 5 and n_cameras <= 3 then 'easy' else 'medium' end").alias("difficulty"), text.alias("question"))


_Q5 = f"""{ACTS}, cn AS (SELECT slot, activity, camera, count(*) AS n FROM acts GROUP BY ALL), tot AS (SELECT slot, activity, CAST(sum(n) AS BIGINT) AS n, count(*) AS m, array_to_string(list(camera || ': ' || n ORDER BY camera), ', ') AS parts, min(camera) AS one FROM cn GROUP BY slot, activity)"""
_REASON = lambda d: f"'The action of ' || {w.phrase(d, 'activity')} || ' was observed ' || n || ' time' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' across ' || m || ' camera' || CASE WHEN m = 1 THEN '' ELSE 's' END || ' (' || CASE WHEN m = 1 THEN 'all on camera ' || one ELSE parts END || ').'"


@query(f"WITH {_Q5} SELECT slot, activity, n, {_REASON(DUCK)} AS reasoning FROM tot WHERE n BETWEEN 2 AND 20")
def q05_count_reasoning(spark, sf_dir):
    per = acts(spark, sf_dir).groupBy("slot", "activity", "camera").agg(F.count("*").alias("n"))
    tot = per.groupBy("slot", "activity").agg(F.sum("n").alias("n"), F.count("*").alias("m"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("camera", "n"))), lambda x: F.concat(x["camera"], F.lit(": "), x["n"].cast("string"))), ", ").alias("parts"), F.min("camera").alias("one"))
    return tot.where("n between 2 and 20").selectExpr("slot", "activity", "n", f"{_REASON(SPARK)} AS reasoning")


_POOL = "[v FOR v IN list_distinct([n - 2, n - 1, n + 1, n + 2, n * 2]) IF v > 0 AND v <> n]"


@query(f"""WITH {ACTS}, c AS (SELECT slot, activity, count(*) AS n FROM acts GROUP BY ALL HAVING count(*) BETWEEN 2 AND 20), o AS (SELECT c.*, v FROM c, unnest({_POOL}) AS u(v)),
 k AS (SELECT *, row_number() OVER (PARTITION BY slot, activity ORDER BY md5('42::' || slot || '::' || activity || '::' || v), v) AS r FROM o), s AS (SELECT slot, activity, n, list_sort(list_append(list(v), n)) AS x FROM k WHERE r <= 3 GROUP BY slot, activity, n)
 SELECT slot, activity, n, array_to_string(x, ',') AS options, list_position(x, n) - 1 AS answer_index FROM s""")
def q04_counting_options(spark, sf_dir):
    """The count among three of its neighbours and its double, by hash, in ascending order."""
    c = acts(spark, sf_dir).groupBy("slot", "activity").agg(F.count("*").alias("n")).where("n between 2 and 20")
    pool = F.expr("filter(array_distinct(array(n - 2, n - 1, n + 1, n + 2, n * 2)), v -> v > 0 and v <> n)")
    ranked = F.array_sort(F.transform(pool, lambda v: F.struct(F.md5(F.concat_ws("::", F.lit("42"), "slot", "activity", v.cast("string"))).alias("h"), v.alias("v"))))
    x = F.array_sort(F.concat(F.transform(F.slice(ranked, 1, 3), lambda s: s["v"]), F.array("n")))
    return c.withColumn("x", x).select("slot", "activity", "n", F.array_join(F.col("x").cast("array<string>"), ",").alias("options"), (F.array_position("x", F.col("n")) - 1).cast("int").alias("answer_index"))


_SCENE = f"""{ACTS}, per AS (SELECT slot, activity, count(*) AS n, min((start_ms, event_id)) AS f, count(DISTINCT camera) AS m FROM acts GROUP BY ALL), cam AS (SELECT slot, camera, count(*) AS n, min((start_ms, event_id)) AS f FROM acts GROUP BY ALL),
 s AS (SELECT slot, count(*) AS n_events, count(DISTINCT camera) AS n_cameras, count(*) FILTER (activity LIKE 'person_%') AS persons, count(*) FILTER (activity LIKE 'vehicle_%') AS vehicles FROM acts GROUP BY slot HAVING count(*) >= 5),
 top AS (SELECT slot, arg_min(activity, (-n, f)) AS top FROM per GROUP BY slot), busy AS (SELECT slot, arg_min(camera, (-n, f)) AS busiest, max(n) AS busiest_n FROM cam GROUP BY slot), crs AS (SELECT slot, count(*) FILTER (m >= 2) AS cross_camera FROM per GROUP BY slot)"""
_KIND = "CASE WHEN persons > vehicles * 2 THEN 'pedestrian-dominant' WHEN vehicles > persons * 2 THEN 'vehicle-dominant' ELSE 'mixed activity' END"
_RIGHT = lambda d: f"'A ' || {_KIND} || ' scene across ' || n_cameras || CASE WHEN n_cameras = 1 THEN ' camera' ELSE ' cameras' END || ', primarily featuring ' || lower({w.gerund_phrase(d, 'top')})"
_WRONG = "CASE WHEN persons > vehicles * 2 THEN 'A vehicle-focused scene with mostly parking and driving activity' ELSE 'A scene dominated by people entering and exiting buildings' END || '|' || 'An empty scene with minimal activity, captured on ' || greatest(1, n_cameras - 3) || CASE WHEN n_cameras <= 4 THEN ' camera' ELSE ' cameras' END || '|A single-camera scene showing only indoor activities'"


@query(f"WITH {_SCENE} SELECT s.slot, {_KIND} AS scene_type, {_RIGHT(DUCK)} AS answer, {_WRONG} AS others, busiest, busiest_n, cross_camera FROM s JOIN top ON top.slot = s.slot JOIN busy ON busy.slot = s.slot JOIN crs ON crs.slot = s.slot")
def q06_scene_questions(spark, sf_dir):
    """What kind of scene a slot is, in words, with wrong descriptions; its busiest camera and activities of two cameras (A1)."""
    a = acts(spark, sf_dir)
    first = F.min(F.struct("start_ms", "event_id")).alias("f")
    per = a.groupBy("slot", "activity").agg(F.count("*").alias("n"), first, F.count_distinct("camera").alias("m"))
    cam = a.groupBy("slot", "camera").agg(F.count("*").alias("n"), first)
    s = a.groupBy("slot").agg(F.count("*").alias("n_events"), F.count_distinct("camera").alias("n_cameras"), F.count_if(F.expr("activity like 'person_%'")).alias("persons"), F.count_if(F.expr("activity like 'vehicle_%'")).alias("vehicles")).where("n_events >= 5")
    most = lambda c: F.min_by(c, F.struct(-F.col("n"), "f"))
    top = per.groupBy("slot").agg(most("activity").alias("top"), F.count_if(F.expr("m >= 2")).alias("cross_camera"))
    busy = cam.groupBy("slot").agg(most("camera").alias("busiest"), F.max("n").alias("busiest_n"))
    return s.join(top, "slot").join(busy, "slot").selectExpr("slot", f"{_KIND} AS scene_type", f"{_RIGHT(SPARK)} AS answer", f"{_WRONG} AS others", "busiest", "busiest_n", "cross_camera")


_ENTER = f"""{ACTS}, en AS (SELECT slot, actor, camera, min(start_ms) AS t FROM acts WHERE activity IN ('person_enters_scene_through_structure', 'person_exits_vehicle') GROUP BY ALL), g AS (SELECT slot, actor, arg_min(camera, (t, camera)) AS first_camera, arg_max(camera, (t, camera)) AS last_camera, min(t) AS t0, max(t) AS t1, count(*) AS n, list(camera ORDER BY t, camera) AS cams FROM en GROUP BY ALL),
 al AS (SELECT slot, list_sort(list(DISTINCT camera)) AS cameras FROM acts GROUP BY slot)"""
_PICKED = "list_transform(list_sort([{{'h': md5('42::' || g.slot || '::' || g.actor || '::' || c), 'c': c}} FOR c IN {src} IF c <> first_camera]), lambda v: v.c)"


@query(f"""WITH {_ENTER}, d AS (SELECT g.slot, g.actor, first_camera, last_camera, t0, t1, n, {_PICKED.format(src='cams')} AS ec, {_PICKED.format(src='list_filter(cameras, lambda c: NOT list_contains(cams, c))')} AS oc FROM g JOIN al ON al.slot = g.slot)
 SELECT slot, actor, first_camera AS answer, array_to_string(list_concat(ec[1:2], oc[1:2])[1:3], ',') AS others, CASE WHEN n >= 3 THEN 'medium' ELSE 'easy' END AS difficulty, CASE WHEN n >= 2 AND t1 - t0 >= 2000 THEN last_camera END AS last_answer FROM d""")
def q07_entrance_questions(spark, sf_dir):
    """Which camera first captures an actor's entrance (J28), against cameras that capture it later and others; and which captures it
    last, if that is two seconds later."""
    a = acts(spark, sf_dir)
    e = a.where("activity in ('person_enters_scene_through_structure', 'person_exits_vehicle')").groupBy("slot", "actor", "camera").agg(F.min("start_ms").alias("t"))
    g = e.groupBy("slot", "actor").agg(F.min_by("camera", F.struct("t", "camera")).alias("first_camera"), F.max_by("camera", F.struct("t", "camera")).alias("last_camera"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"), F.collect_list("camera").alias("cams"))
    al = a.groupBy("slot").agg(F.collect_set("camera").alias("cameras"))
    by_hash = lambda cs: F.transform(F.array_sort(F.transform(cs, lambda c: F.struct(F.md5(F.concat_ws("::", F.lit("42"), "slot", F.col("actor").cast("string"), c)).alias("h"), c.alias("c")))), lambda v: v["c"])
    d = g.join(al, "slot").withColumns({"ec": by_hash(F.array_except("cams", F.array("first_camera"))), "oc": by_hash(F.array_except(F.array_except("cameras", "cams"), F.array("first_camera")))})
    others = F.slice(F.concat(F.slice("ec", 1, 2), F.slice("oc", 1, 2)), 1, 3)
    return d.select("slot", "actor", F.col("first_camera").alias("answer"), F.array_join(others, ",").alias("others"), F.expr("case when n >= 3 then 'medium' else 'easy' end").alias("difficulty"), F.when(F.expr("n >= 2 and t1 - t0 >= 2000"), F.col("last_camera")).alias("last_answer"))


_GROUPS = {"person": "person_opens_trunk person_closes_trunk person_opens_vehicle_door person_enters_vehicle person_sits_down person_stands_up person_reads_document person_purchases".split(), "vehicle": "vehicle_starts vehicle_stops vehicle_turns_left vehicle_turns_right vehicle_makes_u_turn".split()}
_POOLS = ", ".join(f"('{k}', '{v}')" for k, vs in _GROUPS.items() for v in vs)


@query(f"""WITH {ACTS}, here AS (SELECT DISTINCT slot, activity FROM acts), pool(kind, activity) AS (VALUES {_POOLS}), c AS (SELECT h.slot, h.activity, p.activity AS other, NOT EXISTS (SELECT 1 FROM here x WHERE x.slot = h.slot AND x.activity = p.activity) AS far FROM here h JOIN pool p ON p.kind = split_part(h.activity, '_', 1) AND p.activity <> h.activity),
 k AS (SELECT *, row_number() OVER (PARTITION BY slot, activity ORDER BY far, md5('42::' || slot || '::' || activity || '::' || other)) AS r FROM c) SELECT slot, activity, array_to_string(list(other ORDER BY r), ',') AS distractors FROM k WHERE r <= 3 GROUP BY slot, activity""")
def q09_activity_distractors(spark, sf_dir):
    """Three other activities of the same type, those of the slot first."""
    here = acts(spark, sf_dir).select("slot", "activity").distinct()
    pool = F.create_map(*[x for k, vs in _GROUPS.items() for x in (F.lit(k), F.array(*map(F.lit, vs)))])
    near = here.groupBy("slot").agg(F.collect_set("activity").alias("near"))
    c = here.join(near, "slot").withColumn("pool", F.array_except(pool[F.split_part("activity", F.lit("_"), F.lit(1))], F.array("activity")))
    ranked = F.array_sort(F.transform("pool", lambda o: F.struct((~F.array_contains("near", o)).alias("far"), F.md5(F.concat_ws("::", F.lit("42"), "slot", "activity", o)).alias("h"), o.alias("o"))))
    return c.select("slot", "activity", F.array_join(F.transform(F.slice(ranked, 1, 3), lambda v: v["o"]), ",").alias("distractors")).where("distractors <> ''")


_GATES = f"""{ACTS}, uq AS (SELECT slot, camera, activity, max(n) AS shared FROM (SELECT slot, camera, activity, CASE WHEN description IN ('a person', 'a vehicle', 'someone') THEN '' ELSE description END AS t, count(*) AS n FROM acts GROUP BY ALL) GROUP BY ALL),
 p AS (SELECT a.slot, a.event_id AS a_event_id, b.event_id AS b_event_id, a.activity AS a_activity, b.activity AS b_activity, b.start_ms - a.end_ms AS gap_ms, a.described AND b.described AS visual, a.description <> b.description AS differ, ua.shared <= 1 AND ub.shared <= 1 AS unique_, abs(CAST(substr(a.camera, 2) AS BIGINT) - CAST(substr(b.camera, 2) AS BIGINT)) AS apart
 FROM acts a JOIN acts b ON a.slot = b.slot AND a.camera <> b.camera AND b.start_ms - a.end_ms BETWEEN 1000 AND 60000 JOIN uq ua ON ua.slot = a.slot AND ua.camera = a.camera AND ua.activity = a.activity JOIN uq ub ON ub.slot = b.slot AND ub.camera = b.camera AND ub.activity = b.activity)"""
_SCORE = "CASE WHEN apart = 1 THEN 5 WHEN apart <= 3 THEN 30 ELSE 20 END + CASE WHEN a_activity <> b_activity THEN 10 ELSE 0 END"


@query(f"WITH {_GATES} SELECT slot, a_event_id, b_event_id, gap_ms, visual, unique_ AS is_unique, differ, visual AND unique_ AND differ AS passes, {_SCORE} AS score_tenths, {slots.connection('a_activity', 'b_activity')} AS connection FROM p")
def h04_pair_gates(spark, sf_dir):
    """Pairs of events on two cameras with the gates of a question (H4), the score of their cameras (here by number) and what relates
    them (H7)."""
    a = acts(spark, sf_dir)
    generic = F.when(F.col("description").isin("a person", "a vehicle", "someone"), "").otherwise(F.col("description"))
    uq = a.groupBy("slot", "camera", "activity", generic.alias("t")).agg(F.count("*").alias("n")).groupBy("slot", "camera", "activity").agg(F.max("n").alias("shared"))
    e = a.join(uq, ["slot", "camera", "activity"]).select("slot", "event_id", "camera", "activity", "start_ms", "end_ms", "described", "description", "shared", F.expr("cast(substr(camera, 2) as bigint)").alias("number"), *[F.expr(c).alias(n) for n, c in w.relation_bits("activity").items()])
    p = band_join(e, e, ["slot"], "end_ms", "start_ms", 1_000, 60_000).where("a_camera <> b_camera")
    p = p.withColumns({"visual": F.expr("a_described and b_described"), "is_unique": F.expr("a_shared <= 1 and b_shared <= 1"), "differ": F.expr("a_description <> b_description"), "apart": F.expr("abs(a_number - b_number)")})
    return p.select("slot", "a_event_id", "b_event_id", "gap_ms", "visual", "is_unique", "differ", F.expr("visual and is_unique and differ").alias("passes"), F.expr(_SCORE).alias("score_tenths"), F.expr(slots.connected(w.relation_of("a_", "b_"))).alias("connection"))


def _best_pairs(spark, sf_dir):
    """For each two activities of a slot the best pair (T1): a greedy choice without reuse of activities never takes another one, as
    each event has one activity."""
    p = h04_pair_gates(spark, sf_dir).where("passes")
    a = acts(spark, sf_dir).select("slot", "event_id", "activity")
    for s in "ab":
        p = p.join(a.select("slot", F.col("event_id").alias(f"{s}_event_id"), F.col("activity").alias(f"{s}_activity")), ["slot", f"{s}_event_id"])
    best = F.min(F.struct((-F.col("score_tenths")).alias("s"), "gap_ms", "a_event_id", "b_event_id")).alias("m")
    return p.groupBy("slot", "a_activity", "b_activity").agg(best).select("slot", "a_activity", "b_activity", "m.*")


_BEST = f"{_GATES}, bp AS (SELECT slot, a_activity, b_activity, a_event_id, b_event_id, gap_ms, {_SCORE} AS score FROM p WHERE visual AND unique_ AND differ QUALIFY row_number() OVER (PARTITION BY slot, a_activity, b_activity ORDER BY {_SCORE} DESC, gap_ms, a_event_id, b_event_id) = 1)"


@query(f"WITH {_BEST} SELECT slot, a_activity, b_activity, a_event_id, b_event_id, gap_ms, score AS score_tenths FROM bp")
def t01_best_pairs(spark, sf_dir):
    return _best_pairs(spark, sf_dir).select("slot", "a_activity", "b_activity", "a_event_id", "b_event_id", "gap_ms", (-F.col("s")).alias("score_tenths"))


@query()
def g03_selected_pairs(spark, sf_dir):
    """The pairs of each slot, best first, that reuse no activity and so no event.  A slot has one candidate for each two activities."""
    return selection.greedy(_best_pairs(spark, sf_dir), ["slot"], ["s", "gap_ms", "a_event_id", "b_event_id"], selection.no_reuse(("a_activity", "b_activity")))


_PL2 = PLACED + """, dup AS (SELECT a.event_id AS p, b.event_id AS q FROM pl a JOIN pl b ON a.slot = b.slot AND a.activity = b.activity AND a.camera <> b.camera AND b.start_ms - a.start_ms BETWEEN 0 AND 8000 AND (b.start_ms > a.start_ms OR b.event_id > a.event_id)
 WHERE (a.camera IN ('G300', 'G301') AND b.camera IN ('G300', 'G301')) OR coalesce((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 25, b.start_ms - a.start_ms <= 3000))"""


def _chain_sql(names: str) -> str:
    on = " ".join(f"JOIN pl {t} ON {t}.slot = {s}.slot AND {t}.start_ms - {s}.end_ms BETWEEN 2000 AND 60000" for s, t in zip(names, names[1:]))
    apart = " AND ".join(f"NOT EXISTS (SELECT 1 FROM dup WHERE dup.p = {s}.event_id AND dup.q = {t}.event_id)" for i, s in enumerate(names) for t in names[i + 1 :])
    many = lambda c: "len(list_distinct([" + ", ".join(f"{s}.{c}" for s in names) + "]))"
    related = " + ".join(f"CASE WHEN ({w.relation(f'{s}.activity', f'{t}.activity')}) IS NULL THEN 0 ELSE 3 END" for i, s in enumerate(names) for t in names[i + 1 :])
    shown = " + ".join(f"CASE WHEN {s}.described THEN 2 ELSE 0 END" for s in names)
    ids = "[" + ", ".join(f"{s}.event_id" for s in names) + "]"
    cams = "list_sort(list_distinct([" + ", ".join(f"{s}.camera" for s in names) + "]))"
    return f"SELECT a.slot, array_to_string({ids}, ',') AS events, array_to_string({cams}, ',') AS cameras, 4 * {many('camera')} + {related} + {shown} + {int(len(names) == 4)} AS score FROM pl a {on} WHERE {apart} AND {many('camera')} >= 2 AND {many('activity')} >= {len(names) - 1}"


@query(f"WITH {_PL2} {_chain_sql('abc')} UNION ALL {_chain_sql('abcd')}")
def g04_ordering_groups(spark, sf_dir):
    """Chains of three and four events that an ordering question may be made of, with their scores (GR4) in halves."""
    return sweeps.all_groups(placed(spark, sf_dir), 2_000, 60_000)


@query()
def g05_diverse_groups(spark, sf_dir):
    """Two chains of each slot, best first: with other cameras and no event in common, else the next best.  The best twelve chains of a
    slot are one group, found without making the others."""
    import pandas as pd

    some = sweeps.best_groups(placed(spark, sf_dir), 12, 2_000, 60_000)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        got, events, cams = [], set(), set()
        rows_ = frame.sort_values("rank").to_dict("records")
        for r in rows_:
            ids = set(r["events"].split(","))
            if len(got) < 2 and not ids & events and not (got and r["cameras"] in cams):
                got.append(r)
                events |= ids
                cams.add(r["cameras"])
        got += [r for r in rows_ if r not in got][: 2 - len(got)]
        return pd.DataFrame(got, columns=frame.columns)

    return some.groupBy("slot").applyInPandas(choose, some.schema)


@query()
def q02_ordering_questions(spark, sf_dir):
    """The chosen chains shown in hash order, with the right order and three wrong ones in Roman numerals, options in hash order."""
    import itertools

    import pandas as pd

    def wrong(right: list[int], seed: str) -> list[list[int]]:
        from hashlib import md5

        n, out = len(right), []
        swaps = [right[:i] + [right[i + 1], right[i]] + right[i + 2 :] for i in range(n - 1)]
        rest = sorted((list(p) for p in itertools.permutations(range(n))), key=lambda p: md5(f"{seed}{p}".encode()).hexdigest())
        for p in [right[::-1], *swaps, [right[-1], *right[1:-1], right[0]], right[1:] + right[:1], *rest]:
            if p != right and p not in out and len(out) < 3:
                out.append(p)
        return out

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        from hashlib import md5

        rows_ = []
        for r in frame.to_dict("records"):
            ids = r["events"].split(",")
            order = sorted(range(len(ids)), key=lambda i: md5(f"42::{ids[i]}".encode()).hexdigest())
            right = [order.index(k) for k in range(len(ids))]
            label = lambda p: " -> ".join(["I", "II", "III", "IV"][i] for i in p)
            options = sorted([label(p) for p in [right, *wrong(right, r["events"])]], key=lambda o: md5(f"42::{r['events']}::{o}".encode()).hexdigest())
            rows_.append((r["slot"], r["events"], ",".join(ids[i] for i in order), "|".join(options), options.index(label(right))))
        return pd.DataFrame(rows_, columns=["slot", "events", "shown", "options", "answer_index"])

    return g05_diverse_groups(spark, sf_dir).mapInPandas(lambda frames: map(ask, frames), "slot string, events string, shown string, options string, answer_index long")


@query(f"""WITH {ACTS}, s AS (SELECT slot, k AS seed, CAST(sum(CAST('0x' || substr(md5(CAST(k AS VARCHAR) || '::' || event_id), 1, 3) AS BIGINT) % 101) // count(*) AS BIGINT) AS score FROM acts, range(1, 6) t(k) GROUP BY slot, k) SELECT slot, arg_min(seed, CASE WHEN score >= 51 THEN (0, seed) ELSE (1, -score * 1000 + seed) END) AS seed, max(score) AS best FROM s GROUP BY slot""")
def g12_seed_choice(spark, sf_dir):
    """The first of five seeds whose result scores enough, else the best: all are scored at once (here by hash)."""
    each = acts(spark, sf_dir).select("slot", "event_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("seed"))
    point = F.conv(F.substring(F.md5(F.concat_ws("::", F.col("seed").cast("string"), F.col("event_id").cast("string"))), 1, 3), 16, 10).cast("long") % 101
    s = each.groupBy("slot", "seed").agg(F.sum(point).alias("t"), F.count("*").alias("n")).withColumn("score", F.expr("t div n"))
    rank = F.expr("case when score >= 51 then struct(0L as a, seed as b) else struct(1L as a, -score * 1000 + seed as b) end")
    return s.groupBy("slot").agg(F.min_by("seed", rank).alias("seed"), F.max("score").alias("best"))


@query(f"WITH {ACTS}, c AS (SELECT slot, count(DISTINCT camera) AS n FROM acts GROUP BY slot) SELECT count(*) AS n_slots, min(n) AS least, max(n) AS most, CAST(floor(sum(n) * 10.0 / count(*)) AS BIGINT) AS mean_tenths, count(*) FILTER (n >= 2) AS n_multi FROM c")
def h27_slot_statistics(spark, sf_dir):
    c = acts(spark, sf_dir).groupBy("slot").agg(F.count_distinct("camera").alias("n"))
    return c.agg(F.count("*").alias("n_slots"), F.min("n").alias("least"), F.max("n").alias("most"), F.floor(F.sum("n") * F.lit(10.0) / F.count("*")).alias("mean_tenths"), F.count_if(F.expr("n >= 2")).alias("n_multi"))


@query(f"WITH {ACTS}, s AS (SELECT DISTINCT slot, actor, camera FROM acts), p AS (SELECT slot, actor, count(*) AS n FROM s GROUP BY ALL) SELECT slot, actor, n, n >= 2 AS supported FROM p")
def j10_shared_persons(spark, sf_dir):
    """On how many cameras of a slot each person was seen, and whether that makes it a person of two cameras or more."""
    p = acts(spark, sf_dir).select("slot", "actor", "camera").distinct().groupBy("slot", "actor").agg(F.count("*").alias("n"))
    return p.withColumn("supported", F.col("n") >= 2)


@query(f"""WITH {ACTS}, lk AS (SELECT a.slot, a.actor, b.actor AS other, a.camera AS p, b.camera AS q, min(b.start_ms - a.end_ms) AS gap FROM acts a JOIN acts b ON a.slot = b.slot AND a.camera <> b.camera AND b.start_ms - a.end_ms BETWEEN 1000 AND 60000 GROUP BY ALL)
 SELECT slot, least(actor, other) AS u, greatest(actor, other) AS v, count(*) AS n, greatest(400, 1000 - CAST(floor(min(gap) / 60.0) AS BIGINT)) AS confidence FROM lk GROUP BY ALL""")
def gr05_undirected_links(spark, sf_dir):
    """Handoffs as undirected edges, one for each two actors of a slot, with the best confidence in thousandths."""
    l = sweeps.least_gaps(acts(spark, sf_dir), 1_000, 60_000)
    return l.select("slot", "u", "v", "n", F.greatest(F.lit(400).cast("long"), 1000 - F.floor(F.col("gap") / F.lit(60.0))).alias("confidence"))


@query(f"""WITH {ACTS}, ep AS (SELECT slot, actor, list_sort(list(DISTINCT activity)) AS acts FROM acts GROUP BY ALL) SELECT a.slot, a.actor AS a_actor, b.actor AS b_actor FROM ep a JOIN ep b ON a.slot = b.slot AND a.actor < b.actor AND len(list_intersect(a.acts, b.acts)) = 0
 QUALIFY row_number() OVER (PARTITION BY a.slot ORDER BY md5('42::' || a.slot || '::' || a.actor || '::' || b.actor), a.actor, b.actor) = 1""")
def j24_distinct_episodes(spark, sf_dir):
    """Two episodes of each slot (here actors) that share no action, by hash."""
    ep = acts(spark, sf_dir).groupBy("slot", "actor").agg(F.collect_set("activity").alias("acts"))
    return sweeps.least_disjoint_pairs(ep, "slot", "actor", "acts", "42").select("slot", F.col("a").alias("a_actor"), F.col("b").alias("b_actor"))
