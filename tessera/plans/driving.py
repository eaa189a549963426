"""Queries over driving scenes: relations of a frame, intervals of activities, and question contexts built from both."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import driving as d
from tessera.sources.views import cte, rows

from .catalogue import query

OBJ = cte("obj")
RELS = OBJ + f""", rels AS (SELECT a.scene, a.frame, a.obj AS src, b.obj AS tgt, {d.quadrant("(b.x - a.x)", "(b.y - a.y)")} AS dir,
 (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) AS d2 FROM obj a JOIN obj b ON a.scene = b.scene AND a.frame = b.frame AND a.obj < b.obj)"""
_EVT = """, n AS (SELECT *, CASE WHEN lag(activity) OVER w IS DISTINCT FROM activity OR frame - lag(frame) OVER w > 2 THEN 1 ELSE 0 END AS nw FROM obj WINDOW w AS (PARTITION BY scene, obj ORDER BY frame)),
 rn AS (SELECT *, sum(nw) OVER (PARTITION BY scene, obj ORDER BY frame) AS run FROM n),
 evt AS (SELECT scene, obj, min(cls) AS cls, min(activity) AS activity, arg_max(description, (length(description), -frame)) AS description, min(frame) AS f0, max(frame) AS f1 FROM rn GROUP BY scene, obj, run HAVING max(frame) - min(frame) > 2)"""
EVT, BOTH = OBJ + _EVT, RELS + _EVT


def _least(source: str, keys: str, parts: str, ties: str) -> str:
    """Rows of least hash for each key, in SQL."""
    h = "md5('42::' || " + " || '::' || ".join(f"CAST({p} AS VARCHAR)" for p in [*keys.split(", "), *parts.split(", ")]) + ")"
    return f"(SELECT * EXCLUDE (hr) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {h}, {ties}) AS hr FROM {source}) WHERE hr = 1)"


_STATE = ", st AS " + _least("rels", "scene", "frame, src, tgt", "frame")
_ANN = ", ann AS (SELECT scene, obj, arg_min(activity, frame) AS activity, arg_min(description, frame) AS description, arg_min(cls, frame) AS cls FROM obj GROUP BY scene, obj HAVING obj % 3 <> 0)"


def _ground(cls: str, t: str) -> str:
    """Grounded description in SQL, of a class and a (left-joined) annotation."""
    a, e = f"coalesce({t}.activity, '')", f"coalesce({t}.description, '')"
    return f"('the ' || split({cls}, '.')[-1] || CASE WHEN {e} <> '' AND {a} <> '' THEN ' (' || {e} || ', ' || {a} || ')' WHEN {e} <> '' THEN ' (' || {e} || ')' WHEN {a} <> '' THEN ' (' || {a} || ')' ELSE '' END)"


def objects(spark, sf_dir):
    return rows(spark, sf_dir, "obj")


def annotations(obj):
    """One annotation for each instance; every third instance has none."""
    first = lambda c: F.min_by(c, "frame").alias(c)
    return obj.where("obj % 3 <> 0").groupBy("scene", "obj").agg(first("activity"), first("description"), first("cls"))


def parts(spark, sf_dir):
    obj = objects(spark, sf_dir)
    return obj, d.frame_relations(obj), d.activity_intervals(obj)


def described(df, obj, who: str, at: str, out: str):
    """df with the grounded description of an object at a frame, of class unknown where it is not in that frame."""
    cls = obj.select("scene", F.col("frame").alias(at), F.col("obj").alias(who), F.col("cls").alias("__c"))
    ann = annotations(obj).select("scene", F.col("obj").alias(who), F.col("activity").alias("__a"), F.col("description").alias("__d"))
    got = df.join(cls, ["scene", at, who], "left").join(ann, ["scene", who], "left")
    return got.withColumn(out, d.grounded(F.coalesce("__c", F.lit("unknown")), F.coalesce("__d", F.lit("")), F.coalesce("__a", F.lit("")))).drop("__c", "__a", "__d")


def named(events, obj, prefix: str, out: str):
    """events with the grounded description of their object, by the event's class."""
    ann = annotations(obj).select("scene", F.col("obj").alias(f"{prefix}obj"), F.col("activity").alias("__a"), F.col("description").alias("__d"))
    got = events.join(ann, ["scene", f"{prefix}obj"], "left")
    return got.withColumn(out, d.grounded(F.col(f"{prefix}cls"), F.coalesce("__d", F.lit("")), F.coalesce("__a", F.lit("")))).drop("__a", "__d")


@query(f"WITH {RELS} SELECT scene, frame, src, tgt, dir, CAST(floor(sqrt(d2) * 100) AS BIGINT) AS dist_cm, d2 < 100 AS near FROM rels")
def j13_frame_pairs(spark, sf_dir):
    r = d.frame_relations(objects(spark, sf_dir))
    return r.select("scene", "frame", "src", "tgt", "dir", F.floor(F.sqrt("d2") * 100).alias("dist_cm"), (F.col("d2") < d.NEAR**2).alias("near"))


@query(f"""WITH {OBJ} SELECT o.scene, o.frame, o.obj AS src, o.obj + 1 AS tgt, o.cls AS src_class, coalesce(t.cls, 'unknown') AS tgt_class
 FROM obj o LEFT JOIN obj t ON t.scene = o.scene AND t.frame = o.frame AND t.obj = o.obj + 1""")
def j14_relation_classes(spark, sf_dir):
    """A relation of each object with the next by number, whose class is unknown where it is not in the frame."""
    o = objects(spark, sf_dir).select("scene", "frame", "obj", "cls")
    t = o.select("scene", "frame", (F.col("obj") - 1).alias("obj"), F.col("cls").alias("tgt_class"))
    return o.join(t, ["scene", "frame", "obj"], "left").select("scene", "frame", F.col("obj").alias("src"), (F.col("obj") + 1).alias("tgt"), F.col("cls").alias("src_class"), F.coalesce("tgt_class", F.lit("unknown")).alias("tgt_class"))


@query(f"""WITH {OBJ}{_ANN} SELECT o.scene, o.frame, o.obj, coalesce(a.activity, 'moving') AS activity, coalesce(a.description, '') AS description, {_ground("o.cls", "a")} AS grounded
 FROM obj o LEFT JOIN ann a ON a.scene = o.scene AND a.obj = o.obj""")
def j15_annotated_objects(spark, sf_dir):
    o = objects(spark, sf_dir)
    a = annotations(o).select("scene", "obj", F.col("activity").alias("a"), F.col("description").alias("e"))
    got = o.select("scene", "frame", "obj", "cls").join(a, ["scene", "obj"], "left")
    text = d.grounded(F.col("cls"), F.coalesce("e", F.lit("")), F.coalesce("a", F.lit("")))
    return got.select("scene", "frame", "obj", F.coalesce("a", F.lit("moving")).alias("activity"), F.coalesce("e", F.lit("")).alias("description"), text.alias("grounded"))


@query(f"WITH {EVT} SELECT scene, obj, cls, activity, description, f0 AS first_frame, f1 AS last_frame FROM evt")
def w01_activity_intervals(spark, sf_dir):
    e = d.activity_intervals(objects(spark, sf_dir))
    return e.withColumnsRenamed({"first": "first_frame", "last": "last_frame"})


@query(f"""WITH {BOTH}{_STATE} SELECT st.scene, st.frame, src, tgt, dir, e.obj, e.activity, e.f0 AS first_frame, e.f1 AS last_frame, CASE WHEN e.f0 > st.frame + 5 THEN 'After' ELSE 'Before' END AS marker
 FROM st JOIN evt e ON e.scene = st.scene AND e.obj <> src AND e.obj <> tgt AND (e.f0 > st.frame + 5 OR e.f1 < st.frame - 5)""")
def j18_adjacent_events(spark, sf_dir):
    _, r, e = parts(spark, sf_dir)
    got = d.adjacent_events(d.states(r), e)
    return got.select("scene", "frame", "src", "tgt", "dir", F.col("e_obj").alias("obj"), F.col("e_activity").alias("activity"), F.col("e_first").alias("first_frame"), F.col("e_last").alias("last_frame"), "marker")


_FAR = "(SELECT r.*, st.frame AS s_frame, st.src AS s_src, st.tgt AS s_tgt, st.dir AS s_dir, 'second' AS tag FROM rels r JOIN st ON r.scene = st.scene AND abs(r.frame - st.frame) > 10)"
_TWO = (
    _STATE
    + ", two AS (SELECT scene, "
    + ", ".join(f"CASE WHEN s_frame < frame THEN s_{c} ELSE {c} END AS p_{c}, CASE WHEN s_frame < frame THEN {c} ELSE s_{c} END AS q_{c}" for c in ("frame", "src", "tgt", "dir"))
    + " FROM "
    + _least(_FAR, "scene", "tag, frame, src, tgt", "frame")
    + ")"
)


@query(f"""WITH {BOTH}{_TWO} SELECT two.scene, p_frame, p_dir, q_frame, q_dir, e.obj, e.activity, e.f0 AS first_frame, e.f1 AS last_frame
 FROM two JOIN evt e ON e.scene = two.scene AND e.f0 >= p_frame + 5 AND e.f1 <= q_frame - 5 AND p_frame + 5 < q_frame - 5""")
def j19_between_states(spark, sf_dir):
    _, r, e = parts(spark, sf_dir)
    got = d.between_events(d.second_states(r, d.states(r)), e)
    return got.select("scene", "p_frame", "p_dir", "q_frame", "q_dir", F.col("e_obj").alias("obj"), F.col("e_activity").alias("activity"), F.col("e_first").alias("first_frame"), F.col("e_last").alias("last_frame"))


_SNAPS = "(VALUES (0, 0), (1, -3), (2, -2), (3, -1), (4, 1), (5, 2), (6, 3)) AS k(i, o)"
_FR = ", fr AS (SELECT DISTINCT scene, frame FROM obj)"
_SNAP = f"(SELECT min((i, fr.frame)) FROM {_SNAPS}, fr WHERE fr.scene = {{t}}.scene AND fr.frame = {{w}} + k.o)"


@query(f"""WITH {BOTH}{_FR}, w AS (SELECT scene, obj, f0, f1, side, CASE WHEN side = 'before' THEN greatest(0, f0 - 5) ELSE f1 + 5 END AS wanted FROM evt, (VALUES ('before'), ('after')) AS s(side)),
 t AS (SELECT w.*, i, fr.frame FROM w, {_SNAPS}, fr WHERE fr.scene = w.scene AND fr.frame = wanted + k.o),
 b AS (SELECT * EXCLUDE (i, tr) FROM (SELECT *, row_number() OVER (PARTITION BY scene, obj, f0, f1, side ORDER BY i) AS tr FROM t) WHERE tr = 1)
 SELECT b.scene, b.obj, b.f0 AS first_frame, b.f1 AS last_frame, side, b.frame, src, tgt, dir FROM b JOIN rels ON rels.scene = b.scene AND rels.frame = b.frame""")
def j20_event_snapshots(spark, sf_dir):
    """Relations in the frame that stands for the one BUFFER frames before each event begins, or after it ends."""
    o, r, e = parts(spark, sf_dir)
    sides = F.array(F.struct(F.lit("before").alias("side"), F.greatest(F.lit(0), F.col("first") - d.BUFFER).alias("wanted")), F.struct(F.lit("after").alias("side"), (F.col("last") + d.BUFFER).alias("wanted")))
    w = e.select("scene", "obj", F.col("first").alias("first_frame"), F.col("last").alias("last_frame"), F.inline(sides))
    got = d.snapped(w, o, "wanted", "frame").join(r, ["scene", "frame"])
    return got.select("scene", "obj", "first_frame", "last_frame", "side", "frame", "src", "tgt", "dir")


@query(f"""WITH {BOTH} SELECT a.scene, a.obj AS a_obj, a.f1 AS a_last, b.obj AS b_obj, b.f0 AS b_first, r.frame, src, tgt, dir FROM evt a JOIN evt b ON a.scene = b.scene AND a.f1 + 10 < b.f0
 JOIN rels r ON r.scene = a.scene AND r.frame BETWEEN a.f1 + 5 AND b.f0 - 5 AND src NOT IN (a.obj, b.obj) AND tgt NOT IN (a.obj, b.obj)""")
def j21_gap_relations(spark, sf_dir):
    _, r, e = parts(spark, sf_dir)
    return d.gap_relations(e, r).select("scene", "a_obj", "a_last", "b_obj", "b_first", "frame", "src", "tgt", "dir")


_CHANGES = f"""{_FR}, c1 AS (SELECT evt.*, fr.frame AS pre_frame, i FROM evt, {_SNAPS}, fr WHERE fr.scene = evt.scene AND fr.frame = greatest(0, f0 - 5) + k.o),
 c2 AS (SELECT * EXCLUDE (i, tr) FROM (SELECT *, row_number() OVER (PARTITION BY scene, obj, f0 ORDER BY i) AS tr FROM c1) WHERE tr = 1),
 c3 AS (SELECT c2.*, fr.frame AS post_frame, i FROM c2, {_SNAPS}, fr WHERE fr.scene = c2.scene AND fr.frame = f1 + 5 + k.o),
 c4 AS (SELECT * EXCLUDE (i, tr) FROM (SELECT *, row_number() OVER (PARTITION BY scene, obj, f0 ORDER BY i) AS tr FROM c3) WHERE tr = 1),
 ch AS (SELECT c4.*, p.src, p.tgt, p.dir AS pre, q.dir AS post FROM c4 JOIN rels p ON p.scene = c4.scene AND p.frame = pre_frame JOIN rels q ON q.scene = c4.scene AND q.frame = post_frame AND q.src = p.src AND q.tgt = p.tgt AND q.dir <> p.dir)"""


@query(f"WITH {BOTH}{_CHANGES} SELECT scene, obj, f0 AS first_frame, f1 AS last_frame, pre_frame, post_frame, src, tgt, pre, post FROM ch")
def j22_event_changes(spark, sf_dir):
    o, r, e = parts(spark, sf_dir)
    got = d.changes(e, r, o)
    return got.select("scene", "obj", F.col("first").alias("first_frame"), F.col("last").alias("last_frame"), "pre_frame", "post_frame", "src", "tgt", "pre", "post")


_ABSENT = ", ids AS (SELECT DISTINCT scene, obj FROM obj), ab AS (SELECT st.scene, st.frame, ids.obj FROM st JOIN ids ON ids.scene = st.scene WHERE NOT EXISTS (SELECT 1 FROM obj o WHERE o.scene = st.scene AND o.frame = st.frame AND o.obj = ids.obj))"


@query(f"WITH {RELS}{_STATE}{_ABSENT} SELECT * FROM ab")
def j23_absent_objects(spark, sf_dir):
    """Objects of a scene that are not in the frame of its chosen state."""
    o, r, _ = parts(spark, sf_dir)
    ids = o.select("scene", "obj").distinct()
    return d.states(r).select("scene", "frame").join(ids, "scene").join(o.select("scene", "frame", "obj"), ["scene", "frame", "obj"], "left_anti")


@query(f"""WITH {OBJ} SELECT a.scene, a.frame, a.obj, b.obj AS other, {d.local_direction("(b.x - a.x)", "(b.y - a.y)", "a.heading")} AS direction,
 CAST(floor(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) * 10) AS BIGINT) AS dist_dm FROM obj a JOIN obj b ON a.scene = b.scene AND a.frame = b.frame AND a.obj <> b.obj
 WHERE (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) BETWEEN 1 AND 400""")
def geo12_local_frame(spark, sf_dir):
    """Objects within 20 m as an object of the frame sees them along its heading."""
    keys, some = ["scene", "frame"], objects(spark, sf_dir).select("scene", "frame", "obj", "x", "y", "heading")
    p = d.prefixed(some, "a_", keys).join(d.prefixed(some, "b_", keys), keys).where("a_obj <> b_obj").withColumns({"dx": F.expr("b_x - a_x"), "dy": F.expr("b_y - a_y")}).where("dx * dx + dy * dy between 1 and 400")
    return p.select("scene", "frame", F.col("a_obj").alias("obj"), F.col("b_obj").alias("other"), F.expr(d.local_direction("dx", "dy", "a_heading")).alias("direction"), F.expr("floor(sqrt(dx * dx + dy * dy) * 10)").alias("dist_dm"))


_NEARER = """, nf AS (SELECT scene, frame, src, list(struct_pack(d := sqrt(d2), tgt := tgt) ORDER BY sqrt(d2), tgt) AS t FROM rels GROUP BY ALL HAVING count(*) >= 2),
 nq AS (SELECT scene, frame, src, t[1].tgt AS nearer, coalesce(list_filter(t, lambda v: v.d - t[1].d >= 2.0)[1].tgt, t[2].tgt) AS farther FROM nf)"""


@query(f"WITH {RELS}{_NEARER} SELECT * FROM nq")
def geo16_nearer_farther(spark, sf_dir):
    return d.nearer_farther(d.frame_relations(objects(spark, sf_dir)))


@query(f"WITH {OBJ} SELECT scene, cls, count(DISTINCT obj) AS n_objects, count(DISTINCT frame) AS n_frames FROM obj GROUP BY ALL")
def a04_class_objects(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("scene", "cls").agg(F.count_distinct("obj").alias("n_objects"), F.count_distinct("frame").alias("n_frames"))


@query(f"""WITH {OBJ} SELECT scene, obj, CAST(floor(sum(x) * 100.0 / count(*)) AS BIGINT) AS x_cm, CAST(floor(sum(y) * 100.0 / count(*)) AS BIGINT) AS y_cm, count(*) AS frames_seen,
 array_to_string(list_sort(list(DISTINCT visibility)), ',') AS cameras FROM obj GROUP BY ALL""")
def a05_object_positions(spark, sf_dir):
    mean = lambda c: F.floor(F.sum(c) * F.lit(100.0) / F.count("*"))
    return objects(spark, sf_dir).groupBy("scene", "obj").agg(mean("x").alias("x_cm"), mean("y").alias("y_cm"), F.count("*").alias("frames_seen"), F.array_join(F.array_sort(F.collect_set("visibility")).cast("array<string>"), ",").alias("cameras"))


_PER = ", pc AS (SELECT scene, cls, count(DISTINCT obj) AS n FROM obj GROUP BY ALL)"


@query(f"WITH {OBJ}{_PER}, k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY n, cls) AS r FROM pc) SELECT cls, count(*) AS n_scenes, CAST(sum(n) AS BIGINT) AS n_objects FROM k WHERE r = 1 GROUP BY cls")
def a06_rarest_class(spark, sf_dir):
    """How often each class is the rarest of its scene."""
    per = objects(spark, sf_dir).groupBy("scene", "cls").agg(F.count_distinct("obj").alias("n"))
    rare = per.groupBy("scene").agg(F.min(F.struct("n", "cls")).alias("m"))
    return rare.groupBy(F.col("m.cls").alias("cls")).agg(F.count("*").alias("n_scenes"), F.sum("m.n").alias("n_objects"))


@query(f"""WITH {OBJ} SELECT cls, count(*) AS n_boxes, count(DISTINCT scene) AS n_scenes, count(*) FILTER (visibility >= 2) AS n_visible, CAST(floor(count(*) * 1000.0 / sum(count(*)) OVER ()) AS BIGINT) AS per_mille FROM obj GROUP BY cls""")
def a07_class_statistics(spark, sf_dir):
    o = objects(spark, sf_dir)
    total = o.count()
    n = F.count("*")
    return o.groupBy("cls").agg(n.alias("n_boxes"), F.count_distinct("scene").alias("n_scenes"), F.count_if(F.expr("visibility >= 2")).alias("n_visible"), F.floor(n * F.lit(1000.0) / F.lit(max(1, total))).alias("per_mille"))


_FEW = ", fc AS (SELECT scene, frame, count(*) AS n FROM rels GROUP BY ALL), ef AS (SELECT scene, frame, n FROM fc QUALIFY n >= least(2, max(n) OVER (PARTITION BY scene)))"


@query(f"WITH {RELS}{_FEW} SELECT scene, frame, n AS n_relations FROM " + _least("ef", "scene", "frame", "frame"))
def h14_frame_choice(spark, sf_dir):
    """A frame of each scene with two relations or more, or else one; by hash."""
    _, r, _ = parts(spark, sf_dir)
    n = r.groupBy("scene", "frame").agg(F.count("*").alias("n"))
    w = Window.partitionBy("scene")  # the frames of one scene
    some = n.withColumn("most", F.max("n").over(w)).where("n >= least(2, most)").drop("most")
    return d.first_by_hash(some, ["scene"], "frame").select("scene", "frame", F.col("n").alias("n_relations"))


@query(f"""WITH {OBJ}{_ANN}, v AS (SELECT * FROM obj WHERE visibility >= 2), g AS (SELECT scene, obj, count(*) AS n_frames, min(frame) AS first_frame, arg_min(cls, frame) AS cls, arg_min(visibility, frame) AS camera FROM v GROUP BY ALL) SELECT * FROM g""")
def h21_instances(spark, sf_dir):
    """Instances with the frames in which a camera sees them, the class and the camera of the first."""
    v = objects(spark, sf_dir).where("visibility >= 2")
    return v.groupBy("scene", "obj").agg(F.count("*").alias("n_frames"), F.min("frame").alias("first_frame"), F.min_by("cls", "frame").alias("cls"), F.min_by("visibility", "frame").alias("camera"))


@query(f"WITH {OBJ} SELECT scene, frame, obj, split(cls, '.')[-1] AS short_class, CAST(floor(sqrt(vx * vx + vy * vy) * 100) AS BIGINT) AS speed_centi, vx * vx + vy * vy > 0.25 AS moving FROM obj")
def x21_speed(spark, sf_dir):
    o = objects(spark, sf_dir)
    return o.select("scene", "frame", "obj", F.element_at(F.split("cls", r"\."), -1).alias("short_class"), F.expr("floor(sqrt(vx * vx + vy * vy) * 100)").alias("speed_centi"), F.expr("vx * vx + vy * vy > 0.25").alias("moving"))


def _of(sql_dir: str) -> str:
    return f"replace({sql_dir}, '_', ' ')"


_SEQ = f"""{_ANN}, ae AS (SELECT st.scene, st.frame, src, tgt, dir, e.obj AS e_obj, e.cls AS e_cls, e.activity AS e_activity, e.description AS e_description, e.f0, e.f1, CASE WHEN e.f0 > st.frame + 5 THEN 'After' ELSE 'Before' END AS marker
 FROM st JOIN evt e ON e.scene = st.scene AND e.obj <> src AND e.obj <> tgt AND (e.f0 > st.frame + 5 OR e.f1 < st.frame - 5)), pk AS {_least("ae", "scene", "e_obj, f0", "f0")}"""


@query(f"""WITH {BOTH}{_STATE}{_SEQ}, t AS (SELECT pk.*, {_ground("coalesce(so.cls, 'unknown')", "sa")} AS s_text, {_ground("coalesce(po.cls, 'unknown')", "ta")} AS t_text, {_ground("e_cls", "ea")} AS e_text FROM pk
 LEFT JOIN obj so ON so.scene = pk.scene AND so.frame = pk.frame AND so.obj = src LEFT JOIN ann sa ON sa.scene = pk.scene AND sa.obj = src LEFT JOIN obj po ON po.scene = pk.scene AND po.frame = pk.frame AND po.obj = tgt
 LEFT JOIN ann ta ON ta.scene = pk.scene AND ta.obj = tgt LEFT JOIN ann ea ON ea.scene = pk.scene AND ea.obj = e_obj)
 SELECT scene, 'Spatial state: ' || t_text || ' is ' || {_of('dir')} || ' ' || s_text || ' (observed at frame ' || frame || ')' AS grounding_anchor,
 'What happens ' || lower(marker) || ' this spatial state? (Correct: ' || e_text || ' ' || e_activity || ', frames ' || f0 || '-' || f1 || ')' AS target_query, t_text || ' is ' || {_of('dir')} || ' ' || s_text AS spatial_context,
 'Target event: ' || e_text || ' ' || e_activity || ' ' || e_description || ' (frames ' || f0 || '-' || f1 || ')' AS temporal_context FROM t""")
def q12_sequential(spark, sf_dir):
    """A spatial state as anchor, and an event before or after it."""
    o, r, e = parts(spark, sf_dir)
    near = d.adjacent_events(d.states(r), e)
    one = d.first_by_hash(near, ["scene"], "e_obj", "e_first")
    t = named(described(described(one, o, "src", "frame", "s_text"), o, "tgt", "frame", "t_text"), o, "e_", "e_text")
    state = F.concat("t_text", F.lit(" is "), F.replace("dir", F.lit("_"), F.lit(" ")), F.lit(" "), "s_text")
    frames = F.concat(F.lit("frames "), "e_first", F.lit("-"), "e_last", F.lit(")"))
    return t.select(
        "scene",
        F.concat(F.lit("Spatial state: "), state, F.lit(" (observed at frame "), "frame", F.lit(")")).alias("grounding_anchor"),
        F.concat(F.lit("What happens "), F.lower("marker"), F.lit(" this spatial state? (Correct: "), "e_text", F.lit(" "), "e_activity", F.lit(", "), frames).alias("target_query"),
        state.alias("spatial_context"),
        F.concat(F.lit("Target event: "), "e_text", F.lit(" "), "e_activity", F.lit(" "), "e_description", F.lit(" ("), frames).alias("temporal_context"),
    )


_PICKED = ", pc AS " + _least("ch", "scene", "obj, f0, src, tgt", "f0")


@query(f"""WITH {BOTH}{_ANN}{_CHANGES}{_PICKED}, t AS (SELECT pc.*, {_ground("coalesce(so.cls, 'unknown')", "sa")} AS s_text, {_ground("coalesce(po.cls, 'unknown')", "ta")} AS t_text, {_ground("pc.cls", "ea")} AS e_text FROM pc
 LEFT JOIN obj so ON so.scene = pc.scene AND so.frame = pre_frame AND so.obj = src LEFT JOIN ann sa ON sa.scene = pc.scene AND sa.obj = src LEFT JOIN obj po ON po.scene = pc.scene AND po.frame = pre_frame AND po.obj = tgt
 LEFT JOIN ann ta ON ta.scene = pc.scene AND ta.obj = tgt LEFT JOIN ann ea ON ea.scene = pc.scene AND ea.obj = pc.obj)
 SELECT scene, 'Event: ' || e_text || ' ' || activity || ' (frames ' || f0 || '-' || f1 || ')' AS grounding_anchor, 'How does the position of ' || t_text || ' relative to ' || s_text || ' change after this event? (Correct: from ' || {_of('pre')} || ' to ' || {_of('post')} || ')' AS target_query,
 'Before (frame ' || pre_frame || '): ' || t_text || ' is ' || {_of('pre')} || ' ' || s_text || '. After (frame ' || post_frame || '): ' || t_text || ' is ' || {_of('post')} || ' ' || s_text || '.' AS spatial_context,
 t_text || ' remains ' || {_of('pre')} || ' ' || s_text || ' throughout|' || s_text || ' remain ' || {_of('post')} || ' ' || t_text || ' throughout|' || t_text || ' moves from ' || {_of('post')} || ' to ' || {_of('pre')} || ' ' || s_text || '|' || t_text || ' is no longer visible after the event' AS distractor_candidates FROM t""")
def q12_comparative(spark, sf_dir):
    """An event as anchor, and how the relation of two objects changes over it."""
    o, r, e = parts(spark, sf_dir)
    one = d.first_by_hash(d.changes(e, r, o), ["scene"], "obj", "first", "src", "tgt")
    t = described(described(one, o, "src", "pre_frame", "s_text"), o, "tgt", "pre_frame", "t_text")
    t = named(t.withColumnsRenamed({"obj": "e_obj", "cls": "e_cls"}), o, "e_", "e_text").withColumns({c: F.replace(c, F.lit("_"), F.lit(" ")) for c in ("pre", "post")})
    say = lambda *p: F.concat(*[F.lit(x[1:]) if x.startswith("'") else F.col(x) for x in p])
    distractors = [say("t_text", "' remains ", "pre", "' ", "s_text", "' throughout"), say("s_text", "' remain ", "post", "' ", "t_text", "' throughout"), say("t_text", "' moves from ", "post", "' to ", "pre", "' ", "s_text"), say("t_text", "' is no longer visible after the event")]
    return t.select(
        "scene",
        say("'Event: ", "e_text", "' ", "activity", "' (frames ", "first", "'-", "last", "')").alias("grounding_anchor"),
        say("'How does the position of ", "t_text", "' relative to ", "s_text", "' change after this event? (Correct: from ", "pre", "' to ", "post", "')").alias("target_query"),
        say("'Before (frame ", "pre_frame", "'): ", "t_text", "' is ", "pre", "' ", "s_text", "'. After (frame ", "post_frame", "'): ", "t_text", "' is ", "post", "' ", "s_text", "'.").alias("spatial_context"),
        F.concat_ws("|", *distractors).alias("distractor_candidates"),
    )


@query(f"""WITH {BOTH}{_STATE}{_ABSENT}{_ANN}, x AS {_least("ab", "scene", "frame, obj", "obj")}, ev1 AS (SELECT e.* FROM evt e JOIN st ON st.scene = e.scene AND e.obj <> st.src), y AS {_least("ev1", "scene", "obj, f0", "f0")}
 SELECT st.scene, st.dir, CASE st.dir WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' WHEN 'in_front' THEN 'behind' ELSE 'in front' END AS opposite,
 coalesce({_ground("y.cls", "ya")} || ' ' || y.activity, 'No other event occurs in this segment.') AS other_event,
 CASE WHEN x.obj IS NULL THEN 'An object not visible in this segment.' ELSE {_ground("coalesce(xa.cls, 'object')", "xa")} END AS absent_object
 FROM st LEFT JOIN x ON x.scene = st.scene LEFT JOIN ann xa ON xa.scene = st.scene AND xa.obj = x.obj LEFT JOIN y ON y.scene = st.scene LEFT JOIN ann ya ON ya.scene = st.scene AND ya.obj = y.obj""")
def q13_distractors(spark, sf_dir):
    """Wrong answers for the chosen state of each scene: the opposite direction, another event, an object that is not there."""
    o, r, e = parts(spark, sf_dir)
    st = d.states(r)
    absent = d.first_by_hash(j23_absent_objects(spark, sf_dir), ["scene"], "frame", "obj").select("scene", F.col("obj").alias("x_obj"))
    ann = annotations(o).select("scene", F.col("obj").alias("x_obj"), F.col("cls").alias("x_cls"), F.col("activity").alias("x_a"), F.col("description").alias("x_d"))
    other = d.first_by_hash(e.join(st.select("scene", "src"), "scene").where("obj <> src").drop("src"), ["scene"], "obj", "first")
    other = named(d.prefixed(other, "y_", ["scene"]), o, "y_", "y_text").select("scene", F.concat("y_text", F.lit(" "), "y_activity").alias("other_event"))
    got = st.join(absent.join(ann, ["scene", "x_obj"], "left"), "scene", "left").join(other, "scene", "left")
    opposite = F.coalesce(*[F.when(F.col("dir") == a, F.lit(b.replace("_", " "))) for a, b in d.OPPOSITE.items()])
    text = d.grounded(F.coalesce("x_cls", F.lit("object")), F.coalesce("x_d", F.lit("")), F.coalesce("x_a", F.lit("")))
    return got.select("scene", "dir", opposite.alias("opposite"), F.coalesce("other_event", F.lit("No other event occurs in this segment.")).alias("other_event"), F.when(F.col("x_obj").isNull(), "An object not visible in this segment.").otherwise(text).alias("absent_object"))


@query(f"""WITH {RELS}, c AS (SELECT scene, frame, array_to_string(list(n || ' ' || k ORDER BY k), ', ') AS objects FROM (SELECT scene, frame, split(cls, '.')[-1] AS k, count(*) AS n FROM obj GROUP BY ALL) GROUP BY ALL),
 rr AS (SELECT r.scene, r.frame, split(a.cls, '.')[-1] || ' is ' || replace(dir, '_', ' ') || ' ' || split(b.cls, '.')[-1] AS line, row_number() OVER (PARTITION BY r.scene, r.frame ORDER BY src, tgt) AS k FROM rels r
 JOIN obj a ON a.scene = r.scene AND a.frame = r.frame AND a.obj = src JOIN obj b ON b.scene = r.scene AND b.frame = r.frame AND b.obj = tgt),
 l AS (SELECT scene, frame, array_to_string(list(line ORDER BY k), '; ') AS relations FROM rr WHERE k <= 5 GROUP BY ALL), q AS (SELECT scene, frame, row_number() OVER (PARTITION BY scene ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY scene) AS n FROM (SELECT DISTINCT scene, frame FROM obj)),
 s AS (SELECT * FROM q WHERE n <= 15 OR (i % greatest(1, n // 15) = 0 AND i // greatest(1, n // 15) < 15) OR i = n - 1)
 SELECT s.scene, s.frame, '--- Frame ' || s.frame || ' ---' || chr(10) || 'Objects: ' || objects || coalesce(chr(10) || 'Relations: ' || relations, '') AS text FROM s JOIN c ON c.scene = s.scene AND c.frame = s.frame LEFT JOIN l ON l.scene = s.scene AND l.frame = s.frame""")
def q14_scene_text(spark, sf_dir):
    """The text of at most 15 evenly spaced frames of each scene and its last: counts of objects and five relations."""
    o, r, _ = parts(spark, sf_dir)
    short = o.select("scene", "frame", "obj", F.element_at(F.split("cls", r"\."), -1).alias("k"))
    counts = short.groupBy("scene", "frame", "k").agg(F.count("*").alias("n")).groupBy("scene", "frame").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda v: F.concat(v["n"].cast("string"), F.lit(" "), v["k"])), ", ").alias("objects"))
    side = lambda who: short.select("scene", "frame", F.col("obj").alias(who), F.col("k").alias(f"{who}_k"))
    lines = r.join(side("src"), ["scene", "frame", "src"]).join(side("tgt"), ["scene", "frame", "tgt"]).select("scene", "frame", F.struct("src", "tgt", F.concat("src_k", F.lit(" is "), F.replace("dir", F.lit("_"), F.lit(" ")), F.lit(" "), "tgt_k").alias("t")).alias("v"))
    relations = lines.groupBy("scene", "frame").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("v")), 1, 5), lambda v: v["t"]), "; ").alias("relations"))
    w = Window.partitionBy("scene")  # the frames of one scene
    q = o.select("scene", "frame").distinct().withColumns({"i": F.row_number().over(w.orderBy("frame")) - 1, "n": F.count("*").over(w)}).withColumn("step", F.expr("greatest(1, n div 15)"))
    s = q.where("n <= 15 or (i % step = 0 and i div step < 15) or i = n - 1")
    text = F.concat(F.lit("--- Frame "), "frame", F.lit(" ---\nObjects: "), "objects", F.coalesce(F.concat(F.lit("\nRelations: "), "relations"), F.lit("")))
    return s.join(counts, ["scene", "frame"]).join(relations, ["scene", "frame"], "left").select("scene", "frame", text.alias("text"))


@query()
def g08_event_chain(spark, sf_dir):
    """The first chain of events of each scene on different objects: of four, of different classes or of two at most of a class; then
    of three.  A scene's intervals are one group: 64 frames of some objects."""
    import pandas as pd

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        rows_ = frame.sort_values(["first", "last", "obj"], kind="stable").to_dict("records")
        for length in (4, 3):
            for most in (1, 2):
                for start in range(len(rows_)):
                    taken = [rows_[start]]
                    for c in rows_[start + 1 :]:
                        last = taken[-1]["last"]
                        if c["first"] < last - d.BUFFER or c["last"] < last or any(c["obj"] == t["obj"] for t in taken) or sum(c["cls"] == t["cls"] for t in taken) >= most:
                            continue
                        taken.append(c)
                        if len(taken) == length:
                            return pd.DataFrame([{**t, "place": i} for i, t in enumerate(taken)])
        return pd.DataFrame(columns=[*frame.columns, "place"])

    e = d.activity_intervals(objects(spark, sf_dir)).select("scene", "obj", "cls", "activity", "first", "last")
    return e.groupBy("scene").applyInPandas(chain, "scene long, obj long, cls string, activity string, first long, last long, place long")


_GAPS = """, gp AS (SELECT a.scene, a.obj AS a_obj, a.cls AS a_cls, a.activity AS a_activity, a.f0 AS a_f0, a.f1 AS a_f1, b.obj AS b_obj, b.cls AS b_cls, b.activity AS b_activity, b.f0 AS b_f0, b.f1 AS b_f1, r.frame, src, tgt, dir FROM evt a JOIN evt b ON a.scene = b.scene AND a.f1 + 10 < b.f0
 JOIN rels r ON r.scene = a.scene AND r.frame BETWEEN a.f1 + 5 AND b.f0 - 5 AND src NOT IN (a.obj, b.obj) AND tgt NOT IN (a.obj, b.obj))"""
_TEXTS = lambda t, frame: f"""LEFT JOIN obj so ON so.scene = {t}.scene AND so.frame = {t}.{frame} AND so.obj = {t}.src LEFT JOIN ann sa ON sa.scene = {t}.scene AND sa.obj = {t}.src LEFT JOIN obj po ON po.scene = {t}.scene AND po.frame = {t}.{frame} AND po.obj = {t}.tgt LEFT JOIN ann ta ON ta.scene = {t}.scene AND ta.obj = {t}.tgt"""
_S, _T = _ground("coalesce(so.cls, 'unknown')", "sa"), _ground("coalesce(po.cls, 'unknown')", "ta")


def _say(*parts):
    """Columns and 'texts joined."""
    return F.concat(*[F.lit(p[1:]) if isinstance(p, str) and p.startswith("'") else F.col(p) if isinstance(p, str) else p for p in parts])


def _spaced(c: str):
    return F.replace(c, F.lit("_"), F.lit(" "))


@query(f"""WITH {BOTH}{_ANN}{_GAPS}, pk AS {_least("gp", "scene", "a_obj, a_f0, b_obj, b_f0, frame, src, tgt", "frame")}
 SELECT pk.scene, 'Between ' || {_ground("a_cls", "aa")} || ' ' || a_activity || ' (ends frame ' || a_f1 || ') and ' || {_ground("b_cls", "ba")} || ' ' || b_activity || ' (starts frame ' || b_f0 || ')' AS grounding_anchor,
 'At frame ' || pk.frame || ': ' || {_T} || ' is ' || {_of('dir')} || ' ' || {_S} AS spatial_context, 'Gap: frames ' || (a_f1 + 5) || '-' || (b_f0 - 5) AS temporal_context
 FROM pk {_TEXTS('pk', 'frame')} LEFT JOIN ann aa ON aa.scene = pk.scene AND aa.obj = a_obj LEFT JOIN ann ba ON ba.scene = pk.scene AND ba.obj = b_obj""")
def q12_intermediary(spark, sf_dir):
    """Two events as anchors, and a relation of other objects between them."""
    o, r, e = parts(spark, sf_dir)
    one = d.first_by_hash(d.gap_relations(e, r), ["scene"], "a_obj", "a_first", "b_obj", "b_first", "frame", "src", "tgt")
    t = described(described(one, o, "src", "frame", "s_text"), o, "tgt", "frame", "t_text")
    t = named(named(t, o, "a_", "a_text"), o, "b_", "b_text")
    return t.select(
        "scene",
        _say("'Between ", "a_text", "' ", "a_activity", "' (ends frame ", "a_last", "') and ", "b_text", "' ", "b_activity", "' (starts frame ", "b_first", "')").alias("grounding_anchor"),
        _say("'At frame ", "frame", "': ", "t_text", "' is ", _spaced("dir"), "' ", "s_text").alias("spatial_context"),
        _say("'Gap: frames ", F.col("a_last") + d.BUFFER, "'-", F.col("b_first") - d.BUFFER).alias("temporal_context"),
    )


@query(f"""WITH {BOTH}{_ANN}{_FR}, w AS (SELECT scene, obj, cls, activity, f0, f1, side, CASE WHEN side = 'before' THEN greatest(0, f0 - 5) ELSE f1 + 5 END AS wanted FROM evt, (VALUES ('before'), ('after')) AS s(side)),
 t AS (SELECT w.*, i, fr.frame FROM w, {_SNAPS}, fr WHERE fr.scene = w.scene AND fr.frame = wanted + k.o), b AS (SELECT * EXCLUDE (i, tr) FROM (SELECT *, row_number() OVER (PARTITION BY scene, obj, f0, f1, side ORDER BY i) AS tr FROM t) WHERE tr = 1),
 sn AS (SELECT b.*, src, tgt, dir FROM b JOIN rels ON rels.scene = b.scene AND rels.frame = b.frame), pk AS {_least("sn", "scene", "obj, f0, side, src, tgt", "frame")}
 SELECT pk.scene, 'Right ' || side || ' ' || {_ground("pk.cls", "ea")} || ' ' || pk.activity || ' (event frames ' || f0 || '-' || f1 || ')' AS grounding_anchor, 'What is ' || {_of('dir')} || ' ' || {_S} || ' at frame ' || pk.frame || '? (Correct: ' || {_T} || ')' AS target_query
 FROM pk {_TEXTS('pk', 'frame')} LEFT JOIN ann ea ON ea.scene = pk.scene AND ea.obj = pk.obj""")
def q12_snapshot(spark, sf_dir):
    """An event's begin or end as anchor, and a relation at that moment."""
    o, r, e = parts(spark, sf_dir)
    sides = F.array(F.struct(F.lit("before").alias("side"), F.greatest(F.lit(0), F.col("first") - d.BUFFER).alias("wanted")), F.struct(F.lit("after").alias("side"), (F.col("last") + d.BUFFER).alias("wanted")))
    w = e.select("scene", F.col("obj").alias("e_obj"), F.col("cls").alias("e_cls"), "activity", F.col("first").alias("f0"), F.col("last").alias("f1"), F.inline(sides))
    got = d.snapped(w, o, "wanted", "frame").join(r, ["scene", "frame"])
    one = d.first_by_hash(got, ["scene"], "e_obj", "f0", "side", "src", "tgt")
    t = named(described(described(one, o, "src", "frame", "s_text"), o, "tgt", "frame", "t_text"), o, "e_", "e_text")
    return t.select("scene", _say("'Right ", "side", "' ", "e_text", "' ", "activity", "' (event frames ", "f0", "'-", "f1", "')").alias("grounding_anchor"), _say("'What is ", _spaced("dir"), "' ", "s_text", "' at frame ", "frame", "'? (Correct: ", "t_text", "')").alias("target_query"))


@query(f"""WITH {BOTH}{_ANN}{_TWO}, be AS (SELECT two.*, e.obj, e.cls, e.activity, e.f0, e.f1 FROM two JOIN evt e ON e.scene = two.scene AND e.f0 >= p_frame + 5 AND e.f1 <= q_frame - 5 AND p_frame + 5 < q_frame - 5), pk AS {_least("be", "scene", "obj, f0", "f0")},
 p AS (SELECT scene, p_frame AS frame, p_src AS src, p_tgt AS tgt, p_dir AS dir FROM pk), q AS (SELECT scene, q_frame AS frame, q_src AS src, q_tgt AS tgt, q_dir AS dir FROM pk),
 pt AS (SELECT p.scene, {_T} || ' is ' || {_of('dir')} || ' ' || {_S} AS said FROM p {_TEXTS('p', 'frame')}), qt AS (SELECT q.scene, {_T} || ' is ' || {_of('dir')} || ' ' || {_S} AS said FROM q {_TEXTS('q', 'frame')})
 SELECT pk.scene, 'S1: ' || pt.said || ' | S2: ' || qt.said AS spatial_context, 'What happens in between S1 and S2? (Correct: ' || {_ground("pk.cls", "ea")} || ' ' || pk.activity || ', frames ' || f0 || '-' || f1 || ')' AS target_query
 FROM pk JOIN pt ON pt.scene = pk.scene JOIN qt ON qt.scene = pk.scene LEFT JOIN ann ea ON ea.scene = pk.scene AND ea.obj = pk.obj""")
def q12_in_between(spark, sf_dir):
    """Two spatial states as anchors, and an event between them."""
    o, r, e = parts(spark, sf_dir)
    one = d.first_by_hash(d.between_events(d.second_states(r, d.states(r)), e), ["scene"], "e_obj", "e_first")
    t = one
    for s in "pq":
        t = described(described(t, o, f"{s}_src", f"{s}_frame", f"{s}_s"), o, f"{s}_tgt", f"{s}_frame", f"{s}_t")
    t = named(t, o, "e_", "e_text")
    said = lambda s: _say(f"{s}_t", "' is ", _spaced(f"{s}_dir"), "' ", f"{s}_s")
    return t.select("scene", _say("'S1: ", said("p"), "' | S2: ", said("q")).alias("spatial_context"), _say("'What happens in between S1 and S2? (Correct: ", "e_text", "' ", "e_activity", "', frames ", "e_first", "'-", "e_last", "')").alias("target_query"))


@query(f"""WITH {RELS}{_STATE}{_ANN} SELECT st.scene, CASE WHEN substr(md5('42::' || st.scene || '::ego'), 1, 1) < '8' THEN 'What object is ' || {_of('dir')} || ' of ' || {_S} || '?' ELSE 'Where is ' || {_T} || ' relative to ' || {_S} || '?' END AS question,
 CASE WHEN substr(md5('42::' || st.scene || '::ego'), 1, 1) < '8' THEN {_T} ELSE {_of('dir')} END AS answer FROM st {_TEXTS('st', 'frame')}""")
def q12_egocentric(spark, sf_dir):
    """What is in a direction of an object, or where another is."""
    o, r, _ = parts(spark, sf_dir)
    t = described(described(d.states(r), o, "src", "frame", "s_text"), o, "tgt", "frame", "t_text")
    what = F.substring(d.hashed("scene", F.lit("ego")), 1, 1) < "8"
    q = F.when(what, _say("'What object is ", _spaced("dir"), "' of ", "s_text", "'?")).otherwise(_say("'Where is ", "t_text", "' relative to ", "s_text", "'?"))
    return t.select("scene", q.alias("question"), F.when(what, F.col("t_text")).otherwise(_spaced("dir")).alias("answer"))


@query(f"""WITH {RELS}{_NEARER}{_ANN}, pk AS {_least("nq", "scene", "frame, src", "frame")}, dd AS (SELECT pk.*, n.d2 AS n2, f.d2 AS f2 FROM pk JOIN rels n ON n.scene = pk.scene AND n.frame = pk.frame AND n.src = pk.src AND n.tgt = nearer JOIN rels f ON f.scene = pk.scene AND f.frame = pk.frame AND f.src = pk.src AND f.tgt = farther)
 SELECT scene, frame, src, nearer, farther, CAST(floor(sqrt(n2) * 10) AS BIGINT) AS near_dm, CAST(floor(sqrt(f2) * 10) AS BIGINT) AS far_dm, substr(md5('42::' || scene || '::hop'), 1, 1) < '8' AS ask_nearer FROM dd""")
def q12_multihop(spark, sf_dir):
    """Which of two objects is nearer to a third, with their distances."""
    _, r, _ = parts(spark, sf_dir)
    one = d.first_by_hash(d.nearer_farther(r), ["scene"], "frame", "src")
    far = lambda who, out: r.select("scene", "frame", "src", F.col("tgt").alias(who), F.floor(F.sqrt("d2") * 10).alias(out))
    got = one.join(far("nearer", "near_dm"), ["scene", "frame", "src", "nearer"]).join(far("farther", "far_dm"), ["scene", "frame", "src", "farther"])
    return got.select("scene", "frame", "src", "nearer", "farther", "near_dm", "far_dm", (F.substring(d.hashed("scene", F.lit("hop")), 1, 1) < "8").alias("ask_nearer"))


_KINDS = ["sequential", "between", "snapshot", "intermediary", "comparative"]


@query(f"""WITH {BOTH}{_TWO}{_CHANGES}{_GAPS}, av AS (SELECT DISTINCT st.scene, 'sequential' AS kind FROM st JOIN evt e ON e.scene = st.scene AND e.obj NOT IN (src, tgt) AND (e.f0 > st.frame + 5 OR e.f1 < st.frame - 5)
 UNION SELECT two.scene, 'between' FROM two JOIN evt e ON e.scene = two.scene AND e.f0 >= p_frame + 5 AND e.f1 <= q_frame - 5 AND p_frame + 5 < q_frame - 5 UNION SELECT scene, 'comparative' FROM ch UNION SELECT scene, 'intermediary' FROM gp)
 SELECT scene, arg_min(kind, md5('42::' || scene || '::' || kind)) AS kind, count(*) AS n_possible FROM av GROUP BY scene""")
def h16_category_choice(spark, sf_dir):
    """The category of each scene's question: of those that have one, by hash."""
    o, r, e = parts(spark, sf_dir)
    st = d.states(r)
    have = {"sequential": d.adjacent_events(st, e), "between": d.between_events(d.second_states(r, st), e), "comparative": d.changes(e, r, o), "intermediary": d.gap_relations(e, r)}
    av = None
    for kind, df in have.items():
        one = df.select("scene").distinct().withColumn("kind", F.lit(kind))
        av = one if av is None else av.unionByName(one)
    return av.groupBy("scene").agg(F.min(F.struct(d.hashed("scene", "kind").alias("h"), "kind"))["kind"].alias("kind"), F.count("*").alias("n_possible"))


@query(f"""WITH {OBJ}, p AS (SELECT *, list_filter([1, 3, 2, 4], lambda c: (visibility + c) % 2 = 0)[1] AS camera FROM obj) SELECT scene, frame, camera, array_to_string(list(obj || ': ' || split(cls, '.')[-1] || CASE WHEN vx * vx + vy * vy > 0 THEN ' (moving)' ELSE '' END ORDER BY obj), '; ') AS objects FROM p GROUP BY ALL""")
def h22_camera_groups(spark, sf_dir):
    """The objects of a frame as text (H23), by the first camera of a list of preferences that sees them."""
    o = objects(spark, sf_dir)
    camera = F.filter(F.array(*map(F.lit, (1, 3, 2, 4))), lambda c: (F.col("visibility") + c) % 2 == 0)[0].alias("camera")
    text = F.concat(F.col("obj").cast("string"), F.lit(": "), F.element_at(F.split("cls", r"\."), -1), F.when(F.expr("vx * vx + vy * vy > 0"), " (moving)").otherwise(""))
    g = o.select("scene", "frame", camera, F.struct("obj", text.alias("t")).alias("v")).groupBy("scene", "frame", "camera").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    return g.select("scene", "frame", "camera", F.array_join(F.transform("vs", lambda v: v["t"]), "; ").alias("objects"))


@query(f"""WITH {RELS}, o AS (SELECT scene, frame, count(*) AS n, array_to_string(list('- ' || split(cls, '.')[-1] || ' at (' || x || ', ' || y || ')' ORDER BY obj), chr(10)) AS objects FROM obj GROUP BY ALL), u AS (SELECT scene, frame, src, tgt, dir FROM rels WHERE d2 <= 900),
 l AS (SELECT scene, frame, count(*) AS k, array_to_string(list('- ' || src || ' ' || dir || ' ' || tgt ORDER BY src, tgt), chr(10)) AS lines FROM u GROUP BY ALL)
 SELECT o.scene, o.frame, n, coalesce(k, 0) AS n_relations, 'Objects:' || chr(10) || objects || chr(10) || 'Relationships:' || chr(10) || coalesce(lines, '- none') AS prompt FROM o LEFT JOIN l ON l.scene = o.scene AND l.frame = o.frame""")
def q15_caption_prompts(spark, sf_dir):
    """The prompt for a caption of each frame: objects, and relations of those within 30 m."""
    o, r, _ = parts(spark, sf_dir)
    line = F.concat(F.lit("- "), F.element_at(F.split("cls", r"\."), -1), F.lit(" at ("), "x", F.lit(", "), "y", F.lit(")"))
    texts = o.groupBy("scene", "frame").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("obj", line.alias("t")))).alias("v"))
    rel = r.where("d2 <= 900").groupBy("scene", "frame").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct("src", "tgt", F.concat(F.lit("- "), "src", F.lit(" "), "dir", F.lit(" "), "tgt").alias("t")))).alias("w"))
    got = texts.join(rel, ["scene", "frame"], "left")
    prompt = F.concat(F.lit("Objects:\n"), F.array_join(F.transform("v", lambda x: x["t"]), "\n"), F.lit("\nRelationships:\n"), F.coalesce(F.array_join(F.transform("w", lambda x: x["t"]), "\n"), F.lit("- none")))
    return got.select("scene", "frame", "n", F.coalesce("k", F.lit(0).cast("long")).alias("n_relations"), prompt.alias("prompt"))


@query(f"""WITH {RELS}, c AS (SELECT scene, frame, count(*) AS n_objects FROM obj GROUP BY ALL), l AS (SELECT scene, frame, count(*) AS n FROM rels GROUP BY ALL) SELECT c.scene, count(*) AS n_frames, count(*) FILTER (c.frame % 7 <> 3) AS n_success, CAST(floor(sum(n_objects) * 10.0 / count(*)) AS BIGINT) AS objects_tenths,
 CAST(floor(sum(coalesce(n, 0)) * 10.0 / count(*)) AS BIGINT) AS relations_tenths FROM c LEFT JOIN l ON l.scene = c.scene AND l.frame = c.frame GROUP BY c.scene""")
def a17_caption_statistics(spark, sf_dir):
    """Frames of a scene with a caption (here six of seven), and their mean numbers of objects and relations."""
    o, r, _ = parts(spark, sf_dir)
    c = o.groupBy("scene", "frame").agg(F.count("*").alias("n_objects")).join(r.groupBy("scene", "frame").agg(F.count("*").alias("n")), ["scene", "frame"], "left").na.fill(0, ["n"])
    mean = lambda x: F.floor(F.sum(x) * F.lit(10.0) / F.count("*"))
    return c.groupBy("scene").agg(F.count("*").alias("n_frames"), F.count_if(F.expr("frame % 7 <> 3")).alias("n_success"), mean("n_objects").alias("objects_tenths"), mean("n").alias("relations_tenths"))


@query(f"""WITH {OBJ}, i AS (SELECT scene, obj, arg_min(cls, frame) AS cls, arg_min(visibility, frame) AS camera, count(*) AS n FROM obj WHERE visibility >= 2 GROUP BY ALL) SELECT camera, cls, count(*) AS n_instances, count(*) * 1000 // sum(count(*)) OVER (PARTITION BY camera) AS per_mille, CAST(sum(n) * 10 // count(*) AS BIGINT) AS frames_tenths
 FROM i GROUP BY camera, cls QUALIFY row_number() OVER (PARTITION BY camera ORDER BY count(*) DESC, cls) <= 10""")
def a18_annotation_statistics(spark, sf_dir):
    """The ten commonest classes of the instances that each camera sees, their share and mean number of frames."""
    i = h21_instances(spark, sf_dir).groupBy("camera", "cls").agg(F.count("*").alias("n_instances"), F.sum("n_frames").alias("f"))
    w = Window.partitionBy("camera")  # a camera has as many rows as there are classes
    got = i.withColumns({"t": F.sum("n_instances").over(w), "r": F.row_number().over(w.orderBy(F.desc("n_instances"), "cls"))}).where("r <= 10")
    return got.select("camera", "cls", "n_instances", F.expr("n_instances * 1000 div t").alias("per_mille"), F.expr("f * 10 div n_instances").alias("frames_tenths"))


_Q = {c: f"{f}(radians(heading / 2))" for c, f in (("w", "cos"), ("z", "sin"))}
_EGO = f"(2 * {_Q['w']} * {_Q['w']} - 1)", f"(2 * {_Q['w']} * {_Q['z']})"


@query(f"WITH {OBJ} SELECT scene, frame, obj, CAST(round(({_EGO[0]} * x + {_EGO[1]} * y) * 100) AS BIGINT) AS forward_cm, CAST(round(({_EGO[0]} * y - {_EGO[1]} * x) * 100) AS BIGINT) AS left_cm, CAST(round(degrees(atan2(2 * {_Q['w']} * {_Q['z']}, 1 - 2 * {_Q['z']} * {_Q['z']})) * 4) AS BIGINT) AS yaw_quarters FROM obj")
def geo13_ego_frame(spark, sf_dir):
    """Positions turned back by an upright quaternion into the frame of its bearer, and the quaternion's yaw (G-12)."""
    o = objects(spark, sf_dir)
    return o.selectExpr("scene", "frame", "obj", f"CAST(round(({_EGO[0]} * x + {_EGO[1]} * y) * 100) AS BIGINT) AS forward_cm", f"CAST(round(({_EGO[0]} * y - {_EGO[1]} * x) * 100) AS BIGINT) AS left_cm", f"CAST(round(degrees(atan2(2 * {_Q['w']} * {_Q['z']}, 1 - 2 * {_Q['z']} * {_Q['z']})) * 4) AS BIGINT) AS yaw_quarters")


_IN_BOX = "abs(cos(radians(b.heading)) * (p.x - b.x) + sin(radians(b.heading)) * (p.y - b.y)) <= 6.1 AND abs(cos(radians(b.heading)) * (p.y - b.y) - sin(radians(b.heading)) * (p.x - b.x)) <= 3.1 AND abs(p.z - b.z) <= 1.6"


@query(f"WITH {OBJ} SELECT p.scene, p.frame, p.obj, max(b.obj) AS box, count(*) AS n_boxes FROM obj p JOIN obj b ON b.scene = p.scene AND b.frame = p.frame AND b.obj <> p.obj AND {_IN_BOX} GROUP BY ALL")
def geo14_points_in_boxes(spark, sf_dir):
    """Points (here the other objects of a frame) in turned boxes; of several boxes the last one has the point."""
    o = objects(spark, sf_dir).select("scene", "frame", "obj", "x", "y", "z", "heading")
    got = o.alias("p").join(o.alias("b"), ["scene", "frame"]).where(f"p.obj <> b.obj AND {_IN_BOX}")
    return got.groupBy("scene", "frame", F.col("p.obj").alias("obj")).agg(F.max("b.obj").alias("box"), F.count("*").alias("n_boxes"))


_CORNERS = [(dx, dy, dz) for dx in (-2, 2) for dy in (-1, 1) for dz in (0, 1)]
_AHEAD = lambda c: f"(x + 40 + {c[0]} * cos(radians(heading)) - {c[1]} * sin(radians(heading)))"
_U = lambda c: f"(960 - 800 * (y + {c[0]} * sin(radians(heading)) + {c[1]} * cos(radians(heading))) / {_AHEAD(c)})"
_V = lambda c: f"(540 - 800 * (z + {c[2]} - 1.5) / {_AHEAD(c)})"
_BOX2 = {"u0": f"least({', '.join(map(_U, _CORNERS))})", "u1": f"greatest({', '.join(map(_U, _CORNERS))})", "v0": f"least({', '.join(map(_V, _CORNERS))})", "v1": f"greatest({', '.join(map(_V, _CORNERS))})"}
_SHOWN = "u1 > 0 AND u0 < 1920 AND v1 > 0 AND v0 < 1080"


@query(f"WITH {OBJ}, b AS (SELECT scene, frame, obj, {', '.join(f'{e} AS {a}' for a, e in _BOX2.items())} FROM obj) SELECT scene, frame, obj, {_SHOWN} AS visible, CASE WHEN {_SHOWN} THEN CAST(round(greatest(u0, 0.0)) AS BIGINT) END AS left_px, CASE WHEN {_SHOWN} THEN CAST(round(least(u1, 1920.0)) AS BIGINT) END AS right_px FROM b")
def geo15_projected_boxes(spark, sf_dir):
    """The eight corners of each object's box in the picture of a camera 40 m behind, cut to it; null outside."""
    b = objects(spark, sf_dir).selectExpr("scene", "frame", "obj", *[f"{e} AS {a}" for a, e in _BOX2.items()])
    return b.selectExpr("scene", "frame", "obj", f"{_SHOWN} AS visible", f"CASE WHEN {_SHOWN} THEN CAST(round(greatest(u0, CAST(0 AS DOUBLE))) AS BIGINT) END AS left_px", f"CASE WHEN {_SHOWN} THEN CAST(round(least(u1, CAST(1920 AS DOUBLE))) AS BIGINT) END AS right_px")
