"""Queries over tracks, cameras and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import camera as cam
from tessera.operators import selection
from tessera.operators import tracks as tr
from tessera.sources.views import cte, rows

from .catalogue import query

OBJ = cte("obj")


def tracks(spark, sf_dir):
    return rows(spark, sf_dir, "obj")


def _literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS BIGINT)"


CAMS = "cam(camera, site, cset, indoor, e, n, de, dn) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in cam.camera_rows()) + ")"
#: Matrices of the eight cameras that scenes are seen by in turn.
MATRICES = [(i, *cam.camera_matrix(45.0 * i + 20.0, 25.0 + i, 8.0 + i)) for i in range(8)]
MATS = "mat(k, " + ", ".join(f"m{i}" for i in range(9)) + ", c0, c1, c2) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, [k, *m, *c])) + ")" for k, m, c in MATRICES) + ")"
_GROUND = cam.ground_sql("(x1 + x2) / CAST(2 AS DOUBLE)", "greatest(y1, y2)", [f"m{i}" for i in range(9)], ["c0", "c1", "c2"])


def cameras(spark):
    return spark.createDataFrame(cam.camera_rows(), cam.CAMERA_DDL)


def matrices(spark):
    return spark.createDataFrame([(k, *m, *c) for k, m, c in MATRICES], "k long, " + ", ".join(f"m{i} double" for i in range(9)) + ", c0 double, c1 double, c2 double")


def camera_pairs(spark):
    a, b = (cameras(spark).alias(s) for s in "ab")
    return a.join(F.broadcast(b), F.expr("a.camera < b.camera"))


_DIST = "sqrt((a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n))"


@query(f"WITH {OBJ} SELECT scene, obj, frame, x1, y1, x2, y2 FROM obj WHERE frame % 4 = obj % 4")
def s06_sampled_tracks(spark, sf_dir):
    return tr.sampled(tracks(spark, sf_dir), 4, "obj % 4").select("scene", "obj", "frame", "x1", "y1", "x2", "y2")


@query(f"WITH {OBJ} SELECT scene, obj, min(frame) AS first, max(frame) AS last, count(*) AS n FROM obj GROUP BY ALL")
def s07_frame_ranges(spark, sf_dir):
    return tr.frame_ranges(tracks(spark, sf_dir))


@query(f"""WITH {OBJ}, w AS (SELECT scene, obj, 16 * k AS mid FROM (SELECT DISTINCT scene, obj FROM obj), range(4) t(k)), c AS (SELECT w.*, abs(frame - mid) AS gap, frame, x1, y1, x2, y2, row_number() OVER (PARTITION BY w.scene, w.obj, mid ORDER BY abs(frame - mid), frame) AS r
 FROM w JOIN obj ON obj.scene = w.scene AND obj.obj = w.obj AND abs(frame - mid) <= 5) SELECT * EXCLUDE (r) FROM c WHERE r = 1""")
def s08_nearest_boxes(spark, sf_dir):
    """The box nearest to frames 0, 16, 32 and 48 of each track, within five frames."""
    t = tracks(spark, sf_dir)
    wanted = t.select("scene", "obj").distinct().withColumn("mid", F.explode(F.array(*[F.lit(16 * k).cast("long") for k in range(4)])))
    return tr.nearest_boxes(t, wanted, 5)


@query(f"""WITH {OBJ}, a AS (SELECT scene, obj, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY scene, obj ORDER BY (x2 - x1) * (y2 - y1), frame) AS r, count(*) OVER (PARTITION BY scene, obj) AS n FROM obj)
 SELECT scene, obj, area, area >= CASE WHEN scene % 2 = 0 THEN 2048 ELSE 41472 END AS kept FROM a WHERE r = n // 2 + 1""")
def f03_large_enough(spark, sf_dir):
    """Whether the median box of a track is large enough: smaller ones do where the camera is calibrated (even scenes)."""
    return tr.upper_median_area(tracks(spark, sf_dir)).withColumn("kept", F.expr("area >= case when scene % 2 = 0 then 2048 else 41472 end"))


@query(f"""WITH {OBJ}, m AS (SELECT scene, obj, CAST((min(frame) + max(frame) - (min(frame) + max(frame)) % 2) / 2 AS BIGINT) AS mid FROM obj GROUP BY ALL),
 c AS (SELECT m.*, {tr.CLIPPING} AS clipping, row_number() OVER (PARTITION BY m.scene, m.obj ORDER BY abs(frame - mid), frame) AS r FROM m JOIN obj ON obj.scene = m.scene AND obj.obj = m.obj AND abs(frame - mid) <= 30)
 SELECT m.scene, m.obj, m.mid, coalesce(NOT clipping, true) AS visible FROM m LEFT JOIN c ON c.scene = m.scene AND c.obj = m.obj AND c.r = 1""")
def f05_visible_boxes(spark, sf_dir):
    """Whether the box in the middle of a track is not cut off by the picture's edge (F4); a track without a box near it counts as seen."""
    t = tracks(spark, sf_dir)
    mid = tr.frame_ranges(t).select("scene", "obj", F.expr("(first + last) div 2").alias("mid"))
    near = tr.nearest_boxes(t, mid, tr.TOLERANCE).select("scene", "obj", F.expr(f"not ({tr.CLIPPING})").alias("ok"))
    return mid.join(near, ["scene", "obj"], "left").select("scene", "obj", "mid", F.coalesce("ok", F.lit(True)).alias("visible"))


_SAMPLE = f"{OBJ}, sm AS (SELECT * FROM obj WHERE frame % 2 = obj % 2)"
_PAIRS = f"""{_SAMPLE}, bp AS (SELECT a.scene, a.obj AS a_obj, b.obj AS b_obj, a.frame AS a_frame, b.frame AS b_frame, abs(a.frame - b.frame) AS gap FROM sm a JOIN sm b ON a.scene = b.scene AND a.obj < b.obj AND abs(a.frame - b.frame) <= 4),
 fp AS (SELECT scene, a_obj, b_obj, a_frame, b_frame FROM (SELECT *, row_number() OVER (PARTITION BY scene, a_obj, b_obj, a_frame ORDER BY gap, b_frame) AS r FROM (SELECT *, min(gap) OVER (PARTITION BY scene, a_obj, b_obj) AS least FROM bp) WHERE least > 0 OR gap = 0) WHERE r = 1),
 tj AS (SELECT fp.*, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d2, p.x1 + p.x2 - q.x1 - q.x2 AS side FROM fp JOIN sm p ON p.scene = fp.scene AND p.obj = a_obj AND p.frame = a_frame JOIN sm q ON q.scene = fp.scene AND q.obj = b_obj AND q.frame = b_frame),
 cl AS (SELECT scene, a_obj, b_obj, count(*) AS n, arg_min(a_frame, (d2, a_frame)) AS frame, min(d2) AS d2 FROM tj GROUP BY ALL),
 ap AS (SELECT cl.*, cl.n >= 3 AND cl.d2 <= 4 AND coalesce((arg_max(side, a_frame) FILTER (a_frame < frame AND tj.d2 > 25) > 0) <> (arg_min(side, a_frame) FILTER (a_frame > frame AND tj.d2 > 25) > 0), false) AS crosses
 FROM cl JOIN tj ON tj.scene = cl.scene AND tj.a_obj = cl.a_obj AND tj.b_obj = cl.b_obj GROUP BY cl.scene, cl.a_obj, cl.b_obj, cl.n, cl.frame, cl.d2)"""


def _sampled(spark, sf_dir):
    return tracks(spark, sf_dir).where("frame % 2 = obj % 2")


@query(f"WITH {_PAIRS} SELECT * FROM fp")
def j06_frame_pairs(spark, sf_dir):
    """Objects of unequal parity share no sampled frame, so they meet in the nearest ones."""
    return tr.frame_pairs(_sampled(spark, sf_dir), 4)


@query(f"WITH {_PAIRS} SELECT scene, a_obj, b_obj, n, frame, CAST(floor(sqrt(d2) * 100) AS BIGINT) AS dist_cm, CASE WHEN d2 <= 25 THEN 'near' WHEN d2 <= 225 THEN 'moderate' ELSE 'far' END AS proximity, crosses FROM ap")
def w08_approaches(spark, sf_dir):
    """Closest approach (G-6), proximity (G-4) and whether the paths cross."""
    got = tr.approaches(_sampled(spark, sf_dir), 4)
    return got.select("scene", "a_obj", "b_obj", "n", "frame", F.floor(F.sqrt("d2") * 100).alias("dist_cm"), F.expr("case when d2 <= 25 then 'near' when d2 <= 225 then 'moderate' else 'far' end").alias("proximity"), "crosses")


_SPATIAL_OPTIONS = ["They approach and stay near each other (within a few meters)", "They stay at a moderate distance (5-15 meters apart)", "They remain far apart (more than 15 meters)", "They walk past each other, swapping positions (cross paths)"]


@query(f"""WITH {_PAIRS}, q AS (SELECT *, CASE WHEN crosses THEN 3 WHEN d2 <= 25 THEN 0 WHEN d2 <= 225 THEN 1 ELSE 2 END AS i FROM ap) SELECT scene, a_obj, b_obj, i AS answer_index, CASE i {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_SPATIAL_OPTIONS))} END AS answer,
 CASE WHEN crosses OR d2 <= 25 THEN 'easy' ELSE 'medium' END AS difficulty FROM q""")
def q03_spatial_questions(spark, sf_dir):
    got = tr.approaches(_sampled(spark, sf_dir), 4).withColumn("i", F.expr("case when crosses then 3 when d2 <= 25 then 0 when d2 <= 225 then 1 else 2 end"))
    return got.select("scene", "a_obj", "b_obj", F.col("i").alias("answer_index"), F.get(F.array(*map(F.lit, _SPATIAL_OPTIONS)), F.col("i")).alias("answer"), F.expr("case when crosses or d2 <= 25 then 'easy' else 'medium' end").alias("difficulty"))


@query(f"""WITH {_PAIRS}, r AS (SELECT scene, obj, min(frame) AS f0, max(frame) AS f1 FROM sm GROUP BY ALL), b AS (SELECT ap.*, a.f0 AS a0, a.f1 AS a1, b.f0 AS b0, b.f1 AS b1, pa.x1 AS ax1, pa.y1 AS ay1, pa.x2 AS ax2, pa.y2 AS ay2, fp.b_frame FROM ap JOIN r a ON a.scene = ap.scene AND a.obj = a_obj
 JOIN r b ON b.scene = ap.scene AND b.obj = b_obj JOIN fp ON fp.scene = ap.scene AND fp.a_obj = ap.a_obj AND fp.b_obj = ap.b_obj AND fp.a_frame = ap.frame JOIN sm pa ON pa.scene = ap.scene AND pa.obj = ap.a_obj AND pa.frame = ap.frame),
 c AS (SELECT b.*, greatest(0, least(ax2, q.x2) - greatest(ax1, q.x1)) * greatest(0, least(ay2, q.y2) - greatest(ay1, q.y1)) AS shared, (ax2 - ax1) * (ay2 - ay1) + (q.x2 - q.x1) * (q.y2 - q.y1) AS areas FROM b JOIN sm q ON q.scene = b.scene AND q.obj = b.b_obj AND q.frame = b.b_frame)
 SELECT scene, a_obj, b_obj, a_obj % 3 = b_obj % 3 AS same_cluster, 13 * shared > 3 * areas AS same_box, d2 = 0 AND least(a1, b1) > greatest(a0, b0) AND 2 * (least(a1, b1) - greatest(a0, b0)) > least(greatest(a1 - a0, 1), greatest(b1 - b0, 1)) AS same_place FROM c""")
def h06_same_person(spark, sf_dir):
    """Why two tracks may be one person: one cluster (here by number), boxes with an IoU over 0.3 when closest, or one place for most
    of the time."""
    t = _sampled(spark, sf_dir)
    ap, fp, r = tr.approaches(t, 4), tr.frame_pairs(t, 4), tr.frame_ranges(t)
    box = t.select("scene", "obj", "frame", "x1", "y1", "x2", "y2")
    p = ap.withColumnRenamed("frame", "a_frame").join(fp, ["scene", "a_obj", "b_obj", "a_frame"])
    for s in "ab":
        p = p.join(tr.prefixed(box, f"{s}_", ["scene"]), ["scene", f"{s}_obj", f"{s}_frame"]).join(tr.prefixed(r.drop("n"), f"{s}_", ["scene"]), ["scene", f"{s}_obj"])
    p = p.withColumns({"shared": F.expr("greatest(0, least(a_x2, b_x2) - greatest(a_x1, b_x1)) * greatest(0, least(a_y2, b_y2) - greatest(a_y1, b_y1))"), "areas": F.expr("(a_x2 - a_x1) * (a_y2 - a_y1) + (b_x2 - b_x1) * (b_y2 - b_y1)"), "both": F.expr("least(a_last, b_last) - greatest(a_first, b_first)")})
    # an IoU over 0.3: shared over (areas - shared)
    return p.select("scene", "a_obj", "b_obj", F.expr("a_obj % 3 = b_obj % 3").alias("same_cluster"), F.expr("13 * shared > 3 * areas").alias("same_box"), F.expr("d2 = 0 and both > 0 and 2 * both > least(greatest(a_last - a_first, 1), greatest(b_last - b_first, 1))").alias("same_place"))


@query()
def g06_bucket_pick(spark, sf_dir):
    """Three pairs of each scene: crossing ones first, then one of each proximity, then others; one for each two classes."""
    t = _sampled(spark, sf_dir)
    cls = t.groupBy("scene", "obj").agg(F.min_by("cls", "frame").alias("cls"))
    p = w08_approaches(spark, sf_dir)
    for s in "ab":
        p = p.join(tr.prefixed(cls, f"{s}_", ["scene"]), ["scene", f"{s}_obj"])
    key = F.concat_ws("|", F.least("a_cls", "b_cls"), F.greatest("a_cls", "b_cls"))
    p = p.select("scene", "a_obj", "b_obj", "proximity", "crosses", key.alias("key"), F.md5(F.concat_ws("::", F.lit("42"), "scene", "a_obj", "b_obj")).alias("h"))
    return selection.bucket_pick(p, ["scene"], 3)


@query(f"WITH {OBJ}, {MATS} SELECT scene, frame, obj, CASE WHEN {_GROUND[0]} THEN CAST(floor({_GROUND[1]} * 100) AS BIGINT) END AS east_cm, CASE WHEN {_GROUND[0]} THEN CAST(floor({_GROUND[2]} * 100) AS BIGINT) END AS north_cm FROM obj JOIN mat ON k = scene % 8")
def geo03_box_foot(spark, sf_dir):
    """Where the foot of each box stands on the ground, by cameras turned in all directions; null above the horizon."""
    t = tracks(spark, sf_dir).join(F.broadcast(matrices(spark)), F.expr("k = scene % 8"))
    at = lambda e: F.expr(f"case when {_GROUND[0]} then floor({e} * 100) end")
    return t.select("scene", "frame", "obj", at(_GROUND[1]).alias("east_cm"), at(_GROUND[2]).alias("north_cm"))


@query(f"WITH {CAMS} SELECT a.camera AS a_camera, b.camera AS b_camera, CAST(floor({_DIST} * 100) AS BIGINT) AS dist_cm, {cam.overlap_sql(_DIST, '(a.de * b.de + a.dn * b.dn)')} OR (a.cset = 'admin' AND b.cset = 'admin') AS overlap FROM cam a JOIN cam b ON a.camera < b.camera")
def j09_camera_pairs(spark, sf_dir):
    """Distances of all cameras and whether their views overlap (G-10); null where one has no place."""
    over = F.expr(f"{cam.overlap_sql(_DIST, '(a.de * b.de + a.dn * b.dn)')} or (a.cset = 'admin' and b.cset = 'admin')")
    return camera_pairs(spark).select(F.col("a.camera").alias("a_camera"), F.col("b.camera").alias("b_camera"), F.floor(F.expr(_DIST) * 100).alias("dist_cm"), over.alias("overlap"))


_SCORE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in cam.TIER_SCORES.items())


@query(f"WITH {CAMS}, t AS (SELECT a.camera AS a_camera, b.camera AS b_camera, {cam.tier_sql(_DIST)} AS tier FROM cam a JOIN cam b ON a.camera < b.camera) SELECT *, CASE tier {_SCORE} END AS score_tenths FROM t")
def geo09_camera_tiers(spark, sf_dir):
    t = camera_pairs(spark).select(F.col("a.camera").alias("a_camera"), F.col("b.camera").alias("b_camera"), F.expr(cam.tier_sql(_DIST)).alias("tier"))
    return t.withColumn("score_tenths", F.expr(f"case tier {_SCORE} end"))


@query(f"""WITH {CAMS}, o AS (SELECT a.camera AS a, b.camera AS b FROM cam a JOIN cam b ON a.camera < b.camera WHERE {cam.overlap_sql(_DIST, '(a.de * b.de + a.dn * b.dn)')} OR (a.cset = 'admin' AND b.cset = 'admin')), s AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o)
 SELECT camera, site, coalesce(array_to_string(list_sort(list(b)), ','), '') AS neighbours, count(b) AS n FROM cam LEFT JOIN s ON s.a = camera GROUP BY camera, site""")
def h12_camera_neighbours(spark, sf_dir):
    o = j09_camera_pairs(spark, sf_dir).where("overlap").select("a_camera", "b_camera")
    s = o.unionByName(o.select(F.col("b_camera").alias("a_camera"), F.col("a_camera").alias("b_camera"))).groupBy(F.col("a_camera").alias("camera")).agg(F.array_join(F.array_sort(F.collect_list("b_camera")), ",").alias("x"), F.count("*").alias("k"))
    return cameras(spark).join(s, "camera", "left").select("camera", "site", F.coalesce("x", F.lit("")).alias("neighbours"), F.coalesce("k", F.lit(0).cast("long")).alias("n"))


#: Buildings with short labels, those near each site, and the thresholds of "near" and "in the area" (metres).  Centroids
#: are invented by rule, as no meshes come with the data.
BUILDINGS = {"school": "the school", "building1": "the east building", "building2": "the southeast building", "building3": "the south building", "building4": "the west building", "building5": "the northwest building", "gas_station": "the gas station"}
SITES = {"school": "school building1 building2 gas_station", "admin": "building3 building4 building5", "bus": "building4 building5 gas_station", "hospital": "building3 building4"}
PLACES = [(site, b, BUILDINGS[b], (i * 37) % 100 - 50, (i * 61) % 100 - 50) for site, bs in SITES.items() for b in bs.split() for i in [list(BUILDINGS).index(b)]]
PLACE = "place(site, building, label, e, n) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, p)) + ")" for p in PLACES) + ")"
CARDINALS = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"]


def cardinal(de: str, dn: str) -> str:
    """Eight-way direction of an offset; the angle is put off the borders by a thousandth of a degree."""
    a = f"(degrees(atan2(CAST({de} AS DOUBLE), CAST({dn} AS DOUBLE))) + 382.501)"
    i = f"CAST(floor({a} / 45) AS BIGINT) % 8"
    return f"CASE {i} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(CARDINALS)) + " END"


_SITE = "CASE scene % 4 WHEN 0 THEN 'school' WHEN 1 THEN 'admin' WHEN 2 THEN 'bus' ELSE 'hospital' END"
_LABEL = "CASE WHEN d2 < 625 THEN 'near ' || label WHEN d2 < 3600 THEN 'in the area near ' || label END"


@query(f"""WITH {OBJ}, {PLACE}, w AS (SELECT scene, frame, obj, x, y, {_SITE} AS site FROM obj), d AS (SELECT w.*, building, label, (x - e) * (x - e) + (y - n) * (y - n) AS d2, row_number() OVER (PARTITION BY scene, frame, obj ORDER BY (x - e) * (x - e) + (y - n) * (y - n), building) AS r FROM w JOIN place ON place.site = w.site)
 SELECT scene, frame, obj, building, CAST(floor(sqrt(d2) * 10) AS BIGINT) AS dist_dm, {_LABEL} AS location, 'to the ' || {cardinal("x - 3", "y + 7")} AS from_camera FROM d WHERE r = 1""")
def geo08_places(spark, sf_dir):
    """The nearest building of an object's site (T7), the label of its place, and its direction from a camera."""
    place = spark.createDataFrame(PLACES, "site string, building string, label string, e long, n long")
    w = tracks(spark, sf_dir).select("scene", "frame", "obj", "x", "y", F.expr(_SITE).alias("site")).join(F.broadcast(place), "site")
    best = F.min(F.struct(F.expr("(x - e) * (x - e) + (y - n) * (y - n)").alias("d2"), "building", "label")).alias("b")
    got = w.groupBy("scene", "frame", "obj", "x", "y").agg(best).select("*", "b.*")
    return got.select("scene", "frame", "obj", "building", F.expr("floor(sqrt(d2) * 10)").alias("dist_dm"), F.expr(_LABEL).alias("location"), F.expr(f"'to the ' || {cardinal('x - 3', 'y + 7')}").alias("from_camera"))


_SPACE = "CASE WHEN d2 < 25 THEN 1000 WHEN d2 < 400 THEN CAST(floor(1000 - (sqrt(d2) - 5) * 1000 / 15) AS BIGINT) ELSE 0 END"
_TIME = "CASE WHEN gap_ds < 20 THEN 1000 WHEN gap_ds < 100 THEN greatest(400, CAST(floor(1000 - (gap_ds - 20) * 7.5) AS BIGINT)) ELSE 400 END"


@query(f"""WITH {OBJ}, m AS (SELECT a.scene, a.obj, a.frame, b.frame AS next, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, (b.frame - a.frame) * 10 AS gap_ds, CASE WHEN a.description = b.description THEN 1000 ELSE 250 END AS words FROM obj a JOIN obj b ON a.scene = b.scene AND a.obj = b.obj AND b.frame - a.frame BETWEEN 1 AND 12),
 s AS (SELECT *, {_SPACE} AS space, {_TIME} AS time FROM m) SELECT scene, obj, frame, next, space, time, 4 * time + 3 * space + 3 * words AS combined FROM s""")
def geo07_match_scores(spark, sf_dir):
    """How well two sightings match: place and time in thousandths, and 0.4 time, 0.3 place, 0.3 description in ten thousandths."""
    t = tracks(spark, sf_dir).select("scene", "obj", "frame", "x", "y", "description")
    m = tr.prefixed(t, "a_", ["scene", "obj"]).join(tr.prefixed(t, "b_", ["scene", "obj"]), ["scene", "obj"]).where("b_frame - a_frame between 1 and 12")
    m = m.select("scene", "obj", F.col("a_frame").alias("frame"), F.col("b_frame").alias("next"), F.expr("(a_x - b_x) * (a_x - b_x) + (a_y - b_y) * (a_y - b_y)").alias("d2"), F.expr("(b_frame - a_frame) * 10").alias("gap_ds"), F.expr("case when a_description = b_description then 1000 else 250 end").alias("words"))
    return m.withColumns({"space": F.expr(_SPACE), "time": F.expr(_TIME)}).select("scene", "obj", "frame", "next", "space", "time", F.expr("4 * time + 3 * space + 3 * words").alias("combined"))
