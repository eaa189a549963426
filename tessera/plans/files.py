"""Queries that read the reference's file formats: texts are written by rule from the tables and read back, so the tables are the
oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import sinks
from tessera.sources import files
from tessera.sources.adapters import table
from tessera.sources.views import cte, rows

from .catalogue import query

ACTS, OBJ = cte("acts"), cte("obj")


@query("SELECT 'C' || CAST(p_partkey % 40 AS VARCHAR) AS camera, arg_min(p_partkey, (p_partkey % 3, p_partkey)) AS file, min(p_partkey % 3) AS source FROM part GROUP BY p_partkey % 40")
def s01_clip_discovery(spark, sf_dir):
    """The file of each camera: of the best source, then the first by name."""
    p = table(spark, sf_dir, "part").selectExpr("concat('C', p_partkey % 40) AS camera", "p_partkey AS file", "p_partkey % 3 AS source")
    return files.first_by_priority(p, ["camera"], F.col("source"), "file").select("camera", "file", "source")


@query(f"WITH {ACTS} SELECT event_id AS act_id, CASE WHEN event_id % 10 = 3 THEN 'unknown' ELSE activity END AS activity, start_ms // 1000 AS start_frame, end_ms // 1000 AS end_frame, CAST(actor AS VARCHAR) AS actors FROM acts WHERE event_id % 10 <> 7")
def s02_activity_files(spark, sf_dir):
    """Activity files, one for each event: some without an activity, some without a whole span."""
    a = rows(spark, sf_dir, "acts")
    act = F.when(F.col("event_id") % 10 == 3, "").otherwise(F.concat(F.lit("act2: {"), "activity", F.lit(": {}}, ")))
    span = F.when(F.col("event_id") % 10 == 7, F.lit("[3]")).otherwise(F.format_string("[%d, %d]", F.expr("start_ms div 1000"), F.expr("end_ms div 1000")))
    text = F.concat(F.lit("- {act: {}}\n- {act: {"), act, F.lit("id2: "), "event_id", F.lit(", timespan: [{tsr0: "), span, F.lit("}], actors: [{id1: "), "actor", F.lit("}]}}\n"))
    got = files.parse_activities(a.select(F.col("event_id").cast("string").alias("path"), text.alias("value")))
    return got.select("act_id", "activity", "start_frame", "end_frame", F.array_join(F.col("actor_ids").cast("array<string>"), ",").alias("actors"))


@query("SELECT c_custkey AS actor_id, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE lower(c_mktsegment) END AS kind FROM customer")
def s03_type_files(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit(", cset3: {"), F.lower("c_mktsegment"), F.lit(": 1.0}")))
    text = F.concat(F.lit("- {meta: x}\n- {types: {id1: "), "c_custkey", kind, F.lit("}}\n"))
    return files.parse_types(c.select(F.lit("f").alias("path"), text.alias("value"))).select("actor_id", "kind")


@query("SELECT l_partkey AS actor_id, l_orderkey AS frame, l_suppkey - 5 AS x1, l_linenumber AS y1, l_suppkey + 30 AS x2, 40 AS y2 FROM lineitem WHERE l_linenumber <> 5")
def s05_box_files(spark, sf_dir):
    """Box files in three layouts: inline, quoted in another order, and a field on each line; entries without a box are left out."""
    line = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS a", "l_orderkey AS f", "l_linenumber AS n", "concat(l_suppkey - 5, ' ', l_linenumber, ' ', l_suppkey + 30, '.75 40') AS g")
    inline = F.concat(F.lit("- { geom: {id1: "), "a", F.lit(", id0: 1, ts0: "), "f", F.lit(", g0: "), "g", F.lit(", keyframe: true } }\n"))
    turned = F.concat(F.lit("- {'geom': {'g0': '"), "g", F.lit("', 'id0': 1, 'id1': "), "a", F.lit(", 'ts0': "), "f", F.lit("}}\n"))
    lines = F.concat(F.lit("id1: "), "a", F.lit("\nid0: 1\nts0: "), "f", F.lit("\ng0: "), "g", F.lit("\n"))
    empty = F.concat(F.lit("- { geom: {id1: "), "a", F.lit(", ts0: "), "f", F.lit("} }\n"))
    text = F.when(F.col("n") == 5, empty).when(F.col("n") % 3 == 0, inline).when(F.col("n") % 3 == 1, turned).otherwise(lines)
    return files.parse_box_texts(line.select(F.lit("f").alias("path"), text.alias("value"))).drop("path")


@query("SELECT n_nationkey AS camera, n_nationkey + 0.5 AS k0, 9.0 AS r8, CAST(n_regionkey AS DOUBLE) AS t2, CASE WHEN n_nationkey % 2 = 0 THEN 0.25 END AS d0 FROM nation")
def s10_camera_files(spark, sf_dir):
    """Camera files with and without a line of lens distortion."""
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.col("n_nationkey") + 0.5, F.lit(" 0 0\n0 1 0\n0 0 1\n\n1 2 3\n4 5 6\n7 8 9\n\n0 0 "), "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, "\n\n0.25 0 0\n").otherwise("\n"))
    got = files.parse_cameras(n.select(F.col("n_nationkey").cast("string").alias("path"), text.alias("value")))
    return got.select(F.col("path").cast("int").alias("camera"), F.col("k")[0].alias("k0"), F.col("r")[8].alias("r8"), F.col("t")[2].alias("t2"), F.get("d", F.lit(0)).alias("d0"))


@query("SELECT DISTINCT lpad(CAST(c_custkey % 50 AS VARCHAR), 4, '0') AS person, 'G' || CAST(300 + c_nationkey AS VARCHAR) AS camera FROM customer WHERE c_custkey % 9 <> 0")
def s11_sighting_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 9 == 0, F.lit("notes.txt")).otherwise(F.format_string("%04dO%03dC%dT%03dF%05d.jpg", F.col("c_custkey") % 50, F.col("c_custkey") % 7, F.col("c_nationkey") + 300, F.col("c_custkey") % 9, "c_custkey"))
    return files.sighting_names(c.select(name.alias("value")))


@query(f"WITH {ACTS} SELECT event_id, slot AS date, replace(split_part(clip, '.', 2), '.', '') AS start, split_part(clip, '.', 4) AS site, camera FROM acts")
def s12_clip_addresses(spark, sf_dir):
    a = rows(spark, sf_dir, "acts").select("event_id", F.concat(F.lit("https://a.org/x/"), "clip").alias("value"))
    return files.clip_names(a).select("event_id", "date", "start", "site", "camera")


@query("SELECT CAST(p_partkey AS VARCHAR) AS person, CASE WHEN p_partkey % 3 = 0 THEN 'wearing ' || p_brand END AS gpt, coalesce(CASE WHEN p_partkey % 2 = 0 THEN 'blue' END, 'unknown') AS upper, 'G' || p_size || ',G' || (p_size + 100) AS cameras FROM part")
def s13_person_databases(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    inner = F.struct(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("wearing "), "p_brand")).alias("gpt_description"), F.when(F.col("p_partkey") % 2 == 0, "blue").alias("primary_upper_color"), F.create_map(F.concat(F.lit("G"), F.col("p_size") + 100), F.lit("x"), F.concat(F.lit("G"), "p_size"), F.lit("y")).alias("cameras"))
    text = F.to_json(F.struct(F.create_map(F.col("p_partkey").cast("string"), inner).alias("persons")))
    got = files.parse_persons(p.select(text.alias("value")))
    # keys sort as text: G7 after G107
    return got.select("person", "gpt", "upper", F.array_join(F.array_sort(F.transform("cameras", lambda c: F.struct(F.length(c).alias("n"), c.alias("c")))).getField("c"), ",").alias("cameras"))


@query("SELECT 'e' || p_partkey AS entity, 'a person in ' || p_brand AS description FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT 'm' || p_partkey, 'a man near ' || p_brand FROM part WHERE p_partkey % 3 = 1")
def s14_description_files(spark, sf_dir):
    """Descriptions of the extractor and of a model, without generic and short ones."""
    p = table(spark, sf_dir, "part")
    said = F.when(F.col("p_partkey") % 4 == 0, F.lit("a person")).otherwise(F.concat(F.lit("a person in "), "p_brand"))
    one = F.to_json(F.struct(F.create_map(F.concat(F.lit("e"), "p_partkey"), F.struct(said.alias("description"))).alias("actors")))
    model = F.when(F.col("p_partkey") % 3 == 0, F.lit("A person")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a man near "), "p_brand")).otherwise(F.lit("a man"))
    two = F.to_json(F.struct(F.create_map(F.concat(F.lit("m"), "p_partkey"), model).alias("descriptions")))
    return files.parse_descriptions(p.select(one.alias("value"))).unionByName(files.parse_descriptions(p.select(two.alias("value")), model=True))


@query("SELECT o_orderkey AS token, min(o_orderkey) OVER (PARTITION BY o_custkey) AS head, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders")
def gr03_list_places(spark, sf_dir):
    """The place of each order in its customer's linked list."""
    from pyspark.sql import Window

    from tessera.operators.graph import checkpoint_dir

    o = table(spark, sf_dir, "orders")
    checkpoint_dir(spark)
    nodes = o.select(F.col("o_orderkey").alias("token"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("next"))
    return files.list_places(nodes)


@query(f"WITH {OBJ} SELECT CAST(scene AS VARCHAR) AS scene_token, frame AS frame_idx, CAST(obj AS VARCHAR) AS object_id, cls AS object_class, x AS x, visibility FROM obj")
def s18_scene_graphs(spark, sf_dir):
    """Scene graph documents written of the frames of each scene and read back; odd objects have only an annotation token."""
    o = rows(spark, sf_dir, "obj")
    one = F.struct(F.when(F.col("obj") % 2 == 0, F.col("obj").cast("string")).alias("object_id"), F.col("obj").cast("string").alias("annotation_token"), F.col("cls").alias("object_class"), F.array(F.col("x").cast("double"), F.col("y").cast("double"), F.lit(0.0)).alias("position"), F.col("visibility").cast("int").alias("visibility"))
    frames = o.groupBy("scene", "frame").agg(F.collect_list(one).alias("objects"))
    docs = frames.groupBy("scene").agg(F.collect_list(F.struct(F.col("frame").alias("frame_idx"), "objects")).alias("frames"))  # the frames of one scene
    text = F.to_json(F.struct(F.col("scene").cast("string").alias("scene_token"), "frames"))
    objects, _ = files.parse_scene_graphs(docs.select(text.alias("value")))
    return objects.select("scene_token", "frame_idx", "object_id", "object_class", F.col("position")[0].cast("long").alias("x"), F.col("visibility").cast("long").alias("visibility"))


@query("""WITH tr AS (SELECT c_custkey AS k, 'train' AS v, c_acctbal > 0 AS validated FROM customer WHERE c_custkey % 3 <> 0), va AS (SELECT c_custkey AS k, 'val' AS v, c_acctbal > 1000 AS validated FROM customer WHERE c_custkey % 2 = 0)
 SELECT k, coalesce(va.v, tr.v) AS v FROM tr FULL JOIN va USING (k) WHERE coalesce(va.validated, tr.validated)""")
def s19_merged_takes(spark, sf_dir):
    """Two files merged by key, the second one's rows over the first's; then only what is validated."""
    c = table(spark, sf_dir, "customer")
    tr = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS k", "'train' AS v", "c_acctbal > 0 AS validated")
    va = c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS k", "'val' AS v", "c_acctbal > 1000 AS validated")
    return files.merged_right(tr, va, ["k"]).where("validated").select("k", "v")


@query("SELECT o_custkey AS task, o_orderkey AS episode, n AS n_videos FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def s20_episodes_with_videos(spark, sf_dir):
    """Episodes that have a video, by a listing; the listing is counted before it meets them."""
    n = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("episode")).agg(F.count("*").alias("n_videos"))
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS task", "o_orderkey AS episode").join(n, "episode").select("task", "episode", "n_videos")


#: Camera numbers of a vehicle dataset.
VEHICLE_CAMERAS = {1: "FRONT", 2: "FRONT_LEFT", 3: "FRONT_RIGHT", 4: "SIDE_LEFT", 5: "SIDE_RIGHT"}


@query("SELECT l_orderkey AS key, CASE l_linenumber " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in VEHICLE_CAMERAS.items()) + " ELSE 'UNKNOWN' END AS camera, count(*) AS n FROM lineitem GROUP BY ALL")
def s21_vehicle_cameras(spark, sf_dir):
    names = F.create_map(*[x for k, v in VEHICLE_CAMERAS.items() for x in (F.lit(k), F.lit(v))])
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.coalesce(F.try_element_at(names, F.col("l_linenumber")), F.lit("UNKNOWN")).alias("camera")).groupBy("key", "camera").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT p_partkey AS cam, CASE WHEN p_partkey % 3 = 0 THEN 'mp4' ELSE 'avi' END AS ext, p_partkey FROM part UNION ALL SELECT p_partkey, 'mp4', p_partkey FROM part WHERE p_partkey % 2 = 0)
 SELECT cam, arg_min(ext, CASE WHEN ext = 'avi' THEN 0 ELSE 1 END) AS ext, cam % 5 = 0 AS has_activities FROM v WHERE cam % 7 <> 0 GROUP BY cam""")
def s24_paired_files(spark, sf_dir):
    """The video of each box file, AVI before MP4, and whether there is an activity file; cameras without boxes are left out."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cam"))
    v = p.select("cam", F.expr("if(cam % 3 = 0, 'mp4', 'avi')").alias("ext")).unionByName(p.where("cam % 2 = 0").select("cam", F.lit("mp4").alias("ext")))
    one = files.first_by_priority(v, ["cam"], F.when(F.col("ext") == "avi", 0).otherwise(1))
    return one.join(p.where("cam % 7 <> 0"), "cam").select("cam", "ext", (F.col("cam") % 5 == 0).alias("has_activities"))


@query(f"WITH {ACTS}, c AS (SELECT slot, actor, '/mp4s/' || slot || '/' || regexp_replace(regexp_replace(CASE event_id % 3 WHEN 0 THEN clip WHEN 1 THEN replace(clip, '.avi', '.mp4') ELSE replace(clip, '.r13.avi', '') END, '\\.(mp4|avi)$', ''), '\\.r13$', '') || '.r13.mp4' AS p FROM acts) SELECT slot, actor, array_to_string(list_sort(list(DISTINCT p)), ';') AS paths FROM c GROUP BY ALL")
def s25_video_paths(spark, sf_dir):
    """The videos of an actor's events, named in three ways."""
    a = rows(spark, sf_dir, "acts")
    named = F.expr("case event_id % 3 when 0 then clip when 1 then replace(clip, '.avi', '.mp4') else replace(clip, '.r13.avi', '') end")
    g = a.groupBy("slot", "actor").agg(F.collect_set(named).alias("clips"))
    return g.select("slot", "actor", F.array_join(files.video_paths(F.col("clips"), F.concat(F.lit("/mp4s/"), "slot")), ";").alias("paths"))


@query(f"WITH {OBJ}, n AS (SELECT scene, cls, count(DISTINCT obj) AS n FROM obj GROUP BY ALL), f AS (SELECT scene, count(DISTINCT frame) AS k FROM obj GROUP BY scene) SELECT n.scene, 'Scene ' || n.scene || ' has ' || k || ' frames.' || chr(10) || array_to_string(list('- ' || cls || ': ' || n ORDER BY cls), chr(10)) AS prompt FROM n JOIN f ON f.scene = n.scene GROUP BY n.scene, k")
def s26_filled_prompts(spark, sf_dir):
    """A counting prompt for each scene."""
    o = rows(spark, sf_dir, "obj")
    n = o.groupBy("scene", "cls").agg(F.count_distinct("obj").alias("n")).groupBy("scene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cls", "n"))), lambda v: F.concat(F.lit("- "), v["cls"], F.lit(": "), v["n"].cast("string"))), "\n").alias("counts"))
    f = o.groupBy("scene").agg(F.count_distinct("frame").alias("k"))
    return n.join(f, "scene").select("scene", files.filled("Scene {scene} has {frames} frames.\n{counts}", scene=F.col("scene"), frames=F.col("k"), counts=F.col("counts")).alias("prompt"))


@query(f"WITH {ACTS}, s AS (SELECT slot, count(DISTINCT camera) AS cameras, count(DISTINCT actor) AS actors, count(DISTINCT actor) FILTER (described) AS usable FROM acts GROUP BY slot) SELECT slot, cameras, actors, usable, usable * 1000 // actors AS coverage FROM s WHERE cameras >= 1")
def s28_slot_index(spark, sf_dir):
    """Slots with their cameras, actors and the share of those that can be used."""
    s = rows(spark, sf_dir, "acts").groupBy("slot").agg(F.count_distinct("camera").alias("cameras"), F.count_distinct("actor").alias("actors"), F.count_distinct(F.when(F.col("described"), F.col("actor"))).alias("usable"))
    return s.where("cameras >= 1").withColumn("coverage", F.expr("usable * 1000 div actors"))


@query(f"WITH {ACTS}, d AS (SELECT DISTINCT slot, camera FROM acts WHERE described) SELECT DISTINCT a.slot, a.camera FROM acts a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.slot = a.slot AND d.camera = a.camera)")
def j26_undescribed_cameras(spark, sf_dir):
    """Cameras of a slot that no description covers."""
    a = rows(spark, sf_dir, "acts").select("slot", "camera", "described")
    return a.select("slot", "camera").distinct().join(a.where("described").select("slot", "camera").distinct(), ["slot", "camera"], "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def j27_remaining(spark, sf_dir):
    """Orders without a result yet, where finished ones have some."""
    o = table(spark, sf_dir, "orders")
    return sinks.remaining(o.select("o_orderkey"), o.where("o_orderstatus = 'F'"), "o_orderkey")


@query(f"WITH {OBJ} SELECT scene, '## Scene ' || scene || chr(10) || '- Frames: ' || count(DISTINCT frame) || chr(10) || '- Objects: ' || count(DISTINCT obj) AS text FROM obj GROUP BY scene")
def k11_markdown(spark, sf_dir):
    o = rows(spark, sf_dir, "obj").groupBy("scene").agg(F.count_distinct("frame").alias("f"), F.count_distinct("obj").alias("o"))
    return sinks.markdown(o, "scene", "Scene", {"f": "Frames", "o": "Objects"})
