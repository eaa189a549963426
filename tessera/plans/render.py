"""Queries that render, export and prepare questions: perception, naturalised texts, manifests, takes and episodes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import wording as w
from tessera.functions.dialect import DUCK, SPARK
from tessera.operators import sweeps
from tessera.operators.intervals import band_join
from tessera.sources.adapters import table
from tessera.sources.files import merged_right
from tessera.sources.views import cte, rows

from .catalogue import query
from .words import columns

ACTS, PEOPLE, QA, OBJ = cte("acts"), cte("people"), cte("qa"), cte("obj")


def acts(spark, sf_dir):
    return rows(spark, sf_dir, "acts")


def lower_first(text: str) -> str:
    return f"lower(substr({text}, 1, 1)) || substr({text}, 2)"


columns("f01_frame_seconds", "obj", doc="Seconds of frames, with two places.", scene="scene", frame="frame", obj="obj", seconds_centi="CAST(round(round(frame / CAST(30 AS DOUBLE), 2) * 100) AS BIGINT)")
columns("f13_sane_distances", "obj", where="(x * x + y * y) * 400 <= 250000", doc="Objects within 500 m (here 25 units of 20 m).", scene="scene", frame="frame", obj="obj", dist_m="CAST(floor(sqrt((x * x + y * y) * 400)) AS BIGINT)")
columns("q22_aliases", "acts", doc="What an entity is called by its first activity.", event_id="event_id", alias=lambda d: f"CASE WHEN activity LIKE 'vehicle_%' THEN 'vehicle' ELSE 'person' END || ' ' || CAST(actor AS STRING) || ' (' || {w.phrase(d, 'activity')} || ')'")
columns(
    "q11_event_texts", "acts", doc="An event in words, without the activity where the description has it.", event_id="event_id",
    text=lambda d: f"CASE WHEN described THEN description || ', ' || {lower_first(w.gerund_phrase(d, 'activity'))} ELSE 'Someone ' || {lower_first(w.gerund_phrase(d, 'activity'))} END || CASE WHEN actor % 5 = 0 THEN ' near the school' ELSE '' END",
)
columns("h35_question_fields", "qa", doc="The text and reasoning a check reads: the naturalised one first.", question_id="question_id", text="coalesce(CASE WHEN naturalized THEN question END, 'raw ' || question)", reasoning="coalesce(nullif(reasoning, ''), 'none')")
columns(
    "q18_naturalized", "qa", where="category = 'temporal'", doc="A temporal question rebuilt of its events, with its options frozen.", question_id="question_id",
    question="'Consider two events in this multi-camera scene: (1) ' || CASE WHEN correct_idx = 0 THEN upper(substr(a_desc, 1, 1)) || substr(a_desc, 2) ELSE upper(substr(b_desc, 1, 1)) || substr(b_desc, 2) END || '. (2) ' || CASE WHEN correct_idx = 0 THEN upper(substr(b_desc, 1, 1)) || substr(b_desc, 2) ELSE upper(substr(a_desc, 1, 1)) || substr(a_desc, 2) END || '. Which event occurred first?'",
    option_a=lambda d: "replace(" + d.sub("CASE WHEN correct_idx = 0 THEN a_desc ELSE b_desc END", "^[aA] ", "The ") + ", '.', '') || ' occurred first'",
)
columns("h20_exports", "qa", doc="Site, camera names and answer letter of an exported question.", question_id="question_id", site=lambda d: d.extract("slot || '.11-05.school'", r"\.([a-z]+)$"), camera_names="a_camera || '=Camera ' || a_camera || ';' || b_camera || '=Camera ' || b_camera", letter="CASE WHEN correct_idx BETWEEN 0 AND 3 THEN chr(65 + CAST(correct_idx AS INT)) ELSE 'A' END", difficulty="coalesce(nullif(proximity, 'far'), 'medium')")
columns("h02_person_labels", "people", doc="A person in a few words, with what they carry.", id="id", text="CASE WHEN gpt <> '' THEN 'a person ' || gpt WHEN upper <> 'unknown' THEN 'a person in ' || upper ELSE 'a person' END || CASE WHEN accessories LIKE '%backpack%' THEN ' with a backpack' ELSE '' END")


@query(f"WITH {ACTS}, c AS (SELECT event_id, slot, activity, camera, row_number() OVER (PARTITION BY slot ORDER BY start_ms, camera, event_id) AS place FROM acts) SELECT * FROM c")
def s04_slot_events(spark, sf_dir):
    """The events of all cameras of a slot in order of time."""
    a = acts(spark, sf_dir).select("event_id", "slot", "activity", "camera", "start_ms")
    return a.withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy("start_ms", "camera", "event_id"))).drop("start_ms")


@query("SELECT l_orderkey AS sample, l_linenumber AS annotation, o_custkey AS scene, p_type AS category, s_name AS instance, c_mktsegment AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey")
def s16_linked_tables(spark, sf_dir):
    """Tables linked by tokens: each annotation with its sample, scene, category and instance.  The fact table meets small ones, which
    Spark broadcasts if their sizes allow."""
    t = lambda n: table(spark, sf_dir, n)
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    got = l.join(t("orders").select("o_orderkey", "o_custkey"), F.expr("o_orderkey = l_orderkey")).join(t("part").select("p_partkey", "p_type"), F.expr("p_partkey = l_partkey"))
    got = got.join(t("supplier").select("s_suppkey", "s_name"), F.expr("s_suppkey = l_suppkey")).join(t("customer").select("c_custkey", "c_mktsegment"), F.expr("c_custkey = o_custkey"))
    return got.select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("annotation"), F.col("o_custkey").alias("scene"), F.col("p_type").alias("category"), F.col("s_name").alias("instance"), F.col("c_mktsegment").alias("place"))


@query(f"""WITH {ACTS}, p AS (SELECT a.slot, a.event_id AS a_event_id, b.event_id AS b_event_id, b.start_ms - a.end_ms AS gap_ms FROM acts a JOIN acts b ON a.slot = b.slot AND a.camera <> b.camera AND b.start_ms - a.end_ms BETWEEN 1000 AND 90000)
 SELECT * FROM p WHERE gap_ms <= 60000 OR slot NOT IN (SELECT slot FROM p WHERE gap_ms <= 60000 GROUP BY slot HAVING count(*) >= 2)""")
def j03_gap_fallback(spark, sf_dir):
    """Pairs within a minute; where a slot has fewer than two, those within a minute and a half."""
    a = acts(spark, sf_dir).select("slot", "event_id", "camera", "start_ms", "end_ms")
    p = band_join(a, a, ["slot"], "end_ms", "start_ms", 1_000, 90_000).where("a_camera <> b_camera").select("slot", "a_event_id", "b_event_id", "gap_ms")
    enough = p.where("gap_ms <= 60000").groupBy("slot").agg(F.count("*").alias("n")).where("n >= 2").select("slot")
    return p.where("gap_ms <= 60000").unionByName(p.where("gap_ms > 60000").join(enough, "slot", "left_anti"))


@query(f"WITH {ACTS}, k AS (SELECT DISTINCT slot || '.' || split_part(clip, '.', 2) AS long_slot, substr(split_part(clip, '.', 2), 1, 5) AS hhmm, slot FROM acts), s AS (SELECT DISTINCT slot || '.' || substr(split_part(clip, '.', 2), 1, 5) AS short_slot FROM acts) SELECT short_slot, count(*) AS n, min(long_slot) AS first_slot FROM s JOIN k ON short_slot = k.slot || '.' || hhmm GROUP BY short_slot")
def j12_slot_names(spark, sf_dir):
    """Slots named to the minute with those named to the second, by a normalised key."""
    long = acts(spark, sf_dir).select(F.concat_ws(".", "slot", F.split_part("clip", F.lit("."), F.lit(2))).alias("long_slot")).distinct()
    return long.groupBy(F.regexp_replace("long_slot", "-[0-9]+$", "").alias("short_slot")).agg(F.count("*").alias("n"), F.min("long_slot").alias("first_slot"))


@query("""WITH ks AS (SELECT l_orderkey AS take, l_linenumber AS step, l_shipdate AS t, l_suppkey % 7 AS category FROM lineitem), tx AS (SELECT n_nationkey AS node, n_regionkey AS parent, n_name AS name FROM nation WHERE n_nationkey % 7 <> 6)
 SELECT take, step, category, tx.name, r_name AS ancestor, o_orderstatus AS split FROM ks JOIN orders ON o_orderkey = take LEFT JOIN tx ON tx.node = ks.category LEFT JOIN region ON r_regionkey = tx.parent WHERE o_orderstatus <> 'P'""")
def j25_keysteps(spark, sf_dir):
    """Keysteps of takes with their taxonomy node, its ancestor and the split; steps of unknown nodes stay."""
    t = lambda n: table(spark, sf_dir, n)
    ks = t("lineitem").selectExpr("l_orderkey AS take", "l_linenumber AS step", "l_suppkey % 7 AS category")
    tx = t("nation").where("n_nationkey % 7 <> 6").join(t("region"), F.expr("r_regionkey = n_regionkey"), "left").selectExpr("cast(n_nationkey as long) AS category", "n_name AS name", "r_name AS ancestor")
    o = t("orders").where("o_orderstatus <> 'P'").selectExpr("o_orderkey AS take", "o_orderstatus AS split")
    return ks.join(o, "take").join(F.broadcast(tx), "category", "left").select("take", "step", "category", "name", "ancestor", "split")


@query(f"WITH {ACTS}, cl AS (SELECT DISTINCT actor, actor % 40 AS cluster FROM acts WHERE actor % 3 <> 0) SELECT a.slot, a.event_id AS a_event_id, b.event_id AS b_event_id, coalesce(ca.cluster = cb.cluster, false) AS same_cluster FROM acts a JOIN acts b ON a.slot = b.slot AND a.camera <> b.camera AND b.start_ms - a.end_ms BETWEEN 1000 AND 60000 LEFT JOIN cl ca ON ca.actor = a.actor LEFT JOIN cl cb ON cb.actor = b.actor")
def j29_same_cluster(spark, sf_dir):
    """Whether the actors of two events are of one cluster (here by number; every third has none)."""
    a = acts(spark, sf_dir).select("slot", "event_id", "camera", "actor", "start_ms", "end_ms").withColumn("cluster", F.expr("case when actor % 3 <> 0 then actor % 40 end"))
    p = band_join(a, a, ["slot"], "end_ms", "start_ms", 1_000, 60_000).where("a_camera <> b_camera")
    return p.select("slot", "a_event_id", "b_event_id", F.coalesce(F.col("a_cluster") == F.col("b_cluster"), F.lit(False)).alias("same_cluster"))


_STOP = "a an the in on with and of wearing carrying person someone individual".split()
_DTOK = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(told), '[^a-z0-9_ ]', ' ', 'g'), ' +'), lambda t: length(t) > 1 AND t NOT IN (" + ", ".join(f"'{s}'" for s in _STOP) + ")))"


@query(f"WITH {ACTS}, t AS (SELECT slot, event_id, camera, start_ms, end_ms, {_DTOK} AS s FROM acts) SELECT a.event_id AS a_event_id, b.event_id AS b_event_id, len(list_intersect(a.s, b.s)) * 1000 // len(list_distinct(list_concat(a.s, b.s))) AS overlap_milli FROM t a JOIN t b ON a.slot = b.slot AND a.camera <> b.camera AND b.start_ms - a.end_ms BETWEEN 1000 AND 300000")
def x03_description_overlap(spark, sf_dir):
    """Overlap of the words of two sightings' descriptions, without stop words and single letters."""
    import re

    def words(told: str) -> list[str]:
        return [t for t in re.sub("[^a-z0-9_ ]", " ", told.lower()).split(" ") if len(t) > 1 and t not in _STOP]

    return sweeps.set_overlaps(acts(spark, sf_dir), "slot", "camera", "event_id", "told", words, "end_ms", "start_ms", 1_000, 300_000)


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), m AS (SELECT a.k, b.k IS NOT NULL AS both_ FROM a LEFT JOIN b ON a.k = b.k)
 SELECT count(*) AS n_left, count(*) FILTER (both_) AS n_both, count(*) FILTER (NOT both_) AS n_only, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) = 0 AS is_subset, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n_union FROM m""")
def set01_operations(spark, sf_dir):
    """Intersection, difference, union and subset of two key sets."""
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).distinct()
    both = merged_right(a.withColumn("side", F.lit(1)), b.withColumn("side", F.lit(3)).join(a, "k", "left_semi"), ["k"])
    only_b = b.join(a, "k", "left_anti")
    sides = both.unionByName(only_b.withColumn("side", F.lit(2)))
    return sides.agg(F.count_if(F.expr("side in (1, 3)")).alias("n_left"), F.count_if(F.expr("side = 3")).alias("n_both"), F.count_if(F.expr("side = 1")).alias("n_only"), (F.count_if(F.expr("side = 2")) == 0).alias("is_subset"), F.count("*").alias("n_union"))


_CAMS_OF = f"{ACTS}, hr AS (SELECT * REPLACE (slot || '.' || (start_ms // 14400000) AS slot) FROM acts), ac AS (SELECT slot, activity, list_sort(list(DISTINCT camera)) AS cams FROM hr GROUP BY ALL), al AS (SELECT slot, list_sort(list(DISTINCT camera)) AS cameras FROM hr GROUP BY slot)"


def quarters(spark, sf_dir):
    """Events in slots of four hours."""
    return acts(spark, sf_dir).withColumn("slot", F.concat_ws(".", "slot", F.expr("start_ms div 14400000").cast("string")))


_Q8 = "list_transform(list_sort([{'h': md5('42::' || ac.slot || '::' || activity || '::' || c), 'c': c} FOR c IN cameras IF NOT list_contains(cams, c)]), lambda v: v.c)[1:3]"


@query(f"WITH {_CAMS_OF}, q AS (SELECT ac.slot, activity, cams[1] AS answer, {_Q8} AS others FROM ac JOIN al ON al.slot = ac.slot WHERE len(cams) <= 3) SELECT slot, activity, 'Which camera captures a person ' || {lower_first(w.gerund_phrase(DUCK, 'activity'))} || '?' AS question, answer, array_to_string(others, ',') AS others FROM q WHERE len(others) >= 2")
def q08_which_camera(spark, sf_dir):
    """Activities of three cameras at most, against cameras that have none of them."""
    a = quarters(spark, sf_dir)
    ac = a.groupBy("slot", "activity").agg(F.array_sort(F.collect_set("camera")).alias("cams")).where("size(cams) <= 3")
    al = a.groupBy("slot").agg(F.collect_set("camera").alias("cameras"))
    by_hash = F.array_sort(F.transform(F.array_except("cameras", "cams"), lambda c: F.struct(F.md5(F.concat_ws("::", F.lit("42"), "slot", "activity", c)).alias("h"), c.alias("c"))))
    q = ac.join(al, "slot").withColumn("others", F.transform(F.slice(by_hash, 1, 3), lambda v: v["c"])).where("size(others) >= 2")
    return q.select("slot", "activity", F.expr(f"'Which camera captures a person ' || {lower_first(w.gerund_phrase(SPARK, 'activity'))} || '?'").alias("question"), F.col("cams")[0].alias("answer"), F.array_join("others", ",").alias("others"))


@query(f"WITH {ACTS}, c AS (SELECT slot, camera, activity FROM acts GROUP BY ALL), k AS (SELECT slot, camera, count(*) AS n, arg_min(activity, md5('42::' || slot || '::' || camera || '::' || activity)) AS activity FROM c GROUP BY ALL HAVING count(*) >= 2) SELECT slot, camera, 'What activity is occurring on camera ' || camera || '?' AS question, {w.phrase(DUCK, 'activity')} AS answer, n FROM k")
def q08_activity_identification(spark, sf_dir):
    c = acts(spark, sf_dir).select("slot", "camera", "activity").distinct()
    k = c.groupBy("slot", "camera").agg(F.count("*").alias("n"), F.min(F.struct(F.md5(F.concat_ws("::", F.lit("42"), "slot", "camera", "activity")).alias("h"), "activity"))["activity"].alias("activity")).where("n >= 2")
    return k.select("slot", "camera", F.concat(F.lit("What activity is occurring on camera "), "camera", F.lit("?")).alias("question"), F.expr(w.phrase(SPARK, "activity")).alias("answer"), "n")


@query(f"WITH {_CAMS_OF} SELECT slot, activity, array_to_string(cams[1:2], ' and ') AS pair, len(cams) AS n FROM ac WHERE len(cams) >= 2")
def q08_multi_camera(spark, sf_dir):
    """Activities that two cameras confirm."""
    ac = quarters(spark, sf_dir).groupBy("slot", "activity").agg(F.array_sort(F.collect_set("camera")).alias("cams")).where("size(cams) >= 2")
    return ac.select("slot", "activity", F.array_join(F.slice("cams", 1, 2), " and ").alias("pair"), F.size("cams").cast("long").alias("n"))


#: Colours that wrong answers are taken from.
UPPERS = "black white blue red green gray yellow brown orange purple navy beige khaki".split()
LOWERS = "black blue dark gray brown khaki white green red beige navy".split()
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""WITH {PEOPLE}, a AS (SELECT id, CASE WHEN upper <> 'unknown' AND (lower = 'unknown' OR substr(md5('42::' || id), 1, 1) < '8') THEN 'upper' ELSE 'lower' END AS part, * EXCLUDE (id) FROM people WHERE upper <> 'unknown' OR lower <> 'unknown'),
 b AS (SELECT id, part, CASE part WHEN 'upper' THEN upper ELSE lower END AS answer, CASE part WHEN 'upper' THEN {_LIST(UPPERS)} ELSE {_LIST(LOWERS)} END AS pool FROM a)
 SELECT id, part, answer, array_to_string(list_transform(list_sort([{{'h': md5('42::' || id || '::' || c), 'c': c}} FOR c IN pool IF c <> answer]), lambda v: v.c)[1:3], ',') AS others FROM b""")
def q10_attribute_options(spark, sf_dir):
    """A colour of each person, of the upper or the lower garment, against three others."""
    p = rows(spark, sf_dir, "people").where("upper <> 'unknown' or lower <> 'unknown'").withColumn("part", F.expr("case when upper <> 'unknown' and (lower = 'unknown' or substr(md5('42::' || id), 1, 1) < '8') then 'upper' else 'lower' end"))
    p = p.withColumns({"answer": F.expr("if(part = 'upper', upper, lower)"), "pool": F.when(F.col("part") == "upper", F.array(*map(F.lit, UPPERS))).otherwise(F.array(*map(F.lit, LOWERS)))})
    ranked = F.array_sort(F.transform(F.filter("pool", lambda c: c != F.col("answer")), lambda c: F.struct(F.md5(F.concat_ws("::", F.lit("42"), F.col("id").cast("string"), c)).alias("h"), c.alias("c"))))
    return p.select("id", "part", "answer", F.array_join(F.transform(F.slice(ranked, 1, 3), lambda v: v["c"]), ",").alias("others"))


@query(f"""WITH {QA}, g AS (SELECT question_id, slot, category, n, CASE category WHEN 'temporal' THEN question || '|' || a_desc || '|' || b_desc WHEN 'spatial' THEN a_desc || '|' || b_desc WHEN 'best_camera' THEN coalesce(correct_camera, '') || '|' || coalesce(question_type, '') WHEN 'counting' THEN question || '|' || coalesce(question_type, '') WHEN 'summarization' THEN coalesce(question_type, '') ELSE question_id END AS k FROM qa)
 SELECT question_id, row_number() OVER (PARTITION BY slot, category, k ORDER BY n) = 1 AS kept FROM g""")
def g09_category_dedup(spark, sf_dir):
    """The first question of a slot for each key of its category."""
    key = F.expr("case category when 'temporal' then question || '|' || a_desc || '|' || b_desc when 'spatial' then a_desc || '|' || b_desc when 'best_camera' then coalesce(correct_camera, '') || '|' || coalesce(question_type, '') when 'counting' then question || '|' || coalesce(question_type, '') when 'summarization' then coalesce(question_type, '') else question_id end")
    q = rows(spark, sf_dir, "qa").withColumn("k", key)
    return q.withColumn("r", F.row_number().over(Window.partitionBy("slot", "category", "k").orderBy("n"))).select("question_id", (F.col("r") == 1).alias("kept"))


@query(f"WITH {ACTS}, c AS (SELECT slot, activity, count(*) AS n, count(DISTINCT camera) AS m FROM acts GROUP BY ALL HAVING count(*) BETWEEN 2 AND 20), k AS (SELECT *, split_part(activity, '_', 1) AS subtype, CASE WHEN n BETWEEN 3 AND 10 THEN 30 WHEN n < 3 THEN 15 ELSE 5 END + CASE WHEN m >= 2 THEN 20 ELSE 0 END AS score FROM c) SELECT slot, subtype, activity, n, score FROM k QUALIFY row_number() OVER (PARTITION BY slot, subtype ORDER BY score DESC, activity) = 1")
def g10_counting_pick(spark, sf_dir):
    """The best counting candidate of each subtype of a slot (T3): no two of one subtype or activity."""
    c = acts(spark, sf_dir).groupBy("slot", "activity").agg(F.count("*").alias("n"), F.count_distinct("camera").alias("m")).where("n between 2 and 20")
    k = c.withColumns({"subtype": F.split_part("activity", F.lit("_"), F.lit(1)), "score": F.expr("case when n between 3 and 10 then 30 when n < 3 then 15 else 5 end + case when m >= 2 then 20 else 0 end")})
    return k.groupBy("slot", "subtype").agg(F.min(F.struct((-F.col("score")).alias("s"), "activity", "n")).alias("b")).select("slot", "subtype", "b.activity", "b.n", (-F.col("b.s")).alias("score"))


@query(f"WITH {ACTS}, v AS (SELECT slot, actor, camera, count(*) AS n FROM acts GROUP BY ALL), e AS (SELECT slot, actor, 'scene' AS kind FROM v GROUP BY ALL HAVING count(*) >= 1 UNION ALL SELECT DISTINCT slot, actor, 'single' FROM v UNION ALL SELECT DISTINCT slot, actor, 'multiple' FROM v WHERE n >= 2) SELECT slot, actor, kind, row_number() OVER (PARTITION BY slot, actor ORDER BY md5('42::' || slot || '::' || actor || '::' || kind)) AS turn FROM e")
def g11_camera_subtypes(spark, sf_dir):
    """The kinds of camera questions that a video allows, in the order they are asked, each once (F16)."""
    v = acts(spark, sf_dir).groupBy("slot", "actor", "camera").agg(F.count("*").alias("n")).groupBy("slot", "actor").agg(F.max("n").alias("n"))
    e = v.select("slot", "actor", F.explode(F.expr("filter(array('scene', 'single', if(n >= 2, 'multiple', null)), k -> k is not null)")).alias("kind"))
    h = F.md5(F.concat_ws("::", F.lit("42"), "slot", F.col("actor").cast("string"), "kind"))
    return e.withColumn("turn", F.row_number().over(Window.partitionBy("slot", "actor").orderBy(h)))


@query(f"""WITH {ACTS}, o AS (SELECT *, row_number() OVER (PARTITION BY slot, actor ORDER BY start_ms, event_id) AS i, count(*) OVER (PARTITION BY slot, actor) AS n FROM acts), p AS (SELECT slot, actor, 1 + CAST('0x' || substr(md5('42::' || slot || '::' || actor), 1, 6) AS BIGINT) % (n - 1) AS i FROM o WHERE n >= 2 AND i = 1)
 SELECT p.slot, p.actor, a.event_id AS a_event_id, b.event_id AS b_event_id, 'In the video of actor ' || p.actor || ', what follows "' || {w.phrase(DUCK, 'a.activity')} || '"? (Answer: ' || {w.phrase(DUCK, 'b.activity')} || ')' AS prompt FROM p JOIN o a ON a.slot = p.slot AND a.actor = p.actor AND a.i = p.i JOIN o b ON b.slot = p.slot AND b.actor = p.actor AND b.i = p.i + 1""")
def q16_episode_prompts(spark, sf_dir):
    """Two consecutive actions of each episode (here an actor's), by hash, as a prompt."""
    k = Window.partitionBy("slot", "actor")
    o = acts(spark, sf_dir).withColumns({"i": F.row_number().over(k.orderBy("start_ms", "event_id")), "n": F.count("*").over(k), "b_event_id": F.lead("event_id").over(k.orderBy("start_ms", "event_id")), "next": F.lead("activity").over(k.orderBy("start_ms", "event_id"))})
    at = 1 + F.conv(F.substring(F.md5(F.concat_ws("::", F.lit("42"), "slot", F.col("actor").cast("string"))), 1, 6), 16, 10).cast("long") % (F.col("n") - 1)
    p = o.where(F.col("n") >= 2).where(F.col("i") == at)
    text = F.expr(f"'In the video of actor ' || actor || ', what follows \"' || {w.phrase(SPARK, 'activity')} || '\"? (Answer: ' || {w.phrase(SPARK, 'next')} || ')'")
    return p.select("slot", "actor", F.col("event_id").alias("a_event_id"), "b_event_id", text.alias("prompt"))


@query(f"WITH {OBJ}, c AS (SELECT scene, frame, cls, count(*) AS n, min(obj) AS obj FROM obj GROUP BY ALL), u AS (SELECT scene, frame, cls, obj FROM c WHERE n = 1) SELECT scene, frame, arg_min(obj, md5('42::' || scene || '::' || frame || '::' || obj)) AS obj, count(*) AS n_unique FROM u GROUP BY ALL HAVING count(*) >= 2")
def q21_unique_class(spark, sf_dir):
    """An object of each frame that is the only one of its class, where two are; by hash."""
    u = rows(spark, sf_dir, "obj").groupBy("scene", "frame", "cls").agg(F.count("*").alias("n"), F.min("obj").alias("obj")).where("n = 1")
    h = F.md5(F.concat_ws("::", F.lit("42"), F.col("scene").cast("string"), F.col("frame").cast("string"), F.col("obj").cast("string")))
    return u.groupBy("scene", "frame").agg(F.min(F.struct(h.alias("h"), "obj"))["obj"].alias("obj"), F.count("*").alias("n_unique")).where("n_unique >= 2")


@query(f"""WITH {QA}, e AS (SELECT question_id, a_camera AS camera, a_start AS s, a_end AS t FROM qa WHERE category IN ('temporal', 'spatial') UNION ALL SELECT question_id, b_camera, b_start, b_start + 4 FROM qa WHERE category IN ('temporal', 'spatial') UNION ALL SELECT question_id, a_camera, o1, o1 + 3 FROM qa WHERE category = 'event_ordering'
 UNION ALL SELECT question_id, a_camera, o2, o2 + 3 FROM qa WHERE category = 'event_ordering' UNION ALL SELECT question_id, a_camera, NULL, NULL FROM qa WHERE category IN ('summarization', 'counting', 'best_camera')) SELECT question_id, camera, greatest(0, min(s) - 5) AS from_s, max(t) + 5 AS to_s FROM e GROUP BY ALL""")
def q23_render_manifest(spark, sf_dir):
    """What would be rendered of each question: cameras with the range of its events and five seconds around (K10); whole clips where it
    names none."""
    q = rows(spark, sf_dir, "qa")
    none = F.lit(None).cast("long")
    one = lambda c, s, t: F.struct(F.col(c).alias("camera"), s.alias("s"), t.alias("t"))
    pair = F.array(one("a_camera", F.col("a_start"), F.col("a_end")), one("b_camera", F.col("b_start"), F.col("b_start") + 4))
    chain = F.array(one("a_camera", F.col("o1"), F.col("o1") + 3), one("a_camera", F.col("o2"), F.col("o2") + 3))
    e = q.select("question_id", F.inline(F.when(F.col("category").isin("temporal", "spatial"), pair).when(F.col("category") == "event_ordering", chain).otherwise(F.array(one("a_camera", none, none)))))
    # the greatest of a null and a number is the number: a range without events stays null
    g = e.groupBy("question_id", "camera").agg(F.min("s").alias("s"), F.max("t").alias("t"))
    return g.select("question_id", "camera", F.greatest(F.lit(0).cast("long"), F.col("s") - 5).alias("from_s"), (F.col("t") + 5).alias("to_s"))


@query(f"WITH {ACTS}, e AS (SELECT slot, actor, max(CASE WHEN described THEN 1 ELSE 0 END) AS visual, count(*) AS n FROM acts GROUP BY ALL) SELECT slot, actor, row_number() OVER (PARTITION BY slot ORDER BY visual DESC, md5('42::' || slot || '::' || actor)) AS turn FROM e QUALIFY turn <= 5")
def t04_visual_first(spark, sf_dir):
    """Candidates of a slot, those with a visual description first, by hash in each class; the first five."""
    e = acts(spark, sf_dir).groupBy("slot", "actor").agg(F.max(F.col("described").cast("int")).alias("visual"))
    h = F.md5(F.concat_ws("::", F.lit("42"), "slot", F.col("actor").cast("string")))
    return e.withColumn("turn", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("visual"), h))).where("turn <= 5").select("slot", "actor", "turn")


@query(f"WITH {ACTS}, s AS (SELECT slot, actor, count(DISTINCT camera) AS n FROM acts GROUP BY ALL), t AS (SELECT slot, count(*) FILTER (n >= 2) AS shared FROM s GROUP BY slot) SELECT count(*) AS n_slots, count(*) FILTER (shared > 0) AS n_supported, max(shared) AS most, CAST(floor(sum(shared) * 10.0 / count(*)) AS BIGINT) AS mean_tenths FROM t")
def a20_sighting_summary(spark, sf_dir):
    s = acts(spark, sf_dir).groupBy("slot", "actor").agg(F.count_distinct("camera").alias("n")).groupBy("slot").agg(F.count_if(F.expr("n >= 2")).alias("shared"))
    return s.agg(F.count("*").alias("n_slots"), F.count_if(F.expr("shared > 0")).alias("n_supported"), F.max("shared").alias("most"), F.floor(F.sum("shared") * F.lit(10.0) / F.count("*")).alias("mean_tenths"))


@query("SELECT source, count(*) AS n, count(*) FILTER (n_chars > 200) AS n_success, count(*) FILTER (n_chars <= 200) AS n_failed, CAST(sum(n_chars) AS BIGINT) AS chars, arg_min(doc_id, n_chars * 10000000 + doc_id) AS worst FROM documents GROUP BY source")
def a22_batch_summary(spark, sf_dir):
    """How many items of each batch succeeded (here by length), and the worst one."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.expr("n_chars > 200")).alias("n_success"), F.count_if(F.expr("n_chars <= 200")).alias("n_failed"), F.sum("n_chars").alias("chars"), F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("worst"))


@query(f"WITH {ACTS}, a AS (SELECT slot, camera, description, count(*) AS n FROM (SELECT DISTINCT slot, camera, actor, description FROM acts) GROUP BY ALL), m AS (SELECT acts.event_id, acts.slot, a.n FROM acts JOIN a ON a.slot = acts.slot AND a.camera = acts.camera AND a.description = acts.description) SELECT slot, event_id, n FROM m QUALIFY row_number() OVER (PARTITION BY slot ORDER BY n DESC, event_id) <= 5")
def a12_worst_ambiguities(spark, sf_dir):
    """The five events of each slot whose description most entities of their camera share."""
    e = acts(spark, sf_dir)
    n = e.select("slot", "camera", "actor", "description").distinct().groupBy("slot", "camera", "description").agg(F.count("*").alias("n"))
    m = e.join(n, ["slot", "camera", "description"]).select("slot", "event_id", "n")
    return m.withColumn("r", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("n"), "event_id"))).where("r <= 5").drop("r")


@query(f"WITH {OBJ}, r AS (SELECT scene, obj, frame, x1, y1, x2, y2, CASE WHEN (y2 - y1) > 0 THEN (y1 + (y2 - y1) * 10 // 100) END AS u0, y1 + (y2 - y1) * 45 // 100 AS u1, y1 + (y2 - y1) * 55 // 100 AS l0, y1 + (y2 - y1) * 90 // 100 AS l1 FROM obj WHERE y2 - y1 >= 80) SELECT scene, obj, frame, u0, u1, l0, l1, x1 + greatest(1, (x2 - x1) // 10) AS left_, x2 - greatest(1, (x2 - x1) // 10) AS right_ FROM r QUALIFY row_number() OVER (PARTITION BY scene ORDER BY y2 - y1 DESC, obj, frame) <= 200")
def h10_crop_regions(spark, sf_dir):
    """The rows of a crop's upper and lower garment, and its inner columns; crops of 80 pixels or more, the tallest 200 of a scene."""
    r = rows(spark, sf_dir, "obj").where("y2 - y1 >= 80").withColumns({"hgt": F.expr("y2 - y1"), "m": F.expr("greatest(1, (x2 - x1) div 10)")})
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("scene").orderBy(F.desc("hgt"), "obj", "frame"))).where("k <= 200")
    at = lambda p: F.expr(f"y1 + hgt * {p} div 100")
    return r.select("scene", "obj", "frame", at(10).alias("u0"), at(45).alias("u1"), at(55).alias("l0"), at(90).alias("l1"), F.expr("x1 + m").alias("left_"), F.expr("x2 - m").alias("right_"))


@query(f"WITH {QA} SELECT CASE n % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' ELSE 'skip' END AS verdict, category, count(*) AS n FROM qa GROUP BY ALL")
def h28_verdict_tally(spark, sf_dir):
    q = rows(spark, sf_dir, "qa").select(F.expr("case n % 3 when 0 then 'good' when 1 then 'bad' else 'skip' end").alias("verdict"), "category")
    return q.groupBy("verdict", "category").agg(F.count("*").alias("n"))


_MID = "CAST((start_ms + end_ms - (start_ms + end_ms) % 2) / 2 AS BIGINT)"


@query(f"""WITH {ACTS}, m AS (SELECT slot, event_id, camera, activity, {_MID} AS mid, (event_id * 7) % 60 AS x, (event_id * 11) % 60 AS y FROM acts) SELECT a.event_id AS a_event_id, b.event_id AS b_event_id, CAST(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 10) AS BIGINT) AS dist_dm
 FROM m a JOIN m b ON a.slot = b.slot AND a.camera <> b.camera AND b.mid - a.mid BETWEEN 0 AND 60000 AND (b.mid > a.mid OR b.event_id > a.event_id)""")
def h29_midpoint_distances(spark, sf_dir):
    """Distances of the places of events of two cameras whose middles are within a minute."""
    m = acts(spark, sf_dir).selectExpr("slot", "event_id", "camera", f"{_MID} AS mid", "(event_id * 7) % 60 AS x", "(event_id * 11) % 60 AS y")
    p = band_join(m, m, ["slot"], "mid", "mid", 0, 60_000).where("a_camera <> b_camera and (gap_ms > 0 or b_event_id > a_event_id)")
    return p.select("a_event_id", "b_event_id", F.expr("floor(sqrt((a_x - b_x) * (a_x - b_x) + (a_y - b_y) * (a_y - b_y)) * 10)").alias("dist_dm"))


def _persons(spark, sf_dir):
    """When each person was first and last seen by a camera of a slot."""
    return acts(spark, sf_dir).where("activity like 'person_%'").groupBy("slot", "camera", "actor").agg(F.min("start_ms").alias("t0"), F.max("end_ms").alias("t1"))


@query(f"WITH {ACTS}, e AS (SELECT slot, camera, actor, min(start_ms) AS t0, max(end_ms) AS t1 FROM acts WHERE activity LIKE 'person_%' GROUP BY ALL), l AS (SELECT a.slot, a.actor AS a_actor, b.actor AS b_actor, a.camera AS a_camera, b.camera AS b_camera, b.t0 - a.t1 AS gap_ms, greatest(40, 100 - CAST(round((b.t0 - a.t1) / 600.0) AS BIGINT)) AS confidence FROM e a JOIN e b ON a.slot = b.slot AND a.camera <> b.camera AND b.t0 - a.t1 BETWEEN 1000 AND 60000) SELECT * FROM l")
def j04_person_handoffs(spark, sf_dir):
    """Handoffs of persons between cameras within a minute, with their confidence in hundredths."""
    e = _persons(spark, sf_dir)
    p = band_join(e, e, ["slot"], "t1", "t0", 1_000, 60_000).where("a_camera <> b_camera")
    return p.select("slot", "a_actor", "b_actor", "a_camera", "b_camera", "gap_ms", F.greatest(F.lit(40).cast("long"), 100 - F.round(F.col("gap_ms") / F.lit(600.0)).cast("long")).alias("confidence"))


@query()
def gr01_person_clusters(spark, sf_dir):
    """Clusters of sightings linked by handoffs of confidence 70 or more, of two cameras at least; named by their least sighting."""
    from tessera.operators.sweeps import band_components

    # a confidence of 70 is a gap of less than 30.5 steps of 600 ms
    e = _persons(spark, sf_dir).withColumn("sighting", F.row_number().over(Window.partitionBy("slot").orderBy("camera", "actor")).cast("long"))
    c = band_components(e, "slot", "camera", "sighting", "t1", "t0", 1_000, 18_299)
    g = c.groupBy("slot", "component").agg(F.count("*").alias("n"), F.count_distinct("camera").alias("n_cameras"), F.min(F.concat_ws("_", "camera", F.lit("actor"), F.col("actor").cast("string"))).alias("first_entity"))
    return g.where("n >= 2 and n_cameras >= 2").drop("component")
