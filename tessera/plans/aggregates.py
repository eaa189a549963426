"""Queries of aggregations and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import RULES, rule_hit
from tessera.operators.intervals import first_by
from tessera.sources.adapters import table

from .catalogue import EN, EV, query
from .temporal import events_of


@query("WITH " + EV + " SELECT slot, activity, camera_id, count(*) AS n_events, count(DISTINCT actor_id) AS n_actors, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM ev GROUP BY GROUPING SETS ((slot, activity), (slot, camera_id), (slot))")
def a01_scene_analysis(spark, sf_dir):
    e = events_of(spark, sf_dir)
    sets = e.groupingSets([["slot", "activity"], ["slot", "camera_id"], ["slot"]], "slot", "activity", "camera_id")
    return sets.agg(F.count("*").alias("n_events"), F.count_distinct("actor_id").alias("n_actors"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


@query("WITH " + EV + " SELECT slot, activity, count(*) AS n_events, count(DISTINCT camera_id) AS n_cameras FROM ev GROUP BY ALL")
def a03_activity_count(spark, sf_dir):
    return events_of(spark, sf_dir).groupBy("slot", "activity").agg(F.count("*").alias("n_events"), F.count_distinct("camera_id").alias("n_cameras"))


@query("SELECT p_brand, count(DISTINCT l_partkey) AS n_parts, count(*) AS n_lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def a04_distinct_objects(spark, sf_dir):
    # lines are summed by part before they meet the parts, so a part is one row in the join
    per = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return per.join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n_parts"), F.sum("n").alias("n_lines"))


@query("SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) * 1000 // count(*) AS BIGINT) AS mean_milli, count(*) AS n_seen FROM lineitem GROUP BY l_partkey")
def a05_avg_position(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.expr("sum(cast(l_quantity as bigint)) * 1000 div count(*)").alias("mean_milli"), F.count("*").alias("n_seen"))


@query("WITH " + EV + """, v AS (SELECT slot, camera_id, activity, count(*) AS n, min((start_ms, event_id)) AS f FROM ev WHERE activity <> 'error' GROUP BY ALL)
 SELECT slot, camera_id, activity AS winner, n * 100 // total AS percent FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY slot, camera_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY slot, camera_id ORDER BY n DESC, f) AS r FROM v) WHERE r = 1""")
def a08_majority_vote(spark, sf_dir):
    v = events_of(spark, sf_dir).where("activity <> 'error'").groupBy("slot", "camera_id", "activity").agg(F.count("*").alias("n"), F.min(F.struct("start_ms", "event_id")).alias("f"))
    best = F.min_by("activity", F.struct(-F.col("n"), "f")).alias("winner")
    return v.groupBy("slot", "camera_id").agg(best, F.expr("max(n) * 100 div sum(n)").alias("percent"))


@query("""WITH v AS (SELECT source, quality, count(*) AS n, min(d.doc_id) AS f FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY ALL)
 SELECT source, quality AS winner FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS r FROM v) WHERE r = 1""")
def a09_group_vote(spark, sf_dir):
    v = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "quality").agg(F.count("*").alias("n"), F.min("doc_id").alias("f"))
    return v.groupBy("source").agg(F.min_by("quality", F.struct(-F.col("n"), "f")).alias("winner"))


FIRST = EV + """, d AS (SELECT slot, camera_id, actor_id, activity AS description FROM (SELECT *, row_number() OVER (PARTITION BY slot, camera_id, actor_id ORDER BY start_ms, event_id) AS r FROM ev) WHERE r = 1),
 s AS (SELECT *, count(*) OVER (PARTITION BY slot, camera_id, description) AS n FROM d)"""


def described(spark, sf_dir):
    first = first_by(events_of(spark, sf_dir), ["slot", "camera_id", "actor_id"], ["start_ms", "event_id"])
    return first.select("slot", "camera_id", "actor_id", F.col("activity").alias("description"))


@query("WITH " + FIRST + " SELECT slot, max(n) AS most, count(*) FILTER (n = 1) * 100 // count(*) AS percent_unique FROM s GROUP BY slot")
def a12_ambiguity(spark, sf_dir):
    same = described(spark, sf_dir).groupBy("slot", "camera_id", "description").agg(F.count("*").alias("n"))
    return same.groupBy("slot").agg(F.max("n").alias("most"), F.expr("count_if(n = 1) * 100 div sum(n)").alias("percent_unique"))


@query("WITH " + FIRST + " SELECT slot, camera_id, max(n) AS shared FROM s GROUP BY ALL")
def a13_uniqueness(spark, sf_dir):
    same = described(spark, sf_dir).groupBy("slot", "camera_id", "description").agg(F.count("*").alias("n"))
    return same.groupBy("slot", "camera_id").agg(F.max("n").alias("shared"))


HITS = ", ".join(f"regexp_matches(lower(coalesce(text, '')), '{p}') AS {name}" for name, (p, _) in RULES.items())
LOSS = " + ".join(f"CASE WHEN {name} THEN {w} ELSE 0 END" for name, (_, w) in RULES.items())


@query(f"SELECT doc_id, greatest(0, 100 - ({LOSS})) AS score FROM (SELECT doc_id, {HITS} FROM documents)")
def a15_quality_score(spark, sf_dir):
    loss = sum((F.when(rule_hit(F.col("text"), name), w).otherwise(0) for name, (_, w) in RULES.items()), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(0), F.lit(100) - loss).alias("score"))


@query("""SELECT source, lang, count(*) AS n, CAST(sum(CASE WHEN (n_chars > 800) = (quality = 1) THEN 1 ELSE 0 END) AS BIGINT) AS n_right FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY ROLLUP (source, lang)""")
def a19_eval_rollup(spark, sf_dir):
    got = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    right = F.when((F.col("n_chars") > 800) == (F.col("quality") == 1), 1).otherwise(0)
    return got.rollup("source", "lang").agg(F.count("*").alias("n"), F.sum(right).alias("n_right"))


@query("WITH " + EN + " SELECT slot, count(*) AS n_entities, CAST(sum(n_events) AS BIGINT) AS n_events, count(DISTINCT camera_id) AS n_cameras FROM en GROUP BY slot")
def a14_slot_stats(spark, sf_dir):
    e = events_of(spark, sf_dir).groupBy("slot", "camera_id", "actor_id").agg(F.count("*").alias("n"))
    return e.groupBy("slot").agg(F.count("*").alias("n_entities"), F.sum("n").alias("n_events"), F.count_distinct("camera_id").alias("n_cameras"))


@query("SELECT label, count(*) AS n, count(DISTINCT vec_id) AS n_vectors FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 10")
def t05_top_classes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("n_vectors")).orderBy(F.desc("n"), "label").limit(10)
