"""Queries of joins and windows over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import graph, intervals, sweeps
from tessera.sources.adapters import entity_view, event_view, table

from .catalogue import EN, EV, query

READY = EV + """, ready AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slot, activity, camera_id, end_ms - start_ms > 20000 ORDER BY start_ms, event_id) AS r FROM ev WHERE start_ms >= 5000)
 WHERE end_ms - start_ms <= 20000 OR r = 1)"""
GAP_PAIRS = READY + """, pairs AS (SELECT * FROM (SELECT a.slot, a.event_id AS a_event_id, b.event_id AS b_event_id, a.activity AS a_activity, b.activity AS b_activity, a.camera_id AS a_camera_id, b.camera_id AS b_camera_id,
 a.start_ms AS a_start_ms, b.start_ms AS b_start_ms, b.start_ms - a.end_ms AS gap_ms,
 row_number() OVER (PARTITION BY a.slot, a.activity, a.camera_id, b.activity, b.camera_id ORDER BY a.start_ms, b.start_ms, a.event_id, b.event_id) AS r
 FROM ready a JOIN ready b ON a.slot = b.slot AND a.camera_id <> b.camera_id AND b.start_ms - a.end_ms BETWEEN 1000 AND 60000) WHERE r = 1)"""


def events_of(spark, sf_dir):
    return event_view(table(spark, sf_dir, "events"))


def gap_pairs(spark, sf_dir):
    return intervals.temporal_gap_pairs(events_of(spark, sf_dir), 1_000, 60_000, long_ms=20_000)


@query("WITH " + GAP_PAIRS + " SELECT slot, a_event_id, b_event_id, a_activity, b_activity, a_camera_id, b_camera_id, gap_ms FROM pairs")
def j03_temporal_gap_pairs(spark, sf_dir):
    return gap_pairs(spark, sf_dir).select("slot", "a_event_id", "b_event_id", "a_activity", "b_activity", "a_camera_id", "b_camera_id", "gap_ms")


@query("WITH " + EN + """ SELECT a.slot, a.camera_id AS a_camera_id, a.actor_id AS a_actor_id, b.camera_id AS b_camera_id, b.actor_id AS b_actor_id, b.first_ms - a.last_ms AS gap_ms,
 greatest(400, 1000 - CAST(floor((b.first_ms - a.last_ms) * 1000 / 600000) AS BIGINT)) AS confidence_milli
 FROM en a JOIN en b ON a.slot = b.slot AND a.camera_id <> b.camera_id AND b.first_ms - a.last_ms BETWEEN 1000 AND 600000""")
def j04_handoff_links(spark, sf_dir):
    got = intervals.handoffs(entity_view(events_of(spark, sf_dir)), 1_000, 600_000)
    return got.select("slot", "a_camera_id", "a_actor_id", "b_camera_id", "b_actor_id", "gap_ms", "confidence_milli")


@query("WITH " + EV + """ SELECT a_event_id, b_event_id, gap_ms FROM (SELECT a.event_id AS a_event_id, b.event_id AS b_event_id, abs(b.start_ms - a.start_ms) AS gap_ms,
 row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.start_ms - a.start_ms), b.event_id) AS r FROM ev a JOIN ev b ON a.slot = b.slot AND a.activity <> b.activity AND abs(b.start_ms - a.start_ms) <= 60000) WHERE r = 1""")
def j05_nearest_event(spark, sf_dir):
    e = events_of(spark, sf_dir)
    return intervals.nearest(e, e, ["slot"], "start_ms", 60_000, F.expr("a_activity <> b_activity"))


@query("WITH " + EN + """ SELECT a.slot, a.camera_id, a.actor_id AS a_actor_id, b.actor_id AS b_actor_id, least(a.last_ms, b.last_ms) - greatest(a.first_ms, b.first_ms) AS shared_ms
 FROM en a JOIN en b ON a.slot = b.slot AND a.camera_id = b.camera_id AND a.actor_id < b.actor_id AND least(a.last_ms, b.last_ms) > greatest(a.first_ms, b.first_ms)""")
def j07_overlap_pairs(spark, sf_dir):
    got = sweeps.overlapping_pairs(entity_view(sweeps.dealt(events_of(spark, sf_dir), "slot", "camera_id")), "slot", "camera_id", "actor_id", "first_ms", "last_ms")
    return got.select("slot", "camera_id", F.col("a").alias("a_actor_id"), F.col("b").alias("b_actor_id"), F.col("shared").alias("shared_ms"))


@query("WITH " + EV + """ SELECT event_id, slot, activity, EXISTS (SELECT 1 FROM ev a WHERE a.slot = b.slot AND a.activity = b.activity AND a.camera_id <> b.camera_id AND b.start_ms - a.start_ms BETWEEN 0 AND 8000
 AND (a.start_ms < b.start_ms OR a.event_id < b.event_id)) AS is_duplicate FROM ev b""")
def j08_duplicate_events(spark, sf_dir):
    e = events_of(spark, sf_dir)
    dup = intervals.duplicate_events(e, 8_000).withColumn("d", F.lit(True))
    return e.join(dup, "event_id", "left").select("event_id", "slot", "activity", F.coalesce("d", F.lit(False)).alias("is_duplicate"))


@query("WITH " + EV + " SELECT camera_id, actor_id, count(DISTINCT slot) AS n_slots, min(slot) AS first_slot FROM ev GROUP BY ALL HAVING count(DISTINCT slot) >= 2")
def j10_shared_users(spark, sf_dir):
    seen = events_of(spark, sf_dir).select("camera_id", "actor_id", "slot").distinct()
    return seen.groupBy("camera_id", "actor_id").agg(F.count("*").alias("n_slots"), F.min("slot").alias("first_slot")).where("n_slots >= 2")


RELATION = """CASE WHEN t.end_ms < g.start_ms THEN 'before' WHEN t.start_ms > g.end_ms THEN 'after'
 WHEN 2 * (least(t.end_ms, g.end_ms) - greatest(t.start_ms, g.start_ms)) > least(t.end_ms - t.start_ms, g.end_ms - g.start_ms) THEN 'during' END"""


@query("WITH " + EV + f""" SELECT * FROM (SELECT t.event_id AS target_id, g.event_id AS anchor_id, {RELATION} AS relation FROM ev t JOIN ev g ON t.slot = g.slot AND t.actor_id <> g.actor_id AND abs(g.start_ms - t.start_ms) <= 60000) WHERE relation IS NOT NULL""")
def j16_relation_pairs(spark, sf_dir):
    e = events_of(spark, sf_dir)
    pairs = intervals.band_join(e, e, ["slot"], "start_ms", "start_ms", -60_000, 60_000).where("a_actor_id <> b_actor_id")
    rel = intervals.temporal_relation("a_start_ms", "a_end_ms", "b_start_ms", "b_end_ms")
    return pairs.select(F.col("a_event_id").alias("target_id"), F.col("b_event_id").alias("anchor_id"), rel.alias("relation")).where("relation is not null")


@query("WITH " + EV + """ SELECT a.event_id AS a_event_id, t.event_id AS t_event_id, b.event_id AS b_event_id FROM ev a JOIN ev b ON a.slot = b.slot AND a.actor_id <> b.actor_id AND b.start_ms - a.end_ms BETWEEN 1 AND 120000
 JOIN ev t ON t.slot = a.slot AND t.start_ms BETWEEN a.end_ms AND a.end_ms + 120000 AND t.end_ms <= b.start_ms AND t.actor_id NOT IN (a.actor_id, b.actor_id)""")
def j17_between_triples(spark, sf_dir):
    """Both later events begin within two minutes of the first one's end."""
    got = sweeps.between_triples(events_of(spark, sf_dir), 120_000)
    return got.select(F.col("a").alias("a_event_id"), F.col("t").alias("t_event_id"), F.col("b").alias("b_event_id"))


@query("WITH " + EV + """ SELECT event_id, view_id, gap_ms FROM (SELECT a.event_id, b.event_id AS view_id, abs(b.start_ms - a.end_ms) AS gap_ms, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.start_ms - a.end_ms), b.event_id) AS r
 FROM ev a JOIN ev b ON a.slot = b.slot AND b.activity = 'view' AND a.event_id <> b.event_id AND abs(b.start_ms - a.end_ms) <= 30000) WHERE r = 1""")
def j20_snapshot_lookup(spark, sf_dir):
    e = events_of(spark, sf_dir)
    pairs = intervals.band_join(e, e.where("activity = 'view'"), ["slot"], "end_ms", "start_ms", -30_000, 30_000).where("a_event_id <> b_event_id")
    best = F.min(F.struct(F.abs("gap_ms").alias("gap_ms"), "b_event_id")).alias("x")
    return pairs.groupBy("a_event_id").agg(best).select(F.col("a_event_id").alias("event_id"), F.col("x.b_event_id").alias("view_id"), F.col("x.gap_ms").alias("gap_ms"))


@query("""SELECT o_custkey, o_orderkey, pre, o_orderstatus AS post FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pre FROM orders) WHERE pre <> o_orderstatus""")
def j22_state_change(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("pre", F.lag("o_orderstatus").over(w)).where("pre <> o_orderstatus").select("o_custkey", "o_orderkey", "pre", F.col("o_orderstatus").alias("post"))


@query("""WITH d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS slot, event_type AS activity, user_id % 8 AS c FROM events), u AS (SELECT DISTINCT user_id, user_id % 8 AS c FROM events)
 SELECT u.user_id AS actor_id, count(*) AS n_absent FROM u JOIN (SELECT DISTINCT slot, c FROM d) s ON s.c = u.c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND strftime(e.ts, '%Y-%m-%d') = s.slot) GROUP BY ALL""")
def j23_absent_actors(spark, sf_dir):
    e = events_of(spark, sf_dir).select("camera_id", "slot", "actor_id").distinct()
    slots = e.groupBy("camera_id").agg(F.count_distinct("slot").alias("n"))
    seen = e.groupBy("camera_id", "actor_id").agg(F.count("*").alias("m"))
    return seen.join(slots, "camera_id").select("actor_id", (F.col("n") - F.col("m")).alias("n_absent")).where("n_absent > 0")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j26_missing(spark, sf_dir):
    """Customers without an urgent order."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.expr("o_custkey = c_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@query("WITH " + EV + """, m AS (SELECT *, CASE WHEN lag(activity) OVER w = activity AND start_ms - lag(end_ms) OVER w <= 21600000 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY slot, camera_id ORDER BY start_ms, event_id)),
 r AS (SELECT *, sum(new) OVER (PARTITION BY slot, camera_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
 SELECT slot, camera_id, any_value(activity) AS activity, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_events, arg_min(event_id, (start_ms, event_id)) AS first_event_id FROM r GROUP BY slot, camera_id, island""")
def w01_island_events(spark, sf_dir):
    return intervals.islands(events_of(spark, sf_dir), ["slot", "camera_id"], 21_600_000).drop("island")


@query("WITH " + READY + " SELECT event_id, slot, activity, camera_id, end_ms - start_ms AS length_ms FROM ready")
def w02_first_long(spark, sf_dir):
    got = intervals.keep_first_long(events_of(spark, sf_dir).where("start_ms >= 5000"), 20_000)
    return got.select("event_id", "slot", "activity", "camera_id", F.expr("end_ms - start_ms").alias("length_ms"))


@query("WITH " + EV + " SELECT slot, camera_id, activity, start_ms // 5000 AS bucket, arg_min(event_id, (start_ms, event_id)) AS event_id FROM ev GROUP BY slot, camera_id, activity, start_ms // 5000")
def w03_bucket_dedup(spark, sf_dir):
    keys = ["slot", "camera_id", "activity", F.floor(F.col("start_ms") / 5000).alias("bucket")]
    return events_of(spark, sf_dir).groupBy(*keys).agg(F.min_by("event_id", F.struct("start_ms", "event_id")).alias("event_id"))


@query("WITH " + EV + " SELECT slot, activity, arg_min(camera_id, (start_ms, event_id)) AS first_camera, arg_max(camera_id, (start_ms, event_id)) AS last_camera FROM ev GROUP BY slot, activity HAVING max(start_ms) - min(start_ms) >= 2000")
def w04_first_last_camera(spark, sf_dir):
    at = F.struct("start_ms", "event_id")
    got = events_of(spark, sf_dir).groupBy("slot", "activity").agg(F.min_by("camera_id", at).alias("first_camera"), F.max_by("camera_id", at).alias("last_camera"), (F.max("start_ms") - F.min("start_ms")).alias("d"))
    return got.where("d >= 2000").drop("d")


@query("""SELECT conv_id, turn, role, turn - lag(turn) OVER w AS turn_gap, coalesce(role <> lag(role) OVER w, TRUE) AS alternates FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def w05_turn_gaps(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.col("turn") - F.lag("turn").over(w)).alias("turn_gap"), F.coalesce(F.col("role") != F.lag("role").over(w), F.lit(True)).alias("alternates"))


@query("""WITH t AS (SELECT l_partkey, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
 SELECT l_partkey, arg_min(l_orderkey, (abs(q - 25), l_orderkey, l_linenumber)) AS closest_order, min(abs(q - 25)) AS closest FROM t GROUP BY l_partkey""")
def w07_closest_approach(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.abs(F.col("l_quantity").cast("long") - 25).alias("d"))
    return t.groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct("d", "l_orderkey", "l_linenumber")).alias("closest_order"), F.min("d").alias("closest"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
 m AS (SELECT p_brand, p_size AS median FROM r WHERE i = n // 2 + 1)
 SELECT p_partkey, r.p_brand, median, CASE WHEN p_size * 10 > median * 12 THEN 'tall' WHEN p_size * 10 < median * 8 THEN 'short' ELSE 'average' END AS label FROM r JOIN m ON r.p_brand = m.p_brand""")
def w09_relative_label(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    # the upper median: percentile_disc takes the lower one, so it is taken of the reversed order
    m = p.groupBy("p_brand").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size DESC)").alias("median"))
    label = F.when(F.col("p_size") * 10 > F.col("median") * 12, "tall").when(F.col("p_size") * 10 < F.col("median") * 8, "short").otherwise("average")
    return p.join(m, "p_brand").select("p_partkey", "p_brand", F.col("median").cast("int").alias("median"), label.alias("label"))


@query("WITH " + EV + """, r AS (SELECT slot, event_id, row_number() OVER (PARTITION BY slot ORDER BY start_ms, event_id) - 1 AS i, count(*) OVER (PARTITION BY slot) AS n FROM ev)
 SELECT slot, event_id, i * 16 // n AS sample FROM r WHERE i = 0 OR i * 16 // n <> (i - 1) * 16 // n""")
def w10_even_sample(spark, sf_dir):
    w = Window.partitionBy("slot")
    r = events_of(spark, sf_dir).select("slot", "event_id", (F.row_number().over(w.orderBy("start_ms", "event_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    at = F.expr("i * 16 div n")
    return r.where((F.col("i") == 0) | (at != F.expr("(i - 1) * 16 div n"))).select("slot", "event_id", at.alias("sample"))


CHAINS = EV + """, ch AS (SELECT a.slot, a.event_id AS a_event_id, b.event_id AS b_event_id, c.event_id AS c_event_id, b.start_ms - a.end_ms AS gap1_ms, c.start_ms - b.end_ms AS gap2_ms,
 len(list_distinct([a.camera_id, b.camera_id, c.camera_id])) * 2 + len(list_distinct([a.activity, b.activity, c.activity])) AS score
 FROM ev a JOIN ev b ON a.slot = b.slot AND b.start_ms - a.end_ms BETWEEN 1000 AND 30000 JOIN ev c ON c.slot = b.slot AND c.start_ms - b.end_ms BETWEEN 1000 AND 30000
 WHERE NOT (a.camera_id = b.camera_id AND b.camera_id = c.camera_id))"""


@query("WITH " + CHAINS + " SELECT slot, a_event_id, b_event_id, c_event_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, gap1_ms + gap2_ms, a_event_id, b_event_id, c_event_id) AS rank FROM ch) WHERE rank <= 5")
def t02_topk_groups(spark, sf_dir):
    return sweeps.best_chains(events_of(spark, sf_dir), 5, 1_000, 30_000)


@query("WITH RECURSIVE " + EV + """, l AS (SELECT DISTINCT a.event_id AS u, b.event_id AS v FROM ev a JOIN ev b ON a.slot = b.slot AND a.camera_id <> b.camera_id AND b.start_ms - a.end_ms BETWEEN 1000 AND 10000),
 both_ AS (SELECT u, v FROM l UNION SELECT v, u FROM l), r AS (SELECT u AS node, u AS c FROM both_ UNION SELECT b.v, r.c FROM r JOIN both_ b ON b.u = r.node)
 SELECT node, min(c) AS component FROM r GROUP BY node""")
def gr01_components(spark, sf_dir):
    """Components of handoffs within ten seconds.  Links stay within a slot, so slots are joined only if they have an id in common."""
    e = events_of(spark, sf_dir).select("slot", "event_id", "camera_id", "start_ms", "end_ms")
    got = sweeps.band_components(e, "slot", "camera_id", "event_id", "end_ms", "start_ms", 1_000, 10_000).select(F.col("event_id").alias("node"), "component")
    if e.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1 and event_id is not null").isEmpty():
        return got
    return graph.connected_components(got.select(F.col("node").alias("u"), F.col("component").alias("v")))


@query("""SELECT n_name AS child, r_name AS ancestor, 1 AS level FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'world', 2 FROM nation UNION ALL SELECT r_name, 'world', 1 FROM region""")
def gr02_ancestors(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = n.join(r, F.expr("n_regionkey = r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).unionByName(r.select(F.col("r_name").alias("child"), F.lit("world").alias("parent")))
    return graph.ancestors(edges)
