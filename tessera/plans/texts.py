"""Queries of scalar functions, geometry, validation and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import geometry, text
from tessera.operators.similarity import near_duplicate_links
from tessera.sources.adapters import table
from tessera.sources.annotations import parse_geom

from .catalogue import query

TOKENS = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')))"


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '^(person|vehicle|hand)_', ''), '_', ' ', 'g') AS phrase, (CASE WHEN regexp_matches(lower(p_type), '^[aeiou]') THEN 'an ' ELSE 'a ' END) || p_type AS noun FROM part")
def x01_humanize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.humanize(F.lower("p_type")).alias("phrase"), text.with_article(F.col("p_type")).alias("noun"))


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS s FROM documents), b AS (SELECT item_id, {TOKENS} AS s FROM benchmark)
 SELECT item_id, doc_id, len(list_intersect(t.s, b.s)) AS shared, len(list_distinct(list_concat(t.s, b.s))) AS either FROM t, b WHERE len(list_intersect(t.s, b.s)) * 2 > len(list_distinct(list_concat(t.s, b.s)))""")
def x03_token_jaccard(spark, sf_dir):
    """Documents and items with a token Jaccard over one half, over their shared tokens."""
    side = lambda name, key: table(spark, sf_dir, name).select(key, text.token_set(F.col("text")).alias("s")).select(key, F.size("s").alias(f"n_{key}"), F.explode("s").alias("t"))
    # a pair over one half shares a token of the item's half and one; the items' first tokens by length suffice as keys
    items = table(spark, sf_dir, "benchmark").select("item_id", text.token_set(F.col("text")).alias("s"))
    n_keys = (F.size("s") - F.floor(F.size("s") / 2)).cast("int")
    ranked = F.slice(F.array_sort(F.transform("s", lambda x: F.struct((-F.length(x)).alias("l"), x.alias("t")))), 1, n_keys)
    keys = items.select("item_id", F.explode(F.transform(ranked, lambda x: x["t"])).alias("t"))
    docs = side("documents", "doc_id")
    pairs = docs.join(keys, "t").select("doc_id", "item_id").distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", text.token_set(F.col("text")).alias("sd"))
    both = pairs.join(d, "doc_id").join(items, "item_id")
    shared = F.size(F.array_intersect("sd", "s"))
    got = both.select("item_id", "doc_id", shared.cast("long").alias("shared"), (F.size("sd") + F.size("s") - shared).cast("long").alias("either"))
    return got.where("shared * 2 > either")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS s FROM documents), c AS (SELECT s, min(doc_id) AS rep FROM t GROUP BY s),
 l AS (SELECT a.rep AS a, b.rep AS b FROM c a JOIN c b ON a.rep < b.rep AND len(a.s) * 100 >= len(b.s) * 90 AND len(b.s) * 100 >= len(a.s) * 90 AND len(a.s) > 0
 WHERE len(list_intersect(a.s, b.s)) * 100 > 90 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))), e AS (SELECT a AS rep FROM l UNION ALL SELECT b FROM l)
 SELECT doc_id, rep, (SELECT count(*) FROM e WHERE e.rep = c.rep) AS n_links FROM t JOIN c ON t.s = c.s""")
def v04_near_duplicates(spark, sf_dir):
    members, links = near_duplicate_links(table(spark, sf_dir, "documents"), "doc_id", "text")
    n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return members.join(n, "rep", "left").select("doc_id", "rep", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


@query("SELECT event_id, md5(event_type || '::' || CAST(user_id AS VARCHAR)) AS stable_id FROM events")
def x17_stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.stable_id(F.col("event_type"), F.col("user_id").cast("string")).alias("stable_id"))


@query("SELECT c_custkey, chr(CAST(65 + c_custkey % 4 AS INTEGER)) AS letter, 'cust ' || CAST(c_custkey AS VARCHAR) AS option FROM customer")
def x18_options_map(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.letter(F.col("c_custkey") % 4).alias("letter"), F.concat(F.lit("cust "), F.col("c_custkey").cast("string")).alias("option"))


RGB = "WITH e AS (SELECT vec_id, " + ", ".join(f"CAST(floor(abs(CAST(embedding[{i}] AS DOUBLE)) * 1000) AS BIGINT) % 256 AS {c}" for i, c in enumerate("rgb", 1)) + " FROM embeddings)"


@query(RGB + """ SELECT vec_id, CASE WHEN greatest(r, g, b) < 50 THEN 'black' WHEN (greatest(r, g, b) - least(r, g, b)) * 100 < 15 * greatest(r, g, b) THEN CASE WHEN greatest(r, g, b) > 200 THEN 'white' ELSE 'gray' END
 WHEN r >= g AND r >= b THEN CASE WHEN g >= b THEN 'orange' ELSE 'pink' END WHEN g >= b THEN CASE WHEN r >= b THEN 'yellow' ELSE 'green' END WHEN g >= r THEN 'blue' ELSE 'purple' END AS color FROM e""")
def x12_hsv_color(spark, sf_dir):
    channel = [F.expr(f"cast(floor(abs(cast(embedding[{i}] as double)) * 1000) as bigint) % 256") for i in range(3)]
    return table(spark, sf_dir, "embeddings").select("vec_id", geometry.hsv_name(*channel).alias("color"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS x1, l_suppkey % 50 AS y1, l_partkey % 50 + 10 AS x2, l_suppkey % 50 + 10 AS y2 FROM lineitem),
 i AS (SELECT a.l_orderkey, a.l_linenumber, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS w FROM b a JOIN b b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
 SELECT l_orderkey, l_linenumber, w * 100 // (200 - w) AS iou_percent FROM i""")
def geo05_iou(spark, sf_dir):
    box = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("struct(l_partkey % 50 as x, l_suppkey % 50 as y)").alias("p"))
    a, b = (box.select("l_orderkey", (F.col("l_linenumber") - n).alias("l_linenumber"), F.col("p").alias(s)) for n, s in ((0, "a"), (1, "b")))
    corner = lambda s: (F.col(f"{s}.x"), F.col(f"{s}.y"), F.col(f"{s}.x") + 10, F.col(f"{s}.y") + 10)
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.floor(geometry.iou(corner("a"), corner("b")) * 100 + 1e-9).alias("iou_percent"))


@query("""WITH d AS (SELECT vec_id, degrees(atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE))) AS a FROM embeddings)
 SELECT vec_id, CASE WHEN a >= -45 AND a < 45 THEN 'in_front' WHEN a >= 45 AND a < 135 THEN 'left' WHEN a >= 135 OR a < -135 THEN 'behind' ELSE 'right' END AS direction FROM d""")
def geo11_direction(spark, sf_dir):
    x, y = (F.expr(f"cast(embedding[{i}] as double)") for i in (0, 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", geometry.direction(x, y).alias("direction"))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 100 AS x, l_suppkey % 100 AS y FROM lineitem")
def geo02_ground_projection(spark, sf_dir):
    """A camera at height 1 that looks straight down projects its pixel plane on the ground unchanged (y and z turned)."""
    one, zero = F.lit(1.0), F.lit(0.0)
    kinv = [one, zero, zero, zero, one, zero, zero, zero, one]
    r = [one, zero, zero, zero, -one, zero, zero, zero, -one]
    p = geometry.ground_point(kinv, r, [zero, zero, one], (F.col("l_partkey") % 100).cast("double"), -(F.col("l_suppkey") % 100).cast("double"))
    got = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"))
    return got.select("l_orderkey", "l_linenumber", F.round("p.x").cast("long").alias("x"), F.round("p.y").cast("long").alias("y"))


def _flags(names):
    return ", ".join(f"regexp_matches(lower(coalesce(text, '')), '{text.RULES[n][0]}') AS {n}" for n in names)


@query(f"SELECT doc_id, {_flags(['seconds', 'raw_id'])} FROM documents")
def v03_token_leaks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[text.rule_hit(F.col("text"), n).alias(n) for n in ("seconds", "raw_id")])


@query(f"SELECT doc_id, {_flags(['generic', 'article', 'double_article'])} FROM documents")
def v05_generic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[text.rule_hit(F.col("text"), n).alias(n) for n in ("generic", "article", "double_article")])


@query(f"SELECT conv_id, turn, {_flags(['camera', 'seconds'])} FROM conversations")
def v08_forbidden(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[text.rule_hit(F.col("text"), n).alias(n) for n in ("camera", "seconds")])


def _found(rules):
    return ", ".join(f"regexp_matches(coalesce(text, ''), '{text.any_of(patterns)}') AS {name}" for name, patterns in rules.items())


@query(f"SELECT doc_id, {_found(text.LEAKS)} FROM documents")
def v03_all_token_leaks(spark, sf_dir):
    """Every group of raw tokens of the reference; a text counts as naturalised."""
    return table(spark, sf_dir, "documents").select("doc_id", *[text.pattern_hit(F.col("text"), p).alias(n) for n, p in text.LEAKS.items()])


@query(f"SELECT conv_id, turn, {_found(text.FORBIDDEN)} FROM conversations")
def v08_all_forbidden(spark, sf_dir):
    """Every forbidden pattern of the reference; a turn counts as of a restricted category."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[text.pattern_hit(F.col("text"), p).alias(n) for n, p in text.FORBIDDEN.items()])


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42::' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 25")
def e01_stratified_sample(spark, sf_dir):
    w = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("42::"), F.col("doc_id").cast("string"))), "doc_id")
    return table(spark, sf_dir, "documents").select("lang", "doc_id", F.row_number().over(w).alias("r")).where("r <= 25").drop("r")


@query("SELECT p_partkey, i, i * (p_size * 10) // 16 AS frame FROM part, range(16) t(i)")
def e02_frame_indices(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("i"))
    return p.select("p_partkey", "i", F.expr("i * (p_size * 10) div 16").alias("frame"))


@query("""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS s FROM conversations),
 g AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(s) AS w FROM t) GROUP BY ALL)
 SELECT a.conv_id, a.turn, CAST(sum(least(a.c, b.c)) AS BIGINT) AS matched FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn % 2 = 0 AND b.turn = a.turn + 1 AND a.w = b.w GROUP BY a.conv_id, a.turn""")
def e06_rouge(spark, sf_dir):
    """Clipped unigram matches of each answer with its question."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    g = table(spark, sf_dir, "conversations").select("conv_id", F.expr("turn - turn % 2").alias("turn"), (F.col("turn") % 2).alias("side"), F.explode(words).alias("w"))
    g = g.groupBy("conv_id", "turn", "w").agg(F.count_if(F.expr("side = 0")).alias("x"), F.count_if(F.expr("side = 1")).alias("y"))
    return g.groupBy("conv_id", "turn").agg(F.sum(F.least("x", "y")).alias("matched"), F.max(F.least("x", "y")).alias("m")).where("m > 0").drop("m")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS actor_id, l_suppkey AS frame, 1 AS x1, 2 AS y1, l_suppkey + 3 AS x2, 9 AS y2 FROM lineitem")
def s05_geom_parse(spark, sf_dir):
    """Box lines in both inline layouts, written by rule from lineitem."""
    a = "concat('- { geom: {id1: ', l_partkey, ', id0: 1, ts0: ', l_suppkey, ', g0: 1 2 ', l_suppkey + 3, ' 9, keyframe: true } }')"
    b = "concat('- {''geom'': {''g0'': ''1 2 ', l_suppkey + 3, ' 9'', ''id0'': 1, ''id1'': ', l_partkey, ', ''ts0'': ', l_suppkey, '}}')"
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(f"if(l_linenumber % 2 = 0, {a}, {b})").alias("value"))
    return parse_geom(lines)
