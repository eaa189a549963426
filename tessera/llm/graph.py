"""Connected components over tables of links, without a task or driver that sees all links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_written, written

#: The two-star iteration ends far earlier; this only stops a defect from running for ever.
MOST_ROUNDS = 60
#: Links from which on hot nodes are looked for, and the share of links that makes a node hot.
LARGE, HOT_SHARE = 1_000_000, 1 / 10_000


def _kept(e: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The written links (u, v), with their number and a hash of them all, which the write observes.  Should a lost task count twice,
    there is one round more."""
    seen = Observation()
    out = written(e.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")), "links")
    return out, (seen.get["n"], seen.get["h"])


def _with_least(pairs: DataFrame, edges: int) -> DataFrame:
    """u, v and the least id m of u and all its v.

    The centre of a large star is a hot key: in a large graph the least ids of nodes with more than HOT_SHARE of all links (there are
    at most twice 1 / HOT_SHARE of them) are sent to the links, which stay where they are."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    if edges < LARGE:
        return pairs.join(least.drop("n"), "u")
    hot = F.col("n") > HOT_SHARE * edges
    few = F.broadcast(least.where(hot).select("u", "m"))
    return pairs.join(few, "u").unionByName(pairs.join(few, "u", "left_anti").join(least.where(~hot).select("u", "m"), "u"))


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node in links (u, v: long); nulls and loops are left out.

    Alternating large and small stars: each round points every node at the least node that it or its neighbours know, with
    least ids combined before they are shuffled; the table of each round, and the result, is written to the shared folder."""
    e = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = _kept(e)
    for step in range(MOST_ROUNDS + 1):
        if not seen[0]:
            break
        if step == MOST_ROUNDS:
            raise RuntimeError("components did not settle")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = _with_least(large, seen[0])
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).distinct()
        new, now = _kept(small)
        drop_written(e)
        e = new
        if now == seen:
            break
        seen = now
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = written(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops).distinct(), "components")
    drop_written(e)
    return out
