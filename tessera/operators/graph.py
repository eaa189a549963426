"""Connected components and ancestor chains over tables of edges."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint_dir(spark) -> None:
    """Set the folder of checkpoints where the cluster names none; only in local mode, as executors must share it."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least node) for edges u, v; least labels spread over edges and are halved by pointer jumps.

    Each round is checkpointed in the folder of spark.checkpoint.dir, set here only where it is unset."""
    checkpoint_dir(links.sparkSession)
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u is not null and v is not null").distinct().checkpoint()
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c"))
    seen = None
    for _ in range(rounds):
        told = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("d"))
        label = label.join(told, "u").select("u", F.least("c", "d").alias("c"))
        jump = label.select(F.col("u").alias("c"), F.col("c").alias("d"))
        label = label.join(jump, "c").select("u", F.least("c", "d").alias("c")).checkpoint()
        now = label.agg(F.sum(F.col("c").cast("decimal(38,0)")), F.count("*")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label.select(F.col("u").alias("node"), F.col("c").alias("component"))


def ancestors(edges: DataFrame, depth: int = 64) -> DataFrame:
    """child, ancestor, level for child, parent edges of a taxonomy; a chain ends at a node without a parent.

    A chain longer than depth is taken for a cycle and raises."""
    level = edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("level")).where("parent is not null")
    out, up = level, edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("next")).where("parent is not null")
    for k in range(2, depth + 1):
        level = level.join(up, "ancestor").select("child", F.col("next").alias("ancestor"), F.lit(k).alias("level"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"a chain of more than {depth} ancestors: the edges have a cycle")
