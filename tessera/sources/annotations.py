"""Readers of annotation texts: activity and type lists, box lines, camera matrices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIVITIES = "path string, activity string, act_id long, start_frame long, end_frame long, actor_ids array<long>"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and value of each file; a file is one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_activities(spark: SparkSession, path: str) -> DataFrame:
    """Activity entries of YAML files.  Entries without a time span of two frames are left out; a missing activity is "unknown"."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for frame in batches:
            rows = []
            for name, text in zip(frame["path"], frame["value"]):
                for entry in yaml.load(text, loader) or []:
                    act = entry.get("act") or {}
                    span = ((act.get("timespan") or [{}])[0] or {}).get("tsr0") or []
                    if len(span) >= 2:
                        actors = [a["id1"] for a in act.get("actors") or [] if "id1" in a]
                        rows.append((name, next(iter(act.get("act2") or {}), "unknown"), act.get("id2"), span[0], span[1], actors))
            yield pd.DataFrame(rows, columns=["path", "activity", "act_id", "start_frame", "end_frame", "actor_ids"])

    return whole_texts(spark, path).mapInPandas(parse, ACTIVITIES)


def geom_fields(line: Column) -> list[Column]:
    """actor_id, frame, x1, y1, x2, y2 of a box line, quoted or not, fields in any order; nulls where a field is missing."""

    def number(name: str) -> Column:
        return F.expr("try_cast(regexp_extract(__l, '%s.?: *([0-9]+)', 1) as long)" % name)

    box = "regexp_extract(__l, 'g0[^0-9]+([0-9]+) +([0-9]+) +([0-9]+) +([0-9]+)', %d)"
    return [number("id1").alias("actor_id"), number("ts0").alias("frame"), *[F.expr(f"try_cast({box % k} as long)").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"), 1)]]


def parse_geom(lines: DataFrame, text: str = "value") -> DataFrame:
    """Boxes of lines that have one; built-in expressions only."""
    got = lines.withColumn("__l", F.col(text)).where("__l like '%g0%'")
    return got.select(*[c for c in lines.columns if c != text], *geom_fields(F.col("__l"))).where("x2 is not null and frame is not null")


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """path, k, r (9 doubles each, by rows), t (3 doubles) of camera matrix files: non-blank lines 0-2, 3-5 and 6."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    nums = F.transform(lines, lambda x: F.split(F.trim(x), "[ \t]+").cast("array<double>"))
    n = whole_texts(spark, path).select("path", F.slice(nums, 1, 7).alias("n"))
    return n.select("path", F.flatten(F.slice("n", 1, 3)).alias("k"), F.flatten(F.slice("n", 4, 3)).alias("r"), F.get("n", F.lit(6)).alias("t"))
