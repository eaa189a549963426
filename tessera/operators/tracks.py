"""Tracks: boxes of objects by frame.  A track has the frames of one scene (or slot and camera), which bounds what meets in a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .driving import prefixed

#: Frames that a box may be away from the one asked for; metres that are far apart, and close together, for paths that cross.
TOLERANCE, FAR, CLOSE = 30, 5, 2
CLIPPING = "x1 <= 10 OR y1 <= 10 OR x2 >= 1910 OR y2 >= 1070"


def sampled(tracks: DataFrame, every: int, phase: str = "0") -> DataFrame:
    """Boxes of every n-th frame."""
    return tracks.where(f"frame % {every} = {phase}")


def frame_ranges(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("scene", "obj").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"))


def nearest_boxes(tracks: DataFrame, wanted: DataFrame, tolerance: int) -> DataFrame:
    """For each wanted (scene, obj, mid, ...) the box whose frame is nearest to mid, the earlier of two, if any is within the tolerance."""
    box = tracks.select("scene", "obj", "frame", "x1", "y1", "x2", "y2")
    near = wanted.join(box, ["scene", "obj"]).where(F.abs(F.col("frame") - F.col("mid")) <= tolerance)
    keys = wanted.columns
    best = F.min(F.struct(F.abs(F.col("frame") - F.col("mid")).alias("gap"), "frame", "x1", "y1", "x2", "y2")).alias("b")
    return near.groupBy(*keys).agg(best).select(*keys, "b.*")


def upper_median_area(tracks: DataFrame) -> DataFrame:
    """scene, obj, area: of the sorted areas of a track's boxes the one in the middle, the greater of two."""
    w = Window.partitionBy("scene", "obj").orderBy("area", "frame")
    a = tracks.withColumn("area", F.expr("(x2 - x1) * (y2 - y1)")).withColumns({"r": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("scene", "obj"))})
    return a.where("r = n div 2 + 1").select("scene", "obj", "area")


def frame_pairs(tracks: DataFrame, tolerance: int) -> DataFrame:
    """Frames a_frame and b_frame in which two objects of a scene (a_obj < b_obj) are compared: those they share, or if they share none
    the nearest of b for each of a, the earlier of two, within the tolerance."""
    f = tracks.select("scene", "obj", "frame")
    both = prefixed(f, "a_", ["scene"]).join(prefixed(f, "b_", ["scene"]), "scene").where("a_obj < b_obj").withColumn("gap", F.abs(F.col("a_frame") - F.col("b_frame")))
    w = Window.partitionBy("scene", "a_obj", "b_obj")
    marked = both.where(F.col("gap") <= tolerance).withColumn("least", F.min("gap").over(w))
    best = F.row_number().over(w.partitionBy("scene", "a_obj", "b_obj", "a_frame").orderBy("gap", "b_frame"))
    return marked.where("least > 0 OR gap = 0").withColumn("r", best).where("r = 1").select("scene", "a_obj", "b_obj", "a_frame", "b_frame")


def approaches(tracks: DataFrame, tolerance: int) -> DataFrame:
    """scene, a_obj, b_obj, n, frame, d2 (least squared distance, at the first such frame), crosses.

    Paths cross if the objects come close, are far apart before and after, and have changed sides between the last far frame before
    and the first one after."""
    some = tracks.select("scene", "obj", "frame", "x", "y", (F.col("x1") + F.col("x2")).alias("cx"))
    p = frame_pairs(tracks, tolerance).join(prefixed(some, "a_", ["scene"]), ["scene", "a_obj", "a_frame"]).join(prefixed(some, "b_", ["scene"]), ["scene", "b_obj", "b_frame"])
    step = F.struct(F.col("a_frame").alias("f"), F.expr("(a_x - b_x) * (a_x - b_x) + (a_y - b_y) * (a_y - b_y)").alias("d2"), F.expr("a_cx - b_cx").alias("side"))
    t = p.groupBy("scene", "a_obj", "b_obj").agg(F.array_sort(F.collect_list(step)).alias("t"))  # the frames of one scene
    t = t.withColumn("c", F.array_min(F.transform("t", lambda v: F.struct(v["d2"].alias("d2"), v["f"].alias("f")))))
    far = FAR * FAR
    pre = F.expr(f"try_element_at(filter(t, v -> v.f < c.f and v.d2 > {far}), -1)")
    post = F.expr(f"try_element_at(filter(t, v -> v.f > c.f and v.d2 > {far}), 1)")
    crosses = (F.size("t") >= 3) & (F.col("c.d2") <= CLOSE * CLOSE) & F.coalesce((pre["side"] > 0) != (post["side"] > 0), F.lit(False))
    return t.select("scene", "a_obj", "b_obj", F.size("t").cast("long").alias("n"), F.col("c.f").alias("frame"), F.col("c.d2").alias("d2"), crosses.alias("crosses"))
