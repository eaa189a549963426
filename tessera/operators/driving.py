"""Relations between the objects of a frame, activity intervals, and their joins in time.

A frame has some objects and a scene some frames, so pairs within a frame and intervals within a scene are few; scenes are the
unit of parallel work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames around an event that its states are taken from, and frames that a missing one may be replaced by, in this order.
BUFFER, SNAPS = 5, (0, -3, -2, -1, 1, 2, 3)
#: Objects nearer than this are near each other (metres), and frames that two anchors must be apart.
NEAR, APART = 10, 10
OPPOSITE = {"left": "right", "right": "left", "in_front": "behind", "behind": "in_front"}


def quadrant(dx: str, dy: str) -> str:
    """Direction of an offset by its angle: in_front [-45, 45), left [45, 135), right [-135, -45), else behind; exact for integers."""
    return (
        f"CASE WHEN {dx} = 0 AND {dy} = 0 THEN 'in_front' WHEN {dx} > 0 AND {dy} >= -({dx}) AND {dy} < {dx} THEN 'in_front'"
        f" WHEN {dy} > 0 AND {dx} > -({dy}) AND {dx} <= {dy} THEN 'left' WHEN {dx} < 0 AND {dy} <= -({dx}) AND {dy} > {dx} THEN 'behind' ELSE 'right' END"
    )


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])


def frame_relations(obj: DataFrame) -> DataFrame:
    """scene, frame, src, tgt, dir, d2 (squared distance) of each pair of objects of a frame, src < tgt."""
    keys, some = ["scene", "frame"], obj.select("scene", "frame", "obj", "x", "y", "z")
    pairs = prefixed(some, "a_", keys).join(prefixed(some, "b_", keys), keys).where("a_obj < b_obj")
    d2 = F.expr("(b_x - a_x) * (b_x - a_x) + (b_y - a_y) * (b_y - a_y) + (b_z - a_z) * (b_z - a_z)")
    return pairs.select(*keys, F.col("a_obj").alias("src"), F.col("b_obj").alias("tgt"), F.expr(quadrant("(b_x - a_x)", "(b_y - a_y)")).alias("dir"), d2.alias("d2"))


def activity_intervals(obj: DataFrame, gap: int = 2, least: int = 2) -> DataFrame:
    """scene, obj, cls, activity, description, first, last: runs of one activity of an object whose frames are at most gap apart and
    that span more than least frames; of the descriptions the longest, the first of those."""
    w = Window.partitionBy("scene", "obj").orderBy("frame")
    new = F.coalesce((F.lag("activity").over(w) != F.col("activity")) | (F.col("frame") - F.lag("frame").over(w) > gap), F.lit(True))
    runs = obj.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    longest = F.max_by("description", F.struct(F.length("description"), -F.col("frame"))).alias("description")
    got = runs.groupBy("scene", "obj", "run").agg(F.first("cls").alias("cls"), F.first("activity").alias("activity"), longest, F.min("frame").alias("first"), F.max("frame").alias("last"))
    return got.where(F.col("last") - F.col("first") > least).drop("run")


def grounded(cls, description, activity):
    """the car (near the curb, moving)"""
    short = F.element_at(F.split(cls, r"\."), -1)
    inner = F.concat_ws(", ", F.nullif(description, F.lit("")), F.nullif(activity, F.lit("")))
    return F.concat(F.lit("the "), short, F.when(inner != "", F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise(F.lit("")))


def hashed(*parts) -> "F.Column":
    """What stands for a random choice: rows are taken by least hash."""
    return F.md5(F.concat_ws("::", F.lit("42"), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]))


def first_by_hash(df: DataFrame, keys: list[str], *parts) -> DataFrame:
    """For each key the row of least hash of its parts; the other columns break ties."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(hashed(*keys, *parts).alias("h"), *rest)).alias("m")).select(*keys, *[f"m.{c}" for c in rest])


def states(rels: DataFrame) -> DataFrame:
    """One relation of each scene, by hash: scene, frame, src, tgt, dir."""
    return first_by_hash(rels.select("scene", "frame", "src", "tgt", "dir"), ["scene"], "frame", "src", "tgt")


def adjacent_events(state: DataFrame, events: DataFrame) -> DataFrame:
    """Events of other objects that begin after a state, or end before it, by more than BUFFER frames; marker says which."""
    near = state.join(prefixed(events, "e_", ["scene"]), "scene").where("e_obj <> src AND e_obj <> tgt")
    marker = F.when(F.col("e_first") > F.col("frame") + BUFFER, "After").when(F.col("e_last") < F.col("frame") - BUFFER, "Before")
    return near.withColumn("marker", marker).where("marker is not null")


def second_states(rels: DataFrame, state: DataFrame) -> DataFrame:
    """For each scene two relations of frames more than APART apart, in order of time: columns p_ and q_."""
    s = prefixed(state, "s_", ["scene"])
    far = rels.select("scene", "frame", "src", "tgt", "dir").join(s, "scene").where(F.abs(F.col("frame") - F.col("s_frame")) > APART)
    one = first_by_hash(far, ["scene"], F.lit("second"), "frame", "src", "tgt")
    early = F.col("s_frame") < F.col("frame")
    cols = ["frame", "src", "tgt", "dir"]
    return one.select("scene", *[F.when(early, F.col(f"s_{c}")).otherwise(F.col(c)).alias(f"p_{c}") for c in cols], *[F.when(early, F.col(c)).otherwise(F.col(f"s_{c}")).alias(f"q_{c}") for c in cols])


def between_events(two: DataFrame, events: DataFrame) -> DataFrame:
    """Events that lie between two states, BUFFER frames within."""
    got = two.join(prefixed(events, "e_", ["scene"]), "scene")
    return got.where((F.col("e_first") >= F.col("p_frame") + BUFFER) & (F.col("e_last") <= F.col("q_frame") - BUFFER) & (F.col("p_frame") + BUFFER < F.col("q_frame") - BUFFER))


def snapped(rows: DataFrame, frames: DataFrame, wanted: str, out: str) -> DataFrame:
    """rows with the frame (out) that stands for a wanted one: itself, else the first of SNAPS around it; others are left out."""
    tries = rows.withColumn("__k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(SNAPS)]))).withColumn(out, F.col(wanted) + F.col("__k.o"))
    found = tries.join(frames.select("scene", F.col("frame").alias(out)).distinct(), ["scene", out], "left_semi")
    keys = [c for c in rows.columns]
    return found.groupBy(*keys).agg(F.min(F.struct("__k.i", out)).alias("m")).select(*keys, F.col(f"m.{out}").alias(out))


def gap_relations(events: DataFrame, rels: DataFrame) -> DataFrame:
    """Relations in frames between two events of a scene (a_ ends, b_ begins; BUFFER frames within) of objects of neither."""
    pairs = prefixed(events, "a_", ["scene"]).join(prefixed(events, "b_", ["scene"]), "scene").where(F.col("a_last") + 2 * BUFFER < F.col("b_first"))
    got = pairs.join(rels.select("scene", "frame", "src", "tgt", "dir"), "scene")
    inside = F.col("frame").between(F.col("a_last") + BUFFER, F.col("b_first") - BUFFER)
    return got.where(inside & ~F.col("src").isin(F.col("a_obj"), F.col("b_obj")) & ~F.col("tgt").isin(F.col("a_obj"), F.col("b_obj")))


def changes(events: DataFrame, rels: DataFrame, frames: DataFrame) -> DataFrame:
    """Pairs whose relation differs between the frames BUFFER before and after an event: columns pre, post, pre_frame, post_frame."""
    at = events.withColumn("w_pre", F.greatest(F.lit(0), F.col("first") - BUFFER)).withColumn("w_post", F.col("last") + BUFFER)
    at = snapped(snapped(at, frames, "w_pre", "pre_frame"), frames, "w_post", "post_frame")
    side = lambda f, d: rels.select("scene", F.col("frame").alias(f), "src", "tgt", F.col("dir").alias(d))
    return at.join(side("pre_frame", "pre"), ["scene", "pre_frame"]).join(side("post_frame", "post"), ["scene", "post_frame", "src", "tgt"]).where("pre <> post").drop("w_pre", "w_post")


def local_direction(dx: str, dy: str, heading: str) -> str:
    """Where an offset lies for an observer who faces a heading (degrees)."""
    c, s = f"cos(radians(-({heading})))", f"sin(radians(-({heading})))"
    lx, ly = f"({c} * {dx} - {s} * {dy})", f"({s} * {dx} + {c} * {dy})"
    return f"CASE WHEN abs({lx}) >= abs({ly}) THEN CASE WHEN {lx} >= 0 THEN 'in front' ELSE 'behind' END WHEN {ly} >= 0 THEN 'to the left' ELSE 'to the right' END"


def nearer_farther(rels: DataFrame, least: float = 2.0) -> DataFrame:
    """For each scene, frame and source with two targets or more: the nearest target and the first one that is farther by least
    metres, or else the second."""
    d = rels.withColumn("d", F.sqrt("d2"))
    targets = F.array_sort(F.collect_list(F.struct("d", "tgt"))).alias("t")  # the objects of one frame
    got = d.groupBy("scene", "frame", "src").agg(targets).where("size(t) >= 2")
    return got.select("scene", "frame", "src", F.expr("t[0].tgt").alias("nearer"), F.coalesce(F.expr(f"try_element_at(filter(t, v -> v.d - t[0].d >= {least}), 1).tgt"), F.expr("t[1].tgt")).alias("farther"))
