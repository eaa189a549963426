"""Band, overlap, nearest and island operators over times kept as long milliseconds.

Range conditions become hash joins on time buckets, so no plan has a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sided(df: DataFrame, side: str, keys: list[str]) -> DataFrame:
    """df with all columns but the keys prefixed."""
    return df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys])


def band_join(left: DataFrame, right: DataFrame, keys: list[str], from_: str, to: str, low: int, high: int) -> DataFrame:
    """Pairs with equal keys and low <= right.to - left.from_ <= high; columns prefixed a_ and b_, and gap_ms.

    A bucket is as wide as the band: left rows go to two buckets at most, right rows to one."""
    width = high - low + 1
    bucket = lambda c: F.floor(c / width).cast("long")
    a, b = sided(left, "a", keys), sided(right, "b", keys)
    x, y = F.col(f"a_{from_}"), F.col(f"b_{to}")
    a = a.withColumn("__bucket", F.explode(F.sequence(bucket(x + low), bucket(x + high))))
    b = b.withColumn("__bucket", bucket(y))
    return a.join(b, [*keys, "__bucket"]).withColumn("gap_ms", y - x).where(F.col("gap_ms").between(low, high)).drop("__bucket")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """Pairs with equal keys whose intervals share more than a point; each pair is made once, in the bucket of the later start."""
    bucket = lambda c: F.floor(c / width).cast("long")
    spread = lambda d, s: sided(d, s, keys).withColumn("__bucket", F.explode(F.sequence(bucket(F.col(f"{s}_{start}")), bucket(F.greatest(f"{s}_{start}", f"{s}_{end}")))))
    late, early = F.greatest(f"a_{start}", f"b_{start}"), F.least(f"a_{end}", f"b_{end}")
    return spread(left, "a").join(spread(right, "b"), [*keys, "__bucket"]).where((early > late) & (F.col("__bucket") == bucket(late))).drop("__bucket")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; a total order makes it definite.  Rows are combined before they are shuffled."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = F.min(F.struct(*order, *rest)).alias("m")
    return df.groupBy(*keys).agg(least).select(*[c if c in keys else F.col(f"m.{c}").alias(c) for c in df.columns])


def keep_first_long(events: DataFrame, longest_ms: int) -> DataFrame:
    """Short events, and of longer ones the first per slot, activity and camera."""
    long_one = F.col("end_ms") - F.col("start_ms") > longest_ms
    w = Window.partitionBy("slot", "activity", "camera_id", long_one).orderBy("start_ms", "event_id")
    return events.withColumn("__r", F.row_number().over(w)).where(~long_one | (F.col("__r") == 1)).drop("__r")


def temporal_gap_pairs(events: DataFrame, low: int, high: int, settle_ms: int = 5_000, long_ms: int = 30_000) -> DataFrame:
    """Event pairs on two cameras of a slot with low <= b.start - a.end <= high; the first for each two activities and cameras."""
    ready = keep_first_long(events.where(F.col("start_ms") >= settle_ms), long_ms)
    pairs = band_join(ready, ready, ["slot"], "end_ms", "start_ms", low, high).where("a_camera_id <> b_camera_id")
    return first_by(pairs, ["slot", "a_activity", "a_camera_id", "b_activity", "b_camera_id"], ["a_start_ms", "b_start_ms", "a_event_id", "b_event_id"])


def handoffs(entities: DataFrame, low: int, high: int) -> DataFrame:
    """Entities that appear on another camera low to high ms after one was last seen; confidence in thousandths, 400 at least."""
    pairs = band_join(entities, entities, ["slot"], "last_ms", "first_ms", low, high).where("a_camera_id <> b_camera_id")
    return pairs.withColumn("confidence_milli", F.greatest(F.lit(400), F.lit(1000) - F.floor(F.col("gap_ms") * 1000 / high)).cast("long"))


def nearest(events: DataFrame, other: DataFrame, keys: list[str], time: str, tolerance: int, rule: Column) -> DataFrame:
    """For each event the nearest row of other within the tolerance that the rule allows; ties go to the lesser b_event_id."""
    pairs = band_join(events, other, keys, time, time, -tolerance, tolerance).where(rule).withColumn("gap_ms", F.abs("gap_ms"))
    best = F.min(F.struct("gap_ms", "b_event_id")).alias("best")
    return pairs.groupBy("a_event_id").agg(best).select("a_event_id", "best.b_event_id", "best.gap_ms")


def islands(events: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """Runs of consecutive events of one activity whose starts follow the end before by gap_ms at most."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "event_id")
    new = (F.lag("activity").over(w).isNull() | (F.lag("activity").over(w) != F.col("activity")) | (F.col("start_ms") - F.lag("end_ms").over(w) > gap_ms)).cast("int")
    runs = events.withColumn("__new", new).withColumn("island", F.sum("__new").over(w))
    out = runs.groupBy(*keys, "island").agg(F.first("activity").alias("activity"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_events"), F.min_by("event_id", F.struct("start_ms", "event_id")).alias("first_event_id"))
    return out


def temporal_relation(start: str, end: str, g_start: str, g_end: str) -> Column:
    """before, after, during (overlap over half of the shorter) or null."""
    t0, t1, g0, g1 = map(F.col, (start, end, g_start, g_end))
    shared = F.least(t1, g1) - F.greatest(t0, g0)
    return F.when(t1 < g0, "before").when(t0 > g1, "after").when(2 * shared > F.least(t1 - t0, g1 - g0), "during")


def duplicate_events(events: DataFrame, within_ms: int) -> DataFrame:
    """event_id of events that repeat an earlier one (start, id) of the same activity on another camera."""
    e = events.select("slot", "activity", "camera_id", "start_ms", "event_id")
    pairs = band_join(e, e, ["slot", "activity"], "start_ms", "start_ms", 0, within_ms)
    later = (F.col("gap_ms") > 0) | (F.col("b_event_id") > F.col("a_event_id"))
    return pairs.where((F.col("a_camera_id") != F.col("b_camera_id")) & later).select(F.col("b_event_id").alias("event_id")).distinct()


def chains(events: DataFrame, low: int, high: int) -> DataFrame:
    """Three events with both gaps within the band, on two cameras at least; columns a_*, b_*, c_*, gap1_ms, gap2_ms."""
    e = events.select("slot", "event_id", "activity", "camera_id", "start_ms", "end_ms")
    first = band_join(e, e, ["slot"], "end_ms", "start_ms", low, high).withColumnRenamed("gap_ms", "gap1_ms")
    two = band_join(first, e, ["slot"], "b_end_ms", "start_ms", low, high)
    names = {**{f"a_{s}_{c}": f"{s}_{c}" for s in "ab" for c in e.columns if c != "slot"}, **{f"b_{c}": f"c_{c}" for c in e.columns if c != "slot"}, "a_gap1_ms": "gap1_ms", "gap_ms": "gap2_ms"}
    got = two.select("slot", *[F.col(a).alias(b) for a, b in names.items()])
    return got.where("not (a_camera_id = b_camera_id and b_camera_id = c_camera_id)")
