"""Streams give what the batch gives, but for what the watermark has not passed."""

from pyspark.sql import functions as F

from tessera.streaming import events as st

SF = "/root/testdata/sf0.001/events.parquet"


def run(spark, tmp_path, make, name):
    schema = spark.read.parquet(SF).schema
    parts = str(tmp_path / "in")
    if not (tmp_path / "in").exists():
        spark.read.parquet(SF).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(parts)
        # a last row far ahead moves the watermark past all others
        last = spark.read.parquet(SF).orderBy(F.desc("ts")).limit(1).withColumn("ts", F.expr("ts + interval 30 days")).withColumn("event_id", F.lit(10**9).cast("long"))
        last.write.mode("append").parquet(parts)
        last.withColumn("ts", F.expr("ts + interval 30 days")).withColumn("event_id", F.lit(10**9 + 1).cast("long")).write.mode("append").parquet(parts)
    stream = spark.readStream.schema(schema).parquet(parts)
    st.append(make(stream), str(tmp_path / name), str(tmp_path / f"{name}_cp")).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / name))


def test_buckets_sessions_and_handoffs(spark, tmp_path):
    batch = spark.read.parquet(SF).withColumn("ts", F.col("ts").cast("timestamp"))
    small = 10**9
    want = batch.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    got = run(spark, tmp_path, lambda s: st.bucket_dedup(s, ["event_type"], "6 hours"), "buckets").where(F.col("event_id") < small)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())
    want = batch.groupBy("event_type", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"))
    got = run(spark, tmp_path, lambda s: st.sessions(s, ["event_type"], "2 hours"), "sessions").where("last < timestamp '2024-02-15'")
    assert sorted((r.event_type, r.n) for r in got.collect()) == sorted((r.event_type, r.n) for r in want.collect())
    a = batch.select("user_id", F.col("ts").alias("a_ts"), F.col("event_id").alias("a"))
    b = batch.select("user_id", F.col("ts").alias("b_ts"), F.col("event_id").alias("b"))
    want = a.join(b, "user_id").where("b_ts >= a_ts + interval 1 minute and b_ts <= a_ts + interval 12 hours")
    got = run(spark, tmp_path, lambda s: st.handoffs(s, s, "user_id", "1 minute", "12 hours"), "pairs")
    assert {(r.a_event_id, r.b_event_id) for r in got.collect()} == {(r.a, r.b) for r in want.collect()}
