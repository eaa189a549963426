"""What the operators of this subpackage share: written tables, Arrow batches, order buckets."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that goes to a Python worker.  Documents are long; 10,000 of them need not fit in a worker.
ARROW_ROWS = 500
#: Bytes of an Arrow batch, about.
ARROW_BYTES = 8_000_000
#: Code points or bytes that a Python operator works on at a time.
CHUNK = 4_000_000
#: Most buckets that `order_bounds` makes; bounds are driver-side longs.
MAX_BUCKETS = 16_384


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of Arrow batches of this session, unless they are bounded lower already, and their bytes unless those are set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"


@contextlib.contextmanager
def _short_lived_shuffles(spark: SparkSession):
    """Within it a query's shuffle files go when the query ends: what it wrote is in a table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read again: this cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _short_lived_shuffles(spark):
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table that `written` made and that no later step reads."""
    path = df.__dict__.get("_tessera_path")
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect garbage: what finished queries broadcast, and the classes generated for them, goes with their plans, on
    the driver and on executors.  For operators of many queries, between rounds."""
    spark._jvm.System.gc()


def slices(lengths, limit: int = CHUNK):
    """(start, end) of consecutive rows whose lengths sum to about limit at most."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def order_bounds(df: DataFrame, key: str, rows_per_bucket: int = 256) -> list[int]:
    """Upper bounds, ascending, that deal the rows of df by a long key to buckets of about equal size.

    The last bucket has no bound.  Values are taken from the key itself; nulls count as the lowest.
    At most MAX_BUCKETS - 1 longs come to the driver."""
    n = df.select(key).where(F.col(key).isNotNull()).count()
    k = min(MAX_BUCKETS, max(1, n // rows_per_bucket))
    if k == 1:
        return []
    at = [i / k for i in range(1, k)]
    got = df.agg(F.percentile_approx(key, at, max(10_000, 8 * k)).alias("b")).first()["b"]
    return sorted(set(got or []))


def long_array(values: list[int]) -> Column:
    """A constant array; one literal however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below the key, found over two levels of constant arrays; 0 for null."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    top, flat = long_array([bounds[min(i + width, len(bounds)) - 1] for i in range(0, len(bounds), width)]), long_array(bounds)
    r = F.size(F.filter(top, lambda b: b < key))
    return F.coalesce(r * width + F.size(F.filter(F.slice(flat, r * width + 1, F.lit(width)), lambda b: b < key)), F.lit(0)).cast("int")
