"""Writers: documents by slot or category, exports, results and audit rows.  Paths are folders of files that Spark writes in parallel."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import first_by_priority

_NAME = re.compile(r"^[A-Za-z0-9_.-]+$")


def safe_name(name: str) -> str:
    """A name that cannot leave its folder."""
    if not _NAME.match(name) or name in (".", ".."):
        raise ValueError(f"not a plain name: {name!r}")
    return name


def envelopes(questions: DataFrame, key: str = "slot") -> DataFrame:
    """One document for each slot: counts by category and its questions in order.  A slot's questions are some dozens."""
    columns = [c for c in questions.columns if c != key]
    counts = questions.groupBy(key, "category").agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_counts"))
    docs = questions.groupBy(key).agg(F.count("*").alias("total_questions"), F.array_sort(F.collect_list(F.struct(*columns))).alias("qa_pairs"))
    return docs.join(counts, key)


def write_slots(questions: DataFrame, path: str, key: str = "slot") -> None:
    """A folder of documents for each slot (K1)."""
    envelopes(questions, key).write.mode("overwrite").partitionBy(key).json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to what is there: a finished batch is kept without writing the others again (K2, K6)."""
    df.write.mode("append").parquet(path)


def write_categories(questions: DataFrame, path: str) -> None:
    """A folder of questions for each category (K3); a category's name must be plain."""
    for r in questions.select("category").distinct().collect():  # the categories are a fixed few
        safe_name(r[0])
    questions.write.mode("overwrite").partitionBy("category").json(path)


def write_results(results: DataFrame, path: str, strategy: str, model: str) -> None:
    """Evaluation results by category in a folder of their strategy and model (K5)."""
    results.write.mode("overwrite").partitionBy("category").json(f"{path}/{safe_name(strategy)}_{safe_name(model.replace('/', '_'))}")


def write_points(clouds: DataFrame, path: str) -> None:
    """Point arrays with their labels and metadata as columns of one table (K7)."""
    clouds.write.mode("overwrite").parquet(path)


def audit(spark: SparkSession, path: str, rows: list[tuple[str, str, str]]) -> None:
    """Progress, errors and model calls as rows (kind, key, text) of one table."""
    append_rows(spark.createDataFrame(rows, "kind string, key string, text string").withColumn("at", F.current_timestamp()), path)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has no result yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def latest(audit_rows: DataFrame) -> DataFrame:
    """The last row of each kind and key."""
    return first_by_priority(audit_rows, ["kind", "key"], -F.unix_micros("at"))


def markdown(df: DataFrame, key: str, title: str, columns: dict[str, str]) -> DataFrame:
    """key and text: a Markdown section with a line for each column (name: label)."""
    lines = [F.concat(F.lit(f"- {label}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c, label in columns.items()]
    return df.select(key, F.concat_ws("\n", F.concat(F.lit(f"## {title} "), F.col(key).cast("string")), *lines).alias("text"))
