"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, secret scans, BPE encoding and decoding.

Each stage is given (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; `run` writes it as
Parquet in the shared folder and rereads it as the next one's docs.  All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import op10_digest
from tessera.llm.common import table, written
from tessera.llm.decontaminate import find_contamination
from tessera.llm.langid import UNKNOWN, fit_model, held_out, identify
from tessera.llm.ngram_join import near_duplicates
from tessera.llm.secrets import redact_secrets


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts and texts without a letter go.  A null lang is filled with the predicted
    one; other values of lang stay.  Null ids and repeated rows stay; other columns stay whatever their names."""
    got = identify(docs, fit_model(docs.where(~held_out()))).where(F.col("lang_pred") != UNKNOWN)
    return got.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates (nulls last, then by the text's hash); of equal rows one.

    Documents that link with nothing stay, and so do texts without a word.  Different texts under one doc_id are different
    documents; columns beside doc_id and text take no part in the choice, and of rows equal in these any one stays."""
    groups = written(near_duplicates(docs), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    key = ["__id", "__null", "__hash"]
    names = [F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__null"), F.col("text_hash").alias("__hash")]
    least = groups.where("group_id is not null").groupBy("group_id").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_hash")
    keys = groups.select(*names, F.col("group_id").isNull().alias("wordless")).groupBy(*key, "wordless").agg(F.count("*").alias("times"))
    # written, so that joins with the texts go by known sizes; texts are shuffled only for rows that are there more than once
    kept = written(keys.join(least.select(*names, F.lit(True).alias("first")), key, "left").where("wordless or first").select(*key, (F.expr("times > 1 and not wordless")).alias("again")), "kept")
    named = docs.withColumn("text_hash", F.xxhash64(F.col("text").cast("string"))).select(*docs.columns, *names)
    once = named.join(kept.where("not again"), key, "left_semi")
    again = named.join(kept.where("again"), key, "left_semi").dropDuplicates(key)
    return once.unionByName(again).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates.

    Rows are named by a hash of doc_id and text, so a null or shared doc_id keeps no contaminated row and loses no clean one; null
    and empty texts stay, repeated rows stay or go together."""
    named = docs.withColumn("__row", F.xxhash64(F.lit("row"), "doc_id", F.col("text").cast("string")))
    found = find_contamination(named.select(F.col("__row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__row"))
    found = written(found.distinct(), "contaminated")  # its size is known then, and the texts need not be shuffled if it is small
    return named.join(found, "__row", "left_anti").select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of a secret, base or decoded, replaced by the name of its kind, and n_chars made to match.

    Null texts stay null, with a null n_chars; empty ones, null ids and repeated rows stay as they are."""
    return redact_secrets(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of all documents; nulls and repeated rows as op10_digest says."""
    return op10_digest(docs)


STAGES = [
    ("language", language_stage),
    ("jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]
#: No stage but the second is expressible in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
