"""Token-id output: blocks of separately compressed documents with one shared zstandard dictionary.

File format.  A store is a folder with two Parquet tables, so that it can lie in any store that Spark writes:
`dictionary` (one row: hash, dictionary) and `blocks` (bucket, seq, first_doc_id, last_doc_id, tokens_before, tokens, block).
A block holds documents in ascending doc_id order (nulls first, ties by content) as bytes:

    magic "TIDS1", id width (1 byte: 2 or 4), dictionary SHA-256 (32 bytes), number of documents (u32),
    null flags (u8 each), doc_ids (i64 each), token counts (u64 each), offsets (u64 each and one more), frames

Each frame is one document's little-endian ids, compressed alone with the shared dictionary, so a short document is read by
its offset without its neighbours.  tokens_before counts the ids of the bucket's earlier blocks.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode_batches, tokenizer_path
from .common import new_path, order_bounds, small_batches

MAGIC = b"TIDS1"
#: The dictionary is trained on at most this many documents (those of the lowest hash of doc_id) and ids of each.
DICT_DOCS, DICT_IDS, DICT_BYTES = 1000, 4096, 64 * 1024
#: A block is closed when its frames reach this many bytes.
BLOCK_BYTES = 128 * 1024
LEVEL = 3


def _pack(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _coder(dictionary: bytes, compress: bool):
    import zstandard as zs

    d = zs.ZstdCompressionDict(dictionary) if dictionary else None
    if not compress:
        return zs.ZstdDecompressor(dict_data=d)
    if d:
        d.precompute_compress(level=LEVEL)
    return zs.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True)


def train_dictionary(docs: DataFrame, path: str, end_id: int, width: int) -> bytes:
    """A dictionary from the serialized ids of a bounded sample of documents; empty if there is too little to train on."""
    import zstandard as zs

    low = [r[0] for r in docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICT_DOCS).collect()]
    if not low:
        return b""
    src = docs.where(F.col("doc_id").isin(low)).select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        for rows, ids in encode_batches(batches, path, 1, library=True):
            cut = [_pack(x[: 4 * DICT_IDS] + end_id.to_bytes(4, "little"), width) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], names=["x"])

    samples = sorted(r[0] for r in src.mapInArrow(run, "x binary").limit(2 * DICT_DOCS).collect())
    try:
        return zs.train_dictionary(DICT_BYTES, [bytes(x) for x in samples]).as_bytes()
    except zs.ZstdError:
        return b""


def write_token_store(docs: DataFrame, where: str, path: str, end_id: int = 2) -> None:
    """Encode every whole text of docs (doc_id, text; null text: no ids) with the tokenizers library, append end_id and write the store.

    Each worker has the library encode a piece once and keeps its ids; whole texts through it would take five times as long.
    Texts are encoded and compressed where they are read; only frames are shuffled, to buckets of the doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)
    from .bpe import load

    width = 2 if max(load(path).size, end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, path, end_id, width)
    digest = hashlib.sha256(dictionary).digest()
    bounds = np.array(order_bounds(docs, "doc_id"), np.int64)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def frames(batches):
        coder, end = _coder(dictionary, True), end_id.to_bytes(4, "little")
        for rows, ids in encode_batches(batches, path, 1, library=True):
            key = rows.column(0)
            bucket = np.where(np.asarray(key.is_null()), 0, np.searchsorted(bounds, key.fill_null(0).to_numpy(zero_copy_only=False)))
            n = pa.array([len(x) // 4 + 1 for x in ids], pa.int64())
            made = pa.array([coder.compress(_pack(x + end, width)) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), key, n, made], names=["bucket", "doc_id", "n", "frame"])

    def blocks(batches):
        now, seq, before, rows, size = None, 0, 0, [], 0

        def close():
            n = len(rows)
            off = np.cumsum([0, *(len(r[2]) for r in rows)]).astype("<u8")
            head = MAGIC + bytes([width]) + digest + struct.pack("<I", n) + bytes(r[0] is None for r in rows)
            body = np.array([r[0] or 0 for r in rows], "<i8").tobytes() + np.array([r[1] for r in rows], "<u8").tobytes() + off.tobytes()
            return pa.RecordBatch.from_pylist([{"bucket": now, "seq": seq, "first_doc_id": rows[0][0], "last_doc_id": rows[-1][0], "tokens_before": before, "tokens": sum(r[1] for r in rows), "block": head + body + b"".join(r[2] for r in rows)}], schema=schema)

        for batch in batches:
            for b, k, n, f in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (b != now or size >= BLOCK_BYTES):
                    yield close()
                    seq, before, rows, size = seq + 1, before + sum(r[1] for r in rows), [], 0
                if b != now:
                    now, seq, before = b, 0, 0
                rows.append((k, n, f))
                size += len(f)
        if rows:
            yield close()

    schema = pa.schema([("bucket", pa.int32()), ("seq", pa.int64()), ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()), ("tokens_before", pa.int64()), ("tokens", pa.int64()), ("block", pa.binary())])
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{where}/dictionary")
    made = src.mapInArrow(frames, "bucket int, doc_id long, n long, frame binary").repartition(F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "frame")
    made.mapInArrow(blocks, "bucket int, seq long, first_doc_id long, last_doc_id long, tokens_before long, tokens long, block binary").write.option("compression", "none").parquet(f"{where}/blocks")


def unpack_block(block: bytes, dictionary: bytes, only: int | None = None):
    """(doc_id, tokens of the block before it, ids) of each document, or of those with one doc_id; frames of others stay packed."""
    width, digest, n = block[5], block[6:38], struct.unpack_from("<I", block, 38)[0]
    if block[:5] != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a block of this store")
    at = 42
    null = block[at : at + n]
    keys, counts, off = (np.frombuffer(block, t, m, at + n + 8 * k) for t, m, k in (("<i8", n, 0), ("<u8", n, n), ("<u8", n + 1, 2 * n)))
    first, coder = at + n + 8 * (3 * n + 1), _coder(dictionary, False)
    starts = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    for i in range(n):
        key = None if null[i] else int(keys[i])
        if only is None or key == only:
            raw = coder.decompress(block[first + int(off[i]) : first + int(off[i + 1])])
            yield key, int(starts[i]), np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")


def _dictionary(spark: SparkSession, where: str) -> bytes:
    return bytes(spark.read.parquet(f"{where}/dictionary").first()["dictionary"])


def read_token_store(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian u32) of every document of a store."""
    small_batches(spark)
    dictionary = _dictionary(spark, where)
    blocks = spark.read.parquet(f"{where}/blocks")
    sums = blocks.groupBy("bucket").agg(F.sum("tokens").alias("t"))  # MAX_BUCKETS rows at most
    begin = sums.select("bucket", (F.sum("t").over(Window.orderBy("bucket")) - F.col("t")).alias("bucket_start"))
    src = blocks.join(F.broadcast(begin), "bucket").select((F.col("bucket_start") + F.col("tokens_before")).alias("at"), "block")

    def run(batches):
        for batch in batches:
            for at, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(k, at + s, len(x), x.tobytes()) for k, s, x in unpack_block(block.as_py(), dictionary)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

    return src.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def get_document(spark: SparkSession, where: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with one doc_id, read from the blocks whose range holds it."""
    rows = spark.read.parquet(f"{where}/blocks").where((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id)).orderBy("seq").select("block").collect()
    dictionary = _dictionary(spark, where)
    return [ids for r in rows for _, _, ids in unpack_block(bytes(r[0]), dictionary, doc_id)]


def op5_tokens(docs: DataFrame, path: str | None = None, where: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from a store written to and read back from the shared folder.

    Null and empty texts have the end id only; null doc_ids come first and ties are ordered by their packed ids; repeated rows are
    documents of their own; texts are whole however long; other columns take no part, whatever their names; an empty table gives no
    rows."""
    spark = docs.sparkSession
    where = where or new_path(spark, "token_store")
    write_token_store(docs, where, path or tokenizer_path())
    return read_token_store(spark, where).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
