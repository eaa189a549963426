"""Document fingerprints: a homomorphic multiset hash of paragraphs, in built-in functions only.

A paragraph (a line of the text) hashes to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, each
lane modulo a power of two.  So it does not depend on the order of paragraphs, and a paragraph is inserted or deleted by adding
or subtracting its vector.  The vector has two parts:

- EXACT lanes of 32 bits from independent 64-bit hashes of the paragraph (256 bits together), for equality;
- SIGN lanes: each sentence of the paragraph adds 0 or 1 to each of 126 lanes by bits of its hash.  Less half the number of
  sentences these are sums of random signs, so the cosine of two fingerprints estimates the share of common sentences.

Three sign lanes of 21 bits lie in one long.  A text without any sentence has zero lanes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, long_array, order_bounds

EXACT = 8
SHIFTS, PER_LONG, HASHES = 21, 3, 2
SIGN_MASK = 1 | 1 << 21 | 1 << 42
#: The highest bit of each sign lane, and all other bits of the three.
TOPS = SIGN_MASK << 20
REST = (1 << 63) - 1 ^ TOPS
LOW32 = (1 << 32) - 1


def with_lanes(df: DataFrame, text: str, out: str) -> DataFrame:
    """df and the summed vector of a text column: count of sentences, EXACT lanes, then the packed SIGN lanes (array of long).

    Each step has its own projection, so that the parts and their hashes are made once for all lanes."""
    kept = df.columns
    names = [f"__{out}_{k}" for k in range(EXACT // 2 + HASHES)]
    p, s = f"__{out}_p", f"__{out}_s"
    df = df.withColumns({p: F.filter(F.split(F.col(text), "\n"), lambda x: x != ""), s: F.filter(F.transform(F.split(F.col(text), "[\n.!?]+"), lambda x: F.trim(x)), lambda x: x != "")})
    df = df.withColumns({name: _hashes(F.col(p if k < EXACT // 2 else s), k) for k, name in enumerate(names)})
    lanes = [F.size(s).cast("long")]
    for name in names[: EXACT // 2]:
        lanes.append(_sum(F.col(name), lambda h: h.bitwiseAND(F.lit(LOW32)), LOW32))
        lanes.append(_sum(F.col(name), lambda h: F.shiftrightunsigned(h, 32), LOW32))
    for name in names[EXACT // 2 :]:
        lanes += [F.aggregate(F.col(name), F.lit(0).cast("long"), _add_signs(i)) for i in range(SHIFTS)]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.array(*lanes).alias(out))


def _add_signs(i: int):
    """Three lanes of 21 bits, each modulo 2 ** 21: no lane carries into the next."""
    return lambda acc, h: (acc.bitwiseAND(F.lit(REST)) + _sign_lane(i)(h)).bitwiseXOR(acc.bitwiseAND(F.lit(TOPS)))


def _sign_lane(i: int):
    return lambda h: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(SIGN_MASK))


def _hashes(parts: Column, salt: int) -> Column:
    return F.transform(parts, lambda p: F.xxhash64(F.lit(salt), p))


def _sum(hashes: Column, lane, modulus_mask: int) -> Column:
    """Sum of lane(hash) over an array, modulo a power of two at each step."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: (acc + lane(h)).bitwiseAND(F.lit(modulus_mask)))


def fingerprint_string(lanes: Column) -> Column:
    """Lower-case hex, 16 digits for each long."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _unpack(k: int, n: Column):
    return lambda x: F.shiftrightunsigned(x, 21 * k).bitwiseAND(F.lit((1 << 21) - 1)) * F.lit(2.0) - n


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the sign lanes, at least 0."""
    def signs(lanes: Column) -> Column:
        packed = F.slice(lanes, EXACT + 2, SHIFTS * HASHES)
        n = F.get(lanes, F.lit(0)).cast("double")
        return F.flatten(F.array(*[F.transform(packed, _unpack(k, n)) for k in range(PER_LONG)]))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    x, y = signs(a), signs(b)
    size = dot(x, x) * dot(y, y)
    cosine = F.when(size > 0, dot(x, y) / F.sqrt(size)).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of a multiset after the insertion (sign 1) or deletion (-1) of the paragraphs summed in b."""
    def lane(x: Column, y: Column, i: Column) -> Column:
        tops, rest = F.lit(TOPS), F.lit(REST)
        if sign > 0:
            plain, packed = x + y, (x.bitwiseAND(rest) + y.bitwiseAND(rest)).bitwiseXOR(x.bitwiseXOR(y).bitwiseAND(tops))
        else:
            plain, packed = x - y, (x.bitwiseOR(tops) - y.bitwiseAND(rest)).bitwiseXOR(x.bitwiseXOR(F.bitwise_not(y)).bitwiseAND(tops))
        return F.when(i == 0, plain).when(i <= EXACT, plain.bitwiseAND(F.lit(LOW32))).otherwise(packed)

    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda v, i: lane(v["x"], v["y"], i))


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """df with lanes and fingerprint; a null text counts as empty.

    Columns of these names in df are replaced, all others stay whatever their names; repeated rows and null ids stay; texts are whole;
    an empty table gives no rows."""
    df = df.drop("lanes", "fingerprint") if text not in ("lanes", "fingerprint") else df
    rows = with_lanes(df.withColumn("__tessera_text", F.coalesce(F.col(text), F.lit(""))), "__tessera_text", "lanes").drop("__tessera_text")
    return rows.withColumn("fingerprint", fingerprint_string(F.col("lanes")))


def with_next(docs: DataFrame, rows_per_bucket: int = 256) -> tuple[DataFrame, "Window"]:
    """doc_id, text of every row, dealt to buckets of the doc_id order with the first row of the next lower bucket after them
    (ghost = 1), and the window in which lead() gives the next document by descending doc_id; after the last comes the first.

    One shuffle of the rows, and none goes to all: the bounds are doc_ids, so a bucket's first row is known by its id.
    Nulls in doc_id come last, ties are ordered by text."""
    bounds = order_bounds(docs, "doc_id", rows_per_bucket)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    top = src.agg(F.max("doc_id")).first()[0]
    b = F.col("b")
    src = src.withColumn("b", bucket_of(F.col("doc_id"), bounds))
    places = [F.array(F.struct(b.alias("bucket"), F.lit(0).alias("ghost"), F.lit(0).alias("wrap")))]
    if bounds:
        at_bound = F.get(long_array(bounds), b) == F.col("doc_id")
        places.append(F.when(at_bound, F.array(F.struct((b + 1).alias("bucket"), F.lit(1).alias("ghost"), F.lit(0).alias("wrap")))))
    first = F.col("doc_id") == F.lit(top) if top is not None else F.lit(True)
    places.append(F.when(first, F.array(F.struct(F.lit(0).alias("bucket"), F.lit(1).alias("ghost"), F.lit(1).alias("wrap")))))
    none = F.array().cast("array<struct<bucket:int,ghost:int,wrap:int>>")
    dealt = src.select("doc_id", "text", F.inline(F.concat(*[F.coalesce(p, none) for p in places])))
    return dealt, Window.partitionBy("bucket").orderBy("wrap", F.col("doc_id").desc_nulls_last(), "text")


def op7_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    A null text counts as empty; null doc_ids come last and ties are in the order of their texts; repeated rows are documents of their
    own; of an only document it is the next itself; texts are whole; other columns take no part, whatever their names; an empty
    table gives no rows."""
    dealt, order = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    after = F.coalesce(F.lead("text").over(order), F.lit(""))
    rows = dealt.withColumn("after", after).select("doc_id", "text", "bucket", "ghost", "wrap", n.alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("after"), F.lit(1), half)).alias("edited"))
    rows = with_lanes(rows, "text", "lanes")
    rows = rows.withColumn("next_lanes", F.lead("lanes").over(order)).where("ghost = 0").drop("text")
    rows = with_lanes(rows, "edited", "edited_lanes")
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint_string(F.col("lanes")).alias("fingerprint"), fingerprint_string(F.col("edited_lanes")).alias("edited_fingerprint"), likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.coalesce(F.col("next_lanes"), F.col("lanes"))).alias("near_next"))
