"""Queries of frame sampling, model answers and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import models, rouge
from tessera.sources.adapters import table
from tessera.sources.views import cte, rows

from .catalogue import query

SAMPLES = 16
#: Clips of a group of cameras: a brand's parts, each with a number of frames; the first camera by number is the ego view.
CLIPS = "clips AS (SELECT p_brand AS grp, p_partkey AS camera, CAST(p_size AS BIGINT) * 10 + 5 AS frames FROM part)"


def clips(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_brand AS grp", "p_partkey AS camera", "CAST(p_size AS BIGINT) * 10 + 5 AS frames")


def spread(total: str, n: int = SAMPLES) -> str:
    """The i-th of n evenly spaced places from the first to the last of total, or the i-th place if there are fewer."""
    return f"CASE WHEN {total} < {n} THEN i ELSE CAST((i * ({total} - 1) - (i * ({total} - 1)) % {n - 1}) / {n - 1} AS BIGINT) END"


def sampled(df, total: str):
    return df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SAMPLES - 1).cast("long")))).where(f"i < {total}")


_I = f"range({SAMPLES}) AS t(i)"


@query(f"WITH {CLIPS} SELECT camera, i, {spread('frames')} AS frame FROM clips, {_I} WHERE i < frames")
def e02_uniform_frames(spark, sf_dir):
    return sampled(clips(spark, sf_dir), "frames").selectExpr("camera", "i", f"{spread('frames')} AS frame")


@query(f"WITH {CLIPS}, m AS (SELECT grp, min(frames) AS least, count(*) AS n FROM clips GROUP BY grp) SELECT grp, i, {spread('least')} AS frame, CAST(ceil(sqrt(n)) AS BIGINT) AS columns, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS grid_rows FROM m, {_I} WHERE i < least")
def e03_stitched_frames(spark, sf_dir):
    """Frames that all cameras of a group have, and the grid that holds them side by side."""
    m = clips(spark, sf_dir).groupBy("grp").agg(F.min("frames").alias("least"), F.count("*").alias("n"))
    return sampled(m, "least").selectExpr("grp", "i", f"{spread('least')} AS frame", "ceil(sqrt(n)) AS columns", "CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS grid_rows")


@query(f"""WITH {CLIPS}, k AS (SELECT grp, arg_min(frames, camera) AS frames, count(*) AS n, min(camera) AS ego FROM clips GROUP BY grp), g AS (SELECT *, {spread('(frames * n)')} AS g FROM k, {_I} WHERE i < frames * n)
 SELECT grp, i, g % n AS video, CAST((g - g % n) / n AS BIGINT) AS frame, ego, {spread('frames')} AS ego_frame FROM g""")
def e04_interleaved_frames(spark, sf_dir):
    """One run of frames over all videos of a group in turn, by the first one's length, and the ego view alone."""
    c = clips(spark, sf_dir).groupBy("grp").agg(F.min_by("frames", "camera").alias("frames"), F.count("*").alias("n"), F.min("camera").alias("ego"))
    g = sampled(c, "(frames * n)").withColumn("g", F.expr(spread("(frames * n)")))
    return g.selectExpr("grp", "i", "g % n AS video", "CAST((g - g % n) / n AS BIGINT) AS frame", "ego", f"{spread('frames')} AS ego_frame")


QA = cte("qa")
_LETTER = "substr('ABCD', CAST(CAST('0x' || substr(md5(question_id || ' ' || question), 1, 4) AS BIGINT) % 4 + 1 AS INTEGER), 1)"


def answered(spark, sf_dir):
    q = rows(spark, sf_dir, "qa").select("question_id", "category", "correct_idx", F.concat_ws(" ", "question_id", "question").alias("prompt"))
    return models.ask(q, "prompt").select("question_id", "category", F.lower("reply").alias("predicted"), F.lower(F.chr(F.col("correct_idx") + 65)).alias("correct"))


_ANSWERED = f"{QA}, an AS (SELECT question_id, category, lower({_LETTER}) AS predicted, lower(chr(65 + correct_idx)) AS correct FROM qa)"


@query(f"WITH {_ANSWERED} SELECT question_id, predicted, correct, predicted = correct AS is_correct FROM an")
def e05_letter_matches(spark, sf_dir):
    return answered(spark, sf_dir).select("question_id", "predicted", "correct", (F.col("predicted") == F.col("correct")).alias("is_correct"))


@query(f"WITH {_ANSWERED} SELECT category, count(*) AS n, count(*) FILTER (predicted = correct) AS n_correct, count(*) FILTER (predicted = correct) * 1000 // count(*) AS per_mille FROM an GROUP BY ROLLUP (category)")
def a19_accuracy(spark, sf_dir):
    """Accuracy of each category and of all."""
    return answered(spark, sf_dir).rollup("category").agg(F.count("*").alias("n"), F.count_if(F.expr("predicted = correct")).alias("n_correct"), F.expr("count_if(predicted = correct) * 1000 div count(*)").alias("per_mille"))


def turn_pairs(spark, sf_dir):
    """Each turn of odd number with the one before it."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("turn % 2 = 1").select("conv_id", "turn", F.col("text").alias("reference"))
    return c.where("turn % 2 = 0").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("hypothesis")).join(a, ["conv_id", "turn"])


_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_GRAMS = f"""t AS (SELECT conv_id, turn, {_TOKENS} AS s FROM conversations), g AS (SELECT conv_id, turn, 1 AS n, unnest(s) AS w FROM t UNION ALL SELECT conv_id, turn, 2, unnest(list_transform(range(1, greatest(len(s), 1)), lambda i: s[i] || ' ' || s[i + 1])) FROM t),
 c AS (SELECT conv_id, turn, n, w, count(*) AS k FROM g GROUP BY ALL), p AS (SELECT h.conv_id, h.turn + 1 AS turn, h.n, h.w, least(h.k, r.k) AS k FROM c h JOIN c r ON h.conv_id = r.conv_id AND h.turn % 2 = 0 AND r.turn = h.turn + 1 AND h.n = r.n AND h.w = r.w),
 m AS (SELECT conv_id, turn, sum(k) FILTER (n = 1) AS m1, sum(k) FILTER (n = 2) AS m2 FROM p GROUP BY ALL)"""


@query(f"""WITH {_GRAMS} SELECT h.conv_id, r.turn, CASE WHEN len(h.s) + len(r.s) = 0 THEN 0 ELSE CAST(2000 * coalesce(m1, 0) // (len(h.s) + len(r.s)) AS BIGINT) END AS rouge1_milli,
 CASE WHEN greatest(len(h.s) - 1, 0) + greatest(len(r.s) - 1, 0) = 0 THEN 0 ELSE CAST(2000 * coalesce(m2, 0) // (greatest(len(h.s) - 1, 0) + greatest(len(r.s) - 1, 0)) AS BIGINT) END AS rouge2_milli
 FROM t h JOIN t r ON h.conv_id = r.conv_id AND h.turn % 2 = 0 AND r.turn = h.turn + 1 LEFT JOIN m ON m.conv_id = h.conv_id AND m.turn = r.turn""")
def e06_rouge_overlap(spark, sf_dir):
    """F1 of ROUGE-1 and ROUGE-2 without stems, in built-in functions."""
    p = turn_pairs(spark, sf_dir).select("conv_id", "turn", rouge.tokens(F.col("hypothesis")).alias("h"), rouge.tokens(F.col("reference")).alias("r"))
    for n in (1, 2):
        p = p.withColumns({f"h{n}": rouge.ngrams(F.col("h"), n), f"r{n}": rouge.ngrams(F.col("r"), n)})
    f1 = lambda n: F.expr(f"case when size(h{n}) + size(r{n}) = 0 then 0L else 2000L * m{n} div (size(h{n}) + size(r{n})) end").alias(f"rouge{n}_milli")
    return p.withColumns({f"m{n}": rouge.shared(F.col(f"h{n}"), F.col(f"r{n}")) for n in (1, 2)}).select("conv_id", "turn", f1(1), f1(2))


@query()
def e06_rouge_scores(spark, sf_dir):
    """F1 of ROUGE-1, ROUGE-2 and ROUGE-L with stems, of each turn of odd number with the one before it."""
    return turn_pairs(spark, sf_dir).withColumn("s", rouge.rouge(F.col("hypothesis"), F.col("reference"))).select("conv_id", "turn", "s.rouge1", "s.rouge2", F.col("s.rougeL").alias("rouge_l"))


@query(f"WITH {QA} SELECT slot || '_' || category || '_' || CAST(row_number() OVER (PARTITION BY slot, category ORDER BY n) - 1 AS VARCHAR) AS key, 'A) ' || option_0 || '|B) ' || option_1 || '|C) ' || option_2 || '|D) ' || option_3 AS candidates, lower(chr(65 + correct_idx)) AS answer FROM qa")
def s23_dataset_entries(spark, sf_dir):
    """Questions as an evaluation reads them: a key with the place among its video's questions of the category, lettered options, answers in lower case."""
    from pyspark.sql import Window

    q = rows(spark, sf_dir, "qa")
    i = F.row_number().over(Window.partitionBy("slot", "category").orderBy("n")) - 1
    options = F.concat_ws("|", *[F.concat(F.lit(f"{c}) "), F.col(f"option_{k}")) for k, c in enumerate("ABCD")])
    return q.select(F.concat_ws("_", "slot", "category", i.cast("string")).alias("key"), options.alias("candidates"), F.lower(F.chr(F.col("correct_idx") + 65)).alias("answer"))
