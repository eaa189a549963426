"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from .bpe import op10_digest
from .common import table
from .decontaminate import op6_contamination
from .fingerprint import op7_edits
from .html_text import op3_text
from .langid import op2_predict
from .licenses import op4_scan
from .ngram_join import op9_components
from .pii import op8_digest
from .secrets import op1_digest
from .token_store import op5_tokens


def op8_pii(spark, sf_dir):
    return op8_digest(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return op9_components(table(spark, sf_dir, "documents"))


def op10_bpe(spark, sf_dir):
    return op10_digest(table(spark, sf_dir, "documents"))


def op1_secrets(spark, sf_dir):
    return op1_digest(table(spark, sf_dir, "documents"))


def op2_language(spark, sf_dir):
    return op2_predict(table(spark, sf_dir, "documents"))


def op3_html_text(spark, sf_dir):
    return op3_text(table(spark, sf_dir, "pages"))


def op4_licenses(spark, sf_dir):
    return op4_scan(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return op6_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_store(spark, sf_dir):
    return op5_tokens(table(spark, sf_dir, "documents"))


def op7_multiset_hash(spark, sf_dir):
    return op7_edits(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_language, op3_html_text, op4_licenses, op5_token_store, op6_decontamination, op7_multiset_hash, op8_pii, op9_jaccard_join, op10_bpe)}
#: The other operators' results are no SQL: they are tested against brute force, libraries or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op9_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
 t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s), p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
 e AS (SELECT u, v FROM p UNION SELECT v, u FROM p), r AS (SELECT u AS node, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.node), m AS (SELECT node, min(c) AS c FROM r GROUP BY node)
 SELECT s.doc_id, len(s) AS n_shingles, coalesce(least(m.c, s.doc_id), s.doc_id) AS component_id FROM s LEFT JOIN m ON m.node = s.doc_id""",
}
