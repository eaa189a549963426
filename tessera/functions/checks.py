"""The rule engine for generated questions: each rule has a check, a name, a severity and a predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dialect import DUCK, SPARK, Dialect
from .text import FORBIDDEN, LEAKS, any_of

# Points that an issue of a severity costs.
WEIGHTS = {"error": 10, "warning": 5, "info": 1}
# Words before which "a" is right though they begin with a vowel, and words in -sing that are right.
A_WORDS = "uni\\w*|european|euclidean|eulerian|user|useful|usual|utensil|utility|uranium|one|once"
SING_WORDS = "missing|passing|crossing|dressing|pressing|blessing|guessing|assessing|processing|accessing|addressing|expressing|possessing|discussing|bussing|kissing|tossing|fussing|messing|stressing|confessing|obsessing|caressing|reassessing|progressing|impressive|using|housing|causing|pausing|refusing|abusing|amusing|bruising|choosing|closing|composing|losing|opposing|proposing|raising|praising|rising|surprising|advising|exercising|promising|comprising|disguising|revising|supervising|nursing|purchasing|reversing|licensing|sensing|rinsing|dispensing|conversing|rehearsing|endorsing|immersing|coercing|cursing"
VERBS = "close|open|exit|enter|pick|put|sit|stand|walk|talk|read|ride|carry|load|unload|text"
COLOURS = "blue|red|green|black|white|gray|grey|dark|light|navy|teal|indigo|brown|beige|olive|pink|purple|plum|maroon|khaki|camo|charcoal"
GENERIC = "a person|someone|an individual|a vehicle|the person|the individual|a man|a woman"
ACTS = "who|that|opens|closes|exits|enters|walks|sits|stands|talks|carries|picks|puts|rides|reads|loads|unloads"
RESTRICTED = "category IN ('temporal', 'event_ordering', 'spatial', 'counting')"
FIRST = r"(\w[\w\s]*?)\s+(?:occurred|happened|took place)\s+first"

_IN_RANGE = "correct_idx >= 0 AND correct_idx < 4"
_EXPECTED = "CASE correct_idx WHEN 0 THEN option_0 WHEN 1 THEN option_1 WHEN 2 THEN option_2 WHEN 3 THEN option_3 END"
_ALL = "question || ' ' || option_0 || ' ' || option_1 || ' ' || option_2 || ' ' || option_3"


def _apart(d: Dialect) -> str:
    """The answer and the option it should be share less than half of their words."""
    a, b = "lower(trim(answer))", f"lower(trim({_EXPECTED}))"
    return f"{_IN_RANGE} AND reasoning <> '' AND answer <> '' AND {a} <> {b} AND {d.shared(a, b)} * 2 < greatest({d.words(a)}, {d.words(b)})"


def _first(d: Dialect) -> str:
    said = f"trim({d.extract('lower(reasoning)', FIRST)})"
    return f"category = 'temporal' AND answer <> '' AND length({said}) > 5 AND strpos(lower(answer), {said}) = 0".replace("strpos", "instr" if d.spark else "strpos")


def _observed(d: Dialect) -> str:
    said = d.extract("lower(reasoning)", r"observed\s+(\d+)\s+time")
    return f"category = 'counting' AND {said} <> '' AND CAST(CASE WHEN {said} = '' THEN '0' ELSE {said} END AS BIGINT) <> cnt"


def _article(d: Dialect) -> str:
    rest = d.sub("lower(question)", rf"\ba\s+({A_WORDS})\b", " ")
    return d.match(rest, r"\ba\s+[aeiou]\w*\b")


def _sing(d: Dialect) -> str:
    return d.match(d.sub("lower(question)", rf"\b({SING_WORDS})\b", " "), r"\b\w+(es|[^s]s)ing\b")


def _generic(d: Dialect) -> str:
    """A generic reference with an activity after it, and none with a colour or garment."""
    clothed = rf"(^|\s)({GENERIC})([,\s]+(wearing|in\s+(a\s+)?({COLOURS})\b|with\s+(a\s+)?(blue|red|green|black|white|gray|dark|hat|bag|backpack|hoodie|jacket)\b))"
    return f"{d.match('lower(question)', rf'(^|\s)({GENERIC})\s+({ACTS})\b')} AND NOT {d.match('lower(question)', clothed)}"


def _cat(name: str, predicate: str):
    return lambda d: f"category = '{name}' AND {predicate}"


def _plain(predicate: str):
    return lambda d: predicate


def _hits(patterns: list[str], column: str = _ALL):
    return lambda d: d.match(column, any_of(patterns))


#: (check, rule, severity, predicate in a dialect) over the columns of a question.
RULES = [
    ("category", "same_camera", "error", _cat("temporal", "a_camera = b_camera")),
    ("category", "gap_small", "error", _cat("temporal", "gap_ds < 30")),
    ("category", "gap_large", "error", _cat("temporal", "gap_ds > 200")),
    ("category", "not_before", "error", _cat("temporal", "a_start >= b_start")),
    ("category", "no_distance", "error", _cat("spatial", "distance_dm IS NULL")),
    ("category", "near_but_far", "error", _cat("spatial", "proximity = 'near' AND distance_dm > 50")),
    ("category", "not_moderate", "error", _cat("spatial", "proximity = 'moderate' AND (distance_dm <= 50 OR distance_dm > 150)")),
    ("category", "far_but_near", "error", _cat("spatial", "proximity = 'far' AND distance_dm <= 150")),
    ("category", "crosses_apart", "error", _cat("spatial", "crosses AND distance_dm > 20")),
    ("category", "no_question_type", "error", _plain("category IN ('summarization', 'counting', 'best_camera') AND question_type IS NULL")),
    ("category", "count_range", "error", _cat("counting", "(cnt < 2 OR cnt > 20)")),
    ("category", "no_camera", "error", _cat("best_camera", "correct_camera IS NULL")),
    ("category", "too_few_events", "error", _cat("event_ordering", "n_ordered < 3")),
    ("category", "min_gap_small", "error", _cat("event_ordering", "min_gap_ds < 30")),
    ("category", "not_in_order", "error", _cat("event_ordering", "(o1 >= o2 OR (n_ordered >= 3 AND o2 >= o3))")),
    ("reasoning_consistency", "first", "error", _first),
    ("reasoning_consistency", "observed", "error", _observed),
    ("reasoning_consistency", "answer_text", "error", _apart),
    ("raw_token_leak", "timestamp", "warning", lambda d: "naturalized AND " + _hits(LEAKS["timestamp"])(d)),
    ("raw_token_leak", "activity_id", "warning", lambda d: "naturalized AND " + _hits(LEAKS["activity_id"])(d)),
    ("raw_token_leak", "field", "info", lambda d: "naturalized AND " + _hits(LEAKS["field"])(d)),
    ("raw_token_leak", "template", "warning", _hits(LEAKS["template"])),
    ("generic_description", "in_question", "warning", _generic),
    ("generic_description", "a", "warning", lambda d: d.match("lower(trim(a_desc))", rf"^({GENERIC})$")),
    ("generic_description", "b", "warning", lambda d: d.match("lower(trim(b_desc))", rf"^({GENERIC})$")),
    ("multi_correct_ambiguity", "borderline", "warning", _cat("spatial", "((proximity IN ('near', 'moderate') AND distance_dm BETWEEN 40 AND 60) OR (proximity IN ('moderate', 'far') AND distance_dm BETWEEN 120 AND 180))")),
    ("grammar", "article", "info", _article),
    ("grammar", "double_article", "warning", lambda d: d.match("lower(question)", r"\b(a\s+a|an\s+an|the\s+the)\b")),
    ("grammar", "gerund", "warning", _sing),
    ("grammar", "subject_verb", "info", lambda d: d.match("lower(question)", rf"\ba\s+person\s+({VERBS})\b")),
    *[("forbidden_pattern", name, "error", lambda d, p=p: f"{RESTRICTED} AND " + _hits(p, "question")(d)) for name, p in FORBIDDEN.items()],
    ("annotation_verify", "index_range", "error", _plain(f"NOT ({_IN_RANGE})")),
    ("annotation_verify", "answer_mismatch", "error", _plain(f"{_IN_RANGE} AND answer <> {_EXPECTED}")),
    ("annotation_verify", "count_mismatch", "error", _cat("counting", "CAST(cnt AS STRING) <> answer")),
    ("annotation_verify", "count_not_said", "warning", lambda d: f"category = 'counting' AND reasoning <> '' AND {'instr' if d.spark else 'strpos'}(reasoning, CAST(cnt AS STRING)) = 0"),
    ("annotation_verify", "a_not_before_b", "error", _cat("temporal", "a_start <> 0 AND b_start <> 0 AND a_start >= b_start")),
    ("structure", "overlap", "error", _cat("temporal", "a_end > b_start")),
    ("structure", "gap_not_positive", "error", _cat("temporal", "gap_ds <= 0")),
    ("structure", "gap_beyond", "error", _cat("temporal", "gap_ds > 150")),
    ("structure", "same_descriptions", "error", _cat("temporal", "a_desc <> '' AND a_desc = b_desc")),
    ("structure", "chain_order", "error", _cat("event_ordering", "(o1 > o2 + 1 OR (n_ordered >= 3 AND o2 > o3 + 1))")),
    ("structure", "same_options", "error", _plain("(option_0 IN (option_1, option_2, option_3) OR option_1 IN (option_2, option_3) OR option_2 = option_3)")),
]


def issues(questions: DataFrame, *checks: str) -> DataFrame:
    """slot, question_id, category, check_name, rule, severity: one row for each rule that a question breaks.

    A map over rows: all rules are read in one pass."""
    hits = [F.when(F.expr(p(SPARK)), F.struct(F.lit(c).alias("check_name"), F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for c, r, s, p in RULES if not checks or c in checks]
    return questions.select("slot", "question_id", "category", F.inline(F.array_compact(F.array(*hits))))


def issues_sql(*checks: str) -> str:
    return " UNION ALL ".join(f"SELECT slot, question_id, category, '{c}' AS check_name, '{r}' AS rule, '{s}' AS severity FROM qa WHERE {p(DUCK)}" for c, r, s, p in RULES if not checks or c in checks)


def fixed_text(column: str, d: Dialect) -> str:
    """A question with its articles mended, raw tokens taken out and "someone" made a person."""
    mark = "~~"
    out = d.sub(column, rf"\ba ({A_WORDS.replace('uni\\w*', 'uniform|university|unique|united|union')})\b", f"a{mark}\\1")
    out = d.sub(out, r"\ba ([aeiouAEIOU]\w*)\b", r"an \1").replace("\\1", "\\1")
    out = f"replace({out}, '{mark}', ' ')"
    for word in ("a", "an", "the"):
        out = d.sub(out, rf"\b({word})\s+{word}\b", r"\1")
    for pattern in (r"\b\d+\.\d+-\d+\.\d+s\b", r"\bat\s+\d+s\b", r"\b\d{2,3}\s*seconds?\b"):
        out = d.sub(out, pattern, "")
    out = d.sub(out, r"\b(person|vehicle|hand)_([a-z]+)_([a-z]+)\b", r"\2 \3")
    for pattern in (r"\{[a-z_]+\}", r"__\w+__"):
        out = d.sub(out, pattern, "")
    out = d.sub(out, r"\bsomeone\b", "a person")
    return f"trim({d.sub(out, r'\s{2,}', ' ')})"
