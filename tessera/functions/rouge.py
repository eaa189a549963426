"""ROUGE: n-gram overlap in built-in functions, and stemmed ROUGE-1, 2 and L in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiou"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces."""
    if n == 1:
        return words
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(0)))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def shared(a: Column, b: Column) -> Column:
    """How many items two arrays share, each as often as both have it."""
    count = lambda xs, v: F.size(F.filter(xs, lambda y: y == v))
    return F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda acc, v: acc + F.least(count(a, v), count(b, v)))


# -- the stemmer of Porter (1980), by its published steps --


def _form(stem: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in _VOWELS or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _cvc(stem: str) -> bool:
    return _form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _form(stem)[-1] == "c"


# The endings of steps 2 to 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _ending(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(w: str) -> str:
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and "v" in _form(w[: -len(e)])), None)
        if cut is not None:
            w = cut + "e" if cut[-2:] in ("at", "bl", "iz") else cut[:-1] if _double(cut) and cut[-1] not in "lsz" else cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        e = _ending(w, table)
        if e and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + table[e]
    e = _ending(w, STEP4)
    if e and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)][-1:] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if _double(w) and w[-1] == "l" and _measure(w) > 1 else w


def stems(text: str | None) -> list[str]:
    """Lower-case words of letters and digits; those of more than three characters are stemmed."""
    return [stem(w) if len(w) > 3 else w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, in one row of memory."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def scores(hypothesis: str | None, reference: str | None) -> tuple[float, float, float]:
    """F1 of ROUGE-1, ROUGE-2 and ROUGE-L with stems; 0 where a side has no n-gram."""
    from collections import Counter

    h, r = stems(hypothesis), stems(reference)
    out = []
    for n in (1, 2):
        x, y = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (h, r))
        total = sum(x.values()) + sum(y.values())
        out.append(2 * sum((x & y).values()) / total if total else 0.0)
    return out[0], out[1], 2 * lcs(h, r) / (len(h) + len(r)) if h or r else 0.0


def rouge(hypothesis: Column, reference: Column) -> Column:
    """Struct of rouge1, rouge2 and rougeL."""

    def run(h: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scores(x, y) for x, y in zip(h, r)], columns=["rouge1", "rouge2", "rougeL"])

    run.__annotations__ = {"h": pd.Series, "r": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "rouge1 double, rouge2 double, rougeL double")(hypothesis, reference)
