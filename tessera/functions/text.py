"""Text functions as column expressions: humanised activities, ids, options, rule hits."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule patterns, each of one kind (a pattern a dialect of either side reads alike), and weight in the score.
RULES = {
    "article": ("(^|[^a-z])a [aeiou]", 5),
    "double_article": ("(^|[^a-z])(the the|a a|an an)([^a-z]|$)", 5),
    "seconds": ("(^|[^0-9a-z])[0-9]+s([^a-z]|$)", 10),
    "raw_id": ("(person|vehicle|hand)_[a-z]+", 10),
    "generic": ("(^|[^a-z])(someone|a person|an individual)([^a-z]|$)", 1),
    "camera": ("camera [0-9]+|cam[0-9]+", 5),
}

# The activity ids of the dataset.
ACTIVITIES = (
    "hand_interacts_with_person person_abandons_package person_carries_heavy_object person_closes_facility_door person_closes_trunk person_closes_vehicle_door person_embraces_person person_enters_scene_through_structure person_enters_vehicle person_exits_scene_through_structure person_exits_vehicle person_interacts_with_laptop person_loads_vehicle person_opens_facility_door person_opens_trunk person_opens_vehicle_door person_picks_up_object person_purchases person_puts_down_object person_reads_document person_rides_bicycle person_sits_down person_stands_up person_steals_object person_talks_on_phone person_talks_to_person person_texts_on_phone person_transfers_object person_unloads_vehicle "
    "vehicle_drops_off_person vehicle_makes_u_turn vehicle_picks_up_person vehicle_reverses vehicle_starts vehicle_stops vehicle_turns_left vehicle_turns_right"
).split()
# Patterns of raw tokens, by group, and of what questions must not say, in Python's syntax; (?i) for any case.
LEAKS = {
    "timestamp": [r"(?i)\b\d{2,3}\s*seconds?\b", r"\b\d+\.\d+s\b", r"\bat\s+\d+s\b", r"\b\d+\.\d+-\d+\.\d+s\b", r"(?i)\bframe\s*\d+", r"(?i)\bframes?\s*\d+-\d+", r"\b\d+\.\d{2}\s*-\s*\d+\.\d{2}\b"],
    "activity_id": [r"\b(" + "|".join(ACTIVITIES) + r")\b"],
    "field": [r"\bstart_sec\b", r"\bend_sec\b", r"\bframe_range\b", r"\bactor_id\b", r"\bclip_file\b", r"\bentity_\w+\b"],
    "template": [r"\{[a-z_]+\}", r"__\w+__", r"\bevt_\w+\b", r"\bcluster_\d+\b"],
}
FORBIDDEN = {
    "camera_id": [r"(?i)\bcamera\s+G?\d+"],
    "on_camera": [r"(?i)\bon camera\b"],
    "at_seconds": [r"(?i)\bat\s+\d+s\b"],
    "seconds_range": [r"(?i)\b\d+s[-–]\d+s\b"],
    "around": [r"(?i)\baround the \d+"],
    "at_time": [r"(?i)\bat time\s+\d+"],
    "raw_seconds": [r"(?i)\b\d+ seconds?\b"],
}
# Other letters that Python takes for a letter in any case.
_ALSO = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}
_WORD = r"\p{L}\p{N}_"
_CLASS = {r"\d": r"\p{Nd}", r"\w": f"[{_WORD}]", r"\s": r"[\t-\r\x1c-\x1f\x85\p{Z}]"}


def both_dialects(pattern: str) -> str:
    """A pattern in Python's syntax for tests of whether it occurs, so that Java and RE2 read it as Python does: classes and word
    ends of Unicode, any case letter by letter."""
    any_case = pattern.startswith("(?i)")
    out = []
    for m in re.finditer(r"\\.|.", pattern.removeprefix("(?i)")):
        x = m[0]
        if x == r"\b":
            out.append(f"([^{_WORD}]|$)" if m.start() else f"(^|[^{_WORD}])")
        elif any_case and x.isalpha():
            out.append("[" + x.lower() + x.upper() + _ALSO.get(x.lower(), "") + "]")
        else:
            out.append(_CLASS.get(x, x))
    return "".join(out)


def any_of(patterns: list[str]) -> str:
    return "|".join(f"({both_dialects(p)})" for p in patterns)


def humanize(activity: Column) -> Column:
    """person_opens_trunk: opens trunk."""
    return F.regexp_replace(F.regexp_replace(activity, "^(person|vehicle|hand)_", ""), "_", " ")


def gerund(verb: Column) -> Column:
    """A verb's -ing form by rule: a final e goes, a final s of the third person first."""
    stem = F.regexp_replace(verb, "s$", "")
    return F.concat(F.when(F.length(stem) > 2, F.regexp_replace(stem, "([^e])e$", "$1")).otherwise(stem), F.lit("ing"))


def with_article(noun: Column) -> Column:
    return F.concat(F.when(F.lower(noun).rlike("^[aeiou]"), "an ").otherwise("a "), noun)


def stable_id(*parts: Column) -> Column:
    """md5 of the parts joined by ::"""
    return F.md5(F.concat_ws("::", *parts))


def stable_int(*parts: Column) -> Column:
    """The first 12 hexadecimal digits of the stable id, modulo a thousand million."""
    return F.conv(F.substring(stable_id(*parts), 1, 12), 16, 10).cast("long") % 1_000_000_000


def rule_hit(text: Column, rule: str) -> Column:
    return F.coalesce(F.lower(text).rlike(RULES[rule][0]), F.lit(False))


def pattern_hit(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns of LEAKS or FORBIDDEN occurs, false for null."""
    return F.coalesce(text.rlike(any_of(patterns)), F.lit(False))


def token_set(text: Column) -> Column:
    """The sorted distinct lower-case words of letters a-z and digits."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")))


def letter(index: Column) -> Column:
    """0: A, 1: B, ..."""
    return F.chr(index + 65)
