"""Expressions that are written once and read by two SQL engines: this one and the one of the oracles."""

from __future__ import annotations

import re


class Dialect:
    """Regular expressions and token sets in the SQL of one engine."""

    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, value: str) -> str:
        """A literal, whatever is in it."""
        value = value.replace("'", "\\'" if self.spark else "''")
        return f"r'{value}'" if self.spark and "\\" in value and "'" not in value else f"'{value}'"

    def match(self, column: str, pattern: str) -> str:
        return f"{'regexp_like' if self.spark else 'regexp_matches'}(coalesce({column}, ''), {self.text(pattern)})"

    def extract(self, column: str, pattern: str, group: int = 1) -> str:
        """The group of the first match, or an empty string."""
        return f"regexp_extract({column}, {self.text(pattern)}, {group})"

    def sub(self, column: str, pattern: str, new: str) -> str:
        """All matches replaced; \\1 stands for a group."""
        if self.spark:
            return f"regexp_replace({column}, {self.text(pattern)}, {self.text(re.sub(r'\\([0-9])', r'$\1', new))})"
        return f"regexp_replace({column}, {self.text(pattern)}, {self.text(new)}, 'g')"

    def tokens(self, column: str) -> str:
        """The distinct words between spaces."""
        return f"array_distinct(split({column}, ' '))" if self.spark else f"list_distinct(string_split({column}, ' '))"

    def shared(self, a: str, b: str) -> str:
        """How many distinct words two texts share."""
        x, y = self.tokens(a), self.tokens(b)
        return f"size(array_intersect({x}, {y}))" if self.spark else f"len(list_intersect({x}, {y}))"

    def words(self, column: str) -> str:
        """How many words a text has."""
        return f"size(split({column}, ' '))" if self.spark else f"len(string_split({column}, ' '))"


SPARK, DUCK = Dialect(True), Dialect(False)
