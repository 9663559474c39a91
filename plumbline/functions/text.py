"""Scores and other expressions over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode at either end of a text.
_ENDS = r"^[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def exact_match(output: Column, expected: Column, *, trim: bool = False, ignore_case: bool = False) -> Column:
    """1.0 or 0.0; an absent text is an empty one."""
    sides = [F.coalesce(c, F.lit("")) for c in (output, expected)]
    if trim:
        sides = [trim_space(c) for c in sides]
    if ignore_case:
        sides = [F.lower(c) for c in sides]
    return F.when(sides[0] == sides[1], F.lit(1.0)).otherwise(F.lit(0.0))


def redact_userinfo(text: Column) -> Column:
    return F.regexp_replace(text, r"([A-Za-z][A-Za-z0-9+.-]*:/+)[^\s/?#]*@", "$1[redacted]@")


def weighted_goal(components: Column, weights: dict[str, float]) -> Column:
    """A composite score: the weighted mean of a map's components; null if one is absent."""
    total = sum(weights.values())
    return sum((F.try_element_at(components, F.lit(k)) * F.lit(w) for k, w in weights.items()), F.lit(0.0)) / F.lit(total)
