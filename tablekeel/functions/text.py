"""Text functions over columns; Unicode white space counts as blank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_whitespace(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def title(c: Column) -> Column:
    """Upper-case the first letter after anything that is no letter or digit."""
    parts = F.split(F.lower(c), r"(?<=[^\p{L}\p{N}])")
    return F.array_join(F.transform(parts, F.initcap), "")


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group's match, or null where the pattern or the group does not match."""
    found = F.regexp_extract(c, pattern, group)
    return F.when(c.rlike(pattern), F.nullif(found, F.lit("")) if group else found)


STEPS = {"trim": trim, "collapse_whitespace": collapse_whitespace, "lower": F.lower, "upper": F.upper, "title": title}


def normalise(c: Column, steps: list[str]) -> Column:
    for step in steps:
        c = STEPS[step](c)
    return c
