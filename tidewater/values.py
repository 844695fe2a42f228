"""Coercions of text properties: numbers, booleans, dates, blanks, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s ﻿]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(c: Column) -> Column:
    """The value as text; null is the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return F.coalesce(trim(c.cast("string")) == "", F.lit(True))


def is_missing(c: Column) -> Column:
    """Null or exactly the empty text; blanks count as a value."""
    return F.coalesce(c.cast("string") == "", F.lit(True))


def filled(c: Column) -> Column:
    """The value, or null if it is blank."""
    return F.when(~is_blank(c), c)


def number(c: Column) -> Column:
    """The whole text as a number; null if it is not one, or blank."""
    t = trim(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def leading_number(c: Column) -> Column:
    """The number that the text starts with: "12abc" gives 12."""
    found = F.regexp_extract(F.ltrim(c.cast("string")), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
    return F.when(found != "", found.try_cast("double"))


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Nearest multiple of 10**-digits, halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def timestamp(c: Column) -> Column:
    """ISO text as an instant in the session's (UTC) zone; null if it is none."""
    return F.try_to_timestamp(trim(c.cast("string")))


def as_bool(c: Column) -> Column:
    t = c.cast("string")
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)
