"""Printed dates and running times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def date_label(c: Column) -> Column:
    """`Mon d yyyy` for a text that holds a date, else the text in capitals, else UNDATED."""
    found = F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    label = F.date_format(F.try_to_timestamp(found, F.lit("yyyy-MM-dd")), "MMM d yyyy")
    return F.coalesce(label, F.nullif(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit("")), F.lit("UNDATED"))


def spoken_date(c: Column) -> Column:
    """`Feb 1 1924` as `February 1, 1924`; anything else stays."""
    pattern = r"^([A-Z][a-z]{2}) (\d{1,2}) (\d{4})$"
    at = F.array_position(F.array(*[F.lit(m[:3]) for m in FULL_MONTHS]), F.regexp_extract(c, pattern, 1))
    month = F.get(F.array(*[F.lit(m) for m in FULL_MONTHS]), (F.greatest(at, F.lit(1)) - 1).cast("int"))
    spoken = F.concat(month, F.lit(" "), F.regexp_extract(c, pattern, 2), F.lit(", "), F.regexp_extract(c, pattern, 3))
    return F.when(at > 0, spoken).otherwise(c)


def clock(seconds: Column) -> Column:
    """m:ss, never below zero."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    return F.format_string("%d:%02d", (s / 60).cast("long"), s % 60)


def spelled_day(c: Column) -> Column:
    return F.date_format(F.to_date(c), "EEEE, MMMM d, yyyy")
