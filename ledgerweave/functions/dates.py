"""Dates spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Spellings of a calendar date.
SPELLINGS = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "yyyy.MM.dd", "dd.MM.yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "dd-MMM-yyyy")


def spelled_date(c: Column) -> Column:
    """DATE of a text; null where no spelling fits.  A time of day after the date is ignored."""
    text = F.regexp_replace(F.trim(c), r"(?<=\d{4}-\d{2}-\d{2})[T ].*$", "")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(s))) for s in SPELLINGS])
