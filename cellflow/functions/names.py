"""Expressions over product names and over the dates in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_in_name(name: Column) -> Column:
    """The date of the first _YYYYMMDD_ in a name; null where there is none or it is no date."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"_(\d{8})_", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def span_in_name(name: Column) -> tuple[Column, Column]:
    """Start and end of the first _YYYYMMDDTHHMMSS_YYYYMMDDTHHMMSS in a name, or nulls."""
    stamp = r"(\d{8}T\d{6})"
    part = lambda k: F.try_to_timestamp(F.nullif(F.regexp_extract(name, f"_{stamp}_{stamp}", k), F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))
    return part(1), part(2)


def months_touched(day: Column, half_window: int) -> Column:
    """The first days of the months that day +- half_window days reaches."""
    return F.sequence(F.trunc(F.date_sub(day, half_window), "MM"), F.trunc(F.date_add(day, half_window), "MM"), F.expr("INTERVAL 1 MONTH"))


def canonical_suffix(suffix: Column) -> Column:
    """Lower case without blanks around, with one underscore in front; the empty suffix stays empty."""
    bare = F.ltrim(F.lower(F.trim(suffix)), F.lit("_"))
    return F.when(bare == "", bare).otherwise(F.concat(F.lit("_"), bare))


def reasons(**conditions: Column) -> Column:
    """The names of the conditions that hold, joined by +; ? where none does. A null condition doesn't hold."""
    held = F.concat_ws("+", *[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in conditions.items()])
    return F.when(held == "", F.lit("?")).otherwise(held)
