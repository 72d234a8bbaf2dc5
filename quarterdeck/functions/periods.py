"""Periods are strings YYYYQn; their ordinal is year * 4 + quarter - 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD = r"^\d{4}Q[1-4]$"


def is_valid_period(p: Column) -> Column:
    return F.coalesce(p.rlike(PERIOD), F.lit(False))


def period_index(p: Column) -> Column:
    """Null for anything but a valid period."""
    return F.when(is_valid_period(p), F.substring(p, 1, 4).cast("int") * 4 + F.substring(p, 6, 1).cast("int") - 1)


def period_from_index(i: Column) -> Column:
    return F.concat(F.floor(i / 4).cast("string"), F.lit("Q"), (F.pmod(i, F.lit(4)) + 1).cast("string"))


def previous_period(p: Column) -> Column:
    return period_from_index(period_index(p) - 1)


def same_quarter_last_year(p: Column) -> Column:
    return period_from_index(period_index(p) - 4)


def previous_year_end(p: Column) -> Column:
    return F.when(is_valid_period(p), F.concat((F.substring(p, 1, 4).cast("int") - 1).cast("string"), F.lit("Q4")))


def literal_index(period: str) -> int:
    """The ordinal of a period given as a parameter; an invalid one is an error."""
    import re

    if not re.match(PERIOD, period):
        raise ValueError(f"not a period: {period!r}, expected YYYYQ1 to YYYYQ4")
    return int(period[:4]) * 4 + int(period[5]) - 1


def range_bounds(period_from: str, period_to: str) -> tuple[int, int]:
    a, b = literal_index(period_from), literal_index(period_to)
    if a > b:
        raise ValueError(f"{period_from} is after {period_to}")
    return a, b


def in_range(p: Column, period_from: str, period_to: str) -> Column:
    a, b = range_bounds(period_from, period_to)
    return F.coalesce(period_index(p).between(a, b), F.lit(False))


def in_range_or_year(p: Column, period_from: str, period_to: str) -> Column:
    """As in_range; a bare year is in when one of its quarters is."""
    a, b = range_bounds(period_from, period_to)
    clean = F.upper(F.trim(p))
    year = F.when(clean.rlike(r"^\d{4}$"), clean.cast("int"))
    return F.when(year.isNotNull(), (year * 4 + 3 >= a) & (year * 4 <= b)).otherwise(in_range(clean, period_from, period_to))


def first_day(p: Column) -> Column:
    i = period_index(p)
    return F.make_date(F.floor(i / 4).cast("int"), (F.pmod(i, F.lit(4)) * 3 + 1).cast("int"), F.lit(1))


def last_day(p: Column) -> Column:
    i = period_index(p)
    return F.last_day(F.make_date(F.floor(i / 4).cast("int"), (F.pmod(i, F.lit(4)) * 3 + 3).cast("int"), F.lit(1)))


def normalize_user_period(raw: Column) -> Column:
    """2023 → 2023Q4, 2023q2 → 2023Q2, anything else null."""
    clean = F.upper(F.trim(raw))
    return F.when(clean.rlike(r"^\d{4}$"), F.concat(clean, F.lit("Q4"))).when(clean.rlike(PERIOD), clean)


def period_type_for(statement_type: Column, p: Column) -> Column:
    return F.when(statement_type == "balance_sheet", "balance_sheet_snapshot").when(p.endswith("Q4"), "annual").otherwise("ytd")
