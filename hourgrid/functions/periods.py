"""Calendar helpers on wall-clock dates."""

import datetime as dt

from pyspark.sql import functions as F

GRAINS = ("daily", "weekly", "monthly")


def period_start(column, grain):
    """First day of the day, Monday week or month that holds ``column``."""
    if grain not in GRAINS:
        raise ValueError(f"aggregation must be one of {GRAINS}, got {grain!r}")
    if grain == "daily":
        return F.col(column)
    unit = {"weekly": "week", "monthly": "month"}[grain]
    return F.date_trunc(unit, column).cast("date")


def date_window(df, start=None, end=None, column="opr_dt"):
    """Inclusive bounds; either may be missing."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def in_year(df, year, column="opr_dt"):
    """Year as a date range, which reaches the scan as a pushed filter."""
    if year is None:
        return df
    return date_window(df, dt.date(year, 1, 1), dt.date(year, 12, 31), column)


def in_month(df, year, month, column="opr_dt"):
    first = dt.date(year, month, 1)
    following = dt.date(year + month // 12, month % 12 + 1, 1)
    return date_window(df, first, following - dt.timedelta(days=1), column)


def date_spine(df, column="opr_dt"):
    """Every calendar day between the first and last date of ``df``."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return ends.where("lo IS NOT NULL").select(
        F.explode(F.sequence("lo", "hi")).alias(column)
    )
