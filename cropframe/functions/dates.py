"""Date scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_day(c) -> Column:
    """Timestamp or text -> date."""
    return F.to_date(_c(c))


def day_of_year_date(year, yday) -> Column:
    """Date of (year, day-of-year), the '%Y-%j' parse (C6): 2021-60 -> 2021-03-01."""
    return F.date_add(F.make_date(_c(year), F.lit(1), F.lit(1)), _c(yday) - F.lit(1))


def in_months(date, months: tuple[int, int] = (5, 9)) -> Column:
    """Month of ``date`` within [first, last] inclusive (F8)."""
    lo, hi = months
    return F.month(_c(date)).between(int(lo), int(hi))
