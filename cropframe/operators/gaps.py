"""Missing years and fetch ranges.

The reference asks the database once per key (N+1 queries) and loops in
Python; here every key is handled in one plan:
keys x sequence(y0, y1) (a generator, not a join) anti-joined with the
present (key, year) pairs, then gaps-and-islands by
``year - row_number()``. Each window partition holds at most y1 - y0 + 1
rows, so a key with a third of all rows costs no more than any other:
the present pairs are de-duplicated map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropframe.operators.query import distinct_keys, or_else


def missing_years(df: DataFrame, keys: list[str], start_year: int, end_year: int,
                  year: str = "year", equals: dict | None = None,
                  fallback_keys: DataFrame | None = None) -> DataFrame:
    """J5 + D8: (keys, year) pairs of [start, end] that ``df`` lacks.

    ``fallback_keys`` (Q2): when no stored key matches the filters, these
    keys (e.g. every county of the state) miss the whole range.
    """
    if not start_year or not end_year:
        return df.select(*keys, F.col(year).cast("int").alias(year)).limit(0)
    k = distinct_keys(df, keys, equals)
    if fallback_keys is not None:
        k = or_else(k, fallback_keys.select(*keys))
    span = F.explode(F.sequence(F.lit(int(start_year)), F.lit(int(end_year)))).alias(year)
    wanted = k.select(*keys, span)
    present = (df.filter(F.col(year).between(int(start_year), int(end_year)))
               .select(*keys, F.col(year).cast("int").alias(year)).distinct())
    return wanted.join(present, keys + [year], "left_anti")


def year_ranges(years: DataFrame, keys: list[str], year: str = "year",
                start: str = "range_start", end: str = "range_end") -> DataFrame:
    """Contiguous runs of years per key -> (keys, start, end).

    [1990, 1991, 1992, 2021, 2022] -> (1990, 1992), (2021, 2022).
    """
    w = Window.partitionBy(*keys).orderBy(year)
    grp = F.col(year) - F.row_number().over(w)
    return (years.withColumn("_grp", grp).groupBy(*keys, "_grp")
            .agg(F.min(year).alias(start), F.max(year).alias(end)).drop("_grp"))


def fetch_plan(df: DataFrame, keys: list[str], start_year: int, end_year: int,
               year: str = "year", equals: dict | None = None,
               fallback_keys: DataFrame | None = None) -> DataFrame:
    """The ranges to fetch per key (J5 followed by W1)."""
    miss = missing_years(df, keys, start_year, end_year, year, equals, fallback_keys)
    return year_ranges(miss, keys, year)


def expand_ranges(ranges: DataFrame, keys: list[str], year: str = "year",
                  start: str = "range_start", end: str = "range_end") -> DataFrame:
    """Ranges back to (keys, year) rows; bounded by the span per key."""
    return ranges.select(*keys, F.explode(F.sequence(F.col(start), F.col(end))).alias(year))


def keep_missing(landed: DataFrame, missing: DataFrame, keys: list[str], year: str = "year",
                 crop: str | None = None, crop_col: str = "crop") -> DataFrame:
    """Landed rows whose (key, year) is missing; optionally only one crop.

    ``missing`` holds (keys, year) rows or (keys, range_start, range_end).
    """
    if "range_start" in missing.columns:
        missing = expand_ranges(missing, keys, year)
    out = landed.join(missing.select(*keys, year).distinct(), keys + [year], "left_semi")
    if crop:
        out = out.filter(F.col(crop_col) == F.lit(crop))
    return out
