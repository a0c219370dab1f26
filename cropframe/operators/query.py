"""Filtered scans, value lists, head/tail, picks and counts
(F1-F4, F14, D1-D5, G4, G5).

Parameters are Python optionals; a falsy parameter (None, "", 0) means "no
filter", as in the reference service. Every filter is a plain column
predicate, so Catalyst pushes it into the parquet scan (and prunes
partitions when the stored table is partitioned by state).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Crop list offered when the stored yields have none.
DEFAULT_CROPS = ["SOYBEANS", "CORN", "WHEAT", "COTTON", "PEANUTS"]


# The parameters the client upper-cases before calling the service.
UPPER_PARAMS = ("state", "crop")


def filter_rows(df: DataFrame, equals: dict | None = None, between: dict | None = None,
                upper_params=()) -> DataFrame:
    """``equals`` {col: value}, ``between`` {col: (lo, hi)}; falsy -> skipped.

    Parameters named in ``upper_params`` are upper-cased (the parameter, not
    the stored column): the client normalises state and crop, the stored
    values compare case-sensitively.
    """
    for c, v in (equals or {}).items():
        if not v:
            continue
        lit = F.upper(F.lit(v)) if c in upper_params and isinstance(v, str) else F.lit(v)
        df = df.filter(F.col(c) == lit)
    for c, (lo, hi) in (between or {}).items():
        if lo:
            df = df.filter(F.col(c) >= F.lit(lo))
        if hi:
            df = df.filter(F.col(c) <= F.lit(hi))
    return df


def yield_query(yields: DataFrame, state=None, crop=None, start_year=None, end_year=None):
    """the /yields scan."""
    return filter_rows(yields, {"state": state, "crop": crop},
                       {"year": (start_year, end_year)}, upper_params=UPPER_PARAMS)


def weather_query(weather: DataFrame, state=None, county=None, year=None):
    """the /weather scan."""
    return filter_rows(weather, {"state": state, "county": county, "year": year},
                       upper_params=UPPER_PARAMS)


def soil_query(soil: DataFrame, state=None, county=None):
    """the /soil scan (no district filter: the code wins over the docs)."""
    return filter_rows(soil, {"state": state, "county": county}, upper_params=UPPER_PARAMS)


def distinct_keys(df: DataFrame, keys: list[str], equals: dict | None = None) -> DataFrame:
    """Distinct key combinations after optional filters."""
    return filter_rows(df, equals).select(*keys).distinct()


def value_list(df: DataFrame, col: str, upper: bool = False, out: str | None = None) -> DataFrame:
    """D3: sorted distinct non-NULL values of one column."""
    c = F.upper(F.col(col).cast("string")) if upper else F.col(col)
    name = out or col
    return df.select(c.alias(name)).filter(F.col(name).isNotNull()).distinct().orderBy(name)


def crop_list(spark: SparkSession, yields: DataFrame, crop: str = "crop") -> DataFrame:
    """Distinct upper-cased crops, or the default list when there are none.

    The fallback is decided inside the plan (anti-join on a constant key),
    not by counting on the driver.
    """
    found = value_list(yields, crop, upper=True, out="crop")
    defaults = spark.createDataFrame([(c,) for c in DEFAULT_CROPS], "crop string")
    return or_else(found, defaults).orderBy("crop")


def or_else(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rows of ``primary``, or those of ``fallback`` when ``primary`` is empty.

    Decided inside the plan by an uncorrelated scalar subquery (a one-row
    probe of ``primary``, evaluated once): no join, no count on the driver.
    """
    found_any = primary.limit(1).agg(F.count(F.lit(1))).scalar()
    return primary.unionByName(fallback.filter(found_any == 0))


def head_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First n rows by an explicit order (a per-partition top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def tail_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """Last n rows by an explicit order, returned in ascending order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)


def pick_row(df: DataFrame, order: list[str], **equals) -> DataFrame:
    """county -> year -> crop drill-down, then the first row by natural key."""
    return filter_rows(df, equals).orderBy(*order).limit(1)


def count_distinct_by(df: DataFrame, keys: list[str], col: str, out: str = "n") -> DataFrame:
    """Number of distinct values of ``col`` per key (e.g. years per county)."""
    return df.groupBy(*keys).agg(F.count_distinct(col).alias(out))


def year_span(df: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    """Per key, min and max year; NULL keys and years skipped, keys trimmed.

    The keys are trimmed as strings, as the bulk job does before fetching.
    """
    cleaned = df.select(*[F.trim(F.col(k).cast("string")).alias(k) for k in keys],
                        F.col(year).cast("int").alias(year)).dropna()
    return cleaned.groupBy(*keys).agg(F.min(year).alias("start_year"),
                                      F.max(year).alias("end_year"))


def relevance_order(df: DataFrame, score: str = "relevance", name: str = "feature") -> DataFrame:
    """Feature table by score descending, ties by name."""
    return df.orderBy(F.col(score).desc(), F.col(name))


def top_k_per_group(df: DataFrame, group: list[str], score, k: int, tie: str,
                    out: str = "rank") -> DataFrame:
    """The k rows of largest |score| per group, ties by ``tie``.

    ``row_number() <= k`` lets Spark insert a per-partition group limit
    before the shuffle, so even a large group ships only k rows per task.
    """
    s = F.col(score) if isinstance(score, str) else score
    w = Window.partitionBy(*group).orderBy(F.abs(s).desc(), F.col(tie))
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def normalise_params(**params):
    """the client-side normalisation of parameters (state and crop upper-cased)."""
    return {k: v.upper() if k in UPPER_PARAMS and isinstance(v, str) else v
            for k, v in params.items()}
