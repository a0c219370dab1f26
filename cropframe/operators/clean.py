"""Cleaning of landed yield rows and catalog lookups
(C1-C5, C11, C12, F5, F6, F7, F11, J8).

All set-wise: one pass over every county's rows. The per-county request of
the reference becomes an optional DataFrame of (county, state) requests,
matched case- and blank-insensitively by a semi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.functions import area_name, county_name, first_truthy, norm_key, parse_number, plain_code

YIELD_WORD = "YIELD"


def select_renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """keep and rename only the mapped columns that the frame has."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in mapping.items()
                       if src in df.columns])


def _match_requests(df: DataFrame, requests: DataFrame | None, county: str, state: str):
    if requests is None:
        return df
    req = requests.select(norm_key("county").alias("_rc"), norm_key("state").alias("_rs")).distinct()
    cond = (norm_key(county) == F.col("_rc")) & (norm_key(state) == F.col("_rs"))
    return df.join(req, cond, "left_semi")


def clean_yield_csv(df: DataFrame, start_year=None, end_year=None,
                    requests: DataFrame | None = None) -> DataFrame:
    """S1 rows -> stored yield rows.

    Kept: Data Item contains 'YIELD' (any case; NULL -> dropped) and Year in
    [start, end]. Value is parsed without removing ',' (so '1,234' is NULL)
    and rows without a value are dropped. County and state are trimmed.
    Rows with a NULL natural-key column are dropped: the stored table's key
    is NOT NULL.
    """
    year = F.col("Year").try_cast("int")
    item = F.col("`Data Item`")
    keep = F.coalesce(F.upper(item).contains(YIELD_WORD), F.lit(False))
    if start_year is not None:
        keep = keep & (year >= int(start_year))
    if end_year is not None:
        keep = keep & (year <= int(end_year))
    rows = _match_requests(df.filter(keep), requests, "County", "State")
    extra = [c for c in ("src_epoch", "src_file", "src_block", "src_row") if c in df.columns]
    out = rows.select(
        year.alias("year"), F.trim("State").alias("state"), F.trim("County").alias("county"),
        parse_number("Value").alias("value"), F.col("Commodity").alias("crop"),
        first_truthy(item, F.lit(None).cast("string")).alias("unit"),
        F.col("`Ag District`").alias("district"),
        plain_code("`County ANSI`").alias("county_ansi"), *extra)
    return out.filter(F.col("value").isNotNull() & F.col("year").isNotNull()
                      & F.col("county").isNotNull() & F.col("state").isNotNull()
                      & F.col("crop").isNotNull())


def clean_yield_json(df: DataFrame) -> DataFrame:
    """S2 records -> stored yield rows.

    Files with commodity names keep year, value, crop and those of district,
    county_ansi and unit that the file has (``has_<column>``; all of them when
    the flags are missing), and drop a row with any NULL among them; files
    without keep only year and value. ',' is removed before parsing on this path.
    """
    has = F.col("has_commodity")
    value = parse_number("Value", strip_thousands=True)
    year = F.col("year").try_cast("int")
    full = [year, value, F.col("commodity_desc")]
    complete_full = full[0].isNotNull()
    for c in full[1:]:
        complete_full = complete_full & c.isNotNull()
    for c in ("asd_desc", "county_ansi", "unit_desc"):
        there = F.col(f"has_{c}") if f"has_{c}" in df.columns else F.lit(True)
        complete_full = complete_full & (~there | F.col(c).isNotNull())
    complete_min = year.isNotNull() & value.isNotNull()
    keep = F.when(has, complete_full).otherwise(complete_min)

    def only_full(c):
        return F.when(has, c)

    extra = [c for c in ("src_epoch", "src_file", "src_block", "src_row") if c in df.columns]
    return df.filter(keep).select(
        year.alias("year"), F.col("state_name").alias("state"),
        F.col("county_name").alias("county"), value.alias("value"),
        only_full(F.col("commodity_desc")).alias("crop"),
        only_full(F.col("unit_desc")).alias("unit"),
        only_full(F.col("asd_desc")).alias("district"),
        only_full(plain_code("county_ansi")).alias("county_ansi"), *extra)


def box_center(catalog: DataFrame, key: str = "areaname", order: str = "areasymbol",
               lon: str = "lon", lat: str = "lat") -> DataFrame:
    """C11: centre of the first area (smallest ``order``) per ``key``.

    ``min_by`` over a struct is a partial aggregate, so a name with many
    areas never gathers in one task.
    """
    from pyspark.sql import types as T
    def num(c):  # landed catalog values are text
        return (parse_number(c) if isinstance(catalog.schema[c].dataType, T.StringType)
                else F.col(c).cast("double")).alias(c)
    box = F.struct(*[num(c) for c in ("mbrminx", "mbrmaxx", "mbrminy", "mbrmaxy")])
    first = catalog.groupBy(key).agg(F.min_by(box, F.col(order)).alias("_b"))
    return first.select(key, ((F.col("_b.mbrminx") + F.col("_b.mbrmaxx")) / 2).alias(lon),
                        ((F.col("_b.mbrminy") + F.col("_b.mbrmaxy")) / 2).alias(lat))


def catalog_join(df: DataFrame, catalog: DataFrame, county: str = "county",
                 state: str = "state", how: str = "inner") -> DataFrame:
    """Attach catalog rows by the composed area name, compared lower-cased."""
    left = df.withColumn("_area", F.lower(area_name(F.col(county), F.col(state))))
    right = catalog.withColumn("_area", F.lower(F.col("areaname")))
    return left.join(right.drop(*[c for c in (county, state) if c in right.columns]),
                     "_area", how).drop("_area")


def counties_of_state(catalog: DataFrame, state: str) -> DataFrame:
    """F11 + C5: sorted county names of one state from the catalog."""
    return (catalog.filter(F.col("areaname").endswith(f", {state}"))
            .select(county_name("areaname").alias("county")).orderBy("county"))
