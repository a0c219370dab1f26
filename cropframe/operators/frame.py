"""Training frame: yields x weather x soil with unmatched-row diagnostics
(J1, J2, J3, F9, F12, F13, F15, G6).

All three inputs are already aggregated tables (county-year-crop,
county-year, county), so the joins are on small sides; Spark's size-checked
broadcast (autoBroadcastJoinThreshold, and AQE's runtime conversion from
the real shuffle size) picks broadcast or sort-merge, never an unchecked hint.
Joins include ``state`` (Q4): the same county name in two states never matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentinel county names of the yield survey, dropped from the frame.
SENTINEL_COUNTIES = ["OTHER (COMBINED) COUNTIES", "OTHER COUNTIES"]

# Columns that are never model features.
NON_FEATURES = ["yield", "year", "district", "county", "crop", "state", "county_ansi", "unit"]

WEATHER_MEASURES = ["avg_temp", "precipitation", "vp", "srad", "gdd"]
SOIL_MEASURES = ["ph", "organic_matter", "sand_pct", "clay_pct"]
FRAME_COLUMNS = (["year", "state", "district", "county", "county_ansi", "crop", "yield", "unit"]
                 + WEATHER_MEASURES + SOIL_MEASURES)


def _restrict_years(df: DataFrame, years) -> DataFrame:
    if years is None:
        return df
    lo, hi = years
    return df.filter(F.col("year").between(int(lo), int(hi)))


def joined(yields: DataFrame, weather: DataFrame, soil: DataFrame, years=None,
           weather_measures=WEATHER_MEASURES, soil_measures=SOIL_MEASURES) -> DataFrame:
    """J1 + J2 with match markers, before the sentinel filter (F15 projection).

    The right sides are projected to key + measures before joining, so no
    duplicate ``state``/``id`` columns arise; ``_w``/``_s`` mark a match.
    """
    y = _restrict_years(yields, years)
    w = weather.select("state", "county", "year", *weather_measures,
                       F.lit(True).alias("_w"))
    s = soil.select("state", "county", *soil_measures, F.lit(True).alias("_s"))
    return (y.join(w, ["state", "county", "year"], "left")
             .join(s, ["state", "county"], "left")
             .withColumnRenamed("value", "yield"))


def drop_sentinels(df: DataFrame, county: str = "county") -> DataFrame:
    """drop sentinel counties; a NULL county is kept (pandas `!=` keeps it)."""
    c = F.col(county)
    return df.filter(c.isNull() | ~c.isin(SENTINEL_COUNTIES))


def build_frame(yields: DataFrame, weather: DataFrame, soil: DataFrame, years=None) -> DataFrame:
    """The training frame: one row per yield row, weather and soil attached."""
    j = joined(yields, weather, soil, years)
    cols = [c for c in FRAME_COLUMNS if c in j.columns]
    return drop_sentinels(j).select(*cols)


def unmatched(yields: DataFrame, weather: DataFrame, soil: DataFrame, which: str = "weather",
              years=None) -> DataFrame:
    """Yield rows without a weather match (or soil match), sentinels included (Q5)."""
    j = joined(yields, weather, soil, years)
    marker = "_w" if which == "weather" else "_s"
    cols = [c for c in FRAME_COLUMNS if c in j.columns]
    return j.filter(F.col(marker).isNull()).select(*cols)


def diagnostics(yields: DataFrame, weather: DataFrame, soil: DataFrame, years=None) -> DataFrame:
    """Row counts of each input and of both unmatched sets, long form (metric, n).

    The unmatched counts come from one pass over the joined frame with both
    markers; each input count is one partial aggregate.
    """
    j = joined(yields, weather, soil, years)
    m = j.agg(F.count(F.lit(1)).alias("yield_rows"),
              F.count_if(F.col("_w").isNull()).alias("no_weather"),
              F.count_if(F.col("_s").isNull()).alias("no_soil"))
    m = m.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("bigint").alias("n"))
        for n in ("yield_rows", "no_weather", "no_soil")])).alias("x")).select("x.*")
    w = weather.agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(
        F.lit("weather_rows").alias("metric"), "n")
    s = soil.agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(
        F.lit("soil_rows").alias("metric"), "n")
    return m.unionByName(w).unionByName(s)


def training_scope(df: DataFrame, districts: list[str] | None = None) -> DataFrame:
    """whole frame, or the rows of the chosen districts (at least one)."""
    if districts is None:
        return df
    if not districts:
        raise ValueError("select at least one district")
    return df.filter(F.col("district").isin(list(districts)))


def feature_columns(df: DataFrame, target: str = "yield", numeric_only: bool = False) -> list[str]:
    """all columns minus the identity/target columns; optionally numeric only."""
    from pyspark.sql import types as T
    out = []
    for f in df.schema.fields:
        if f.name in NON_FEATURES or f.name == target:
            continue
        if numeric_only and not isinstance(f.dataType, T.NumericType):
            continue
        out.append(f.name)
    return out
