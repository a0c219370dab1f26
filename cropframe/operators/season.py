"""Growing-season features from daily rows.

One scan and one hash aggregate: the season test sits *inside* the
aggregates, so a county-year with daily rows but no season days still gives
a row (sums 0.0, means NULL), and partial aggregation collapses every group
map-side before the shuffle, so a hot key costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropframe.functions import degree_days, in_months, midpoint, nan_to_null, to_day

# Season May..September and a 10 degree base.
DEFAULT_MONTHS = (5, 9)
DEFAULT_BASE = 10.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def annual_features(df: DataFrame, keys: list[str], date, tmax, tmin,
                    sums: dict[str, object] | None = None,
                    means: dict[str, object] | None = None,
                    months: tuple[int, int] = DEFAULT_MONTHS, base: float = DEFAULT_BASE,
                    temp_mean=None, year_col: str = "year",
                    temp_name: str = "avg_temp", gdd_name: str = "gdd") -> DataFrame:
    """Per (keys, year): season sums, season means, mean temperature and GDD.

    ``temp_mean`` None -> mean of the daily midpoint (grid variant, G2);
    a column -> mean of that column (CSV variant, G3).
    """
    sums = sums or {}
    means = means or {}
    day = to_day(date)
    season = in_months(day, months)
    t_mid = midpoint(nan_to_null(tmax), nan_to_null(tmin))
    t_avg = t_mid if temp_mean is None else nan_to_null(temp_mean)

    def s_sum(x: Column) -> Column:
        return F.coalesce(F.sum(F.when(season, x)), F.lit(0.0))

    def s_mean(x: Column) -> Column:
        return F.avg(F.when(season, x))

    aggs = [s_sum(nan_to_null(c).cast(T.DoubleType())).alias(n) for n, c in sums.items()]
    aggs.append(s_mean(t_avg).alias(temp_name))
    aggs.append(s_sum(degree_days(t_mid, base)).alias(gdd_name))
    aggs += [s_mean(nan_to_null(c).cast(T.DoubleType())).alias(n) for n, c in means.items()]
    return (df.groupBy(*[_c(k) for k in keys], F.year(day).alias(year_col)).agg(*aggs))


def season_table(df: DataFrame, keys: list[str], date, value, seasons: dict[str, tuple[int, int]],
                 how: str = "sum", year_col: str = "year") -> DataFrame:
    """One aggregate per named month window, as columns, in one pass.

    ``seasons`` maps a name to (first month, last month); windows may
    overlap, so each window is its own conditional aggregate rather than a
    pivot over a single label.
    """
    day = to_day(date)
    v = nan_to_null(value)
    aggs = []
    for name, months in seasons.items():
        x = F.when(in_months(day, months), v)
        agg = F.coalesce(F.sum(x), F.lit(0.0)) if how == "sum" else F.avg(x)
        aggs.append(agg.alias(name))
    return df.groupBy(*[_c(k) for k in keys], F.year(day).alias(year_col)).agg(*aggs)


def cumulative_gdd(daily: DataFrame, keys: list[str], date, tmax, tmin,
                   months: tuple[int, int] = DEFAULT_MONTHS, base: float = DEFAULT_BASE,
                   out: str = "cum_gdd") -> DataFrame:
    """Running season GDD per (keys, year), one row per day.

    Input may hold several readings per day; they are reduced to one daily
    mean first (partial aggregation), so each window partition is bounded by
    366 rows whatever the skew of the keys.
    """
    day = to_day(date)
    per_day = (daily.groupBy(*[_c(k) for k in keys], day.alias("date"))
               .agg(F.avg(nan_to_null(tmax)).alias("_tmax"),
                    F.avg(nan_to_null(tmin)).alias("_tmin")))
    gdd = F.when(in_months("date", months),
                 degree_days(midpoint("_tmax", "_tmin"), base))
    w = (Window.partitionBy(*keys, F.year("date")).orderBy("date")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (per_day.withColumn("gdd", gdd)
            .withColumn(out, F.coalesce(F.sum("gdd").over(w), F.lit(0.0)))
            .select(*keys, "date", F.year("date").alias("year"), "gdd", out))
