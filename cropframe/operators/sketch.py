"""Mergeable column profiles (the approximate forms of P2, P3, P5).

Each stored partition keeps one small row per numeric column: exact count,
missing, least, largest and sum, a HyperLogLog sketch for the distinct count
and a KLL sketch for the quantiles. A profile of any set of partitions is the
union of their rows, so an upsert sketches only the partitions that it rewrote.
The estimates are asked for by calling this module; the exact profile stays
``profile.numeric_profile`` and ``profile.quantiles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.operators.profile import PROFILE_PROBS, numeric_columns

#: Registers of a distinct-count sketch (2^LG_K): a standard error of about 1.6 %.
LG_K = 12
#: Size of a quantile sketch: ranks are off by about 0.7 % of the rows.
K = 400


def column_sketches(df: DataFrame, by: list[str], cols: list[str] | None = None, lg_k: int = LG_K, k: int = K) -> DataFrame:
    """(by, feature, count, missing, min, max, sum, distinct, ranks): a row per partition and numeric column, one scan.

    Sketches are combined before the shuffle; NaN is missing.
    """
    cols = cols or [c for c in numeric_columns(df) if c not in by]
    v = F.col("value")
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                              for c in cols])).alias("t")).select(*by, "t.*")
    long = long.withColumn("value", F.when(~F.isnan(v), v + F.lit(0.0)))
    return long.groupBy(*by, "feature").agg(
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.sum("value").alias("sum"),
        F.hll_sketch_agg(F.when(F.col("value").isNotNull(), F.xxhash64("value")), lg_k).alias("distinct"),
        F.kll_sketch_agg_double("value", k).alias("ranks"))


def merged_profile(sketches: DataFrame, probs: list[float] | None = None) -> DataFrame:
    """(feature, count, missing, min, max, mean, distinct, pNN...): the profile of all the partitions' rows together."""
    probs = probs or PROFILE_PROBS
    g = sketches.groupBy("feature").agg(
        F.sum("count").alias("count"), F.sum("missing").alias("missing"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.try_divide(F.sum("sum"), F.sum("count")).alias("mean"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"),
        F.kll_merge_agg_double("ranks").alias("_r"))
    at = [F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("_r", F.lit(float(p)))).alias(f"p{round(p * 100):02d}")
          for p in probs]
    return g.select("feature", "count", "missing", "min", "max", "mean", "distinct", *at)


def write_sketches(sketches: DataFrame, path: str, by: list[str]) -> str:
    """Store sketches partitioned like their table; only the partitions present in ``sketches`` are replaced."""
    (sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))
    return path


def refresh_sketches(table: DataFrame, touched: DataFrame, path: str, by: list[str],
                     cols: list[str] | None = None) -> str:
    """Sketch again only the partitions of ``table`` whose keys stand in ``touched`` (a row per rewritten partition)."""
    keys = touched.select(*by).distinct()
    return write_sketches(column_sketches(table.join(keys, by, "left_semi"), by, cols), path, by)
