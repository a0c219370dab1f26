"""Data profiling (P1-P12): overview, column statistics, quantiles, histograms,
categories, correlation matrices, missing-data patterns and alerts.

Scale rules followed throughout:
* all columns at once in long form (``unpivot``) or one wide aggregate,
  never a job per column;
* values are compressed to (value, count) first, so a value holding a
  third of the rows is one row, and the input is not scanned again;
* no sort in one task: quantiles and ranks are running counts over the range
  partitions of the distinct values;
* small per-feature tables (bounded by the number of columns x a fixed
  count) are the only things broadcast or collected.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropframe.functions import nan_to_null

# Default quantiles of a numeric profile.
PROFILE_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
APPROX_ACCURACY = 10000
SORT_VALUES = 1_000_000      # distinct values per sorted partition
RANK_CELLS = 1_000_000       # ranks that are broadcast, of all columns together
KENDALL_BUCKETS = 32
KENDALL_POINTS = 1_000_000   # distinct points per bucket
KENDALL_CELLS = 1_000_000    # grid cells settled in one array
HIST_BINS = 10
TOP_VALUES = 5

# Alert thresholds (profile parameters).
ALERT_MISSING = 0.2
ALERT_CORRELATION = 0.9
ALERT_SKEWNESS = 20.0
ALERT_ZEROS = 0.1


def _reuse(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a compressed table that several passes reread,
    so the raw input is scanned once (and a lost executor recovers from it)."""
    from cropframe.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` by way of Parquet in the shared folder: like ``_reuse``, where passes read few of its columns or rows."""
    from cropframe.session import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def safe_corr(a, b):
    """Pearson r that is NULL (not an error) when a side has no variance."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)   # pairwise complete
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def long_form(df: DataFrame, cols: list[str], dtype: str = "double", keep_null: bool = False,
              feature: str = "feature", value: str = "value") -> DataFrame:
    """Wide -> (feature, value), all columns cast to one type."""
    # "+ 0.0" folds -0.0 into 0.0, so both count as the same value; NaN is missing.
    w = df.select(*[(nan_to_null(F.col(c).cast(dtype)) + F.lit(0.0) if dtype == "double"
                     else F.col(c).cast(dtype)).alias(c) for c in cols])
    out = w.unpivot([], cols, feature, value)
    return out if keep_null else out.filter(F.col(value).isNotNull())


def missing(df: DataFrame, c: str):
    """NULL or NaN."""
    test = F.col(c).isNull()
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        test = test | F.isnan(c)
    return test


def value_counts(df: DataFrame, cols: list[str], keep: bool = True) -> DataFrame:
    """(feature, value, c): how often each numeric value occurs, from one scan.

    Values are told apart in the column's own type (large integers and decimals
    that share a double stay distinct rows); ``value`` is the double that
    positions and ranks use. With ``keep`` the table is checkpointed: distinct
    counts, quantiles, deviations and ranks all read it instead of the input.
    """
    parts, keys = [], ["feature", "whole", "value"]
    if any(isinstance(df.schema[c].dataType, T.DecimalType) for c in cols):
        keys.append("exact")       # decimals of any scale are told apart by their text
    for c in cols:
        v, kind = nan_to_null(F.col(c).cast("double")) + F.lit(0.0), df.schema[c].dataType
        fields = {"feature": F.lit(c), "whole": F.col(c).cast("long") if isinstance(kind, T.IntegralType) else F.lit(None).cast("long"),
                  "value": v, "exact": F.col(c).cast("string") if isinstance(kind, T.DecimalType) else F.lit(None).cast("string")}
        parts.append(F.struct(*[fields[k].alias(k) for k in keys]))
    long = df.select(F.explode(F.array(*parts)).alias("t")).select("t.*").filter(F.col("value").isNotNull())
    vc = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).select("feature", "value", "c")
    return _reuse(vc) if keep else vc


def cumulated(vc: DataFrame, feature: str = "feature", value: str = "value", c: str = "c",
              totals_to: dict | None = None) -> DataFrame:
    """``vc`` with ``start``, the number of smaller values of the feature, for each distinct value.

    One range partitioning by (feature, value): a running sum inside each
    sorted partition plus the totals of the partitions before it. No value
    count, however large, gathers in one task; only one total per partition
    and feature reaches the driver (``totals_to`` gets each feature's).
    """
    totals: dict[str, tuple[int, list[int]]] = {}
    flat = _stored(vc.groupBy(feature, value).agg(F.sum(c).alias(c)), "values")
    run = running_counts(flat, feature, value, [c], totals)
    if totals_to is not None:
        totals_to.update({f: sums[0] for f, (_, sums) in totals.items()})
    return run.select(feature, value, c, F.col("_starts")[0].alias("start"))


def ranges(flat: DataFrame, feature: str, value: str, rows: int) -> DataFrame:
    """A stored table of distinct (feature, value) in range partitions of about ``rows`` at most, numbered ``_pid``."""
    n = max(1, -(-flat.count() // rows), int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return flat.repartitionByRange(n, feature, value).withColumn("_pid", F.spark_partition_id())


def running_counts(flat: DataFrame, feature: str, value: str, counts: list[str],
                   totals_to: dict[str, tuple[int, list[int]]]) -> DataFrame:
    """A stored table of distinct (feature, value) with ``_starts``, the sums of each of ``counts`` over smaller values.

    ``totals_to`` gets each feature's number of values and sums of ``counts``.
    """
    spark = flat.sparkSession
    parts = _stored(ranges(flat.select(feature, value, *counts), feature, value, SORT_VALUES), "ranges")
    sums = [F.sum(c).alias(f"_t{i}") for i, c in enumerate(counts)]
    found = sorted(parts.groupBy(feature, "_pid").agg(F.count(F.lit(1)).alias("_t"), *sums).collect(),
                   key=lambda r: (r[0], r[1]))
    offsets = []
    for f, pid, rows, *part in found:
        values, before = totals_to.get(f, (0, [0] * len(counts)))
        offsets.append((f, pid, before))
        totals_to[f] = values + rows, [x + y for x, y in zip(before, part, strict=True)]
    off = spark.createDataFrame(offsets, f"{feature} string, _pid int, _off array<long>")
    w = Window.partitionBy(feature, "_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    run = parts.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_run{i}") for i, c in enumerate(counts)])
    starts = F.array(*[F.col("_off")[i] + F.col(f"_run{i}") for i in range(len(counts))])
    # one row per partition and feature: bounded by the partition count
    return run.join(F.broadcast(off), [feature, "_pid"]).select(feature, value, *counts, starts.alias("_starts"))


# --------------------------------------------------------------------------- P1
def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells (count and share) and duplicate rows,
    as (metric, value). Duplicates = rows - distinct rows (one aggregation)."""
    cols = df.columns
    # one scan: rows are counted and judged after they are grouped with their copies
    nulls = sum((missing(df, c).cast("long") for c in cols), F.lit(0))
    copies = "_copies"
    a = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(copies)).agg(
        F.coalesce(F.sum(copies), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(nulls * F.col(copies)), F.lit(0)).alias("missing"))
    ncol = float(len(cols))
    values = {"rows": F.col("rows"), "columns": F.lit(ncol), "missing_cells": F.col("missing"),
              "missing_share": F.try_divide(F.col("missing").cast("double"), F.col("rows") * F.lit(ncol)),
              "duplicate_rows": F.col("rows") - F.col("distinct_rows")}
    return a.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])).alias("t")
    ).select("t.*")


# --------------------------------------------------------------------------- P2
PROFILE_SCHEMA = ("feature string, count long, missing long, distinct long, mean double, std double, variance double, "
                  "min double, max double, sum double, zeros long, negatives long, skewness double, kurtosis double")


def numeric_profile(df: DataFrame, cols: list[str] | None = None, vc: DataFrame | None = None) -> DataFrame:
    """One row per numeric column; skewness and kurtosis are the sample
    (bias-adjusted) estimates a pandas frame reports.

    Moments of all columns come from one wide aggregate (one scan, one row);
    the distinct count from the value counts (``vc``, computed if not given),
    which tell values apart in the column's own type. NaN counts as missing.
    """
    cols = cols or numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    vc = value_counts(df, cols, keep=False) if vc is None else vc     # read once here
    names = ["count", "missing", "mean", "std", "variance", "min", "max", "sum", "zeros", "negatives", "_g1", "_g2"]
    aggs = []
    for i, c in enumerate(cols):
        v = nan_to_null(F.col(c).cast("double"))
        found = [F.count(v), F.count_if(v.isNull()), F.avg(v), F.stddev_samp(v), F.var_samp(v), F.min(v), F.max(v),
                 F.sum(v), F.count_if(v == 0), F.count_if(v < 0), F.skewness(v), F.kurtosis(v)]
        aggs += [x.alias(f"{n}{i}") for n, x in zip(names, found)]
    g = df.agg(*aggs).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}{i}").alias(n) for n in names])
        for i, c in enumerate(cols)])).alias("t")).select("t.*")
    dist = vc.groupBy("feature").agg(F.count(F.lit(1)).alias("distinct"))
    g = g.join(F.broadcast(dist), "feature", "left")     # a row per column
    n = F.col("count").cast("double")
    skew = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("_g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return g.select("feature", "count", "missing",
                    F.coalesce(F.col("distinct"), F.lit(0)).alias("distinct"), "mean", "std",
                    "variance", "min", "max", "sum", "zeros", "negatives",
                    skew.alias("skewness"), kurt.alias("kurtosis"))


# --------------------------------------------------------------------------- P3
def exact_quantiles(vc: DataFrame, probs: list[float], feature: str = "feature", value: str = "value",
                    c: str = "c") -> DataFrame:
    """Exact linear-interpolation quantiles per feature of a value-count table -> (feature, p, q).

    The two order statistics of each p are read off the cumulated counts:
    exact at any size, with no sketch and no global sort.
    """
    totals: dict[str, int] = {}
    cum = cumulated(vc, feature, value, c, totals)
    places = []
    for f, n in totals.items():
        for p in map(float, probs):
            h = float(n - 1) * p
            places.append((f, p, h, math.floor(h), min(math.floor(h) + 1, n - 1)))
    at = vc.sparkSession.createDataFrame(places, f"{feature} string, p double, h double, k_lo long, k_hi long")
    end = F.col("start") + F.col(c) - 1
    # a row per feature and probability: bounded
    j = cum.join(F.broadcast(at), feature).filter(
        (F.col("start") <= F.col("k_hi")) & (F.col("k_lo") <= end))
    hit = j.groupBy(feature, "p").agg(
        F.max(F.when((F.col("start") <= F.col("k_lo")) & (F.col("k_lo") <= end), F.col(value))).alias("x_lo"),
        F.max(F.when((F.col("start") <= F.col("k_hi")) & (F.col("k_hi") <= end), F.col(value))).alias("x_hi"),
        F.first("h").alias("h"), F.first("k_lo").alias("k_lo"))
    q = F.col("x_lo") + (F.col("x_hi") - F.col("x_lo")) * (F.col("h") - F.col("k_lo"))
    return hit.select(feature, "p", q.alias("q"))


def quantiles(df: DataFrame, cols: list[str] | None = None, probs: list[float] | None = None,
              vc: DataFrame | None = None) -> DataFrame:
    """5/25/50/75/95 % quantiles, IQR and MAD per numeric column (one row each).

    One scan for the value counts; the quantiles, and the median of
    |value - median|, are both read off them. The medians (a number per
    column) are collected to be literals of the second table.
    """
    spark = df.sparkSession
    cols = cols or numeric_columns(df)
    probs = probs or PROFILE_PROBS
    allp = sorted(set(probs) | {0.25, 0.5, 0.75})
    vc = value_counts(df, cols) if vc is None else vc
    got: dict[str, dict[float, float]] = {}
    for r in exact_quantiles(vc, allp).collect():
        got.setdefault(r["feature"], {})[r["p"]] = r["q"]
    mads = {}
    if got:
        pairs = []
        for c in got:
            pairs += [F.lit(c), F.lit(got[c][0.5])]
        med = F.create_map(*pairs)
        dev = vc.select("feature", F.abs(F.col("value") - F.element_at(med, F.col("feature"))).alias("value"), "c")
        mads = {r["feature"]: r["q"] for r in exact_quantiles(dev, [0.5]).collect()}
    names = [f"p{int(round(p * 100)):02d}" for p in probs]
    rows = []
    for c in cols:
        if c not in got:
            continue
        qd = got[c]
        rows.append(tuple([c] + [qd[p] for p in probs] + [qd[0.75] - qd[0.25], mads.get(c)]))
    schema = ", ".join(["feature string"] + [f"{n} double" for n in names]
                       + ["iqr double", "mad double"])
    return spark.createDataFrame(rows, schema)


# --------------------------------------------------------------------------- P4
def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins per numeric column -> (feature, bin, lo, hi, count).

    The maximum falls in the last bin; a constant column has one bin.
    """
    cols = cols or numeric_columns(df)
    lf = long_form(df, cols)
    rng = lf.groupBy("feature").agg(F.min("value").alias("_mn"), F.max("value").alias("_mx"))
    width = (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))
    b = F.when(F.col("_mx") == F.col("_mn"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_mn")) / width), F.lit(bins - 1))).cast("int")
    # rng holds one row per column: bounded, safe to broadcast.
    counted = (lf.join(F.broadcast(rng), "feature").withColumn("bin", b)
               .groupBy("feature", "bin", "_mn", "_mx").agg(F.count(F.lit(1)).alias("count")))
    return counted.select(
        "feature", "bin", (F.col("_mn") + F.col("bin") * width).alias("lo"),
        F.when(F.col("bin") == bins - 1, F.col("_mx")).otherwise(
            F.col("_mn") + (F.col("bin") + 1) * width).alias("hi"), "count")


# --------------------------------------------------------------------------- P5
def category_profile(df: DataFrame, cols: list[str] | None = None, k: int = TOP_VALUES):
    """P5: per text column: count, missing, distinct, string lengths and the k
    most frequent values. Returns (summary, top) DataFrames.

    Top-k uses ``row_number() <= k`` over (feature) on value counts; Spark
    inserts a per-partition group limit before the shuffle, so no feature's
    values gather in one task.
    """
    cols = cols or string_columns(df)
    lf = long_form(df, cols, dtype="string", keep_null=True)
    v = F.col("value")
    summary = lf.groupBy("feature").agg(
        F.count(v).alias("count"), F.count_if(v.isNull()).alias("missing"),
        F.count_distinct(v).alias("distinct"), F.min(F.length(v)).alias("min_length"),
        F.avg(F.length(v)).alias("mean_length"), F.max(F.length(v)).alias("max_length"))
    vc = lf.filter(v.isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("feature").orderBy(F.col("count").desc(), F.col("value"))
    top = vc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return summary, top


# --------------------------------------------------------------------------- P6
def pearson(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pairwise Pearson r of every column pair -> (x, y, r), pairwise complete.

    Two cheap passes: the column means (p numbers, collected), then one
    aggregate of plain sums of mean-centred values per pair under the
    pair's non-NULL mask. Centring keeps the one-pass formula stable; plain
    sums keep the whole aggregate inside generated code even for many pairs.
    A side without variance gives NULL.
    """
    cols = cols or numeric_columns(df)
    pairs = list(combinations(cols, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "x string, y string, r double")
    d = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    means = d.agg(*[F.avg(c).alias(c) for c in cols]).first()      # p numbers
    cen = {c: F.col(c) - F.lit(float(means[c] or 0.0)) for c in cols}
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        xa, xb = F.when(both, cen[a]), F.when(both, cen[b])
        aggs += [F.count(xa).alias(f"n{i}"), F.sum(xa).alias(f"a{i}"), F.sum(xb).alias(f"b{i}"),
                 F.sum(xa * xa).alias(f"aa{i}"), F.sum(xb * xb).alias(f"bb{i}"),
                 F.sum(xa * xb).alias(f"ab{i}")]
    row = d.agg(*aggs)

    def r(i):
        n = F.col(f"n{i}").cast("double")
        sa, sb = F.col(f"a{i}"), F.col(f"b{i}")
        cov = F.col(f"ab{i}") - sa * sb / n
        va = F.col(f"aa{i}") - sa * sa / n
        vb = F.col(f"bb{i}") - sb * sb / n
        return F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))

    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r(i).alias("r"))
        for i, (a, b) in enumerate(pairs)])).alias("t")).select("t.*")


# --------------------------------------------------------------------------- P7
def _edges(points: DataFrame, col: str, buckets: int) -> list[float]:
    """Bucket edges with about equally many points; a value that fills a bucket alone gets one for itself."""
    if buckets <= 1:
        return [-math.inf, math.inf]
    ps = [i / buckets for i in range(1, buckets)]
    row = points.agg(F.percentile_approx(F.col(col), ps, max(APPROX_ACCURACY, 10 * buckets))).first()
    found = Counter(float(e) for e in (row[0] or []) if e is not None)
    inner = set(found) | {float(np.nextafter(v, math.inf)) for v, k in found.items() if k > 1}
    return [-math.inf] + sorted(inner) + [math.inf]


def average_rank(df: DataFrame, col: str, out: str = "rank", weight: str | None = None) -> DataFrame:
    """Average (tie-mean) rank of each distinct value of ``col`` -> (col, count, rank)."""
    cnt = F.sum(weight) if weight else F.count(F.lit(1))
    vc = df.filter(F.col(col).isNotNull()).groupBy(col).agg(cnt.alias("c")).withColumn("feature", F.lit(col))
    r = cumulated(vc, "feature", col, "c")
    return r.select(col, F.col("c").alias("count"),
                    (F.col("start").cast("double") + (F.col("c") + 1) / 2.0).alias(out))


def spearman_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """P7 for one pair (see ``spearman``)."""
    return spearman(df, [x, y])


def _rank_sums(batches, counts: list[str], weights: list[tuple[str, str]]):
    """One row per feature of a range partition: its rows by each of ``counts`` and, over its values' average
    ranks inside the partition, less their mean, the sums of squares by count and of products with ``weights``."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    names = t.column("feature").combine_chunks().dictionary_encode()
    code, out = names.indices.to_numpy(), []
    values = t.column("value").to_numpy()
    for k, f in enumerate(names.dictionary.to_pylist()):
        at = np.flatnonzero(code == k)
        at = at[np.argsort(values[at])]
        row = {"feature": f, "_pid": t.column("_pid")[0].as_py()}
        rank = {}
        for x in counts:
            c = t.column(x).to_numpy()[at]
            end = np.cumsum(c)
            rank[x] = (end - c) + (c + 1) / 2.0 - (end[-1] + 1) / 2.0
            row[f"n{x}"], row[f"s{x}"] = int(end[-1]), float(np.sum(c * rank[x] * rank[x]))
        for x, y in weights:
            w = t.column(x).to_numpy()[at]
            row[f"t{x}"], row[f"p{x}"] = float(np.sum(w)), float(np.sum(w * rank[y]))
        out.append(row)
    kinds = [("feature", pa.string()), ("_pid", pa.int32()), *[(x, pa.int64() if x[0] == "n" else pa.float64())
                                                               for x in list(out[0])[2:]]]
    yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))


def rank_sums(flat: DataFrame, counts: list[str], weights: list[tuple[str, str]]) -> dict[str, dict[str, float]]:
    """Sums over the values of each feature of a stored (feature, value, counts, weights) table.

    Of the ranks by each of ``counts``, less their mean: the sum of squares, and
    for each (weight, count) the sum of products with the weight. Each range
    partition gives one row per feature, with ranks from its own start; these
    rows are moved to their places on the driver, so values are shuffled once
    and nothing of their size is stored again.
    """
    schema = ", ".join(["feature string, _pid int", *[f"n{x} long, s{x} double" for x in counts],
                        *[f"t{x} double, p{x} double" for x, _ in weights]])
    found: dict[str, list] = {}
    part = partial(_rank_sums, counts=counts, weights=weights)
    # a partition is sorted in one array: the wider the rows, the fewer
    parts = ranges(flat, "feature", "value", max(1, 4 * SORT_VALUES // len(flat.columns)))
    for row in sorted(parts.mapInArrow(part, schema).collect(), key=lambda x: x["_pid"]):
        found.setdefault(row["feature"], []).append(row)
    out = {}
    for f, rows in found.items():
        out[f] = sums = dict.fromkeys([*counts, *[x for x, _ in weights]], 0.0)
        for y in counts:
            total, before = sum(x[f"n{y}"] for x in rows), 0
            for x in rows:
                # from the mean rank of the whole to that of the part; ranks less their mean sum to zero
                shift = before + (x[f"n{y}"] - total) / 2.0
                before += x[f"n{y}"]
                sums[y] += x[f"s{y}"] + shift * shift * x[f"n{y}"]
                for w, of in weights:
                    if of == y:
                        sums[w] += x[f"p{w}"] + shift * x[f"t{w}"]
    return out


def spearman(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Spearman matrix (x, y, r) over all column pairs, pairwise complete; NaN is missing.

    Each column's values are counted once per partner column, over the rows
    that have the partner too, so running counts give a value's average rank
    among the rows of each of its pairs; these tables grow with the square of
    the columns, whatever null patterns occur. Columns of few values are ranked
    first and meet the rows by broadcast; the counts of a column of many values
    then carry the sums of its partners' ranks, so that pairs with a column of
    few values need no join of the rows. Only pairs of two columns of many
    values join their ranks to the distinct value tuples, by one shuffle a
    column. The plan is the same with and without NULLs.
    """
    cols = cols or numeric_columns(df)
    spark, every = df.sparkSession, range(len(cols))
    pairs = list(combinations(every, 2))
    if not pairs:
        return spark.createDataFrame([], "x string, y string, r double")
    v, c, r, w = ([f"_{k}{i}" for i in every] for k in "vcrw")
    rows = _stored(df.select(*[(nan_to_null(F.col(x).cast("double")) + F.lit(0.0)).alias(v[i])
                               for i, x in enumerate(cols)]), "rows")
    # an estimate picks the plan, no result depends on it
    sizes = rows.agg(*[F.approx_count_distinct(x) for x in v]).first()
    room, small = RANK_CELLS, []
    for i in sorted(every, key=lambda i: sizes[i]):
        room -= sizes[i] * len(cols)
        if room >= 0:
            small.append(i)
    big = [i for i in every if i not in small]

    def counted(table: DataFrame, which: list[int], partners: list[int]) -> DataFrame:
        """(feature, value): rows with each other column, and the sums of the ranks that ``partners`` have there."""
        others = [j for j in every if which != [j]]

        def fields(i: int) -> list:
            return [F.lit(v[i]).alias("feature"), F.col(v[i]).alias("value"),
                    *[F.col(v[j]).isNotNull().cast("long").alias(c[j]) for j in others],
                    *[F.coalesce(F.col(f"_r{j}_{i}"), F.lit(0.0)).alias(w[j]) for j in partners]]

        long = table.select(F.explode(F.array(*[F.struct(*fields(i)) for i in which])).alias("t")).select("t.*") \
            if len(which) > 1 else table.select(*fields(which[0]))
        return long.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
            *[F.sum(x).alias(x) for x in [*[c[j] for j in others], *[w[j] for j in partners]]])

    def ranks_of(table: DataFrame, i: int) -> DataFrame:
        return table.filter(F.col("feature") == v[i]).select(
            F.col("value").alias(v[i]), *[F.col(r[j]).alias(f"_r{i}_{j}") for j in every if j != i])

    def products(table: DataFrame, which: list[int], n) -> None:
        """Sums of the products of ranks for the pairs inside ``which``."""
        inside = list(combinations(sorted(which), 2))
        if inside:
            found = table.agg(*[F.sum(n * F.col(f"_r{i}_{j}") * F.col(f"_r{j}_{i}")) for i, j in inside]).first()
            shared.update(zip(inside, found, strict=True))

    square, shared, ranked = {}, {}, rows
    if small:       # about RANK_CELLS cells at most: sorted by feature
        others = [j for j in every if small != [j]]
        of = Window.partitionBy("feature")
        smaller = of.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        # average ranks have the mean (n + 1) / 2, exactly
        ranks = _stored(counted(rows, small, []).select("feature", "value", *[c[j] for j in others], *[
            (F.coalesce(F.sum(c[j]).over(smaller), F.lit(0)).cast("double") + (F.col(c[j]) + 1) / 2.0
             - (F.sum(c[j]).over(of) + 1) / 2.0).alias(r[j]) for j in others]), "ranks")
        for x in ranks.groupBy("feature").agg(*[F.sum(F.col(c[j]) * F.col(r[j]) * F.col(r[j])).alias(c[j])
                                                for j in others]).collect():
            square[x["feature"]] = x
        for i in small:
            ranked = ranked.join(F.broadcast(ranks_of(ranks, i)), v[i], "left")
        products(ranked, small, F.lit(1.0))
    if big:
        flat = _stored(counted(ranked, big, small), "values")
        found = rank_sums(flat, [c[j] for j in every if big != [j]], [(w[j], c[j]) for j in small])
        for x, sums in found.items():
            square[x], i = sums, v.index(x)
            shared.update({(min(i, j), max(i, j)): sums[w[j]] for j in small})
    if len(big) > 1:
        totals: dict[str, tuple[int, list[int]]] = {}
        cum = running_counts(flat, "feature", "value", c, totals)
        mids = F.create_map(*[e for x, (_, sums) in totals.items()
                              for e in (F.lit(x), F.array(*[F.lit((n + 1) / 2.0) for n in sums]))])[F.col("feature")]
        cum = _stored(cum.select("feature", "value", *[
            (F.col("_starts")[j].cast("double") + (F.col(c[j]) + 1) / 2.0 - mids[j]).alias(r[j]) for j in every]),
            "ranks", ["feature"])
        keys = [v[i] for i in big]
        tuples = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        for i in big:       # rows without a value match nothing, and are dealt out by their other columns
            salt = F.when(F.col(v[i]).isNull(), F.xxhash64(*keys)).otherwise(F.lit(0))
            tuples = tuples.withColumn("_salt", salt).join(ranks_of(cum, i).withColumn("_salt", F.lit(0).cast("long")),
                                                           [v[i], "_salt"], "left").drop("_salt")
        products(tuples, big, F.col("_n"))

    def corr(i: int, j: int) -> float | None:
        a, b = (square[v[k]][c[m]] if v[k] in square else 0.0 for k, m in ((i, j), (j, i)))
        return shared[i, j] / math.sqrt(a * b) if a > 0 and b > 0 else None

    return spark.createDataFrame([(cols[i], cols[j], corr(i, j)) for i, j in pairs], "x string, y string, r double")


# --------------------------------------------------------------------------- P8
def _pair_concordance(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """Exact sum over unordered pairs of c_i c_j sign(x_i - x_j) sign(y_i - y_j).

    Vectorised divide and conquer over the dense rank of x: at level l the
    x-ranks form blocks of 2^(l+1) ranks, each split into a left and a right
    half; every pair with different x is settled at exactly one level, as a
    (left, right) pair of one block. Per level one lexsort by (block, y)
    gives, for every right point, the left weight below and above its y.
    O(m log^2 m) numpy work, no per-point Python.
    """
    m = len(x)
    if m < 2:
        return 0.0
    _, xr = np.unique(x, return_inverse=True)
    _, yr = np.unique(y, return_inverse=True)
    c = c.astype(np.float64)
    levels = int(np.ceil(np.log2(xr.max() + 1))) if xr.max() > 0 else 0
    total = 0.0
    for lev in range(levels):
        block = xr >> (lev + 1)
        right = ((xr >> lev) & 1).astype(bool)
        order = np.lexsort((yr, block))
        b, yy, rr, cc = block[order], yr[order], right[order], c[order]
        lw = np.where(rr, 0.0, cc)
        # groups of equal (block, y)
        new_grp = np.ones(m, dtype=bool)
        new_grp[1:] = (b[1:] != b[:-1]) | (yy[1:] != yy[:-1])
        gid = np.cumsum(new_grp) - 1
        g_left = np.bincount(gid, weights=lw)
        g_block = b[new_grp]
        # left weight strictly below each group inside its block
        cum = np.cumsum(g_left) - g_left
        first_of_block = np.ones(len(g_block), dtype=bool)
        first_of_block[1:] = g_block[1:] != g_block[:-1]
        block_start = np.maximum.accumulate(np.where(first_of_block, np.arange(len(g_block)), 0))
        below = cum - cum[block_start]
        block_total = np.bincount(np.cumsum(first_of_block) - 1, weights=g_left)
        blk_idx = np.cumsum(first_of_block) - 1
        above = block_total[blk_idx] - below - g_left
        contrib = (below - above)[gid]
        total += float(np.sum(np.where(rr, cc * contrib, 0.0)))
    return total


def _local_terms(pdf: pd.DataFrame) -> pd.DataFrame:
    s = _pair_concordance(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["c"].to_numpy())
    return pd.DataFrame({"s": [float(pdf["sign"].iloc[0]) * s]})


def concordance(pts: DataFrame, buckets: int | None = None) -> float:
    """Sum over pairs of distinct points (x, y, c) of c c' sign(dx) sign(dy), exactly.

    Points are placed on a grid with about equally many points per x- and per
    y-bucket; a value with more than its share has a bucket for itself. Pairs
    that share neither bucket are the same sum over the grid's cells (in one
    array while these are few, else by the same method). Pairs sharing an
    x-bucket, or a y-bucket, are counted inside it (grouped pandas, vectorised
    O(m log^2 m)); pairs sharing a cell were counted twice and are taken off
    once. A bucket of a single x (or y) holds ties only and is skipped, so no
    hot value gathers in one task.
    """
    if buckets is None:
        buckets = max(KENDALL_BUCKETS, math.ceil(pts.count() / KENDALL_POINTS))
    sx, sy = _edges(pts, "x", buckets), _edges(pts, "y", buckets)
    bz = Bucketizer(splitsArray=[sx, sy], inputCols=["x", "y"], outputCols=["bx", "by"])
    pb = bz.transform(pts).withColumn("bx", F.col("bx").cast("int")).withColumn("by", F.col("by").cast("int"))
    pb = _reuse(pb)
    cells = pb.groupBy("bx", "by").agg(F.sum("c").alias("c")).select(
        F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y"), "c")
    if len(sx) * len(sy) <= KENDALL_CELLS:
        rows = cells.collect()               # bounded by KENDALL_CELLS
        a = np.array([[r["x"], r["y"], r["c"]] for r in rows], dtype=np.float64).reshape(-1, 3)
        cross = _pair_concordance(a[:, 0], a[:, 1], a[:, 2])
    else:
        cross = concordance(_reuse(cells), KENDALL_BUCKETS)
    # buckets that hold more than one value of their axis
    live_x = [r[0] for r in pb.groupBy("bx").agg(F.min("x") != F.max("x")).collect() if r[1]]
    live_y = [r[0] for r in pb.groupBy("by").agg(F.min("y") != F.max("y")).collect() if r[1]]
    in_x, in_y = F.col("bx").isin(live_x), F.col("by").isin(live_y)

    def part(keep, kind, gid, sign):
        return F.when(keep, F.struct(F.lit(kind).alias("kind"), gid.alias("gid"), F.lit(sign).alias("sign")))

    cell = F.col("bx").cast("long") * len(sy) + F.col("by")
    groups = (pb.select("x", "y", "c", F.explode(F.array_compact(F.array(
        part(in_x, "x", F.col("bx").cast("long"), 1), part(in_y, "y", F.col("by").cast("long"), 1),
        part(in_x & in_y, "c", cell, -1)))).alias("g")).select("x", "y", "c", "g.*"))
    local = groups.groupBy("kind", "gid").applyInPandas(_local_terms, "s double")
    return cross + (local.agg(F.sum("s")).first()[0] or 0.0)


def kendall_pair(df: DataFrame, x: str, y: str, buckets: int | None = None) -> DataFrame:
    """Kendall tau-b of one pair, exact, with no pair enumeration (see ``concordance``)."""
    spark = df.sparkSession
    pts = _reuse(df.select(nan_to_null(F.col(x).cast("double")).alias("x"),
                           nan_to_null(F.col(y).cast("double")).alias("y"))
                 .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
                 .groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")))
    s = concordance(pts, buckets)
    ties = pts.agg(F.sum("c").alias("n")).first()["n"] or 0
    tx = pts.groupBy("x").agg(F.sum("c").alias("t")).agg(
        F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("v")).first()["v"] or 0.0
    ty = pts.groupBy("y").agg(F.sum("c").alias("t")).agg(
        F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("v")).first()["v"] or 0.0
    n0 = ties * (ties - 1) / 2.0
    den = math.sqrt((n0 - tx) * (n0 - ty)) if (n0 - tx) > 0 and (n0 - ty) > 0 else 0.0
    tau = s / den if den else None
    return spark.createDataFrame([(x, y, None if tau is None else float(tau))],
                                 "x string, y string, tau double")


def kendall(df: DataFrame, cols: list[str] | None = None, buckets: int | None = None):
    """Kendall tau-b matrix (x, y, tau) over all column pairs."""
    cols = cols or numeric_columns(df)
    parts = [kendall_pair(df, a, b, buckets) for a, b in combinations(cols, 2)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --------------------------------------------------------------------------- P9
def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """Observed cells (x, y, count); absent cells are zero."""
    return df.groupBy(x, y).agg(F.count(F.lit(1)).alias("count"))


def pair_cells(df: DataFrame, pairs: list[tuple[str, str]], codes: dict | None = None) -> DataFrame:
    """(pair, xv, yv, count): the contingency tables of all column pairs, from one scan.

    ``codes`` gives the column expression to tabulate instead of the value. Rows
    with a missing side are left out of a pair, like in a cross-tabulation. Cells
    are counted before the shuffle, so a hot category is one row a task.
    """
    names = list(dict.fromkeys(c for p in pairs for c in p))
    codes = codes or {}
    kinds = {c: df.schema[c].dataType for c in names}

    def code(c: str):
        v = codes.get(c)
        if v is None:
            v = nan_to_null(F.col(c).cast("double")) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.col(c)
        return v.cast("string")

    coded = df.select(*[code(c).alias(f"_v{i}") for i, c in enumerate(names)])
    at = {c: F.col(f"_v{i}") for i, c in enumerate(names)}
    long = coded.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("pair"), at[a].alias("xv"), at[b].alias("yv")) for k, (a, b) in enumerate(pairs)])).alias("t"))
    return long.select("t.*").filter(F.col("xv").isNotNull() & F.col("yv").isNotNull()).groupBy("pair", "xv", "yv").agg(
        F.count(F.lit(1)).alias("count"))


def with_margins(cells: DataFrame) -> DataFrame:
    """Cells with their row sum ``r_i`` and column sum ``c_j``, by plain aggregates."""
    cells = _reuse(cells)
    rows = cells.groupBy("pair", "xv").agg(F.sum("count").alias("r_i"))
    columns = cells.groupBy("pair", "yv").agg(F.sum("count").alias("c_j"))
    return cells.join(rows, ["pair", "xv"]).join(columns, ["pair", "yv"])


def _pair_names(spark, pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, x string, y string")


def chi_square_pairs(df: DataFrame, pairs: list[tuple[str, str]], correction: bool = True,
                     codes: dict | None = None) -> DataFrame:
    """Chi-square statistic, degrees of freedom and bias-corrected Cramer's V of every pair.

    chi2 = n * sum(o^2 / (r_i c_j)) - n over observed cells only (absent
    cells contribute exactly their expectation). In a 2 x 2 table every
    cell deviates by the same d = |o - e| and sum(1/e) = n * sum(1/r_i) *
    sum(1/c_j), so d follows from the plain statistic and Yates' correction
    is chi2 = max(d - 0.5, 0)^2 * n * sum(1/r_i) * sum(1/c_j).
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], "x string, y string, chi2 double, dof long, cramers_v double")
    j = with_margins(pair_cells(df, pairs, codes))
    o, ri, cj = (F.col("count").cast("double"), F.col("r_i").cast("double"),
                 F.col("c_j").cast("double"))
    # Over the cells of a row, sum(o / r_i) = 1 and sum(o / r_i^2) = 1 / r_i,
    # so category counts and inverse-margin sums come from the same pass.
    t = j.groupBy("pair").agg(F.sum(o).alias("n"), F.sum(o * o / (ri * cj)).alias("q"),
                              F.round(F.sum(o / ri)).alias("r"), F.round(F.sum(o / cj)).alias("k"),
                              F.sum(o / (ri * ri)).alias("ir"), F.sum(o / (cj * cj)).alias("ic"))
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    plain = n * F.col("q") - n
    inv = n * F.col("ir") * F.col("ic")
    dev = F.sqrt(F.greatest(plain, F.lit(0.0)) / inv)
    yates = F.pow(F.greatest(dev - 0.5, F.lit(0.0)), 2) * inv
    dof = (r - 1) * (k - 1)
    chi2 = F.when(F.lit(correction) & (dof == 1), yates).otherwise(plain)
    t = t.select("pair", chi2.alias("chi2"), dof.cast("long").alias("dof"), "n", "r", "k")
    phi2 = F.col("chi2") / n
    phi2c = F.greatest(F.lit(0.0), phi2 - F.try_divide((k - 1) * (r - 1), n - 1))
    rc = r - F.try_divide((r - 1) * (r - 1), n - 1)
    kc = k - F.try_divide((k - 1) * (k - 1), n - 1)
    rk = F.least(kc - 1, rc - 1)
    v = F.when(rk == 0, F.lit(1.0)).otherwise(F.sqrt(F.try_divide(phi2c, rk)))
    t = t.select("pair", "chi2", "dof", v.alias("cramers_v"))
    # a row per pair on both sides
    return _pair_names(df.sparkSession, pairs).join(F.broadcast(t), "pair", "left").select(
        "x", "y", "chi2", "dof", "cramers_v")


def chi_square(df: DataFrame, x: str, y: str, correction: bool = True) -> DataFrame:
    """P9 for one pair (see ``chi_square_pairs``)."""
    return chi_square_pairs(df, [(x, y)], correction)


def cramers_v(df: DataFrame, cols: list[str], correction: bool = True) -> DataFrame:
    """Cramer's V matrix (x, y, chi2, dof, cramers_v) over column pairs, from one scan."""
    return chi_square_pairs(df, list(combinations(cols, 2)), correction)


# --------------------------------------------------------------------------- P10
def equal_width_codes(df: DataFrame, cols: list[str], bins: int = HIST_BINS) -> dict:
    """The equal-width bin 0..bins-1 of every numeric column, as column expressions.

    The ends of all columns come from one aggregate (two numbers a column) and
    are literals: no join, no further scan. NaN is missing.
    """
    value = {c: nan_to_null(F.col(c).cast("double")) for c in cols}
    if not cols:
        return {}
    ends = df.agg(*[F.min(value[c]).alias(f"a{i}") for i, c in enumerate(cols)],
                  *[F.max(value[c]).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        mn, mx = ends[f"a{i}"], ends[f"b{i}"]
        if mn is None:
            out[c] = F.lit(None).cast("int")
        elif mn == mx:
            out[c] = F.when(value[c].isNotNull(), F.lit(0))
        else:
            width = F.lit((mx - mn) / float(bins))
            out[c] = F.least(F.floor((value[c] - F.lit(mn)) / width), F.lit(bins - 1)).cast("int")
    return out


def equal_width_bins(df: DataFrame, col: str, bins: int = HIST_BINS, out: str | None = None):
    """Numeric column -> equal-width bin index 0..bins-1, as text."""
    return df.withColumn(out or col, equal_width_codes(df, [col], bins)[col].cast("string"))


def auto_matrix(df: DataFrame, numeric: list[str], categorical: list[str],
                bins: int = HIST_BINS) -> DataFrame:
    """P10: Spearman for numeric pairs, Cramer's V when a category is involved
    (the numeric side binned into equal-width bins). -> (x, y, method, value).

    One scan codes all columns and counts the cells of all mixed pairs; one more
    ranks the numeric columns."""
    mixed = [(a, b) for a, b in combinations(numeric + categorical, 2) if b in categorical]
    parts = []
    if len(numeric) > 1:
        parts.append(spearman(df, numeric).select("x", "y", F.lit("spearman").alias("method"), F.col("r").alias("value")))
    if mixed:
        codes = equal_width_codes(df, [c for c in numeric if any(c == a for a, _ in mixed)], bins)
        parts.append(chi_square_pairs(df, mixed, codes=codes).select(
            "x", "y", F.lit("cramers").alias("method"), F.col("cramers_v").alias("value")))
    if not parts:
        return df.sparkSession.createDataFrame([], "x string, y string, method string, value double")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# --------------------------------------------------------------------------- P11
def nullity(df: DataFrame, cols: list[str] | None = None):
    """Missing count and share per column, and the correlation of the
    missing indicators of every column pair, from one aggregate each (NaN is missing).
    Returns (per_column, pairs)."""
    cols = cols or df.columns
    ind = {c: missing(df, c).cast("double") for c in cols}
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(ind[c]).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[safe_corr(ind[a], ind[b]).alias(f"r{i}_{j}")
                   for (i, a), (j, b) in combinations(list(enumerate(cols)), 2)])
    per_col = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").cast("long").alias("missing"),
                 F.try_divide(F.col(f"m{i}"), F.col("_n").cast("double")).alias("share"))
        for i, c in enumerate(cols)])).alias("t")).select("t.*")
    pairs = row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}_{j}").alias("r"))
        for (i, a), (j, b) in combinations(list(enumerate(cols)), 2)])).alias("t")).select("t.*")
    return per_col, pairs


# --------------------------------------------------------------------------- P12
def alerts(df: DataFrame, numeric: list[str] | None = None, missing: float = ALERT_MISSING,
           correlation: float = ALERT_CORRELATION, skewness: float = ALERT_SKEWNESS,
           zeros: float = ALERT_ZEROS) -> DataFrame:
    """(feature, alert, value) flags over the profile tables:
    constant, unique, missing, zeros, skewed, high correlation."""
    numeric = numeric or numeric_columns(df)
    p = numeric_profile(df, numeric)
    tot = (F.col("count") + F.col("missing")).cast("double")
    zshare = F.try_divide(F.col("zeros").cast("double"), F.col("count").cast("double"))
    def cand(name, value, on):
        return F.struct(F.lit(name).alias("alert"), value.cast("double").alias("value"),
                        on.alias("on"))

    cands = F.array(
        cand("constant", F.col("distinct"), F.col("distinct") == 1),
        cand("unique", F.col("distinct"), (F.col("distinct") == F.col("count")) & (F.col("count") > 0)),
        cand("missing", F.col("missing") / tot, F.col("missing") / tot > missing),
        cand("zeros", zshare, zshare > zeros),
        cand("skewed", F.col("skewness"), F.abs(F.col("skewness")) > skewness))
    out = (p.select("feature", F.explode(cands).alias("t"))
           .filter(F.col("t.on")).select("feature", "t.alert", "t.value"))
    if len(numeric) > 1:
        r = pearson(df, numeric).filter(F.abs(F.col("r")) > correlation)
        both = r.select(F.col("x").alias("feature"), "r").unionByName(
            r.select(F.col("y").alias("feature"), "r"))
        out = out.unionByName(both.groupBy("feature").agg(F.max(F.abs("r")).alias("value"))
                              .select("feature", F.lit("high_correlation").alias("alert"), "value"))
    return out


# --------------------------------------------------------------------------- report
def report(df: DataFrame, numeric: list[str] | None = None,
           categorical: list[str] | None = None) -> dict[str, DataFrame]:
    """All profile tables of a frame in one call (overview, column profiles,
    quantiles, histograms, categories, the six correlation kinds, missing
    patterns, alerts). Each value is a DataFrame; the correlation kinds are
    auto, pearson, spearman, kendall, cramers and phik, as the profile asks for.
    """
    numeric = numeric if numeric is not None else numeric_columns(df)
    categorical = categorical if categorical is not None else string_columns(df)
    out = {"overview": overview(df)}
    if numeric:
        vc = value_counts(df, numeric)
        out["numeric"] = numeric_profile(df, numeric, vc)
        out["quantiles"] = quantiles(df, numeric, vc=vc)
        out["histogram"] = histogram(df, numeric)
    if categorical:
        out["categories"], out["top_values"] = category_profile(df, categorical)
    if len(numeric) > 1:
        out["pearson"] = pearson(df, numeric)
        out["spearman"] = spearman(df, numeric)
        out["kendall"] = kendall(df, numeric)
    if len(categorical) > 1:
        out["cramers"] = cramers_v(df, categorical)
    if len(numeric) + len(categorical) > 1:
        from cropframe.operators.phik import phik_matrix
        out["auto"] = auto_matrix(df, numeric, categorical)
        out["phik"] = phik_matrix(df, numeric, categorical)
    out["missing"], out["missing_pairs"] = nullity(df)
    out["alerts"] = alerts(df, numeric) if numeric else None
    return {k: v for k, v in out.items() if v is not None}
