"""Mean imputation and feature ranking.

Relevance is binned mutual information: each feature and the target are
cut at their own quantiles, the rows are counted by their tuple of bins, and
every joint table is summed up from these counts.
It is a different estimator from a nearest-neighbour one, so values differ
from such a library while the ranking is comparable.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MI_BINS = 10


def impute_mean(df: DataFrame, cols: list[str], drop_all_null: bool = True) -> DataFrame:
    """NULL/NaN -> the column mean over the whole frame.

    A column with no value at all has no mean; it is dropped first. The
    means come from one aggregate (one number per column).
    """
    # one mean per column, collected once and used as literals: no join, no re-scan
    means = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))
                     .alias(c) for c in cols]).first()
    out = df.select(*[
        F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")),
                   F.lit(means[c]).cast("double")).alias(c) if c in cols else F.col(c)
        for c in df.columns])
    if drop_all_null:
        out = out.drop(*[c for c in cols if means[c] is None])
    return out


def _binned(df: DataFrame, cols: list[str], bins: int) -> DataFrame:
    """Rows counted by the tuple of their columns' quantile bins (column ``_n``).

    A value's bin is the number of inner quantiles below it. The edges (bins -
    1 numbers a column) come from exact running counts and are literals here.
    The counts are checkpointed: all joint tables are read off them.
    """
    from cropframe.operators.model import materialize
    from cropframe.operators.profile import exact_quantiles, value_counts
    edges: dict[str, list[float]] = {c: [] for c in cols}
    found = exact_quantiles(value_counts(df, cols, keep=False), [i / bins for i in range(1, bins)]).collect()
    for r in found:
        edges[r["feature"]].append(float(r["q"]))
    out = []
    for c in cols:
        above = sum((F.col(c) > F.lit(e)).cast("int") for e in sorted(edges[c]))
        out.append((F.when(F.col(c).isNotNull(), above) if edges[c] else F.lit(None).cast("int")).alias(c))
    return materialize(df.select(*out).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")))


def _filled(df: DataFrame, features: list[str], target: str, impute: bool) -> DataFrame:
    d = df.filter(F.col(target).isNotNull())
    if impute:
        d = impute_mean(d, features, drop_all_null=False)
    return d.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y"))


def mutual_information(df: DataFrame, features: list[str], target: str,
                       bins: int = MI_BINS, impute: bool = True) -> DataFrame:
    """M1 + D5: (feature, relevance) = binned MI with the target, sorted.

    Features are mean-imputed first (the reference fills with the mean);
    rows without a target are left out.
    """
    return _relevance(_binned(_filled(df, features, target, impute), features + ["_y"], bins), features)


def _relevance(counts: DataFrame, features: list[str]) -> DataFrame:
    long = counts.unpivot(["_y", "_n"], features, "feature", "xb").filter(F.col("xb").isNotNull())
    return _mi_from_long(long, "feature", "xb", "_y").withColumnRenamed("mi", "relevance") \
        .orderBy(F.col("relevance").desc(), F.col("feature"))


def _mi_from_long(long: DataFrame, key, xb: str, yb: str) -> DataFrame:
    """MI per key from counted rows (key..., xb, yb, _n): sum p log(p / (px py))."""
    keys = [key] if isinstance(key, str) else list(key)
    joint = long.groupBy(*keys, xb, yb).agg(F.sum("_n").alias("nxy"))
    px = joint.groupBy(*keys, xb).agg(F.sum("nxy").alias("nx"))
    py = joint.groupBy(*keys, yb).agg(F.sum("nxy").alias("ny"))
    n = joint.groupBy(*keys).agg(F.sum("nxy").alias("n"))
    j = joint.join(px, keys + [xb]).join(py, keys + [yb]).join(n, keys)
    term = (F.col("nxy") / F.col("n")) * F.log(
        F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return j.groupBy(*keys).agg(F.sum(term).alias("mi"))


def mrmr(df: DataFrame, features: list[str], target: str, k: int | None = None,
         bins: int = MI_BINS) -> DataFrame:
    """M2: greedy minimum-redundancy maximum-relevance order.

    Relevance and the pairwise feature MI table are read off one table of
    counted bin tuples; the greedy pick runs on the p x p table (bounded by the
    number of features). Score = relevance - mean MI with the already chosen.
    """
    spark = df.sparkSession
    b = _binned(_filled(df, features, target, True), features + ["_y"], bins)
    rel = {r["feature"]: r["relevance"] for r in _relevance(b, features).collect()}
    pairs = list(combinations(features, 2))
    red = {}
    if pairs:
        long = b.select(F.explode(F.array(*[
            F.struct(F.lit(a).alias("fa"), F.lit(c).alias("fb"), F.col(a).alias("xa"),
                     F.col(c).alias("xc"), F.col("_n")) for a, c in pairs])).alias("t")).select("t.*")
        for r in _mi_from_long(long.dropna(), ["fa", "fb"], "xa", "xc").collect():
            red[(r["fa"], r["fb"])] = red[(r["fb"], r["fa"])] = r["mi"]
    chosen, rows = [], []
    left = [f for f in features if f in rel]
    while left and (k is None or len(chosen) < k):
        def score(f):
            r = sum(red.get((f, c), 0.0) for c in chosen) / len(chosen) if chosen else 0.0
            return rel[f] - r, r
        best = max(left, key=lambda f: (score(f)[0], -features.index(f)))
        s, r = score(best)
        rows.append((len(chosen) + 1, best, float(rel[best]), float(r), float(s)))
        chosen.append(best)
        left.remove(best)
    return spark.createDataFrame(rows, "rank int, feature string, relevance double, "
                                       "redundancy double, score double")
