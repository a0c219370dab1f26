"""Regression trees for every region at once (M15 beyond least squares).

Features are coded once by their own quantiles, and rows with the same codes
are added up, so later passes read counted tuples instead of rows. The trees of
all regions then grow together, level by level: one aggregate by (region, node,
feature, bin) gives every split of every open node, and the best split of a node
is one maximum. A region with a third of the rows is combined before the
shuffle like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropframe.functions import nan_to_null

BINS = 32
DEPTH = 3
LEAST_ROWS = 1
LEAST_GAIN = 1e-12


def feature_edges(df: DataFrame, features: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """The inner quantiles of every feature (bins - 1 numbers a feature), exact."""
    from cropframe.operators.profile import exact_quantiles, value_counts

    edges: dict[str, list[float]] = {f: [] for f in features}
    for r in exact_quantiles(value_counts(df, features, keep=False), [i / bins for i in range(1, bins)]).collect():
        edges[r["feature"]].append(float(r["q"]))
    return {f: sorted(e) for f, e in edges.items()}


def _code(value: Column, edges: list[float]) -> Column:
    """How many edges the value exceeds; a missing value exceeds all, so it goes right."""
    above = sum(((value > F.lit(e)).cast("int") for e in edges), F.lit(0))
    return F.coalesce(above, F.lit(len(edges)))


def grouped_trees(df: DataFrame, group: list[str], features: list[str], label: str, max_depth: int = DEPTH,
                  bins: int = BINS, least_rows: int = LEAST_ROWS, edges: dict[str, list[float]] | None = None) -> DataFrame:
    """A regression tree per group -> (group, node, n, prediction, feature, threshold, gain).

    Nodes are numbered like a heap (root 1, children 2i and 2i + 1). A split
    sends feature <= threshold left; it is the one with the largest fall of the
    squared error (ties: first feature, then smallest threshold) that leaves
    ``least_rows`` rows on both sides. Leaves have no feature. Rows without a label
    are left out; missing features go right.
    """
    from cropframe.operators.model import materialize

    y = nan_to_null(F.col(label).cast("double"))
    value = {f: nan_to_null(F.col(f).cast("double")) for f in features}
    edges = edges or feature_edges(df, features, bins)
    codes = [f"_b{i}" for i in range(len(features))]
    rows = df.select(*group, y.alias("_y"), *[_code(value[f], edges[f]).alias(c) for f, c in zip(features, codes, strict=True)])
    rows = rows.filter(F.col("_y").isNotNull()).groupBy(*group, *codes).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s"))
    rows = materialize(rows.withColumn("_node", F.lit(1)))
    own = [*group, "_node"]
    levels = []
    for depth in range(max_depth + 1):
        total = rows.groupBy(*own).agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"))
        if depth == max_depth:
            levels.append(total.select(*own, "n", (F.col("s") / F.col("n")).alias("prediction"), F.lit(None).cast("int").alias("at"),
                                       F.lit(None).cast("int").alias("bin"), F.lit(None).cast("double").alias("gain")))
            break
        long = rows.select(*own, "_n", "_s", F.posexplode(F.array(*codes)).alias("at", "bin"))
        cells = long.groupBy(*own, "at", "bin").agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"))
        # at most ``bins`` rows a window
        side = Window.partitionBy(*own, "at").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*own, "at")
        cells = cells.select(*own, "at", "bin", F.sum("n").over(side).alias("ln"), F.sum("s").over(side).alias("ls"),
                             F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"))
        rn, rs, mean = F.col("n") - F.col("ln"), F.col("s") - F.col("ls"), F.col("s") / F.col("n")
        # n_l n_r / n (mean_l - mean_r)^2, the fall of the squared error
        gain = F.col("ln") * rn / F.col("n") * F.pow(F.col("ls") / F.col("ln") - F.try_divide(rs, rn), 2)
        fits = (F.col("ln") >= least_rows) & (rn >= max(1, least_rows)) & (gain > LEAST_GAIN)
        best = cells.groupBy(*own).agg(F.max("n").alias("n"), F.max_by(mean, -F.col("at")).alias("prediction"), F.max(F.when(
            fits, F.struct(gain.alias("gain"), (-F.col("at")).alias("at"), (-F.col("bin")).alias("bin")))).alias("best"))
        found = materialize(best.select(*own, "n", "prediction", (-F.col("best.at")).alias("at"),
                                        (-F.col("best.bin")).alias("bin"), F.col("best.gain").alias("gain")))
        levels.append(found)
        split = found.filter(F.col("at").isNotNull()).select(*own, "at", "bin")
        rows = rows.join(split, own).withColumn(
            "_node", 2 * F.col("_node") + (F.element_at(F.array(*codes), F.col("at") + 1) > F.col("bin")).cast("int"))
        rows = materialize(rows.drop("at", "bin"))
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("at") + 1)
    table = F.array(*[F.array(*[F.lit(float(e)) for e in edges[f]]).cast("array<double>") for f in features])
    cut = F.element_at(F.element_at(table, F.col("at") + 1), F.col("bin") + 1)
    return nodes.select(*group, F.col("_node").alias("node"), "n", "prediction", F.when(F.col("at").isNotNull(), name).alias("feature"),
                        F.when(F.col("at").isNotNull(), cut).alias("threshold"), "gain")


def predict_trees(df: DataFrame, nodes: DataFrame, group: list[str], features: list[str], max_depth: int = DEPTH,
                  out: str = "prediction") -> DataFrame:
    """``df`` with its group's tree applied; a group without a tree gets NULL.

    A group's whole tree (under 2^(max_depth + 1) nodes) travels as one map, so
    the rows are joined once and walk the tree by expressions.
    """
    tree = nodes.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct(
        "node", F.struct("feature", "threshold", "prediction")))).alias("_tree"))
    joined = df.join(tree, group, "left").withColumn("_at", F.lit(1))
    value = F.create_map(*[x for f in features for x in (F.lit(f), nan_to_null(F.col(f).cast("double")))])
    for _ in range(max_depth):
        here = F.col("_tree")[F.col("_at")]
        right = F.coalesce((value[here["feature"]] > here["threshold"]).cast("int"), F.lit(1))
        joined = joined.withColumn("_at", F.when(here["feature"].isNotNull(), 2 * F.col("_at") + right).otherwise(F.col("_at")))
    return joined.withColumn(out, F.col("_tree")[F.col("_at")]["prediction"]).drop("_tree", "_at")
