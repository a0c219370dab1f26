"""Model explanations.

Shapley values use the interventional value function
v(S) = mean over background rows b of f(x_S, b_rest). The background is a
fixed-size sample (a sampling operator: the masker's definition, 100 rows
by default); every explained row is kept. Linear models and sums of trees have
closed forms without a fan-out. For any other model, rows x coalitions x
background are produced by ``explode`` of bounded arrays (coalition masks, the
background embedded as a literal), scored by the model's own ``transform``
and reduced by ``groupBy``, so the fan-out is distributed and never joins
two unbounded sides.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ImputerModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropframe.operators.model import materialize, stacked_solve
from cropframe.operators.query import top_k_per_group
from cropframe.operators.tree_shap import tree_shap

BACKGROUND_ROWS = 100
MOST_COALITIONS = 1 << 16
LIME_SAMPLES = 5000
LIME_TOP = 8
LIME_RIDGE = 1.0
SEED = 42


# --------------------------------------------------------------------------- E2
def linear_shap(df: DataFrame, keys: list[str], coefs: dict[str, float], intercept: float,
                means: dict[str, float]) -> DataFrame:
    """SHAP of a linear model in closed form: coef * (x - mean(background)).

    -> (keys, feature, value, shap, base) with base = intercept + sum(coef * mean).
    """
    base = intercept + sum(coefs[f] * means[f] for f in coefs)
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                               (F.lit(float(c)) * (F.col(f).cast("double") - F.lit(float(means[f]))))
                               .alias("shap")) for f, c in coefs.items()])
    return df.select(*keys, F.explode(parts).alias("t")).select(
        *keys, "t.*", F.lit(float(base)).alias("base"))


# --------------------------------------------------------------------------- E1
def background_sample(df: DataFrame, keys: list[str], features: list[str],
                      n: int = BACKGROUND_ROWS, seed: int = SEED) -> DataFrame:
    """The n rows with the smallest key hash: a deterministic, partition-independent sample."""
    h = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    return df.select(*features, h.alias("_h")).orderBy("_h").limit(n).drop("_h")


def _shapley_plan(p: int, seed: int, permutations: int | None) -> list[tuple[int, int, float]]:
    """(feature index, coalition mask without it, weight) terms of the Shapley sum.

    All coalitions, weight |S|!(p-|S|-1)!/p!, so the values are exact; only where
    the caller names a number of ``permutations``, that many seeded random
    orders, weight 1/permutations each.
    """
    plan = []
    if permutations is None:
        if 1 << p > MOST_COALITIONS:
            raise ValueError(f"{p} features have 2^{p} coalitions; give a number of permutations to estimate instead")
        for i in range(p):
            others = [j for j in range(p) if j != i]
            for s in range(p):
                w = math.factorial(s) * math.factorial(p - s - 1) / math.factorial(p)
                for comb in combinations(others, s):
                    plan.append((i, sum(1 << j for j in comb), w))
        return plan
    rng = random.Random(seed)
    acc: dict[tuple[int, int], float] = {}
    for _ in range(permutations):
        order = list(range(p))
        rng.shuffle(order)
        mask = 0
        for i in order:
            acc[(i, mask)] = acc.get((i, mask), 0.0) + 1.0 / permutations
            mask |= 1 << i
    return [(i, m, w) for (i, m), w in acc.items()]


def shap_values(model: PipelineModel, df: DataFrame, keys: list[str], features: list[str],
                background: DataFrame | None = None, seed: int = SEED,
                permutations: int | None = None, background_rows: int = BACKGROUND_ROWS,
                engine: str = "auto") -> DataFrame:
    """Shapley value of every feature for every row of ``df``.

    -> (keys, feature, shap, base, prediction); sum(shap) + base = prediction.
    ``engine``: "linear" (a linear model's closed form over any background,
    however large: only its means are needed), "tree" (exact values of a sum of
    numeric trees) or "coalition" (any model, scored on coalitions mixed with
    background rows); "auto" takes the first that fits the model. The last two use
    ``background_rows`` background rows, the masker's sample size.
    """
    spark = df.sparkSession
    p = len(features)
    last = model.stages[-1]
    if engine not in ("auto", "linear", "tree", "coalition"):
        raise ValueError(f"no engine {engine!r}")
    linear = isinstance(last, LinearRegressionModel) and len(last.coefficients) == p
    if engine == "linear" or engine == "auto" and linear:
        if not linear:
            raise ValueError("the model is not linear in these features")
        return _linear_path(model, df, keys, features, background if background is not None else df)
    bg = background_sample(background if background is not None else df,
                           keys if background is None else features, features, background_rows, seed)
    bg_rows = [tuple(None if v is None else float(v) for v in r) for r in
               bg.select(*features).collect()]          # bounded: the sample size
    if engine in ("auto", "tree") and bg_rows:
        found = tree_shap(model, df, keys, features, np.array(
            [[math.nan if v is None else v for v in r] for r in bg_rows], dtype=float))
        if found is not None:
            return found
        if engine == "tree":
            raise ValueError("the model is no sum of numeric trees over these features")
    plan = _shapley_plan(p, seed, permutations)
    masks = sorted({m for _, m, _ in plan} | {m | (1 << i) for i, m, _ in plan} | {0, (1 << p) - 1})
    bg_struct = T.StructType([T.StructField(f"_b{j}", T.DoubleType()) for j in range(p)])
    bg_lit = F.array(*[F.struct(*[F.lit(v).cast("double").alias(f"_b{j}")
                                  for j, v in enumerate(r)]) for r in bg_rows]).cast(
        T.ArrayType(bg_struct))
    rows = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    fan = (rows.withColumn("_mask", F.explode(F.array(*[F.lit(m) for m in masks])))
           .withColumn("_bg", F.explode(bg_lit)))
    mixed = fan.select(*keys, "_mask", *[
        F.when((F.col("_mask").bitwiseAND(F.lit(1 << j))) != 0, F.col(f))
        .otherwise(F.col(f"_bg._b{j}")).alias(f) for j, f in enumerate(features)])
    scored = model.transform(mixed)
    v = scored.groupBy(*keys, "_mask").agg(F.avg("prediction").alias("_v"))
    plan_df = spark.createDataFrame(plan, "_i int, _mask long, _w double")
    names = F.array(*[F.lit(f) for f in features])
    # plan_df holds at most p * 2^(p-1) rows (or p x permutations): bounded.
    terms = v.join(F.broadcast(plan_df), "_mask").withColumn(
        "_with", F.col("_mask").bitwiseOR(F.expr("shiftleft(CAST(1 AS BIGINT), _i)")))
    v_with = v.select(*keys, F.col("_mask").alias("_with"), F.col("_v").alias("_v1"))
    contrib = terms.join(v_with, keys + ["_with"]).select(
        *keys, F.element_at(names, F.col("_i") + 1).alias("feature"),
        (F.col("_w") * (F.col("_v1") - F.col("_v"))).alias("_c"))
    phi = contrib.groupBy(*keys, "feature").agg(F.sum("_c").alias("shap"))
    ends = v.filter(F.col("_mask").isin(0, (1 << p) - 1)).groupBy(*keys).agg(
        F.max(F.when(F.col("_mask") == 0, F.col("_v"))).alias("base"),
        F.max(F.when(F.col("_mask") == (1 << p) - 1, F.col("_v"))).alias("prediction"))
    return phi.join(ends, keys)


def _linear_path(model: PipelineModel, df: DataFrame, keys: list[str], features: list[str],
                 background: DataFrame) -> DataFrame:
    """Shapley values of a linear model: coef * (x - mean), NULLs imputed as the model imputes them."""
    last = model.stages[-1]
    fill = next((s.surrogateDF.first().asDict() for s in model.stages if isinstance(s, ImputerModel)), {})
    x = {f: F.coalesce(F.col(f).cast("double"), F.lit(float(fill[f]))) if f in fill else F.col(f).cast("double")
         for f in features}
    means = background.agg(*[F.avg(x[f]).alias(f) for f in features]).first()      # p numbers
    coef = {f: float(c) for f, c in zip(features, last.coefficients.toArray(), strict=True)}
    base = float(last.intercept) + sum(coef[f] * means[f] for f in features)
    shap = {f: F.lit(coef[f]) * (x[f] - F.lit(float(means[f]))) for f in features}
    total = sum(shap.values(), F.lit(base))
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), shap[f].alias("shap")) for f in features])
    return df.select(*keys, F.explode(parts).alias("t"), total.alias("prediction")).select(
        *keys, "t.feature", "t.shap", F.lit(base).alias("base"), "prediction")


def global_importance(shap: DataFrame) -> DataFrame:
    """E1 bar chart data: mean |shap| per feature, descending."""
    return shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("importance")).orderBy(
        F.col("importance").desc(), "feature")


# --------------------------------------------------------------------------- E4
def _quartiles(train: DataFrame, features: list[str]):
    q = train.agg(*[F.percentile_approx(F.col(f).cast("double"), [0.25, 0.5, 0.75], 10000)
                    .alias(f) for f in features]).first()
    return {f: [float(x) for x in q[f]] for f in features}  # 3 numbers per feature: bounded


def _bin(col, qs):
    return (F.when(col <= qs[0], 0).when(col <= qs[1], 1).when(col <= qs[2], 2).otherwise(3))


# Coefficients of Wichura's algorithm AS 241 (1988) for the normal quantile, lowest power first.
_CENTRE = ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
            4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
           [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
            2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3])
_FLANK = ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
           1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
          [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
           1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
_TAIL = ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
          2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
         [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
          7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])


def normal_quantile(p):
    """Inverse of the normal distribution function as a column expression (to 1e-15); NULL outside (0, 1)."""
    def ratio(parts, x):
        def power_sum(coefs):
            out = F.lit(coefs[-1])
            for c in reversed(coefs[:-1]):
                out = out * x + F.lit(c)
            return out
        return power_sum(parts[0]) / power_sum(parts[1])

    q = p - 0.5
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    outer = F.when(r <= 5, ratio(_FLANK, r - 1.6)).otherwise(ratio(_TAIL, r - 5.0))
    value = F.when(F.abs(q) <= 0.425, q * ratio(_CENTRE, 0.180625 - q * q)).when(q < 0, -outer).otherwise(outer)
    return F.when((p > 0) & (p < 1), value)


def _truncated(mean: float, sd: float, low: float, high: float) -> tuple[float, ...]:
    """mean, sd, the ends of a bin, and the normal distribution function at its ends."""
    below = [0.5 * math.erfc((mean - x) / (sd * math.sqrt(2))) if sd else 0.5 for x in (low, high)]
    return (mean, sd, low, high, *below)


def lime(model: PipelineModel, train: DataFrame, instances: DataFrame, keys: list[str],
         features: list[str], n_samples: int = LIME_SAMPLES, k: int = LIME_TOP,
         seed: int = SEED, selection: str = "highest_weights") -> DataFrame:
    """E4 + D6 + E5: local linear explanation of each instance.

    NULLs are replaced by the training means first. Draws are hashes of the
    instance's key, the sample's number and the feature, so they do not depend
    on the partition layout. ``selection`` names how the k features are chosen:
    "highest_weights" of a light ridge, or "forward" selection.

    Quartile bins of the training data define the interpretable features
    (1 = same bin as the instance). For each instance, ``n_samples`` points
    are drawn (bins by their training frequency, values uniform inside the
    bin), scored by the model, weighted by an exponential kernel of width
    0.75 * sqrt(p) on the scaled binary distance, and a ridge regression on
    the binary features is fitted from grouped Gram sums. The k largest
    |weights| are kept and refitted.
    -> (keys, rank, feature, condition, weight).
    """
    spark = train.sparkSession
    p = len(features)
    means = train.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
    filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(float(means[f] or 0.0))).alias(f) for f in features}
    train = train.select(*filled.values())
    qs = _quartiles(train, features)
    # one pass for all features: rows, least and largest value of each bin
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), _bin(F.col(f), qs[f]).alias("b"), F.col(f).alias("v"))
        for f in features])).alias("t")).select("t.*")
    cells = long.groupBy("feature", "b").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # at most 4 rows a feature
    freq, box, stats = {}, {}, {}
    for f in features:
        own = {r["b"]: r for r in cells if r["feature"] == f}
        tot = sum(r["n"] for r in own.values())
        freq[f] = {b: r["n"] / tot for b, r in own.items()}
        box[f] = {b: (r["lo"], r["hi"]) for b, r in own.items()}
        stats[f"m_{f}"] = sum(b * q for b, q in freq[f].items())
        stats[f"s_{f}"] = math.sqrt(sum(q * (b - stats[f"m_{f}"]) ** 2 for b, q in freq[f].items()))
    width = 0.75 * math.sqrt(p)
    inst = instances.select(*keys, *filled.values()).withColumn("_iid", F.xxhash64(*[F.col(c) for c in keys]))

    def draw(number: int):
        """Uniform on [0, 1) from the instance, the sample and ``number``."""
        return F.pmod(F.xxhash64("_iid", "_s", F.lit(number), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))

    samples = inst.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    cols, zs = [], []
    for j, f in enumerate(features):
        u = draw(2 * j)
        cum, b = 0.0, None
        for bb in sorted(freq[f]):
            cum += freq[f][bb]
            b = F.when(u <= F.lit(cum), F.lit(bb)) if b is None else b.when(u <= F.lit(cum), F.lit(bb))
        b = b.otherwise(F.lit(max(freq[f])))
        lo, hi = (F.element_at(F.create_map(*sum(([F.lit(x), F.lit(float(box[f][x][i]))] for x in box[f]), [])), b)
                  for i in (0, 1))
        val = lo + draw(2 * j + 1) * (hi - lo)
        first = F.col("_s") == 0
        cols.append(F.when(first, F.col(f)).otherwise(val).alias(f))
        zs.append(F.when(first, F.lit(1.0)).otherwise(
            (b == _bin(F.col(f), qs[f])).cast("double")).alias(f"_z{j}"))
    drawn = samples.select(*keys, "_iid", "_s", *cols, *zs)
    scored = model.transform(drawn)
    # Binary rows are standardised with the mean and (population) std of the
    # training bin indices; the regression and the distances use that scale.
    zc, d2 = [], None
    for j, f in enumerate(features):
        mu, sd = float(stats[f"m_{f}"]), float(stats[f"s_{f}"] or 1.0)
        zc.append(((F.col(f"_z{j}") - F.lit(mu)) / F.lit(sd)).alias(f"_z{j}"))
        t = ((F.col(f"_z{j}") - F.lit(1.0)) / F.lit(sd)) ** 2
        d2 = t if d2 is None else d2 + t
    weighted = scored.select(*keys, "prediction",
                             F.sqrt(F.exp(-d2 / F.lit(width * width))).alias("_kw"), *zc)
    # every selection and refit pass must see the same random neighbourhood
    weighted = materialize(weighted)
    zcols = [f"_z{j}" for j in range(p)]
    if selection == "forward":
        chosen = _forward_selection(weighted, keys, features, k)
    else:
        # highest weights: a light ridge, features ranked by |coef * instance value|
        c0 = _weighted_ridge(weighted, keys, zcols, "prediction", "_kw", alpha=0.01)
        inst_z = {f: (1.0 - float(stats[f"m_{f}"])) / float(stats[f"s_{f}"] or 1.0)
                  for f in features}
        long = c0.select(*keys, F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"),
                     (F.col(f"_z{j}") * F.lit(inst_z[f])).alias("weight"))
            for j, f in enumerate(features)])).alias("t")).select(*keys, "t.*")
        chosen = top_k_per_group(long, keys, "weight", k, tie="feature").select(*keys, "feature")
    refit = _refit_selected(weighted, chosen, keys, features)
    cond = _condition(spark, inst, keys, features, qs)
    ranked = top_k_per_group(refit.join(chosen.select(*keys, "feature"), keys + ["feature"]),
                             keys, "weight", k, tie="feature")
    return ranked.join(cond, keys + ["feature"])


def _forward_selection(weighted: DataFrame, keys: list[str], features: list[str], k: int):
    """Greedy forward selection by weighted R^2 of an unpenalised fit.

    Each step scores every remaining candidate per instance (one grouped
    Gram-sum fit per candidate) and keeps the best one per instance.
    """
    from pyspark.sql import Window
    inst = weighted.select(*keys).distinct()
    chosen = None
    for _ in range(min(k, len(features))):
        scores = None
        for f in features:
            cand = inst.withColumn("feature", F.lit(f))
            if chosen is not None:
                cand = cand.join(chosen.groupBy(*keys).agg(F.collect_set("feature").alias("_c")),
                                 keys).filter(~F.array_contains("_c", F.lit(f))).drop("_c")
            trial = cand if chosen is None else chosen.join(cand.select(*keys), keys).unionByName(cand)
            sc = _refit_selected(weighted, trial, keys, features, alpha=0.0, score=True).join(
                cand, keys).select(*keys, "feature", "_r2")
            scores = sc if scores is None else scores.unionByName(sc)
        w = Window.partitionBy(*keys).orderBy(F.col("_r2").desc(), F.col("feature"))
        pick = scores.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1) \
            .select(*keys, "feature")
        chosen = pick if chosen is None else chosen.unionByName(pick)
    return chosen


def _weighted_ridge(df: DataFrame, keys: list[str], xs: list[str], y: str, w: str,
                    alpha: float = LIME_RIDGE) -> DataFrame:
    """Per instance weighted ridge (intercept not penalised) from grouped Gram sums."""
    cols = [F.lit(1.0)] + [F.col(x) for x in xs]
    aggs = []
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            aggs.append(F.sum(F.col(w) * cols[i] * cols[j]).alias(f"a_{i}_{j}"))
        aggs.append(F.sum(F.col(w) * cols[i] * F.col(y)).alias(f"b_{i}"))
    g = df.groupBy(*keys).agg(*aggs)
    m = len(cols)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a = np.zeros((len(f), m, m))
            for i in range(m):
                for j in range(i, m):
                    a[:, i, j] = a[:, j, i] = f[f"a_{i}_{j}"].to_numpy(float)
            a[:, range(1, m), range(1, m)] += alpha
            sol = stacked_solve(a, np.stack([f[f"b_{i}"].to_numpy(float) for i in range(m)], axis=1))
            out = f[keys].copy()
            for i, name in enumerate(["_icpt"] + xs):
                out[name] = sol[:, i]
            yield out

    schema = T.StructType([g.schema[c] for c in keys] + [T.StructField("_icpt", T.DoubleType())]
                          + [T.StructField(x, T.DoubleType()) for x in xs])
    return g.mapInPandas(solve, schema)


def _refit_selected(weighted: DataFrame, chosen: DataFrame, keys: list[str],
                    features: list[str], alpha: float = LIME_RIDGE,
                    score: bool = False) -> DataFrame:
    """Ridge (alpha 1) on the selected features only: other columns are zeroed
    per instance, which leaves their coefficients at 0 under the penalty."""
    sel = chosen.groupBy(*keys).agg(F.collect_set("feature").alias("_sel"))  # <= k per instance
    w = weighted.join(sel, keys)
    zs = [F.when(F.array_contains("_sel", F.lit(f)), F.col(f"_z{j}")).otherwise(F.lit(0.0))
          .alias(f"_z{j}") for j, f in enumerate(features)]
    w = w.select(*keys, "prediction", "_kw", *zs)
    zcols = [f"_z{j}" for j in range(len(features))]
    c2 = _weighted_ridge(w, keys, zcols, "prediction", "_kw", alpha=alpha)
    if score:
        fitted = w.join(c2.select(*keys, "_icpt", *[F.col(z).alias(f"_c{z}") for z in zcols]), keys)
        pred = F.col("_icpt")
        for z in zcols:
            pred = pred + F.col(f"_c{z}") * F.col(z)
        ybar = F.sum(F.col("_kw") * F.col("prediction")) / F.sum("_kw")
        r2 = fitted.groupBy(*keys).agg(
            F.sum(F.col("_kw") * (F.col("prediction") - pred) ** 2).alias("_sse"),
            F.sum(F.col("_kw") * F.col("prediction") ** 2).alias("_syy"),
            ybar.alias("_yb"), F.sum("_kw").alias("_sw"))
        return r2.select(*keys, (1 - F.col("_sse") / (F.col("_syy") - F.col("_sw") * F.col("_yb") ** 2))
                         .alias("_r2"))
    return c2.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"_z{j}").alias("weight"))
        for j, f in enumerate(features)])).alias("t")).select(*keys, "t.*")


def _condition(spark, inst: DataFrame, keys: list[str], features: list[str], qs) -> DataFrame:
    """E5 labels: the instance's quartile bin written as a condition."""
    parts = []
    for f in features:
        q1, q2, q3 = (f"{x:.2f}" for x in qs[f])
        b = _bin(F.col(f), qs[f])
        text = (F.when(b == 0, F.lit(f"{f} <= {q1}")).when(b == 1, F.lit(f"{q1} < {f} <= {q2}"))
                .when(b == 2, F.lit(f"{q2} < {f} <= {q3}")).otherwise(F.lit(f"{f} > {q3}")))
        parts.append(F.struct(F.lit(f).alias("feature"), text.alias("condition")))
    return inst.select(*keys, F.explode(F.array(*parts)).alias("t")).select(*keys, "t.*")


# --------------------------------------------------------------------------- K6
def write_explanations(df: DataFrame, path: str, model_name: str, run_ts: str,
                       fmt: str = "parquet") -> str:
    """K6: explanation tables partitioned by model and run timestamp."""
    (df.withColumn("model", F.lit(model_name)).withColumn("run_ts", F.lit(run_ts))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("model", "run_ts").format(fmt).save(path))
    return path

