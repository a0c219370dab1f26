"""Regression modelling with MLlib.

* Splits and folds are hashes of the natural key, so they do
  not depend on partitioning or row order, and repeat for the same seed.
* Every fit sees its input as ``repartition(n, key).sortWithinPartitions(key)``
  with n from the number of rows: tree learners then repeat exactly (their
  result depends on the partition layout), and tasks grow with the input.
* Evaluation is one aggregate over a (model, fold, label, prediction) table.
* Linear fits per group (M15) and leverage (M11) use means and centred
  co-moments computed by Spark's one-pass merging aggregates, so large offsets
  do not cancel; only p x p matrices (p = number of features) reach the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import (DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressor,
                                   LinearRegression, RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropframe.session import checkpoint_dir, scratch_path

SEED = 42
ROWS_PER_TASK = 250_000
# The library's default experiment settings.
TRAIN_SHARE = 0.7
DEFAULT_FOLDS = 10
PARALLEL_FITS = 8


# --------------------------------------------------------------------------- M3
def hash_bucket(keys: list[str], seed: int, buckets: int = 100):
    """Deterministic bucket 0..buckets-1 of a row from its natural key.

    The leading 32 bits of an MD5 of the key's text: any engine can repeat the
    split, so its results can be checked outside Spark.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def split(df: DataFrame, keys: list[str], seed: int = SEED, train_share: float = TRAIN_SHARE):
    """M3: (train, test) by a hash of the natural key (Q9: seeded, repeatable)."""
    b = hash_bucket(keys, seed)
    cut = int(round(train_share * 100))
    return df.filter(b < cut), df.filter(b >= cut)


def with_folds(df: DataFrame, keys: list[str], folds: int = DEFAULT_FOLDS, seed: int = SEED,
               out: str = "fold") -> DataFrame:
    return df.withColumn(out, hash_bucket(keys, seed + 1, folds).cast("int"))


def fit_partitions(rows: int) -> int:
    """Tasks of a fit: one per ROWS_PER_TASK rows."""
    return max(1, -(-rows // ROWS_PER_TASK))


def stable_layout(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Partition count from the input's rows and a fixed order, so tree fits repeat exactly."""
    n = n or fit_partitions(df.count())
    return df.repartition(n, *[F.col(k) for k in keys]).sortWithinPartitions(*keys)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used before loops of fits: every fit then reads the checkpoint instead
    of recomputing the input's lineage, and a lost executor recovers from
    the checkpoint files.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class ModeImputer(Estimator, HasInputCols, HasOutputCols):
    """M3: a category's NULL becomes the column's most frequent value (ties: the smallest).

    All columns are counted in one long aggregate; one value a column reaches the
    driver. A column without any value keeps its NULLs.
    """

    def __init__(self, inputCols: list[str], outputCols: list[str]):
        super().__init__()
        self._set(inputCols=inputCols, outputCols=outputCols)

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        cols = self.getInputCols()
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                                             for c in cols])).alias("t")).select("t.*").filter("value is not null")
        counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
        found = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("c"), F.col("value"))).alias("mode")).collect()
        model = ModeImputerModel()
        model._set(inputCols=cols, outputCols=self.getOutputCols(), fills=json.dumps({r["feature"]: r["mode"] for r in found}))
        return model


class ModeImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ``ModeImputer``; saved and read like any other stage."""

    fills = Param(Params._dummy(), "fills", "most frequent value of each column, as JSON", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = json.loads(self.getOrDefault(self.fills))
        return df.withColumns({out: F.coalesce(F.col(c).cast("string"), F.lit(fills.get(c))) for c, out in zip(
            self.getInputCols(), self.getOutputCols(), strict=True)})


def pipeline(estimator, numeric: list[str], categorical: list[str] | None = None,
             features_col: str = "features") -> Pipeline:
    """M3: mean imputation, mode imputation and one-hot categories, assembled vector, estimator."""
    categorical = categorical or []
    stages = []
    num_out = [f"{c}__imp" for c in numeric]
    if numeric:
        stages.append(Imputer(strategy="mean", inputCols=numeric, outputCols=num_out))
    cat_out = []
    if categorical:
        filled, idx = [f"{c}__mode" for c in categorical], [f"{c}__idx" for c in categorical]
        cat_out = [f"{c}__ohe" for c in categorical]
        stages.append(ModeImputer(inputCols=categorical, outputCols=filled))
        stages.append(StringIndexer(inputCols=filled, outputCols=idx, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=cat_out, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=num_out + cat_out, outputCol=features_col,
                                  handleInvalid="keep"))
    stages.append(estimator)
    return Pipeline(stages=stages)


# The compared learners' public default settings.
FOREST_TREES = 100
FOREST_DEPTH = 30          # the deepest that MLlib grows
BOOST_ROUNDS = 100
BOOST_DEPTH = 3
BOOST_STEP = 0.1
ADA_ROUNDS = 50


def estimators(label: str = "label", seed: int = SEED) -> dict:
    """M5-M8: the compared learners with fixed seeds.

    Settings follow the usual library defaults: forest and extra trees of 100
    trees over all features, boosting of 100 depth-3 trees with step 0.1,
    AdaBoost.R2 of 50 depth-3 trees.
    """
    return {
        "lr": LinearRegression(labelCol=label, solver="normal"),
        "rf": RandomForestRegressor(labelCol=label, seed=seed, numTrees=FOREST_TREES,
                                    maxDepth=FOREST_DEPTH, featureSubsetStrategy="all"),
        "gbr": GBTRegressor(labelCol=label, seed=seed, maxIter=BOOST_ROUNDS,
                            maxDepth=BOOST_DEPTH, stepSize=BOOST_STEP),
        "ada": AdaBoostRegressor(labelCol=label, seed=seed, n_estimators=ADA_ROUNDS),
        "et": ExtraTreesRegressor(labelCol=label, seed=seed, n_estimators=FOREST_TREES, max_depth=FOREST_DEPTH),
    }


# --------------------------------------------------------------------------- M9
def metrics(pred: DataFrame, group: list[str], label: str = "label",
            prediction: str = "prediction") -> DataFrame:
    """M9: MAE, MSE, RMSE, R2, RMSLE, MAPE per group in one aggregate.

    RMSLE uses |y| and |y_hat|; MAPE leaves out rows with y = 0.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    g = pred.groupBy(*group).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.sqrt(F.avg(F.pow(F.log1p(F.abs(p)) - F.log1p(F.abs(y)), 2))).alias("rmsle"),
        F.avg(F.try_divide(F.abs(e), F.abs(y))).alias("mape"))
    return g.select(*group, "mae", "mse", F.sqrt("mse").alias("rmse"),
                    (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"),
                    "rmsle", "mape")


def residuals(pred: DataFrame, keys: list[str], label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """Per row label, prediction, residual (the residual/error plots' data)."""
    return pred.select(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction"),
                       (F.col(label) - F.col(prediction)).alias("residual"))


def prediction_error_line(pred: DataFrame, group: list[str], label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Best-fit line of prediction on label (the prediction-error plot)."""
    return pred.groupBy(*group).agg(F.regr_slope(prediction, label).alias("slope"),
                                    F.regr_intercept(prediction, label).alias("intercept"),
                                    F.regr_r2(prediction, label).alias("r2"))


# --------------------------------------------------------------------------- M4
def compare_models(df: DataFrame, keys: list[str], numeric: list[str], label: str,
                   categorical: list[str] | None = None, models: dict | None = None,
                   folds: int = DEFAULT_FOLDS, seed: int = SEED,
                   train_share: float = TRAIN_SHARE, parallelism: int = PARALLEL_FITS):
    """M4: k-fold cross validation of every model -> (leaderboard, predictions).

    Fits of several folds and models run at a time, at most ``parallelism`` of
    them: most jobs of one fit are too small to fill a cluster.

    As in the experiment setup, the folds cover the training split
    (``train_share`` of the rows by key hash); the rest is held out. The
    leaderboard averages fold metrics per model and is ordered by R2 (the
    library's default sort). Out-of-fold predictions of all models form one
    long table (key, model, fold, label, prediction).
    """
    models = models or estimators("label", seed)
    if train_share < 1.0:
        df = split(df, keys, seed, train_share)[0]
    data = with_folds(df.withColumn("label", F.col(label).cast("double"))
                      .filter(F.col("label").isNotNull()), keys, folds, seed)
    # laid out once; a fold's filter keeps the layout, so no fit shuffles its rows again
    data = materialize(stable_layout(materialize(data), keys))
    schema = data.select(*keys, F.lit("").alias("model"), "fold", "label", F.lit(0.0).alias("prediction")).schema

    def one(job: tuple[str, int]) -> str:
        """Fit on the other folds, score the fold, write its rows to the shared folder."""
        name, k = job
        fitted = pipeline(models[name].copy(), numeric, categorical).fit(data.filter(F.col("fold") != k))
        path = scratch_path(df.sparkSession, "fold-predictions")
        fitted.transform(data.filter(F.col("fold") == k)).select(
            *keys, F.lit(name).alias("model"), "fold", "label", "prediction").write.parquet(path)
        return path

    jobs = [(name, k) for name in models for k in range(folds)]
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(jobs)))) as pool:
        paths = list(pool.map(inheritable_thread_target(df.sparkSession)(one), jobs))
    # scored once, read by the leaderboard and the caller
    preds = df.sparkSession.read.schema(schema).parquet(*paths)
    per_fold = metrics(preds, ["model", "fold"])
    board = per_fold.groupBy("model").agg(*[F.avg(c).alias(c) for c in
                                           ("mae", "mse", "rmse", "r2", "rmsle", "mape")])
    return board.orderBy(F.col("r2").desc(), "model"), preds


def fit(df: DataFrame, keys: list[str], numeric: list[str], label: str, estimator=None,
        categorical: list[str] | None = None) -> PipelineModel:
    """Fit one pipeline on a stable layout."""
    est = estimator or LinearRegression(labelCol="label", solver="normal")
    data = stable_layout(df.withColumn("label", F.col(label).cast("double"))
                         .filter(F.col("label").isNotNull()), keys)
    return pipeline(est, numeric, categorical).fit(data)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Batch scoring."""
    return model.transform(df)


def save(model: PipelineModel, path: str) -> str:
    """K7: persist a fitted pipeline."""
    model.write().overwrite().save(path)
    return path


def slot_names(model: PipelineModel, features: list[str], slots: int) -> list[str]:
    """Name of every slot of the assembled vector: a numeric feature, or feature=category."""
    labels: dict[str, list[str]] = {}
    inputs = None
    for stage in model.stages[:-1]:
        if hasattr(stage, "labelsArray"):
            for col, names in zip(stage.getInputCols(), stage.labelsArray, strict=True):
                labels[col.removesuffix("__mode")] = list(names)
        elif type(stage).__name__ == "VectorAssembler":
            inputs = stage.getInputCols()
    out: list[str] = []
    for col in inputs or features:
        base = col.removesuffix("__imp").removesuffix("__ohe")
        if col.endswith("__ohe"):
            # the categories and the slot of unseen ones; the encoder drops the last of all
            out += [f"{base}={v}" for v in labels.get(base, [])] + [f"{base}=(other)"]
        else:
            out.append(base)
    if len(out) != slots:
        raise ValueError(f"{slots} slots, {len(out)} names")
    return out


def importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """Tree importances, or |coefficient| for a linear model -> (feature, importance), a row per slot."""
    spark = SparkSession.getActiveSession()
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        vals = np.abs(last.coefficients.toArray())
    else:
        raise TypeError(f"{type(last).__name__} has no importances")
    rows = [(f, float(v)) for f, v in zip(slot_names(model, features, len(vals)), vals, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature")


# --------------------------------------------------------------------------- M12, M13
def learning_curve(df: DataFrame, keys: list[str], numeric: list[str], label: str,
                   estimator=None, shares=(0.2, 0.4, 0.6, 0.8, 1.0), seed: int = SEED):
    """Fits on nested hash fractions of the training split -> (share, train_r2, test_r2)."""
    spark = df.sparkSession
    train, test = split(materialize(df), keys, seed)
    b = hash_bucket(keys, seed + 2)
    rows = []
    for s in shares:
        part = train.filter(b < int(round(s * 100)))
        m = fit(part, keys, numeric, label, estimator.copy() if estimator else None)
        tr = metrics(m.transform(part.withColumn("label", F.col(label).cast("double"))), [])
        te = metrics(m.transform(test.withColumn("label", F.col(label).cast("double"))), [])
        rows.append((float(s), tr.first()["r2"], te.first()["r2"]))
    return spark.createDataFrame(rows, "share double, train_r2 double, test_r2 double")


def validation_curve(df: DataFrame, keys: list[str], numeric: list[str], label: str,
                     estimator, param: str, values: list, seed: int = SEED):
    """Fits over one hyper-parameter grid -> (value, train_r2, test_r2)."""
    spark = df.sparkSession
    train, test = split(materialize(df), keys, seed)
    rows = []
    for v in values:
        est = estimator.copy({estimator.getParam(param): v})
        m = fit(train, keys, numeric, label, est)
        tr = metrics(m.transform(train.withColumn("label", F.col(label).cast("double"))), [])
        te = metrics(m.transform(test.withColumn("label", F.col(label).cast("double"))), [])
        rows.append((str(v), tr.first()["r2"], te.first()["r2"]))
    return spark.createDataFrame(rows, "value string, train_r2 double, test_r2 double")


# --------------------------------------------------------------------------- M15
def co_moments(df: DataFrame, group: list[str], features: list[str], label: str) -> DataFrame:
    """Per group: n, means and centred co-moments of features and label (one merging aggregate)."""
    cols = [F.col(f).cast("double") for f in features] + [F.col(label).cast("double")]
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull()
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(cols[i], cols[j]).alias(f"c_{i}_{j}")
             for i in range(len(cols)) for j in range(i, len(cols))]
    return df.filter(ok).groupBy(*group).agg(*aggs)


def moment_arrays(f: pd.DataFrame, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, covariances, covariances with the label) of all rows of a co-moment table."""
    means = np.stack([f[f"m_{i}"].to_numpy(float) for i in range(p + 1)], axis=1)
    c = np.zeros((len(f), p + 1, p + 1))
    for i in range(p + 1):
        for j in range(i, p + 1):
            c[:, i, j] = c[:, j, i] = f[f"c_{i}_{j}"].to_numpy(float)
    return means, c[:, :p, :p], c[:, :p, p]


def stacked_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-norm solutions of many symmetric systems at once, on unit diagonals."""
    d = np.sqrt(np.einsum("nii->ni", a))
    d = np.where(d > 0, d, 1.0)
    inverse = np.linalg.pinv(a / (d[:, :, None] * d[:, None, :]), rcond=1e-12, hermitian=True)
    return np.einsum("nij,nj->ni", inverse, b / d) / d


def grouped_ols(df: DataFrame, group: list[str], features: list[str], label: str) -> DataFrame:
    """One least-squares fit per group -> (group..., intercept, coefficient per feature).

    Spark computes the co-moments per group; the small systems are solved in
    stacks, a batch of groups at a time, where the aggregate left them.
    """
    g = co_moments(df, group, features, label)
    p = len(features)
    schema = T.StructType([g.schema[c] for c in group] + [T.StructField("intercept", T.DoubleType())]
                          + [T.StructField(f"b{i}", T.DoubleType()) for i in range(1, p + 1)])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            means, a, b = moment_arrays(f, p)
            coef = stacked_solve(a, b)
            out = f[group].copy()
            out["intercept"] = means[:, p] - np.einsum("ni,ni->n", coef, means[:, :p])
            for i in range(p):
                out[f"b{i + 1}"] = coef[:, i]
            yield out

    return g.mapInPandas(solve, schema).select(
        *group, "intercept", *[F.col(f"b{i}").alias(f) for i, f in enumerate(features, 1)])


def predict_grouped(df: DataFrame, coefs: DataFrame, group: list[str], features: list[str],
                    out: str = "prediction") -> DataFrame:
    """Apply per-group coefficients (the coefficient table has one row per group)."""
    c = coefs.select(*group, F.col("intercept").alias("_b0"),
                     *[F.col(f).alias(f"_b_{f}") for f in features])
    j = df.join(c, group)
    pred = F.col("_b0")
    for f in features:
        pred = pred + F.col(f"_b_{f}") * F.col(f).cast("double")
    return j.withColumn(out, pred).drop("_b0", *[f"_b_{f}" for f in features])


# --------------------------------------------------------------------------- M11
def cooks_distance(df: DataFrame, keys: list[str], features: list[str], label: str) -> DataFrame:
    """Cook's distance of an OLS fit -> (keys, leverage, residual, cooks).

    With centred features z = x - mean and their covariance C,
    h = 1/n + z' C^-1 z / n and D = e^2 / (p s^2) * h / (1 - h)^2; C comes from
    one aggregate, the residual sum of squares from a second one over the
    residuals themselves, so nothing is found by subtracting large sums.
    """
    f = co_moments(df, [], features, label).toPandas()      # one row
    k, n = len(features), int(f["n"][0])
    means, a, b = moment_arrays(f, k)
    coef = stacked_solve(a, b)[0]
    inv = np.linalg.pinv(a[0], hermitian=True)
    z = [F.col(c).cast("double") - F.lit(float(means[0, i])) for i, c in enumerate(features)]
    h = F.lit(1.0 / n)
    for i in range(k):
        for j in range(k):
            h = h + F.lit(float(inv[i, j]) / n) * z[i] * z[j]
    e = F.col(label).cast("double") - F.lit(float(means[0, k]))
    for i in range(k):
        e = e - F.lit(float(coef[i])) * z[i]
    rows = df.select(*keys, h.alias("leverage"), e.alias("residual"))
    s2 = rows.agg(F.sum(F.col("residual") ** 2)).first()[0] / (n - k - 1)
    return rows.withColumn("cooks", F.col("residual") ** 2 / F.lit((k + 1) * s2) * F.col("leverage")
                           / (1 - F.col("leverage")) ** 2)


# --------------------------------------------------------------------------- M8
class AdaBoostRegressor(Estimator):
    """M8: AdaBoost.R2 (linear loss) over weighted MLlib regression trees.

    Each round fits ``DecisionTreeRegressor(weightCol)``, scores every row,
    and updates the weights with one aggregate (max error, weighted mean
    loss). The weighted table is checkpointed every few rounds into the
    shared checkpoint folder so lineage stays short. The ensemble predicts
    the weighted median of the round predictions, computed per row with
    array functions (no Python per row).
    """

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction",
                 n_estimators: int = 50, learning_rate: float = 1.0, max_depth: int = 3,
                 seed: int = SEED, checkpoint_every: int = 5):
        super().__init__()
        self.featuresCol, self.labelCol, self.predictionCol = featuresCol, labelCol, predictionCol
        self.n_estimators, self.learning_rate, self.max_depth = n_estimators, learning_rate, max_depth
        self.seed, self.checkpoint_every = seed, checkpoint_every

    def copy(self, extra=None):
        c = AdaBoostRegressor(self.featuresCol, self.labelCol, self.predictionCol,
                              self.n_estimators, self.learning_rate, self.max_depth, self.seed,
                              self.checkpoint_every)
        for k, v in (extra or {}).items():
            setattr(c, k.name if hasattr(k, "name") else k, v)
        return c

    def getParam(self, name):
        return name

    def _fit(self, df: DataFrame):
        y = F.col(self.labelCol)
        data = materialize(df.select(self.featuresCol, self.labelCol).withColumn("_w", F.lit(1.0)))
        trees, weights = [], []
        for m in range(self.n_estimators):
            dt = DecisionTreeRegressor(featuresCol=self.featuresCol, labelCol=self.labelCol,
                                       weightCol="_w", maxDepth=self.max_depth,
                                       seed=self.seed + m, predictionCol="_p")
            tree = dt.fit(data)
            scored = tree.transform(data).withColumn("_e", F.abs(y - F.col("_p")))
            # one pass: sum(w * e) / (max(e) * sum(w)) is the weighted mean linear loss
            st = scored.agg(F.max("_e").alias("mx"), F.sum("_w").alias("sw"),
                            F.sum(F.col("_w") * F.col("_e")).alias("swe")).first()
            if not st["mx"]:
                trees.append(tree)
                weights.append(1.0)
                break
            loss = F.col("_e") / F.lit(st["mx"])
            avg_loss = st["swe"] / (st["mx"] * st["sw"])
            if avg_loss >= 0.5:
                if not trees:
                    trees.append(tree)
                    weights.append(1.0)
                break
            beta = avg_loss / (1 - avg_loss)
            trees.append(tree)
            weights.append(self.learning_rate * math.log(1 / beta))
            data = scored.select(self.featuresCol, self.labelCol, (
                F.col("_w") * F.pow(F.lit(beta), F.lit(self.learning_rate) * (1 - loss)))
                .alias("_w"))
            if (m + 1) % self.checkpoint_every == 0:
                data = data.checkpoint()
        return AdaBoostModel(trees, weights, self.featuresCol, self.predictionCol)


class _TreesWriter(MLWriter):
    """Saves a tree ensemble: its settings as metadata, each tree beside them."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"ensemble": m.settings()})
        for i, tree in enumerate(m.trees):
            tree.write().overwrite().save(f"{path}/trees/{i}")


class _TreesReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)["ensemble"]
        trees = [DecisionTreeRegressionModel.load(f"{path}/trees/{i}") for i in range(found.pop("n"))]
        return self.cls(trees, **found)


class _TreeEnsemble(Model, MLWritable, MLReadable):
    """A saved and read ensemble of trees."""

    def write(self) -> MLWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreesReader(cls)


class AdaBoostModel(_TreeEnsemble):
    def settings(self) -> dict:
        return {"n": len(self.trees), "weights": [float(w) for w in self.weights],
                "featuresCol": self.featuresCol, "predictionCol": self.predictionCol}

    def __init__(self, trees, weights, featuresCol, predictionCol):
        super().__init__()
        self.trees, self.weights = trees, weights
        self.featuresCol, self.predictionCol = featuresCol, predictionCol

    @property
    def featureImportances(self):
        tot = sum(self.weights)
        acc = None
        for t, w in zip(self.trees, self.weights):
            v = t.featureImportances.toArray() * w / tot
            acc = v if acc is None else acc + v
        from pyspark.ml.linalg import Vectors
        return Vectors.dense(acc)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        cols = []
        for i, t in enumerate(self.trees):
            c = f"_ada_{i}"
            out = t.setPredictionCol(c).transform(out)
            cols.append(c)
        pairs = F.array_sort(F.array(*[
            F.struct(F.col(c).alias("p"), F.lit(float(w)).alias("w"))
            for c, w in zip(cols, self.weights)]))
        half = 0.5 * sum(self.weights)
        cum = F.aggregate(pairs, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("m")),
                          lambda acc, x: F.struct(
                              (acc["s"] + x["w"]).alias("s"),
                              F.when(acc["m"].isNull() & (acc["s"] + x["w"] >= F.lit(half)),
                                     x["p"]).otherwise(acc["m"]).alias("m")))
        return out.withColumn(self.predictionCol, cum["m"]).drop(*cols)


class ExtraTreesRegressor(Estimator):
    """M4 ``et``: extremely randomised trees on MLlib's tree learner.

    Each tree sees all rows with every feature coded by its own ``cuts`` random
    thresholds, drawn evenly between the feature's least and largest value; the
    learner then picks splits among these random thresholds only. The ensemble
    predicts the mean of its trees.
    """

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction",
                 n_estimators: int = 100, max_depth: int = 30, cuts: int = 31, seed: int = SEED):
        super().__init__()
        self.featuresCol, self.labelCol, self.predictionCol = featuresCol, labelCol, predictionCol
        self.n_estimators, self.max_depth, self.cuts, self.seed = n_estimators, max_depth, cuts, seed

    def copy(self, extra=None):
        c = ExtraTreesRegressor(self.featuresCol, self.labelCol, self.predictionCol, self.n_estimators,
                                self.max_depth, self.cuts, self.seed)
        for k, v in (extra or {}).items():
            setattr(c, k.name if hasattr(k, "name") else k, v)
        return c

    def getParam(self, name):
        return name

    def _fit(self, df: DataFrame):
        data = materialize(df.select(vector_to_array(self.featuresCol).alias("_x"), F.col(self.labelCol)))
        width = F.size("_x")
        p = data.select(width.alias("p")).first()
        p = p["p"] if p else 0
        ends = data.agg(*[F.min(F.col("_x")[j]).alias(f"a{j}") for j in range(p)],
                        *[F.max(F.col("_x")[j]).alias(f"b{j}") for j in range(p)]).first()
        trees, cuts = [], []
        for t in range(self.n_estimators):
            rng = np.random.default_rng([self.seed, t])
            cut = [sorted(set(float(v) for v in rng.uniform(ends[f"a{j}"], ends[f"b{j}"], self.cuts))) for j in range(p)]
            coded = data.select(_coded("_x", cut).alias(self.featuresCol), self.labelCol)
            tree = DecisionTreeRegressor(featuresCol=self.featuresCol, labelCol=self.labelCol, maxDepth=self.max_depth,
                                         maxBins=self.cuts + 1, seed=self.seed + t)
            trees.append(tree.fit(coded))
            cuts.append(cut)
        return ExtraTreesModel(trees, cuts, self.featuresCol, self.predictionCol)


def _coded(array_col: str, cuts: list[list[float]]):
    """Vector of how many of its feature's thresholds each value exceeds."""
    def exceeded(j: int, cut: list[float]):
        return F.size(F.filter(F.lit(cut), lambda t: t < F.col(array_col)[j])).cast("double")

    return array_to_vector(F.array(*[exceeded(j, c) if c else F.lit(0.0) for j, c in enumerate(cuts)]))


class ExtraTreesModel(_TreeEnsemble):
    def __init__(self, trees, cuts, featuresCol, predictionCol):
        super().__init__()
        self.trees, self.cuts = trees, cuts
        self.featuresCol, self.predictionCol = featuresCol, predictionCol

    def settings(self) -> dict:
        return {"n": len(self.trees), "cuts": self.cuts, "featuresCol": self.featuresCol,
                "predictionCol": self.predictionCol}

    @property
    def featureImportances(self):
        from pyspark.ml.linalg import Vectors
        return Vectors.dense(np.mean([t.featureImportances.toArray() for t in self.trees], axis=0))

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_et_x", vector_to_array(self.featuresCol))
        cols = []
        for i, (tree, cut) in enumerate(zip(self.trees, self.cuts, strict=True)):
            c = f"_et_{i}"
            coded = out.withColumn("_et_v", _coded("_et_x", cut))
            out = tree.copy().setFeaturesCol("_et_v").setPredictionCol(c).transform(coded).drop("_et_v")
            cols.append(c)
        mean = sum((F.col(c) for c in cols), F.lit(0.0)) / F.lit(float(len(cols)))
        return out.withColumn(self.predictionCol, mean).drop("_et_x", *cols)
