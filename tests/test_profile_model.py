import math

import numpy as np
import pandas as pd
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from cropframe.operators import explain, model, profile, select
from cropframe.sources import driver_table
from helpers import SF_SMALL


def _li(spark):
    return driver_table(spark, SF_SMALL, "lineitem")


def test_exact_quantiles_match_numpy(spark):
    li = _li(spark)
    pdf = li.select("l_quantity", "l_extendedprice").toPandas()
    q = {r["feature"]: r for r in profile.quantiles(li, ["l_quantity", "l_extendedprice"]).collect()}
    for c in ("l_quantity", "l_extendedprice"):
        v = pdf[c].to_numpy()
        for name, p in (("p05", 5), ("p25", 25), ("p50", 50), ("p75", 75), ("p95", 95)):
            assert math.isclose(q[c][name], np.percentile(v, p), rel_tol=1e-12)
        med = np.median(v)
        assert math.isclose(q[c]["mad"], np.median(np.abs(v - med)), rel_tol=1e-12)


def test_exact_quantiles_over_many_sorted_partitions(spark, monkeypatch):
    monkeypatch.setattr(profile, "SORT_VALUES", 300)
    li = _li(spark)
    pdf = li.select("l_extendedprice").toPandas()
    q = profile.quantiles(li, ["l_extendedprice"]).first()
    v = pdf["l_extendedprice"].to_numpy()
    for name, p in (("p05", 5), ("p50", 50), ("p95", 95)):
        assert math.isclose(q[name], np.percentile(v, p), rel_tol=1e-12)


def test_profile_tells_large_integers_apart_and_takes_nan_as_missing(spark):
    df = spark.createDataFrame([(2 ** 53, 1.0), (2 ** 53 + 1, float("nan")), (5, None), (5, 3.0)], "k long, v double")
    got = {r["feature"]: r for r in profile.numeric_profile(df).collect()}
    assert got["k"]["distinct"] == 3 and got["k"]["missing"] == 0
    assert got["v"]["mean"] == 2.0 and got["v"]["missing"] == 2 and got["v"]["distinct"] == 2
    over = {r["metric"]: r["value"] for r in profile.overview(df).collect()}
    assert over["rows"] == 4 and over["missing_cells"] == 2 and over["duplicate_rows"] == 0
    assert profile.quantiles(df, ["v"]).first()["p50"] == 2.0


def test_average_rank_matches_pandas(spark, monkeypatch):
    monkeypatch.setattr(profile, "SORT_VALUES", 500)
    li = _li(spark)
    got = profile.average_rank(li, "l_extendedprice").toPandas()
    pdf = li.select("l_extendedprice").toPandas()
    want = pdf.assign(r=pdf["l_extendedprice"].rank(method="average")).drop_duplicates(
        "l_extendedprice").set_index("l_extendedprice")["r"]
    got = got.set_index("l_extendedprice")["rank"]
    assert np.allclose(got.sort_index().to_numpy(), want.sort_index().to_numpy())


def test_spearman_matches_pandas(spark):
    li = _li(spark)
    r = profile.spearman_pair(li, "l_quantity", "l_extendedprice").first()["r"]
    pdf = li.select("l_quantity", "l_extendedprice").toPandas()
    assert math.isclose(r, pdf.corr(method="spearman").iloc[0, 1], rel_tol=1e-9)


def _kendall_brute(x, y):
    n = len(x)
    dx = np.sign(x[:, None] - x[None, :])
    dy = np.sign(y[:, None] - y[None, :])
    s = (dx * dy)[np.triu_indices(n, 1)].sum()
    n0 = n * (n - 1) / 2
    tx = sum(c * (c - 1) / 2 for c in pd.Series(x).value_counts())
    ty = sum(c * (c - 1) / 2 for c in pd.Series(y).value_counts())
    return s / math.sqrt((n0 - tx) * (n0 - ty))


def test_kendall_exact_with_grid(spark):
    li = _li(spark).limit(1500)
    pdf = li.select("l_quantity", "l_discount").toPandas()
    want = _kendall_brute(pdf["l_quantity"].to_numpy(), pdf["l_discount"].to_numpy())
    sdf = spark.createDataFrame(pdf)
    got = profile.kendall_pair(sdf, "l_quantity", "l_discount", buckets=4).first()["tau"]
    assert math.isclose(got, want, rel_tol=1e-9)


def test_kendall_bounds_its_groups_under_a_few_hot_values(spark, monkeypatch):
    sdf = _li(spark).select("l_linenumber", "l_extendedprice")
    pdf = sdf.toPandas()
    pts = sdf.select(F.col("l_linenumber").cast("double").alias("x"), F.col("l_extendedprice").alias("y")).groupBy(
        "x", "y").agg(F.count(F.lit(1)).alias("c"))
    m = pts.count()
    sx, sy = profile._edges(pts, "x", 32), profile._edges(pts, "y", 32)
    # seven values: each has a bucket of its own, so all x groups are ties and are skipped
    assert {float(v) for v in pdf["l_linenumber"].unique()} <= set(sx)
    per_bucket = np.histogram(pts.toPandas()["y"], bins=[-1e18] + sy[1:-1] + [1e18])[0]
    assert per_bucket.max() <= 3 * m / 32
    monkeypatch.setattr(profile, "KENDALL_CELLS", 600)      # cells settled by the same method again
    got = profile.kendall_pair(sdf, "l_linenumber", "l_extendedprice", buckets=128).first()["tau"]
    want = _kendall_brute(pdf["l_linenumber"].to_numpy(), pdf["l_extendedprice"].to_numpy())
    assert math.isclose(got, want, rel_tol=1e-9)


def test_chi_square_yates_2x2(spark):
    # 2 x 2 table [[10, 20], [30, 5]]: Yates-corrected chi2 computed by hand
    data = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5
    df = spark.createDataFrame(data, "u string, v string")
    got = profile.chi_square(df, "u", "v").first()
    o = np.array([[10, 20], [30, 5]], float)
    e = o.sum(1)[:, None] * o.sum(0)[None, :] / o.sum()
    want = (((np.abs(o - e) - 0.5) ** 2) / e).sum()
    assert math.isclose(got["chi2"], want, rel_tol=1e-12) and got["dof"] == 1


def test_grouped_ols_and_cooks(spark):
    li = _li(spark).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax",
                           "l_extendedprice").withColumn("g", F.lit(1))
    pdf = li.toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf["l_quantity"], pdf["l_tax"]])
    beta = np.linalg.lstsq(X, pdf["l_extendedprice"].to_numpy(), rcond=None)[0]
    c = model.grouped_ols(li, ["g"], ["l_quantity", "l_tax"], "l_extendedprice").first()
    assert np.allclose([c["intercept"], c["l_quantity"], c["l_tax"]], beta, rtol=1e-8)
    cd = model.cooks_distance(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"],
                              "l_extendedprice").toPandas()
    h = np.einsum("ij,jk,ik->i", X, np.linalg.inv(X.T @ X), X)
    assert np.allclose(np.sort(cd["leverage"]), np.sort(h), rtol=1e-6)


def test_shap_matches_linear_closed_form(spark):
    li = _li(spark).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax",
                           "l_extendedprice").limit(200)
    keys, feats = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"]
    m = model.fit(li, keys, feats, "l_extendedprice", LinearRegression(labelCol="label"))
    bg = explain.background_sample(li, keys, feats, n=20)
    sv = explain.shap_values(m, li, keys, feats, background=bg)
    lr = m.stages[-1]
    means = {f: v for f, v in zip(feats, bg.agg(*[F.avg(f) for f in feats]).first())}
    closed = explain.linear_shap(li, keys, dict(zip(feats, lr.coefficients.toArray())),
                                 lr.intercept, means)
    a = sv.join(closed.select(*keys, "feature", F.col("shap").alias("c")), keys + ["feature"])
    assert a.count() == 400
    assert a.agg(F.max(F.abs(F.col("shap") - F.col("c")))).first()[0] < 1e-6
    tot = sv.groupBy(*keys).agg(F.sum("shap").alias("s"), F.first("base").alias("b"),
                                F.first("prediction").alias("p"))
    assert tot.agg(F.max(F.abs(F.col("s") + F.col("b") - F.col("p")))).first()[0] < 1e-6


def test_models_beat_mean_and_repeat(spark):
    li = _li(spark).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax",
                           "l_extendedprice")
    keys, feats = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"]
    est = model.AdaBoostRegressor(labelCol="label", n_estimators=4)
    m1 = model.fit(li, keys, feats, "l_extendedprice", est)
    p1 = model.metrics(m1.transform(li.withColumn("label", F.col("l_extendedprice"))), [])
    assert p1.first()["r2"] > 0.0
    m2 = model.fit(li, keys, feats, "l_extendedprice", est.copy())
    p2 = model.metrics(m2.transform(li.withColumn("label", F.col("l_extendedprice"))), [])
    assert p1.first()["mse"] == p2.first()["mse"]


def test_mutual_information_ranks_price_driver(spark):
    li = _li(spark)
    mi = select.mutual_information(li, ["l_quantity", "l_tax"], "l_extendedprice").collect()
    assert mi[0]["feature"] == "l_quantity" and mi[0]["relevance"] > mi[1]["relevance"]


def test_lime_top_k(spark):
    li = _li(spark).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount",
                           "l_extendedprice")
    keys, feats = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax", "l_discount"]
    m = model.fit(li, keys, feats, "l_extendedprice")
    one = li.orderBy(*keys).limit(1)
    out = explain.lime(m, li, one, keys, feats, n_samples=500, k=2).collect()
    assert len(out) == 2 and out[0]["feature"] == "l_quantity" or out[1]["feature"] == "l_quantity"


def test_profile_report_all_tables(spark):
    part = driver_table(spark, SF_SMALL, "part").select("p_size", "p_retailprice", "p_brand",
                                                        "p_type")
    rep = profile.report(part)
    assert {"overview", "numeric", "quantiles", "histogram", "categories", "top_values",
            "pearson", "spearman", "kendall", "cramers", "auto", "missing", "missing_pairs",
            "alerts"} <= set(rep)
    assert rep["numeric"].count() == 2 and rep["auto"].count() == 6


def test_fit_tasks_grow_with_the_input(spark):
    assert [model.fit_partitions(n) for n in (0, 10, 250_000, 250_001, 10 ** 9)] == [1, 1, 1, 2, 4000]
    df = spark.range(1000).withColumn("label", F.rand(1))
    assert model.stable_layout(df, ["id"], 3).rdd.getNumPartitions() == 3


def test_ols_and_cooks_survive_large_offsets(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300) + 1e9
    y = 3 * (x - 1e9) + 5 + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([(i, float(a), float(b), i % 2) for i, (a, b) in enumerate(zip(x, y))],
                               "id long, x double, y double, g int")
    got = {r["g"]: r["x"] for r in model.grouped_ols(df, ["g"], ["x"], "y").collect()}
    for g in (0, 1):
        z = x[g::2] - 1e9
        want = np.polyfit(z, y[g::2], 1)[0]
        assert math.isclose(got[g], want, rel_tol=1e-6)
    cd = model.cooks_distance(df, ["id"], ["x"], "y").toPandas().set_index("id").sort_index()
    X = np.column_stack([np.ones(300), x - 1e9])
    h = np.einsum("ij,jk,ik->i", X, np.linalg.inv(X.T @ X), X)
    e = y - X @ np.linalg.lstsq(X, y, rcond=None)[0]
    d = e ** 2 / (2 * (e @ e) / 298) * h / (1 - h) ** 2
    assert np.allclose(cd["cooks"], d, rtol=1e-4)


def test_every_ensemble_can_be_saved_and_read(spark, tmp):
    import os
    from pyspark.ml import PipelineModel
    li = _li(spark).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax",
                           (10 * F.col("l_quantity") + F.col("l_tax")).alias("l_extendedprice"))
    keys, feats = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"]
    for name, est in (("ada", model.AdaBoostRegressor(n_estimators=3)),
                      ("et", model.ExtraTreesRegressor(n_estimators=3, max_depth=6))):
        m = model.fit(li, keys, feats, "l_extendedprice", est)
        again = PipelineModel.load(model.save(m, os.path.join(tmp, name)))
        a = model.score(m, li).agg(F.sum("prediction")).first()[0]
        assert a == model.score(again, li).agg(F.sum("prediction")).first()[0]
        r2 = model.metrics(model.score(again, li).withColumn("label", F.col("l_extendedprice")), []).first()["r2"]
        assert r2 > 0.8


def test_importance_names_every_slot(spark):
    li = _li(spark).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_extendedprice")
    m = model.fit(li, ["l_orderkey", "l_linenumber"], ["l_quantity"], "l_extendedprice", categorical=["l_returnflag"])
    names = {r["feature"] for r in model.importance(m, ["l_quantity"]).collect()}
    flags = {f"l_returnflag={r[0]}" for r in li.select("l_returnflag").distinct().collect()}
    assert "l_quantity" in names and flags <= names
    assert len(names) == len(m.stages[-1].coefficients)


def test_lime_does_not_depend_on_the_layout_and_imputes(spark):
    li = _li(spark).select("l_orderkey", "l_linenumber", "l_quantity",
                           F.when(F.col("l_linenumber") < 6, F.col("l_tax")).alias("l_tax"), "l_extendedprice")
    keys, feats = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"]
    m = model.fit(li, keys, feats, "l_extendedprice")
    inst = li.orderBy(F.col("l_linenumber").desc(), "l_orderkey").limit(3)
    run = lambda n: sorted(map(tuple, explain.lime(m, li, inst.repartition(n), keys, feats, n_samples=300)
                               .select(*keys, "feature", "condition", F.round("weight", 6)).collect()))
    assert run(1) == run(3)


def test_linear_shapley_values_add_up(spark):
    li = _li(spark).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice").dropDuplicates(
        ["l_orderkey", "l_linenumber"])
    keys, feats = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"]
    m = model.fit(li, keys, feats, "l_extendedprice")
    sv = explain.shap_values(m, li, keys, feats)
    got = sv.groupBy(*keys).agg((F.sum("shap") + F.first("base")).alias("s")).join(model.score(m, li), keys)
    assert got.agg(F.max(F.abs(F.col("s") - F.col("prediction")))).first()[0] < 1e-6
