"""Tree Shapley values, nearest-neighbour information, phi_k, regional trees and rank matrices against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

from cropframe.operators import explain, knn_mi, model, phik, profile, regional

KEYS = ["k"]
FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.c_[rng.normal(size=(160, 2)), rng.integers(0, 4, size=(160, 2))]
    y = x[:, 0] * x[:, 1] + np.where(x[:, 2] > 1, x[:, 0], -x[:, 3]) + rng.normal(size=160) / 9
    out = [(i, *[None if rng.random() < 0.06 else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return model.materialize(spark.createDataFrame(out, "k long, a double, b double, c double, d double, y double"))


@pytest.mark.parametrize("name", ["rf", "gbr", "dt", "et"])
def test_tree_shap_equals_all_coalitions(rows, name):
    est = {"rf": RandomForestRegressor(labelCol="label", numTrees=7, maxDepth=6, seed=1, featureSubsetStrategy="all"),
           "gbr": GBTRegressor(labelCol="label", maxIter=6, maxDepth=3, stepSize=0.3, seed=1),
           "dt": DecisionTreeRegressor(labelCol="label", maxDepth=7, seed=1),
           "et": model.ExtraTreesRegressor(labelCol="label", n_estimators=4, max_depth=5)}[name]
    fitted = model.fit(rows, KEYS, FEATURES, "y", est)
    some = rows.filter("k < 40")
    kw = {"background": rows, "background_rows": 12}
    tree = explain.shap_values(fitted, some, KEYS, FEATURES, engine="tree", **kw).toPandas()
    every = explain.shap_values(fitted, some, KEYS, FEATURES, engine="coalition", **kw).toPandas()
    both = tree.merge(every, on=["k", "feature"], suffixes=("", "_e"))
    assert len(both) == len(tree) == len(every) == 160
    for c in ("shap", "base", "prediction"):
        assert np.abs(both[c] - both[c + "_e"]).max() < 1e-6
    total = tree.groupby("k").agg({"shap": "sum", "base": "first", "prediction": "first"})
    assert np.abs(total["shap"] + total["base"] - total["prediction"]).max() < 1e-9
    want = fitted.transform(some).select("k", "prediction").toPandas().set_index("k")["prediction"]
    assert np.abs(total["prediction"] - want).max() < 1e-9


def test_engines_are_chosen_by_name(rows):
    fitted = model.fit(rows, KEYS, FEATURES, "y", model.AdaBoostRegressor(labelCol="label", n_estimators=2))
    with pytest.raises(ValueError):
        explain.shap_values(fitted, rows, KEYS, FEATURES, engine="tree")
    with pytest.raises(ValueError):
        explain.shap_values(fitted, rows, KEYS, FEATURES, engine="linear")
    with pytest.raises(ValueError, match="permutations"):
        explain._shapley_plan(20, 1, None)
    weights = {}
    for i, _, w in explain._shapley_plan(20, 1, 5):
        weights[i] = weights.get(i, 0) + w
    assert all(abs(w - 1) < 1e-9 for w in weights.values()) and len(weights) == 20


def brute_mi(x, y, k):
    """The estimate by comparing every row with every other one."""
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    n = len(x)
    cut = lambda v: np.floor((v - v.min()) / float(f"{v.std():.9e}") * 2.0 ** 30).astype(np.int64) if v.std() else np.zeros(n, int)
    x, y = cut(x), cut(y)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.iinfo(np.int64).max)
    r = np.maximum(np.sort(d, axis=1)[:, k - 1], 1)[:, None]
    nx, ny = (dx < r).sum(axis=1), (dy < r).sum(axis=1)
    return max(0.0, psi(n) + psi(k) - np.mean([psi(a) + psi(b) for a, b in zip(nx, ny, strict=True)]))


def test_nearest_neighbour_information(spark):
    rng = np.random.default_rng(3)
    n = 600
    y = rng.normal(size=n).round(2)
    data = pd.DataFrame({"line": y + rng.normal(size=n) / 9, "round": rng.integers(0, 3, n).astype(float),
                         "copy": y, "heavy": np.where(rng.random(n) < 0.4, 0.0, rng.pareto(0.6, n)), "flat": 1.0, "y": y})
    data.loc[data.index[:150], "y"] = 0.5        # a hot value of the target
    df = spark.createDataFrame(data)
    features = ["line", "round", "copy", "heavy", "flat"]
    for cells, sample in ((16, 1 << 17), (8, 60), (4096, 1 << 17)):
        got = {r["feature"]: r["relevance"] for r in knn_mi.knn_mutual_information(
            df, features, "y", cell_points=cells, sample=sample).collect()}
        for f in features:
            assert abs(got[f] - brute_mi(data[f].to_numpy(), data["y"].to_numpy(), 3)) < 1e-9, (f, cells)
    few = df.limit(3).withColumn("y", df["y"])
    assert {r["relevance"] for r in knn_mi.knn_mutual_information(few, ["line"], "y").collect()} == {None}


def test_grid_finds_every_cell_that_a_box_meets():
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 500, 3000), rng.integers(0, 400, 3000) ** 2
    grid = knn_mi.Grid(x[::3], y[::3], np.ones(1000, dtype=np.int64), 60)
    cell = grid.cell(x, y)
    r = rng.integers(0, 60, 3000)
    rows, met = grid.reached(x, y, r)
    found = {k: set() for k in range(3000)}
    for i, c in zip(rows.tolist(), met.tolist(), strict=True):
        found[i].add(c)
    for i in range(0, 3000, 7):
        near = np.maximum(np.abs(x - x[i]), np.abs(y - y[i])) <= r[i]
        assert set(cell[near].tolist()) - {cell[i]} <= found[i] and cell[i] not in found[i]
    none = np.zeros(0, dtype=np.int64)
    assert [len(v) for v in grid.reached(none, none, none)] == [0, 0] and len(grid.cell(none, none)) == 0


def test_digamma(spark):
    from pyspark.sql import functions as F
    got = spark.range(1, 400).select("id", knn_mi.digamma(F.col("id")).alias("p")).collect()
    for r in got:
        assert abs(r["p"] - (-0.5772156649015329 + sum(1 / i for i in range(1, r["id"])))) < 1e-11


def test_normal_table_by_adding_up_its_density():
    t = phik.NormalTable(4, 5)
    rho, step = 0.6, 0.02
    g = np.arange(-8, 8, step) + step / 2
    density = np.exp(-(g[:, None] ** 2 + g ** 2 - 2 * rho * g[:, None] * g) / (2 * (1 - rho ** 2))) / (2 * np.pi * np.sqrt(1 - rho ** 2))
    ix, iy = np.searchsorted(t.x, g), np.searchsorted(t.y, g)
    p = np.zeros((4, 5))
    np.add.at(p, (ix[:, None] + 0 * iy, iy + 0 * ix[:, None]), density * step * step)
    d = np.pad(t.excess(rho), 1)
    cell = d[1:, 1:] - d[:-1, 1:] - d[1:, :-1] + d[:-1, :-1] + np.outer(t.px, t.py)
    assert np.abs(p - cell).max() < 1e-4
    one = np.pad(t.excess(1.0), 1) - np.pad(t.excess(1 - 1e-9), 1)
    assert np.abs(one).max() < 1e-3


def test_phik_of_normal_samples_is_their_correlation(spark):
    rng = np.random.default_rng(8)
    n = 40_000
    a, e = rng.normal(size=n), rng.normal(size=n)
    for rho in (0.0, 0.5, 0.9):
        b = rho * a + math.sqrt(1 - rho ** 2) * e
        df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
        clipped = df.selectExpr("greatest(-5, least(5, a)) a", "greatest(-5, least(5, b)) b").unionByName(
            spark.createDataFrame([(-5.0, 0.0), (5.0, 0.0), (0.0, -5.0), (0.0, 5.0)], "a double, b double"))
        got = phik.phik_matrix(clipped, ["a", "b"]).first()["phik"]
        assert abs(got - rho) < 0.06, (rho, got)
    mixed = spark.createDataFrame([(float(i % 4), "abcd"[i % 4], None if i % 9 else "x") for i in range(400)], "u double, v string, w string")
    found = {(r["x"], r["y"]): r["phik"] for r in phik.phik_matrix(mixed, ["u"], ["v", "w"]).collect()}
    assert found[("u", "v")] == 1.0 and found[("u", "w")] is None


def grown(x, y, depth, bins, node=1):
    """A regression tree by trying every quantile edge."""
    out = {node: (len(y), y.mean(), None, None)}
    if depth:
        best = None
        for j, edges in enumerate(bins):
            for t in sorted(set(edges)):
                left = x[:, j] <= t
                if left.any() and not left.all():
                    gain = left.sum() * (~left).sum() / len(y) * (y[left].mean() - y[~left].mean()) ** 2
                    if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-12)):
                        best = (gain, j, t, left)
        if best:
            _, j, t, left = best
            out[node] = (len(y), y.mean(), j, t)
            out |= grown(x[left], y[left], depth - 1, bins, 2 * node) | grown(x[~left], y[~left], depth - 1, bins, 2 * node + 1)
    return out


def test_regional_trees(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"g": rng.choice(["n", "s", "hot"], 500, p=[0.2, 0.1, 0.7]), "a": rng.normal(size=500),
                         "b": rng.integers(0, 5, 500).astype(float)})
    data["y"] = np.where(data.a > 0.3, data.b, -data.a) + (data.g == "s") * data.b
    df = spark.createDataFrame(data)
    nodes = regional.grouped_trees(df, ["g"], ["a", "b"], "y", max_depth=3, bins=6)
    got = {(r["g"], r["node"]): r for r in nodes.collect()}
    bins = [np.quantile(data[f], np.arange(1, 6) / 6).tolist() for f in ("a", "b")]
    want = {}
    for g, part in data.groupby("g"):
        want |= {(g, k): v for k, v in grown(part[["a", "b"]].to_numpy(), part["y"].to_numpy(), 3, bins).items()}
    assert got.keys() == want.keys()
    for k, (n, p, j, t) in want.items():
        r = got[k]
        assert r["n"] == n and abs(r["prediction"] - p) < 1e-9
        assert r["feature"] == (None if j is None else "ab"[j]), k
        if j is not None:   # thresholds between the same two values send the same rows left
            x = data[data.g == k[0]][r["feature"]]
            assert ((x <= r["threshold"]) == (x <= t)).all()
    odd = df.unionByName(spark.createDataFrame([("n", None, float("nan"), 1.0), ("new", 1.0, 1.0, 2.0), ("n", 1.0, 1.0, None)], df.schema))
    scored = regional.predict_trees(odd, nodes, ["g"], ["a", "b"]).toPandas()
    assert len(scored) == 503 and scored[scored.g == "new"]["prediction"].isna().all()
    for _, r in scored[scored.g != "new"].iterrows():
        node = 1
        while want[(r.g, node)][2] is not None:
            v, t = (r.a, r.b)[want[(r.g, node)][2]], got[(r.g, node)]["threshold"]
            node = 2 * node + (0 if v <= t else 1)
        assert abs(r.prediction - want[(r.g, node)][1]) < 1e-9
    assert regional.grouped_trees(df.limit(0), ["g"], ["a"], "y", edges={"a": [0.0]}).count() == 0


def test_rank_matrix_with_nulls_and_nan(spark):
    rng = random.Random(4)
    rows = [tuple(None if rng.random() < 0.2 else rng.choice([float("nan"), 1.0, 2.5, -3.0, 7.0, rng.random()]) for _ in range(4))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumn("e", (profile.F.col("a") * 0 + 1))
    want = df.toPandas().astype(float).corr(method="spearman")
    for r in profile.spearman(df).collect():
        v = want.loc[r["x"], r["y"]]
        assert (r["r"] is None and np.isnan(v)) or abs(r["r"] - v) < 1e-9, r
    pearson = df.toPandas().astype(float).corr()
    for r in profile.pearson(df, ["a", "b", "c", "d"]).collect():
        assert abs(r["r"] - pearson.loc[r["x"], r["y"]]) < 1e-9
    per_col = {r["feature"]: r["missing"] for r in profile.nullity(df)[0].collect()}
    assert per_col["a"] == int(df.toPandas()["a"].isna().sum())


def test_pair_tables_read_the_input_once(spark, tmp):
    spark.range(300).selectExpr("id % 3 a", "id % 4 b", "cast(id % 5 as double) c", "cast(id as string) d").write.parquet(f"{tmp}/t")
    df = spark.read.parquet(f"{tmp}/t")
    got = profile.pair_cells(df, [("a", "b"), ("a", "c"), ("c", "d")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Window" not in plan
    cells = {(r["pair"], r["xv"], r["yv"]): r["count"] for r in got.collect()}
    assert sum(v for k, v in cells.items() if k[0] == 0) == 300 and len([k for k in cells if k[0] == 0]) == 12


def test_sketches_of_partitions_merge_to_the_whole(spark, tmp):
    from cropframe.operators import sketch
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"g": rng.integers(0, 5, 20_000), "v": rng.pareto(1.5, 20_000), "w": rng.integers(0, 300, 20_000).astype(float)})
    data.loc[::50, "v"] = np.nan
    df = spark.createDataFrame(data)
    path = sketch.write_sketches(sketch.column_sketches(df, ["g"]), f"{tmp}/s", ["g"])
    changed = df.withColumn("w", profile.F.when(df["g"] == 2, -df["w"]).otherwise(df["w"]))
    sketch.refresh_sketches(changed, spark.createDataFrame([(2,)], "g int"), path, ["g"])
    got = {r["feature"]: r for r in sketch.merged_profile(spark.read.parquet(path)).collect()}
    data["w"] = np.where(data.g == 2, -data.w, data.w)
    for c in ("v", "w"):
        x = data[c].dropna()
        r = got[c]
        assert r["count"] == len(x) and r["missing"] == 20_000 - len(x) and r["min"] == x.min() and r["max"] == x.max()
        assert abs(r["mean"] - x.mean()) < 1e-9 * abs(x).mean() + 1e-12
        assert abs(r["distinct"] - x.nunique()) <= 0.06 * x.nunique()
        for p in (5, 25, 50, 75, 95):
            assert (x < r[f"p{p:02d}"]).mean() - 0.02 <= p / 100 <= (x <= r[f"p{p:02d}"]).mean() + 0.02


def test_normal_quantile_and_truncated_draws(spark):
    from statistics import NormalDist
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.0749, 0.3, 0.5, 0.500001, 0.925, 0.93, 0.9999, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", explain.normal_quantile(profile.F.col("p")).alias("z"))
    for r in got.collect():
        want = NormalDist().inv_cdf(r["p"])
        assert abs(r["z"] - want) <= 1e-13 * max(1, abs(want))
    edge = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(explain.normal_quantile(profile.F.col("p")).alias("z"))
    assert [r["z"] for r in edge.collect()] == [None] * 3
    mean, sd, low, high, a, b = explain._truncated(1.0, 2.0, 0.0, 5.0)
    n = 20_000
    u = profile.F.pmod(profile.F.xxhash64("id"), profile.F.lit(1 << 53)) / float(1 << 53)
    z = explain.normal_quantile(profile.F.lit(a) + u * (b - a))
    x = np.array([r[0] for r in spark.range(n).select(mean + sd * z).collect()])
    assert low <= x.min() and x.max() <= high
    d = NormalDist(mean, sd)
    for t in (0.5, 1.0, 2.0, 3.5):      # the distribution of a normal cut to (0, 5)
        assert abs((x <= t).mean() - (d.cdf(t) - d.cdf(low)) / (d.cdf(high) - d.cdf(low))) < 0.015


def test_mode_imputation_in_a_saved_pipeline(spark, tmp):
    rows = [(i, "b" if i % 3 else None, "x" if i % 2 else "y", float(i % 5), float(i % 3) + (i % 2)) for i in range(60)] + [
        (100, "a", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, c string, d string, v double, y double").withColumn("e", profile.F.lit(None).cast("string"))
    fitted = model.ModeImputer(["c", "d", "e"], ["c2", "d2", "e2"]).fit(df)
    got = {(r["c"], r["c2"], r["d2"], r["e2"]) for r in fitted.transform(df).collect()}
    assert got == {("b", "b", "x", None), ("b", "b", "y", None), (None, "b", "x", None), (None, "b", "y", None), ("a", "a", "x", None)}
    m = model.fit(df, ["k"], ["v"], "y", categorical=["c", "d"])
    path = model.save(m, f"{tmp}/m")
    again = type(m).load(path)
    a = {r["k"]: r["prediction"] for r in model.score(m, df).collect()}
    b = {r["k"]: r["prediction"] for r in model.score(again, df).collect()}
    assert a == b and len(a) == 61
    names = [r["feature"] for r in model.importance(m, ["v"]).collect()]
    assert "c=b" in names and "d=x" in names


def test_rank_matrix_grows_with_the_columns_not_their_null_patterns(spark, monkeypatch):
    rng = random.Random(11)
    # a value or none in each of six columns: most of the 64 null patterns occur
    rows = [tuple(None if rng.random() < 0.4 else float(rng.choice([rng.randrange(5), rng.random()])) for _ in range(6))
            for _ in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    plans = [len(profile.spearman(d)._jdf.queryExecution().optimizedPlan().toString()) for d in (df.fillna(0.5), df)]
    assert plans[1] < 1.2 * plans[0]
    want = df.toPandas().corr(method="spearman")
    for cells in (profile.RANK_CELLS, 0):       # all columns by broadcast; all by shuffle, rows without a value too
        monkeypatch.setattr(profile, "RANK_CELLS", cells)
        got = profile.spearman(df)
        assert len(got.collect()) == 15
        for r in got.collect():
            assert abs(r["r"] - want.loc[r["x"], r["y"]]) < 1e-9, r


def test_rank_matrix_of_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, None, 1.0), (3.0, None, None)], "a double, b double, c double")
    assert {(r["x"], r["y"]): r["r"] for r in profile.spearman(df).collect()} == {
        ("a", "b"): None, ("a", "c"): -1.0, ("b", "c"): None}
    assert [r["r"] for r in profile.spearman(df.select("b", profile.F.col("b").alias("d"))).collect()] == [None]
    assert [r["r"] for r in profile.spearman(df.limit(0)).collect()] == [None] * 3


def test_rank_matrix_stores_a_column_of_many_values_once(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.2 else float(rng.randrange(5)),
             rng.choice([0.0, float("nan"), float(i), i / 7, rng.random(), rng.random()]),
             None if rng.random() < 0.3 else float(rng.randrange(7)), None if rng.random() < 0.3 else rng.random() - i / 900)
            for i in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    stored, write = [], profile._stored
    monkeypatch.setattr(profile, "_stored", lambda d, name, by=None: stored.append((name, out := write(d, name, by))) or out)
    monkeypatch.setattr(profile, "RANK_CELLS", 100)     # a and c meet the rows by broadcast, b and d do not
    monkeypatch.setattr(profile, "SORT_VALUES", 50)
    pdf = df.toPandas()
    want = pdf.corr(method="spearman")
    for cols in (["a", "b", "c"], ["b", "c"], ["c", "a"], ["a", "b", "c", "d"]):
        stored.clear()
        got = profile.spearman(df, cols).collect()
        assert len(got) == len(cols) * (len(cols) - 1) // 2
        for r in got:
            assert abs(r["r"] - want.loc[r["x"], r["y"]]) < 1e-9, r
        if len(cols) < 4:
            values = sum(d.count() for name, d in stored if name != "rows")
            assert values <= sum(pdf[c].nunique() for c in cols)
