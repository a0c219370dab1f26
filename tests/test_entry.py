import os

import __spark_entry__ as E
from cropframe.operators import explain, model
from cropframe.plans import stand_ins


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["year", "state", "district"]
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())


def test_explanation_sink_and_model_persistence(spark, tmp):
    from pyspark.ml import PipelineModel
    from pyspark.sql import functions as F
    li = stand_ins._li(spark, "/root/testdata/sf0.001").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    keys = ["l_orderkey", "l_linenumber"]
    m = model.fit(li, keys, ["l_quantity"], "l_extendedprice")
    path = model.save(m, os.path.join(tmp, "model"))
    again = PipelineModel.load(path)
    a = model.score(m, li).agg(F.sum("prediction")).first()[0]
    b = model.score(again, li).agg(F.sum("prediction")).first()[0]
    assert a == b
    out = explain.write_explanations(model.importance(m, ["l_quantity"]),
                                     os.path.join(tmp, "exp"), "lr", "2026-01-01T00")
    back = spark.read.parquet(out)
    assert back.filter(F.col("model") == "lr").count() == 1


def test_training_job_end_to_end(spark):
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor
    from pyspark.sql import functions as F
    from cropframe.plans import training
    sf = "/root/testdata/sf0.001"
    y, w, s = stand_ins.stand_in_tables(spark, sf)
    row = y.orderBy("state", "county", "year", "crop").limit(1)
    models = {"lr": LinearRegression(labelCol="label"),
              "rf": RandomForestRegressor(labelCol="label", numTrees=5, seed=1)}
    out = training.train_and_explain(spark, y, w, s, folds=2, features=["avg_temp", "gdd", "ph"],
                                     models=models, explain_rows=row)
    assert out["leaderboard"].count() == 2
    assert out["shap_importance"].count() == 3
    assert out["lime"].count() == 3
    sv = out["shap"].groupBy("state", "county", "year", "crop").agg(
        F.sum("shap").alias("s"), F.first("base").alias("b"), F.first("prediction").alias("p"))
    assert sv.agg(F.max(F.abs(F.col("s") + F.col("b") - F.col("p")))).first()[0] < 1e-6


def test_workers_find_the_package_from_any_folder(tmp):
    """A session started elsewhere, without PYTHONPATH, still runs grouped-pandas operators."""
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "import __spark_entry__ as E\nfrom cropframe import get_spark\n"
            f"s = get_spark('elsewhere', cores=2, shuffle_partitions=2, extra={{'spark.checkpoint.dir': {tmp!r}}})\n"
            "print('ROWS', E.queries()['q_kendall'](s, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in out.stdout, out.stderr[-2000:]
