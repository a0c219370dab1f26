"""E-3: frame -> ranking -> model comparison -> explanations, one job.

The frame is written once to the shared checkpoint folder and read back,
because ranking, every fold fit and the explanations all rescan it; a
written table also cuts the lineage, so a lost executor recomputes from
that table, not from the raw inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cropframe.operators import explain, frame, model, select
from cropframe.session import scratch_path

KEY = ["state", "county", "year", "crop"]


def persist_frame(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = scratch_path(spark, "frame")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def train_and_explain(spark: SparkSession, yields: DataFrame, weather: DataFrame, soil: DataFrame,
                      years=None, districts=None, folds: int = model.DEFAULT_FOLDS,
                      explain_rows: DataFrame | None = None, features: list[str] | None = None,
                      models: dict | None = None,
                      background_rows: int = explain.BACKGROUND_ROWS) -> dict[str, DataFrame]:
    """Run the whole modelling page set-wise; returns every table it shows.

    ``features`` defaults to every numeric non-identity column (F13);
    ``explain_rows`` names the rows for LIME by natural key.
    """
    f = persist_frame(spark, frame.training_scope(
        frame.build_frame(yields, weather, soil, years), districts))
    feats = features or frame.feature_columns(f, numeric_only=True)
    ranking = select.mutual_information(f, feats, "yield")
    models = models or model.estimators("label")
    board, preds = model.compare_models(f, KEY, feats, "yield", models=models, folds=folds)
    best = board.first()["model"]
    # the winner learns from the training split only; the held-out rows stay unseen
    train = model.split(f, KEY)[0]
    fitted = model.fit(train, KEY, feats, "yield", models[best].copy())
    shap = persist_frame(spark, explain.shap_values(fitted, f, KEY, feats, background_rows=background_rows))
    settings = {"target": "yield", "seed": model.SEED, "folds": folds, "train_share": model.TRAIN_SHARE,
                "numeric_features": len(feats), "imputation": "mean", "models": ",".join(models),
                "rows": f.count(), "train_rows": train.count()}
    out = {"frame": f, "ranking": ranking, "leaderboard": board, "predictions": preds,
           "settings": spark.createDataFrame([(k, str(v)) for k, v in settings.items()], "setting string, value string"),
           "learning": model.learning_curve(f, KEY, feats, "yield", models[best].copy()),
           "importance": model.importance(fitted, feats), "shap": shap,
           "shap_importance": explain.global_importance(shap)}
    if explain_rows is not None:
        # rows to explain are named by natural key and taken from the frame
        inst = f.join(explain_rows.select(*KEY).distinct(), KEY, "left_semi")
        out["lime"] = explain.lime(fitted, f, inst, KEY, feats)
    return out
