"""The reference's requests over dataset zones, as library calls.

``eda`` answers one analysis type; ``train_dataset`` splits, fits, scores and
stores a model; ``evaluate_dataset`` scores a stored model on a dataset;
``predict_dataset`` scores any DataFrame with a stored model.  Results are
DataFrames or small dicts; nothing but reports and previews is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.expressions import col
from tessera.operators import clean, evaluate, profile, train
from tessera.operators.predict import predict
from tessera.sources import files, models

ANALYSES = ("summary", "correlation", "distribution", "missing", "categorical", "outliers",
            "pairplot", "duplicates", "imbalance", "skewness")


def eda(df: DataFrame, analysis_type: str, target: str = "target",
        order_by: Sequence[str] | None = None) -> dict[str, DataFrame] | DataFrame:
    """One EDA analysis.  ``summary`` returns shape, head, describe and info
    reports; every other type returns its report DataFrame."""
    if analysis_type == "summary":
        return {"shape": clean.shape(df), "head": clean.head(df, 5, order_by),
                "describe": profile.describe(df), "info": profile.info(df)}
    reports = {
        "correlation": profile.correlation, "distribution": profile.distribution,
        "missing": profile.missing, "categorical": profile.categorical_counts,
        "outliers": profile.outlier_summary, "pairplot": profile.pair_bins,
        "duplicates": profile.duplicates, "skewness": profile.skewness_check,
    }
    if analysis_type == "imbalance":
        return profile.class_balance(df, target)
    if analysis_type not in reports:
        raise ValueError(f"Invalid analysis type: {analysis_type}")
    return reports[analysis_type](df)


def train_dataset(spark: SparkSession, root: str, name: str, target: str,
                  algorithm: str = "random_forest", test_size: float = 0.2,
                  cross_validation: str | int | None = None, key: Sequence[str] | None = None,
                  seed: int = 42) -> tuple[str, dict]:
    """Load, train, store; returns (model id, metrics)."""
    df = files.load_dataset(spark, root, name)
    result = train.train_model(df, target, algorithm, test_size, cross_validation, key, seed)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    model_id = models.save_model(spark, root, result.model, target, algorithm,
                                 result.feature_names, types, result.labels)
    return model_id, {"accuracy": result.accuracy,
                      "cross_validation_scores": result.cv_scores}


def evaluate_dataset(spark: SparkSession, root: str, model_id: str, name: str, target: str,
                     metrics: Sequence[str] = evaluate.METRICS) -> DataFrame:
    """Score a stored model on a dataset: (metric, value) rows."""
    stored = models.load_model(spark, root, model_id)
    df = files.load_dataset(spark, root, name)
    evaluate.require_target(df, target)
    scored = stored.model.transform(df)
    return evaluate.evaluate(scored, target, metrics, labels=stored.labels)


def confusion_dataset(spark: SparkSession, root: str, model_id: str, name: str,
                      target: str) -> DataFrame:
    """Confusion counts of a stored model on a dataset."""
    stored = models.load_model(spark, root, model_id)
    df = files.load_dataset(spark, root, name)
    evaluate.require_target(df, target)
    scored = stored.model.transform(df).withColumn("_ts_actual", col(target).cast("string"))
    return evaluate.confusion_matrix(scored, "_ts_actual", train.PREDICTED_LABEL)


def predict_dataset(spark: SparkSession, root: str, model_id: str, rows: DataFrame,
                    keep: Sequence[str] | None = None) -> DataFrame:
    """Batch prediction with a stored model; missing features are nulls."""
    stored = models.load_model(spark, root, model_id)
    return predict(stored.model, rows, stored.features, stored.feature_types,
                   list(keep) if keep is not None else None, stored.feature_types.get(stored.target))
