"""Batch prediction."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import col
from tessera.operators.train import PREDICTED_LABEL


def align_features(df: DataFrame, features: list[str], feature_types: dict[str, str]) -> DataFrame:
    """Add every stored feature missing from ``df`` as a typed null, so a
    partial input still runs through the pipeline."""
    missing = {c: F.lit(None).cast(feature_types.get(c, "string"))
               for c in features if c not in df.columns}
    return df.withColumns(missing) if missing else df


def predict(model: PipelineModel, df: DataFrame, features: list[str],
            feature_types: dict[str, str], keep: list[str] | None = None,
            target_type: str | None = None) -> DataFrame:
    """``model.transform`` over any DataFrame; returns the kept columns
    (default: all input columns) plus ``prediction`` as the label value, in
    the target's type if that is given."""
    keep = list(keep) if keep is not None else list(df.columns)
    scored = model.transform(align_features(df, features, feature_types))
    return scored.select(*[col(c) for c in keep],
                         F.col(PREDICTED_LABEL).cast(target_type or "string").alias("prediction"))
