"""Model store (S10): Spark ML pipelines saved under a generated id.

Each model folder holds ``pipeline`` (``PipelineModel.save``) and ``meta``
(one JSON record: target, algorithm, feature names and types, labels).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.files import MODEL_ZONE


@dataclass
class StoredModel:
    model_id: str
    model: PipelineModel
    target: str
    algorithm: str
    features: list[str]
    feature_types: dict[str, str]
    labels: list[str]


def save_model(spark: SparkSession, root: str, model: PipelineModel, target: str,
               algorithm: str, features: list[str], feature_types: dict[str, str],
               labels: list[str], model_id: str | None = None) -> str:
    model_id = model_id or str(uuid.uuid4())
    base = posixpath.join(root, MODEL_ZONE, model_id)
    model.write().overwrite().save(posixpath.join(base, "pipeline"))
    meta = {"model_id": model_id, "target": target, "algorithm": algorithm,
            "features": json.dumps(features), "feature_types": json.dumps(feature_types),
            "labels": json.dumps(labels)}
    spark.createDataFrame([meta]).coalesce(1).write.mode("overwrite").json(
        posixpath.join(base, "meta"))
    return model_id


def load_model(spark: SparkSession, root: str, model_id: str) -> StoredModel:
    base = posixpath.join(root, MODEL_ZONE, model_id)
    try:
        meta = spark.read.json(posixpath.join(base, "meta")).first()
    except Exception as exc:  # noqa: BLE001
        raise FileNotFoundError(f"Model {model_id} not found") from exc
    model = PipelineModel.load(posixpath.join(base, "pipeline"))
    return StoredModel(model_id, model, meta["target"], meta["algorithm"],
                       json.loads(meta["features"]), json.loads(meta["feature_types"]),
                       json.loads(meta["labels"]))


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """(model_id, target, algorithm) of every stored model."""
    pattern = posixpath.join(root, MODEL_ZONE, "*", "meta")
    try:
        meta = spark.read.json(pattern)
    except Exception as exc:  # noqa: BLE001 - no model yet
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return spark.createDataFrame([], "model_id string, target string, algorithm string")
        raise
    return meta.select("model_id", "target", "algorithm")


def model_features(stored: StoredModel) -> list[str]:
    """R2: the feature names stored with the model (no dummy fallback)."""
    return list(stored.features)

