"""Scoring a stream with fitted steps and a stored model.

Fitted steps of this library (``Imputation``, ``Bounds``, ``Scaler``,
``PowerTransform``, ``OneHot``, ``Projection``) are plain Column
projections, and Spark ML pipeline models are row-wise transforms, so they
apply to a streaming DataFrame unchanged: the statistics were fitted once
on batch data, the stream only replays the projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.predict import predict


def apply_steps(df: DataFrame, steps: Sequence) -> DataFrame:
    """Apply fitted steps (anything with ``transform(df)``) in order."""
    for step in steps:
        df = step.transform(df)
    return df


def score_stream(stream: DataFrame, model: PipelineModel, features: list[str],
                 feature_types: dict[str, str], keep: Sequence[str],
                 steps: Sequence = ()) -> DataFrame:
    """Streaming DataFrame of ``keep`` columns plus ``prediction``."""
    return predict(model, apply_steps(stream, steps), features, feature_types, list(keep))


def write_scores(scored: DataFrame, path: str, checkpoint_location: str,
                 fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Append the scores to files; the checkpoint location (a shared folder)
    makes the sink exactly-once across restarts."""
    writer = (scored.writeStream.format(fmt).outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
