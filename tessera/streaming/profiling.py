"""The summary of A1 kept up to date over a stream.

The state is Spark's own: one streaming aggregation keyed by (column, value),
whose partial sums merge before and in the state store.  A numeric column is
one key (count, mean, deviation, least and greatest value), another column one
key for each distinct value.  Each micro-batch writes the keys that changed
into a folder of its own number, so that a batch run again after a failure
replaces what it wrote; a reader takes the newest row of each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.expressions import col, nan_to_null
from tessera.functions.schema import is_numeric

_FIGURES = ("count", "mean", "std", "min", "max")


def profile_updates(rows: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, count, mean, std, min, max): a row with null
    ``value`` for each numeric column, else one for each value.  Missing
    entries (null, NaN) count for nothing.  ``rows`` may be a stream."""
    cols = list(cols) if cols else list(rows.columns)

    def entry(c: str) -> Column:
        numeric = is_numeric(rows.schema[c].dataType)
        value = F.lit(None).cast("string") if numeric else col(c).cast("string")
        x = nan_to_null(col(c).cast("double")) if numeric else F.lit(None).cast("double")
        return F.struct(F.lit(c).alias("column_name"), value.alias("value"), x.alias("x"))

    entries = rows.select(F.explode(F.array(*[entry(c) for c in cols])).alias("e")).select("e.*")
    return (entries.where(F.col("x").isNotNull() | F.col("value").isNotNull()).groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
                 F.min("x").alias("min"), F.max("x").alias("max")))


def write_profile(stream: DataFrame, path: str, checkpoint_location: str, cols: Sequence[str] | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Start the profile of ``stream``; ``path`` and ``checkpoint_location``
    are shared folders, and belong together: a new checkpoint needs a new
    path."""
    def replace(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = (profile_updates(stream, cols).writeStream.outputMode("update").foreachBatch(replace)
              .option("checkpointLocation", checkpoint_location))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_profile(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """The summary so far: ``describe`` without quartiles, a row for each of
    ``cols`` (count 0 where nothing was seen)."""
    newest = (spark.read.parquet(path).groupBy("column_name", "value")
              .agg(F.max_by(F.struct(*_FIGURES), "batch").alias("s")).select("column_name", "value", "s.*"))
    # A tie of counts goes to the smallest value, as in ``describe``.
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("count")).alias("neg"), F.col("value").alias("value"))))
    merged = newest.groupBy("column_name").agg(
        F.sum("count").alias("count"), F.count("value").alias("unique"), best.alias("best"),
        *(F.max(c).alias(c) for c in _FIGURES[1:]))
    every = spark.createDataFrame([(c,) for c in cols], "column_name string")
    return every.join(merged, "column_name", "left").select(
        "column_name", F.coalesce("count", F.lit(0).cast("long")).alias("count"),
        F.when(F.col("unique") > 0, F.col("unique")).alias("unique"), F.col("best.value").alias("top"),
        (-F.col("best.neg")).alias("freq"), *_FIGURES[1:])
