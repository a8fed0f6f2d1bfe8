"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id of ``edges`` (two columns ``a`` and
    ``b`` of longs): the smallest id that can be reached.

    Each round takes the least label among an id's neighbours and then the
    label of that label, and is written to the shared folder.  It ends when
    no label has changed.  A hub's edges are joined, never gathered.
    """
    both = shared.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                          .filter("a <> b").distinct(), "edges")
    labels = shared.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"),
                            "labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "label"), "b")
                .groupBy("a").agg(F.min("label").alias("near")))
        lower = labels.join(near, labels["id"] == near["a"]).select(
            "id", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("jumped"))
        labels = shared.written(lower.join(jump, "low").select("id", F.least("low", "jumped").alias("label"), "was"), "labels")
        if labels.filter("label <> was").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        labels = labels.drop("was")
