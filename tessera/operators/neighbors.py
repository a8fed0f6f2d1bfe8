"""Nearest-neighbour operators: kNN classifier (M8) and SMOTE.

The classifier votes over all training rows.  Rows of at most
``max_broadcast_bytes`` are sent to the tasks, which score Arrow batches
against them; more stay a table, and rows find their neighbours by the exact
pivot join of ``knn_join``.  Both give the same votes.  SMOTE searches the neighbours of every row of a class within the
class, however large: the class is sorted along several random directions, cut
into cells of a fixed number of rows, and each row is compared exactly with
the rows of its own and the adjacent cells.  A class of one cell is searched
exactly; nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import (DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasPredictionCol,
                                     HasProbabilityCol, HasRawPredictionCol)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from tessera.functions.expressions import col
from tessera.operators.knn_join import knn_join, points, written

# Bytes of training rows (points and labels) that are sent to the tasks.
MAX_BROADCAST_BYTES = 16 << 20
QUERY_BLOCK = 256
DEFAULT_K = 5
# Random directions of the neighbour search, and rows of a cell.
DIRECTIONS, CELL_ROWS = 6, 128


def _nearest(x: np.ndarray, ref: np.ndarray, k: int, exclude: np.ndarray | None = None):
    """Indices of the k nearest reference rows for each row of x (blocked), of
    equally far rows the first: products only choose which distances are
    computed exactly.  ``exclude`` is a row's own index in the reference."""
    k = min(k, len(ref))
    out = np.empty((len(x), k), dtype=np.int64)
    ref_sq = np.square(ref).sum(axis=1)
    for s in range(0, len(x) if k else 0, QUERY_BLOCK):
        block = x[s:s + QUERY_BLOCK]
        own = np.square(block).sum(axis=1)
        rough = ref_sq - 2.0 * block @ ref.T + own[:, None]
        if exclude is not None:
            rough[np.arange(len(block)), exclude[s:s + QUERY_BLOCK]] = np.inf
        slack = 2e-9 * (ref_sq.max() + own.max())
        row, at = np.nonzero(rough <= np.partition(rough, k - 1, axis=1)[:, k - 1, None] + slack)
        d = np.concatenate([np.square(block[row[i:i + 65536]] - ref[at[i:i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536)])
        order = np.lexsort((at, d, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        out[s:s + len(block)] = at[order[place < k]].reshape(len(block), k)
    return out


def neighbour_indices(df: DataFrame, vec: Column, reference: np.ndarray, k: int) -> Column:
    """Column of the k nearest reference row numbers for each row."""
    ref_b = df.sparkSession.sparkContext.broadcast(reference)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def find(rows: pd.Series) -> pd.Series:
        x = np.vstack(rows.to_numpy()) if len(rows) else np.zeros((0, reference.shape[1]))
        return pd.Series(list(_nearest(x, ref_b.value, k)))
    return find(vec)


class _KNNWriter(MLWriter):
    """Params as metadata; reference rows and labels as Parquet."""

    def __init__(self, instance: "KNNModel"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={
            "k": m.k, "n_classes": m.n_classes, "max_broadcast_bytes": m.max_broadcast_bytes})
        m.table.write.mode("overwrite").parquet(f"{path}/data")


class _KNNReader(MLReader):
    def load(self, path: str) -> "KNNModel":
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = KNNModel(self.sparkSession.read.parquet(f"{path}/data"), int(meta["n_classes"]), int(meta["k"]),
                         int(meta["max_broadcast_bytes"]))
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


class KNNModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol,
               MLWritable, MLReadable):
    """Majority vote of the k nearest training rows (uniform weights; ties
    go to the smallest class index, and of equally far rows to those with
    the smallest hash of point and label).  ``table`` has the training rows:
    ``id`` (that hash), ``y`` and ``vec`` (the point as bytes)."""

    def __init__(self, table: DataFrame | None = None, n_classes: int = 1, k: int = DEFAULT_K,
                 max_broadcast_bytes: int = MAX_BROADCAST_BYTES):
        super().__init__()
        self.table, self.n_classes, self.k = table, n_classes, k
        self.max_broadcast_bytes = max_broadcast_bytes
        self._rows: tuple[np.ndarray, np.ndarray] | None = None

    def write(self) -> MLWriter:
        return _KNNWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _KNNReader()

    def _small(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Points and labels in order of id, if their bytes are few enough."""
        if self._rows is None:
            size = self.table.agg(F.sum(F.octet_length("vec") + 16)).first()[0] or 0
            if size > self.max_broadcast_bytes:
                return None
            rows = sorted(self.table.collect(), key=lambda r: (r["id"], r["y"]))
            points = [np.frombuffer(r["vec"], "<f8") for r in rows]
            self._rows = (np.stack(points) if rows else np.zeros((0, 0)), np.array([r["y"] for r in rows], dtype=np.int64))
        return self._rows

    def _transform(self, dataset: DataFrame) -> DataFrame:
        small = self._small()
        scored = self._by_join(dataset) if small is None else self._by_broadcast(dataset, *small)
        best = F.array_position("_ts_share", F.array_max("_ts_share")) - 1
        return (scored.withColumn(self.getProbabilityCol(), array_to_vector(F.col("_ts_share")))
                      .withColumn(self.getRawPredictionCol(), F.col(self.getProbabilityCol()))
                      .withColumn(self.getPredictionCol(), best.cast("double")).drop("_ts_share"))

    def _by_broadcast(self, dataset: DataFrame, reference: np.ndarray, labels: np.ndarray) -> DataFrame:
        nn = neighbour_indices(dataset, vector_to_array(F.col(self.getFeaturesCol())), reference, min(self.k, len(labels)))
        lab = dataset.sparkSession.sparkContext.broadcast(labels)
        n_classes = self.n_classes

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def vote(idx: pd.Series) -> pd.Series:
            if not len(idx):
                return pd.Series([], dtype=object)
            votes = lab.value[np.vstack(idx.to_numpy())]
            share = (votes[:, :, None] == np.arange(n_classes)).mean(axis=1)
            return pd.Series(list(share))

        return dataset.withColumn("_ts_share", vote(nn))

    def _by_join(self, dataset: DataFrame) -> DataFrame:
        """Each distinct point is asked once, and joined with its votes."""
        numbered = dataset.withColumn("_ts_x", vector_to_array(F.col(self.getFeaturesCol())))
        asked = numbered.select("_ts_x").distinct().withColumn("_ts_id", F.xxhash64(F.lit(1), "_ts_x"))
        near = knn_join(points(asked, "_ts_id", "_ts_x"), self.table, self.k)
        counts = near.groupBy("query").agg(F.collect_list("y").alias("ys"))  # k labels each
        share = F.transform(F.sequence(F.lit(0), F.lit(self.n_classes - 1)), lambda c: F.size(F.filter("ys", lambda y: y == c)) / F.size("ys"))
        votes = asked.join(counts, asked["_ts_id"] == counts["query"]).select("_ts_x", share.alias("_ts_share"))
        return numbered.join(votes, "_ts_x", "left").drop("_ts_x")


class KNNClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol,
                    HasRawPredictionCol):
    """k-nearest-neighbour classifier over all training rows."""

    def __init__(self, k: int = DEFAULT_K, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, seed: int = 42):
        super().__init__()
        self.k, self.max_broadcast_bytes, self.seed = k, max_broadcast_bytes, seed

    def setFeaturesCol(self, value: str) -> "KNNClassifier":
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str) -> "KNNClassifier":
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str) -> "KNNClassifier":
        return self._set(predictionCol=value)

    def setProbabilityCol(self, value: str) -> "KNNClassifier":
        return self._set(probabilityCol=value)

    def setRawPredictionCol(self, value: str) -> "KNNClassifier":
        return self._set(rawPredictionCol=value)

    def _fit(self, dataset: DataFrame) -> KNNModel:
        pairs = dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"),
                               F.col(self.getLabelCol()).cast("int").alias("y"))
        hashed = pairs.withColumn("id", F.xxhash64(F.lit(self.seed), "x", "y"))
        table = written(points(hashed, "id", "x", "y"), "model")
        last = table.agg(F.max("y")).first()[0]
        model = KNNModel(table, 1 if last is None else int(last) + 1, self.k, self.max_broadcast_bytes)
        model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                   probabilityCol=self.getProbabilityCol(),
                   rawPredictionCol=self.getRawPredictionCol())
        return model


def estimator_for(algorithm: str, seed: int = 42):
    if algorithm == "svm":
        from tessera.operators.svm import KernelSVM
        return KernelSVM(seed=seed)
    if algorithm == "knn":
        return KNNClassifier(DEFAULT_K, seed=seed)
    raise ValueError(f"no such algorithm: {algorithm}")


def neighbours_in_class(rows: DataFrame, k: int, seed: int = 42, directions: int = DIRECTIONS,
                        cell_rows: int = CELL_ROWS) -> DataFrame:
    """(cls, idx, near) for rows (cls, idx, x): the up to ``k`` nearest other
    rows of the same class found, as structs (distance, idx), nearest first.

    Each direction sorts the classes once; a cell and its two neighbours are
    one bounded group, so a class of any size is spread over many tasks.
    """
    from tessera.plans.ordering import with_group_index

    width = len(rows.first()["x"]) if not rows.isEmpty() else 0
    rng = np.random.default_rng(seed)
    spread = None
    for direction in range(directions):
        weights = F.array(*[F.lit(float(w)) for w in rng.normal(size=width)])
        along = F.aggregate(F.zip_with("x", weights, lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)
        placed = with_group_index(rows.withColumn("_ts_p", along), ["cls"], ["_ts_p", "idx"], "_ts_pos")
        home = (F.col("_ts_pos") / cell_rows).cast("long")
        part = placed.select("cls", "idx", "x", F.lit(direction).alias("direction"), home.alias("home"),
                             F.explode(F.array(home - 1, home, home + 1)).alias("cell"))
        spread = part if spread is None else spread.unionByName(part)
    cls_type = rows.schema["cls"].dataType.simpleString()

    def search(group: pd.DataFrame) -> pd.DataFrame:
        own = (group["home"] == group["cell"]).to_numpy()
        ids, x = group["idx"].to_numpy(), np.vstack(group["x"].to_numpy())
        if not own.any() or len(ids) < 2:
            query = np.empty(0, dtype=np.int64)
        else:
            query = np.flatnonzero(own)
        kk = max(1, min(k, len(ids) - 1))
        found = _nearest(x[query], x, kk, query)
        gap = np.sqrt(((x[query][:, None, :] - x[found]) ** 2).sum(axis=2))
        return pd.DataFrame({"cls": np.full(len(query) * kk, group["cls"].iloc[0], dtype=object), "idx": np.repeat(ids[query], kk), "other": ids[found].ravel(),
                             "distance": gap.ravel()})

    pairs = spread.groupBy("cls", "direction", "cell").applyInPandas(
        search, f"cls {cls_type}, idx long, other long, distance double")
    # At most k entries for each direction.
    near = F.slice(F.array_sort(F.collect_set(F.struct("distance", "other"))), 1, k)
    return pairs.groupBy("cls", "idx").agg(near.alias("near"))


def smote_resample(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str],
                   k: int = DEFAULT_K, seed: int = 42) -> DataFrame:
    """Every class below the majority count gets synthetic rows
    x_i + gap * (x_nn - x_i), x_nn one of the k nearest rows of the same
    class, until it reaches the majority count.  Output: the feature
    columns (as double) and the target, originals first.

    Rows with a missing feature are not allowed (as in the reference's
    library), nor columns besides features, key and target: a synthetic row
    would have no value for them.  Base row, neighbour and gap of draw j are
    seeded hashes of (seed, class, j), so the result repeats.
    """
    from tessera.operators.balance import class_counts
    from tessera.plans.ordering import with_group_index

    feats = list(features)
    other = [c for c in df.columns if c not in feats and c != target and c not in key]
    if other:
        raise ValueError(f"smote has no value for the columns {other}; encode or drop them")
    extra = [c for c in key if c not in feats and c != target]
    data = df.select(*[col(c).cast("double").alias(c) for c in feats], *[col(c) for c in [target, *extra]])
    if not data.where(F.exists(F.array(*[col(c) for c in feats]), lambda v: v.isNull())).isEmpty():
        raise ValueError("smote needs feature columns without missing values")
    counts = {c: n for c, n in class_counts(data, target).items() if c is not None}
    originals = data.select(*[col(c) for c in [*feats, target]])
    if not counts:
        return originals
    n_max = max(counts.values())
    small = {c: n for c, n in counts.items() if n < n_max}
    if not small:
        return originals
    if min(small.values()) < 2:
        raise ValueError("smote needs at least two rows of a class")
    kind = df.schema[target].dataType
    minority = data.where(col(target).isin(*[F.lit(c) for c in small]))
    members = (with_group_index(minority, [target], list(key), "idx")
               .select(col(target).alias("cls"), "idx", F.array(*[col(c) for c in feats]).alias("x")))
    near = neighbours_in_class(members, k, seed)
    spark = df.sparkSession
    draws = None
    for cls, n in small.items():
        def hashed(what: str, salt: str = str(cls)) -> Column:
            return F.xxhash64(F.lit(seed), F.lit(salt), F.lit(what), F.col("id"))

        part = spark.range(n_max - n).select(
            F.lit(cls).cast(kind).alias("cls"), F.pmod(hashed("base"), F.lit(n)).alias("idx"),
            F.abs(hashed("nn")).alias("pick"), (F.pmod(hashed("gap"), F.lit(1 << 30)) / float(1 << 30)).alias("gap"))
        draws = part if draws is None else draws.unionByName(part)
    chosen = F.element_at("near", (F.pmod("pick", F.size("near")) + 1).cast("int"))["other"]
    based = draws.join(near.join(members, ["cls", "idx"]), ["cls", "idx"])
    paired = based.select("cls", chosen.alias("idx"), "gap", F.col("x").alias("from")).join(members, ["cls", "idx"])
    step = F.zip_with("from", "x", lambda a, b: b - a)
    made = paired.select("cls", "from", "gap", step.alias("step"))
    values = [(F.col("from")[i] + F.col("gap") * F.col("step")[i]).alias(c) for i, c in enumerate(feats)]
    return originals.unionByName(made.select(*values, F.col("cls").alias(target)))
