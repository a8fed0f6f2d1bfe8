"""PCA (G7) of sparse rows with many columns, without a covariance matrix.

A randomized range finder: the rows are multiplied by a narrow block of l =
``k + oversample`` directions, at first seeded normal ones, and the products
lead to better directions, round after round (Halko, Martinsson and Tropp,
2011).  Directions of earlier rounds are kept and the best axes are looked for
among all of them (a block Krylov space, restarted with the l best when it is
full; Musco and Musco, 2015), so variances that hardly differ take few rounds
too.  One round is one pass: each task multiplies its rows, centred, and
sends for each column that its rows use l numbers, which are added up by
column.  Once the directions are found, each task factors its rows' products
by QR, the small triangles are factored again in groups, and the last triangle
gives axes and variances (Demmel et al., 2012), so nothing of columns x columns
exists anywhere.  Each task holds columns x l doubles (50,000 columns and
l = 12: 5 MB), the driver (or the one task of few rows) also the directions
kept and their products (``BASIS_BYTES``, or six times columns x l doubles),
whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import map_arrow, schema_of
from tessera.functions.expressions import col
from tessera.operators.boosting import vector_entries
from tessera.operators.train import FIT_BYTES

# Rows multiplied at once and triangles factored in one group.
ROWS = 4096
GROUPS = 64
# Directions kept over the rounds, unless three blocks are more, and the bytes
# that they and their products may take.
BASIS, BASIS_BYTES = 1024, 64 << 20
# Residuals this small, as a share of the largest variance, are rounding.
ROUNDING = 1e-13


@dataclass(frozen=True)
class WidePCA:
    """Axes (k rows of unit length, largest loading positive), their variances
    and the column means; ``rounds`` passes were made."""

    components: np.ndarray
    variances: np.ndarray
    mean: np.ndarray
    rounds: int

    def transform(self, df: DataFrame, vector: str, prefix: str = "PC") -> DataFrame:
        """Add ``PC1`` .. ``PCk``; null for a row whose vector is null or holds
        a value that isn't finite."""
        names = [f"{prefix}{i + 1}" for i in range(len(self.components))]
        clash = sorted(set(names) & set(df.columns))
        if clash:
            raise ValueError(f"columns exist already: {clash}")
        shared = df.sparkSession.sparkContext.broadcast((self.components.T.copy(), self.components @ self.mean))
        schema = schema_of(", ".join(f"{n} double" for n in names))

        @F.arrow_udf(schema)
        def project(column: pa.Array) -> pa.Array:
            axes, shift = shared.value
            out = _product(column, axes) - shift
            missing = pa.array(~np.isfinite(out).all(axis=1) | ~column.is_valid().to_numpy(zero_copy_only=False))
            return pa.StructArray.from_arrays(
                [pa.array(out[:, i], mask=missing.to_numpy(zero_copy_only=False)) for i in range(len(names))], names)

        made = "_ts_projected"
        return df.withColumn(made, project(col(vector))).select(*[col(c) for c in df.columns], f"{made}.*")


def _product(column: pa.Array, block: np.ndarray) -> np.ndarray:
    """Rows of a vector column times a dense block, ``ROWS`` rows at a time."""
    out = np.zeros((len(column), block.shape[1]))
    for at in range(0, len(column), ROWS):
        row, feature, value = vector_entries(column.slice(at, ROWS))
        if len(row):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[at + row[starts]] = np.add.reduceat(block[feature] * value[:, None], starts, axis=0)
    return out


def _lengths(column: pa.Array) -> np.ndarray:
    """Lengths of a column of ML vectors without nulls."""
    storage = column.storage if isinstance(column, pa.ExtensionArray) else column
    _, size, _, values = storage.flatten()
    return pc.coalesce(size, pc.list_value_length(values)).to_numpy(zero_copy_only=False)


def _mean(rows: DataFrame) -> tuple[int, int, np.ndarray]:
    """Numbers of rows and of entries, and the mean of each column, added up by
    column as in ``_round``; ValueError if lengths differ."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high, n, entries = np.zeros(0), np.inf, -np.inf, 0, 0
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            lengths = _lengths(column)
            low, high, n = min(low, lengths.min()), max(high, lengths.max()), n + len(lengths)
            total = np.pad(total, (0, max(int(high) - len(total), 0)))
            _, feature, value = vector_entries(column)
            total += np.bincount(feature, value, len(total))
            entries += len(value)
        if n:
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(np.r_[-4, -3, -2, -1, at].astype(np.int32)), pa.array(np.r_[entries, n, low, high, total[at]])],
                                  names=["feature", "total"])

    found = (map_arrow(rows, run, "feature int, total double").groupBy("feature")
             .agg(F.sum("total"), F.min("total"), F.max("total")).toArrow())
    feature, total, low, high = (found.column(i).to_numpy() for i in range(4))
    if not len(feature):
        return 0, 0, np.zeros(0)
    size = int(high[feature == -1][0])
    if low[feature == -2][0] != size:
        raise ValueError(f"vectors have {int(low[feature == -2][0])} to {size} components")
    n = int(total[feature == -3][0])
    mean = np.zeros(size)
    mean[feature[feature >= 0]] = total[feature >= 0] / n
    return n, int(total[feature == -4][0]), mean


def _cross(columns: Iterable[pa.Array], z: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These rows' part of the cross product times ``z``, and which columns
    they use."""
    total, used = np.zeros(z.shape), np.zeros(len(z), dtype=bool)
    for column in columns:
        for at in range(0, len(column), ROWS):
            part = column.slice(at, ROWS)
            y = _product(part, z) - shift
            row, feature, value = vector_entries(part)
            order = np.argsort(feature, kind="stable")
            row, feature, value = row[order], feature[order], value[order]
            if len(row):
                starts = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]])
                total[feature[starts]] += np.add.reduceat(y[row] * value[:, None], starts, axis=0)
                used[feature[starts]] = True
    return total, used


def _factor(columns: Iterable[pa.Array], z: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of these rows, centred, times ``z``."""
    r = np.zeros((0, z.shape[1]))
    for column in columns:
        for at in range(0, len(column), ROWS):
            r = np.linalg.qr(np.vstack([r, _product(column.slice(at, ROWS), z) - shift]), mode="r")
    return r


def _round(rows: DataFrame, block: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The centred rows' cross product with themselves, times ``block``."""
    shared = rows.sparkSession.sparkContext.broadcast((block, mean @ block))
    width = block.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = _cross((b.column(0) for b in batches), *shared.value)
        # Columns these rows don't use send nothing.
        at = np.flatnonzero(used)
        for first in range(0, len(at), ROWS):
            some = at[first:first + ROWS]
            yield pa.record_batch([pa.array(some.astype(np.int32)), *(pa.array(total[some, i]) for i in range(width))],
                                  names=["feature", *(f"y{i}" for i in range(width))])

    schema = "feature int, " + ", ".join(f"y{i} double" for i in range(width))
    found = (map_arrow(rows, run, schema).groupBy("feature").agg(*(F.sum(f"y{i}").alias(f"y{i}") for i in range(width)))
             .toArrow())
    out = np.zeros(block.shape)
    out[found["feature"].to_numpy()] = np.column_stack([found[f"y{i}"].to_numpy() for i in range(width)])
    shared.unpersist()
    return out


def _triangle(rows: DataFrame, block: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of the centred rows times ``block``: each task
    factors its own rows, then triangles are factored in groups."""
    shared = rows.sparkSession.sparkContext.broadcast((block, mean @ block))
    width = block.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = _factor((b.column(0) for b in batches), *shared.value)
        if len(r):
            group = TaskContext.get().partitionId() % GROUPS
            yield pa.record_batch([pa.array([group], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["g", "r"])

    def join(parts: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, width))
        for one in parts["r"]:
            r = np.linalg.qr(np.vstack([r, np.asarray(one).reshape(-1, width)]), mode="r")
        return pd.DataFrame({"g": parts["g"].iloc[:1], "r": [r.ravel()]})

    kind = "g int, r array<double>"
    last = map_arrow(rows, run, kind).groupBy("g").applyInPandas(join, kind).collect()
    r = np.vstack([np.asarray(x["r"]).reshape(-1, width) for x in sorted(last, key=lambda x: x["g"])])
    shared.unpersist()
    return np.linalg.qr(r, mode="r")


def fit_wide_pca(df: DataFrame, vector: str, k: int = 2, oversample: int = 10, tolerance: float = 1e-9,
                 max_rounds: int = 100, seed: int = 0, task_bytes: int = FIT_BYTES) -> WidePCA:
    """The ``k`` leading axes of a column of ML vectors of one length.

    Rounds go on until the k axes turn by less than ``tolerance`` (the sine of
    the largest angle between two rounds' spaces), or nothing but rounding is
    left to better; at most ``BASIS`` columns are exact once the directions kept
    are as many.  Axes of equal variance are any basis of their space.
    ValueError if ``max_rounds`` aren't enough: raise them, or ``oversample``.  Rows whose vector is null or holds a value that isn't
    finite are left out.  Where the columns are no more than l, one round is
    exact.  Fewer than two rows: ValueError.  The rows are persisted for the
    rounds, in partitions of about ``task_bytes``, a lost one being made again;
    rows that fill just one have all rounds in its task.
    """
    rows = df.select(col(vector).alias("x")).where(F.col("x").isNotNull())

    @F.arrow_udf("boolean")
    def finite(column: pa.Array) -> pa.Array:
        bad = np.zeros(len(column), dtype=bool)
        row, _, value = vector_entries(column)
        bad[row[~np.isfinite(value)]] = True
        return pa.array(~bad)

    rows = rows.where(finite("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, entries, mean = _mean(rows)
        if n < 2:
            raise ValueError("PCA needs two rows at least")
        parts = -(-(32 * n + 12 * entries) // task_bytes)
        ask = mean, n, k, oversample, tolerance, max_rounds, seed
        if parts == 1:
            return _in_one_task(rows.coalesce(1), ask)
        rows_held = rows.coalesce(parts)
        return _iterate(lambda z: _round(rows_held, z, mean), lambda z: _triangle(rows_held, z, mean), *ask)
    finally:
        rows.unpersist()


def _in_one_task(rows: DataFrame, ask: tuple) -> WidePCA:
    """All rounds in one task, which holds its rows: the same steps without a
    job for each round."""
    shared = rows.sparkSession.sparkContext.broadcast(ask)
    kind = "error string, rounds int, components array<double>, variances array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, mean = [b.column(0) for b in batches], shared.value[0]
        error, found = None, WidePCA(np.zeros((0, 0)), np.zeros(0), mean, 0)
        try:
            found = _iterate(lambda z: _cross(columns, z, mean @ z)[0], lambda z: _factor(columns, z, mean @ z), *shared.value)
        except ValueError as unsettled:
            error = str(unsettled)
        yield pa.record_batch([pa.array([error], pa.string()), pa.array([found.rounds], pa.int32()),
                               pa.array([found.components.ravel()], pa.list_(pa.float64())),
                               pa.array([found.variances], pa.list_(pa.float64()))],
                              names=["error", "rounds", "components", "variances"])

    row = map_arrow(rows, run, kind).first()
    shared.unpersist()
    if row["error"]:
        raise ValueError(row["error"])
    return WidePCA(np.array(row["components"]).reshape(-1, len(ask[0])), np.array(row["variances"]), ask[0], row["rounds"])


def _outside(directions: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of what ``directions`` have outside ``basis``, as
    far as they are longer than ``least``; no more than there is room for."""
    room = len(basis) - basis.shape[1]
    out, scale, _ = np.linalg.svd(directions - basis @ (basis.T @ directions), full_matrices=False)
    out = out[:, scale > least][:, :room]
    # Again: short directions have lost their right angle to the basis.
    for _ in range(2):
        out = np.linalg.qr(out - basis @ (basis.T @ out))[0]
    return out


def _iterate(cross: Callable[[np.ndarray], np.ndarray], triangle: Callable[[np.ndarray], np.ndarray], mean: np.ndarray, n: int,
             k: int, oversample: int, tolerance: float, max_rounds: int, seed: int) -> WidePCA:
    size = len(mean)
    k, width = min(k, size), min(k + oversample, size)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    basis, images = np.zeros((size, 0)), np.zeros((size, 0))
    most = min(size, max(3 * width, min(BASIS, BASIS_BYTES // (16 * size))))
    axes, fresh, rounds = None, block, 0
    while width < size:
        rounds += 1
        basis, images = np.hstack([basis, fresh]), np.hstack([images, cross(fresh)])
        # Rayleigh-Ritz: the best axes inside the space of all blocks kept.
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:width], vectors[:, ::-1][:, :width]
        block, ahead = basis @ vectors, images @ vectors
        now, off = block[:, :k], ahead - block * values
        if axes is not None and np.linalg.norm(now - axes @ (axes.T @ now), 2) < tolerance:
            break
        axes = now
        if basis.shape[1] + width > most and basis.shape[1] < size and most < size:
            basis, images = block, ahead
        fresh = _outside(off, basis, ROUNDING * np.abs(values).max())
        if not fresh.shape[1] or np.linalg.norm(off[:, :k], axis=0).max() <= ROUNDING * np.abs(values).max():
            break
        if rounds == max_rounds:
            raise ValueError(f"the axes still turn after {max_rounds} rounds")
    block = np.linalg.qr(block)[0]
    _, scale, turned = np.linalg.svd(triangle(block))
    scale = np.r_[scale, np.zeros(width)][:k]
    components = turned[:k] @ block.T
    signs = np.sign(components[np.arange(k), np.abs(components).argmax(axis=1)])
    return WidePCA(components * np.where(signs == 0, 1.0, signs)[:, None], scale**2 / (n - 1), mean, rounds)
