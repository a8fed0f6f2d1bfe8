"""Exact k-nearest-neighbour join by pivots (M8).

Reference rows belong to the cell of their nearest pivot (a Voronoi diagram of
a few rows); a cell knows its size and greatest distance.  Round one compares a
query with the nearest cells that hold enough rows, which bounds its k-th
distance from above.  Round two goes only to cells that can hold a nearer row:
those neither ruled out by the triangle inequality (distance to the pivot less
the cell's radius) nor by the hyperplane between the pivots.  Neighbouring cells share a bin of
bounded bytes, a hot cell has several, and the queries of a bin are cut into
blocks.  A query is sent once to each bin, with the list of cells it is
compared with there, and a bin once to each of its blocks: about ``BINS`` copies
of either at most, until bins reach ``PORTION_BYTES``.  Only pivots are
broadcast, never rows.

Of equal reference points, the k with the smallest ids are compared (a hot
point costs no more).  Ties in distance go to the smaller id.  Points that are
null or hold a null or a component that isn't finite take no part.  All points
have one length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrow import arrow_schema, map_arrow, schema_of
from tessera.session import checkpoint_dir

#: Pivots at most, and the bytes they may take.
PIVOTS, PIVOT_BYTES = 256, 16 << 20
#: Bytes of a bin of reference rows and of a block of queries at most; rows are
#: cut into so many bins and blocks before, unless these had fewer rows than ROWS.
PORTION_BYTES, BINS, ROWS = 64 << 20, 8, 1024
#: Queries compared at once.
QUERIES = 2048

_POINT = "id long, y long, vec binary"


@dataclass
class Cells:
    """Pivots, and each cell's rows and greatest distance to its pivot."""

    pivots: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(np.square(x - p).sum(axis=1)) for p in self.pivots], axis=1)

    def first(self, far: np.ndarray, k: int) -> np.ndarray:
        """Which cells are compared in round one: the nearest until they hold
        ``k`` rows."""
        order = np.argsort(far, axis=1, kind="stable")
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        out = np.zeros(far.shape, dtype=bool)
        np.put_along_axis(out, order, (before < k) & (self.sizes[order] > 0), axis=1)
        return out

    def others(self, far: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
        """Which of the other cells can hold a row nearer than the bound."""
        slack = 1e-9 * (1.0 + far)
        near = far - self.radii <= bound[:, None] + slack
        own = far.argmin(axis=1)
        apart = self.distances(self.pivots)[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (np.square(far) - np.square(far[np.arange(len(far)), own])[:, None]) / (2.0 * apart)
        near &= ~(np.nan_to_num(plane, nan=0.0, posinf=0.0, neginf=0.0) > bound[:, None] + slack)
        return near & ~self.first(far, k) & (self.sizes > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)


def written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/knn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def points(rows: DataFrame, id_col: str, x: str, y: str | None = None) -> DataFrame:
    """``id``, ``y`` and ``vec`` (bytes) of the rows whose point takes part."""
    source = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.col(f"`{y}`").cast("long") if y else F.lit(None).cast("long")).alias("y"),
                         F.col(f"`{x}`").cast("array<double>").alias("x"))
    fine = source.filter(F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    arrow = arrow_schema(_POINT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = [(np.array(v) + 0.0).astype("<f8").tobytes() for v in batch.column("x").to_pylist()]  # no minus zero
            yield pa.record_batch([batch.column("id"), batch.column("y"), pa.array(vec, type=pa.binary())], schema=arrow)

    return map_arrow(fine, run, _POINT)


def _cells(reference: DataFrame, n: int, width: int, most: int) -> np.ndarray:
    """Pivots: distinct points in the order of a hash."""
    count = max(1, min(most, int(np.ceil(np.sqrt(n))), PIVOT_BYTES // (8 * max(width, 1))))
    rows = reference.orderBy(F.xxhash64("vec"), "vec").select("vec").limit(count).collect()
    return np.unique(np.stack([np.frombuffer(r["vec"], "<f8") for r in rows]), axis=0)


def _bins(cells: Cells, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bin of each cell and how many it has.  Cells go from one to the
    nearest that is left, and fill bins of ``most`` rows; one of more rows has
    bins of its own."""
    apart = cells.distances(cells.pivots)
    starts, portions = np.zeros(len(apart), dtype=np.int64), np.ones(len(apart), dtype=np.int64)
    left, at, made, filled = np.ones(len(apart), dtype=bool), 0, 0, most
    for _ in range(len(apart)):
        left[at] = False
        n = int(cells.sizes[at])
        if n > most:
            starts[at], portions[at] = made, -(-n // most)
            made, filled = made + portions[at], most
        else:
            if filled + n > most or not made:
                made, filled = made + 1, 0
            starts[at], filled = made - 1, filled + n
        at = int(np.where(left, apart[at], np.inf).argmin())
    return starts, portions


def _spread(rows: DataFrame, lists, sent, columns: str) -> DataFrame:
    """The rows, once for each place that ``lists(cells, batch)`` names, and
    what it says of them."""
    schema = schema_of(rows.schema.simpleString()[7:-1] + ", " + columns)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                at, *more = lists(sent.value, part)
                yield pa.record_batch([*(c.take(pa.array(at)) for c in part.columns), *(pa.array(m, type=arrow.field(len(part.columns) + i).type) for i, m in enumerate(more))], schema=arrow)

    return map_arrow(rows, run, schema)


def _of(numbers: np.ndarray, place: str):
    """The number of each row's ``place``."""
    return F.element_at(F.lit([int(n) for n in numbers]), F.col(place) + 1)


class _Block:
    """Queries that are compared at once: ids, points, least bounds, the cells
    they want and what is found."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, bound: np.ndarray, wants: np.ndarray):
        self.ids, self.points, self.wants = ids, points, wants
        self.squares, self.bound = np.square(points).sum(axis=1), np.square(bound)
        self.any = np.unpackbits(np.bitwise_or.reduce(wants, axis=0)).astype(bool)
        none = np.empty(0, dtype=np.int64)
        self.found = none, none, none, np.empty(0)

    def compare(self, cell: np.ndarray, ids: np.ndarray, y: np.ndarray, x: np.ndarray, k: int) -> None:
        use = np.flatnonzero(self.any[cell])
        if not len(use):
            return
        mask = np.unpackbits(self.wants, axis=1)[:, cell[use]].astype(bool)
        who = np.flatnonzero(mask.any(axis=1))
        self.found = _merge(self, who, mask[who], ids[use], y[use], x[use], k)


def _compared(dealt: DataFrame, k: int, tiles: int) -> DataFrame:
    """``query``, ``id``, ``y`` and ``d2``: the k nearest rows of a bin for
    each query of a block, but for those beyond its bound."""
    schema = "query long, id long, y long, d2 double"
    arrow = arrow_schema(schema)
    group = ["bin", "block"]
    # Twice as many partitions as tiles, so that few share one; their work is
    # in the comparing, so that small ones must not be put together.
    sorted_ = dealt.repartition(2 * tiles, *group).sortWithinPartitions(*group, "kind", "cell", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, asked, held = None, [], []

        def closed() -> Iterator[pa.RecordBatch]:
            for block in held:
                query, ids, y, d2 = block.found
                yield pa.record_batch([pa.array(block.ids[query]), pa.array(ids), pa.array(y, mask=y == _NONE), pa.array(d2)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*group, "kind")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                for begin in range(start, stop, 1024):
                    part = batch.slice(begin, min(stop, begin + 1024) - begin)
                    key = tuple(keys[begin][:2])
                    if key != current:
                        yield from closed()
                        current, asked, held = key, [], []
                    ids, x = part.column("id").to_numpy(zero_copy_only=False), _matrix(part.column("vec"))
                    if keys[begin][2] == 0:
                        wants = np.frombuffer(b"".join(part.column("wants").to_pylist()), np.uint8).reshape(len(ids), -1)
                        asked.append((ids, x, part.column("bound").to_numpy(zero_copy_only=False), wants))
                        continue
                    if asked:
                        whole = [np.concatenate(c) for c in zip(*asked, strict=True)]
                        held, asked = [_Block(*(c[i:i + QUERIES] for c in whole)) for i in range(0, len(whole[0]), QUERIES)], []
                    y, cell = part.column("y").fill_null(_NONE).to_numpy(zero_copy_only=False), part.column("cell").to_numpy(zero_copy_only=False)
                    for block in held:
                        block.compare(cell, ids, y, x, k)
        yield from closed()

    return map_arrow(sorted_, run, schema)


_NONE = -(1 << 62)


def _merge(held: _Block, who: np.ndarray, mask: np.ndarray, ids: np.ndarray, y: np.ndarray, x: np.ndarray, k: int) -> tuple:
    """The k nearest so far, when queries ``who`` are compared with the rows
    that ``mask`` allows; lowers the queries' bounds."""
    queries, squares, bound, found = held.points[who], held.squares[who], held.bound, held.found
    own = np.square(x).sum(axis=1)
    rough = squares[:, None] + own - 2.0 * queries @ x.T
    rough[~mask] = np.inf
    slack = 1e-9 * (squares.max() + own.max())
    limit = bound[who] + slack
    near = mask & (rough <= limit[:, None])
    if len(ids) >= k and np.count_nonzero(near) > 2 * k * len(who):
        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack)
        near = mask & (rough <= limit[:, None])
    query, at = np.nonzero(near)
    if not len(query):
        return found
    d2 = np.concatenate([np.square(queries[query[i:i + 65536]] - x[at[i:i + 65536]]).sum(axis=1) for i in range(0, len(query), 65536)])
    query = who[query]
    query, names, label, d2 = (np.concatenate(c) for c in zip(found, (query, ids[at], y[at], d2), strict=True))
    order = np.lexsort((label, names, d2, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    order = order[place < k]
    found = query[order], names[order], label[order], d2[order]
    full = np.flatnonzero(np.bincount(found[0], minlength=len(bound)) == k)
    last = np.searchsorted(found[0], full, side="right") - 1
    bound[full] = np.minimum(bound[full], found[3][last])
    return found


def knn_join(queries: DataFrame, reference: DataFrame, k: int, pivots: int = PIVOTS, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """For each query (``id``, ``vec`` of :func:`points`; ids are distinct) its ``k`` nearest
    reference points (``id``, ``y``, ``vec``): ``query``, ``rank`` (from 1),
    ``id``, ``y`` and ``distance``; fewer if there are not so many."""
    spark = queries.sparkSession
    out = "query long, rank int, id long, y long, distance double"
    same = Window.partitionBy("vec").orderBy("id", "y")
    rows = written(reference.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k).drop("_n"), "reference")
    seen = rows.agg(F.count("*").alias("n"), F.max(F.octet_length("vec")).alias("bytes")).first()
    if not seen["n"]:
        return spark.createDataFrame([], out)
    width = seen["bytes"] // 8
    found = _cells(rows, seen["n"], width, pivots)
    sent = spark.sparkContext.broadcast(Cells(found, np.zeros(len(found)), np.zeros(len(found))))

    def nearest(cells: Cells, part: pa.RecordBatch):
        far = cells.distances(_matrix(part.column("vec")))
        return np.arange(len(far)), far.argmin(axis=1).astype(np.int32), far.min(axis=1)

    placed = written(_spread(rows, nearest, sent, "cell int, far double"), "cells")
    sizes, radii = np.zeros(len(found), dtype=np.int64), np.zeros(len(found))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row for each pivot
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["far"]
    cells = spark.sparkContext.broadcast(Cells(found, sizes, radii))
    largest = max(1, portion_bytes // (8 * width))
    starts, portions = _bins(cells.value, min(largest, max(ROWS, -(-int(sizes.sum()) // BINS))))
    here = np.zeros((len(found), int((starts + portions).max())), dtype=np.float32)  # which bins a cell has
    for c, (start, n) in enumerate(zip(starts, portions, strict=True)):
        here[c, start:start + n] = 1

    def compare(asking: DataFrame, choose) -> DataFrame:
        def bins(cells: Cells, part: pa.RecordBatch):
            far = cells.distances(_matrix(part.column("vec")))
            wanted = choose(cells, part, far)
            at, place = np.nonzero(wanted @ here)
            packed = np.packbits(wanted, axis=1)
            return at, place.astype(np.int32), far.argmin(axis=1).astype(np.int32)[at], [packed[i].tobytes() for i in at]

        looks = _spread(asking, bins, cells, "bin int, cell int, wants binary")
        asked = np.zeros(here.shape[1], dtype=np.int64)
        for r in looks.groupBy("bin").agg(F.count("*").alias("n")).collect():  # a row for each bin
            asked[r["bin"]] = r["n"]
        block = max(QUERIES, min(largest, -(-int(asked.max()) // BINS)))
        blocks = np.maximum(1, -(-asked // block))
        wanted = [int(c) for c in np.flatnonzero(asked)]
        dealt = (looks.select("bin", F.pmod(F.xxhash64("id"), _of(blocks, "bin")).cast("int").alias("block"),
                              F.lit(0).alias("kind"), "cell", "id", F.lit(None).cast("long").alias("y"), "vec", "bound", "wants")
                 .unionByName(placed.withColumn("bin", (_of(starts, "cell") + F.pmod(F.xxhash64("id", "vec"), _of(portions, "cell"))).cast("int"))
                              .filter(F.col("bin").isin(wanted))
                              .select("bin", F.explode(F.sequence(F.lit(0), (_of(blocks, "bin") - 1).cast("int"))).alias("block"), F.lit(1).alias("kind"), "cell",
                                      "id", "y", "vec", F.lit(None).cast("double").alias("bound"), F.lit(None).cast("binary").alias("wants"))))
        return _compared(dealt, k, int(blocks[asked > 0].sum()) or 1)

    best = Window.partitionBy("query").orderBy("d2", "id", "y")

    def top(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def first_cells(cells: Cells, part: pa.RecordBatch, far: np.ndarray) -> np.ndarray:
        return cells.first(far, k)

    def other_cells(cells: Cells, part: pa.RecordBatch, far: np.ndarray) -> np.ndarray:
        return cells.others(far, part.column("bound").to_numpy(zero_copy_only=False), k)

    infinite = F.lit(float("inf"))
    asking = written(queries.select("id", "vec"), "queries")
    first = written(top(compare(asking.withColumn("bound", infinite), first_cells)), "first")
    bounds = (first.groupBy("query").agg(F.count("*").alias("n"), F.max("d2").alias("d2")).filter(F.col("n") >= k)
              .select(F.col("query").alias("id"), F.sqrt("d2").alias("bound")))
    # Written, as it is read twice: to count each bin's queries, and to send them.
    bounded = written(asking.join(bounds, "id", "left").select("id", "vec", F.coalesce("bound", infinite).alias("bound")), "bounded")
    rest = compare(bounded, other_cells)
    return (top(first.drop("rank").unionByName(rest))
            .select("query", F.col("rank").cast("int").alias("rank"), "id", "y", F.sqrt("d2").alias("distance")))
