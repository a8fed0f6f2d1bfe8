"""Approximate nearest neighbours with balanced posting lists.

Largest inner products become least distances: vectors are scaled by the
greatest norm and get one more component that fills them up to length one;
queries are scaled to length one.  Centroids come from halving a bounded
sample again and again at the median between two centers, so that lists have
equal shares.  Centroids are searched by best-first search in a graph of near
centroids that every task holds in memory.

Every vector is listed at its nearest centroid, and at a boundary at others
almost as near as well.  A query looks into its nearest lists first, and then
into all whose centroids are at most ``ratio`` times as far as its nearest one,
which return only what is as good; the ratio is calibrated on the sample,
where it must reach ``RECALL``.  Scores of what is found are computed
from the original vectors in double precision, each pair by itself, so equal
vectors have equal scores.

Lists and their queries are cut into portions of bounded size; equal vectors
are searched as one, with the ids that can be among the nearest.

Rows: vectors that are null or zero, or hold a null or a component that isn't
finite, and rows with a null id take no part, nor do vectors of another length
than the most frequent (of equally frequent ones the shortest).  Rows with
equal ids are candidates each; a query's own id is none.  Equal scores are
ordered by id.  An empty table gives no rows.  Only the two named columns are
read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, StructType, _parse_datatype_string

from tessera.llm import shared

NEAREST = 20
#: Distinct vectors that the centroids and the ratio are learned from, at most.
SAMPLE = 16_384
#: Distinct vectors for each list, and the most lists: centroids stay in memory.
LIST, MAX_LISTS = 512, 2048
#: Neighbours of a centroid in the graph.
DEGREE = 24
#: Lists that a vector is in at most, and how much farther than the nearest.
REPLICAS, CLOSURE = 2, 1.04
#: Share of the sample's nearest neighbours that the ratio must find.
RECALL = 0.985
#: Vectors and queries of a list that one task compares.
PORTION, QUERIES = 16_384, 4096
#: By which single-precision products of vectors up to length one may be off.
SLACK = 2e-5


@dataclass
class Index:
    """What every task holds: centroids, their graph, entry points, and the
    ratio for queries; scale is the greatest norm."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    scale: float
    ratio: float
    kind: str


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1).astype(np.float64)


def lifted(x: np.ndarray, scale: float, query: bool) -> np.ndarray:
    """Vectors scaled by the greatest norm and filled up to length one, or
    queries scaled to length one, in single precision."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    if query:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        rest = np.zeros((len(x), 1))
    else:
        x = x * (top / scale)
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.square(x).sum(axis=1, keepdims=True)))
    return np.hstack([x, rest]).astype(np.float32)


def _distance(dots: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """From vectors of length one to centroids of squared norms."""
    return np.sqrt(np.maximum(1.0 + norms - 2.0 * dots, 0.0))


def halved(points: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of as many parts of equal size: each part is cut at the
    median between two centers that follow its halves."""
    random = np.random.default_rng(seed)
    parts = [np.arange(len(points))]
    while 2 * len(parts) <= lists:
        following = []
        for part in parts:
            x = points[part]
            a, b = x[random.choice(len(x), 2, replace=False)]
            for _ in range(8):
                near = x @ (b - a)
                order = np.argsort(near, kind="stable")
                a, b = x[order[:len(x) // 2]].mean(axis=0), x[order[len(x) // 2:]].mean(axis=0)
            following += [part[order[:len(x) // 2]], part[order[len(x) // 2:]]]
        parts = following
    return np.stack([points[part].mean(axis=0) for part in parts]).astype(np.float32)


def neighbour_graph(centroids: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Nearest centroids of each one; the last of a row links all in a ring, so
    that every centroid can be reached."""
    n = len(centroids)
    norms = np.square(centroids).sum(axis=1)
    apart = norms - 2.0 * centroids @ centroids.T
    np.fill_diagonal(apart, np.inf)
    near = np.argsort(apart, axis=1, kind="stable")[:, :min(degree, n) - 1] if n > 1 else np.zeros((1, 0), dtype=np.int64)
    return np.hstack([near, ((np.arange(n) + 1) % n)[:, None]])


def search(index: Index, points: np.ndarray, ratio: float, least: int) -> np.ndarray:
    """Distances from points to the centroids that best-first search meets
    (infinite for the others): it goes on from all that are at most ``ratio``
    times as far as the nearest, and from the ``least`` nearest."""
    n, lists = len(points), len(index.centroids)
    norms = np.square(index.centroids).sum(axis=1)
    apart = np.full((n, lists), np.inf, dtype=np.float32)
    apart[:, index.entries] = _distance(points @ index.centroids[index.entries].T, norms[index.entries])
    done = np.zeros((n, lists), dtype=bool)
    least = min(least, lists)
    active = np.arange(n)
    while len(active):
        own = apart[active]
        bound = np.maximum(own.min(axis=1) * ratio, np.partition(own, least - 1, axis=1)[:, least - 1])
        ahead = np.isfinite(own) & ~done[active] & (own <= bound[:, None])
        rows, nodes = np.nonzero(ahead)
        done[active[rows], nodes] = True
        target = (active[rows][:, None] * lists + index.graph[nodes]).ravel()
        fresh = np.zeros(n * lists, dtype=bool)
        fresh[target] = True
        target = np.flatnonzero(fresh & ~np.isfinite(apart.ravel()))
        for k in range(0, len(target), 1 << 16):
            i, c = np.divmod(target[k:k + (1 << 16)], lists)
            apart[i, c] = _distance(np.einsum("nd,nd->n", points[i], index.centroids[c]), norms[c])
        active = active[ahead.any(axis=1)]
    return apart


def listed(index: Index, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Point and list of every posting: the nearest centroid and, at a
    boundary, others almost as near."""
    apart = search(index, points, CLOSURE, 8)
    order = np.argsort(apart, axis=1, kind="stable")[:, :REPLICAS]
    far = np.take_along_axis(apart, order, axis=1)
    rows, at = np.nonzero(np.isfinite(far) & (far <= far[:, :1] * CLOSURE))
    return rows, order[rows, at]


def probed(index: Index, points: np.ndarray, sizes: np.ndarray, wanted: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Query and list of every look: the ``first`` ones, at the nearest lists
    until ``wanted`` vectors are listed, or the others within the ratio."""
    ratio = index.ratio
    while True:
        apart = search(index, points, ratio, 8)
        order = np.argsort(apart, axis=1, kind="stable")
        far = np.take_along_axis(apart, order, axis=1)
        found = np.isfinite(far)
        before = np.cumsum(np.where(found, sizes[order], 0), axis=1) - sizes[order]
        chosen = found & ((before < wanted) if first else (before >= wanted) & (far <= far[:, :1] * index.ratio))
        if found.all() or (np.where(found, sizes[order], 0).sum(axis=1) >= min(wanted, sizes.sum())).all():
            rows, at = np.nonzero(chosen)
            return rows, order[rows, at]
        ratio = ratio * 1.5 + 0.1


def calibrated(index: Index, points: np.ndarray, asked: np.ndarray, nearest: int) -> float:
    """The least ratio with which that share of the asked points' nearest
    sample points are in lists that are looked into."""
    rows, lists = listed(index, points)
    queries = points[asked].copy()
    queries[:, -1] = 0
    length = np.linalg.norm(queries, axis=1, keepdims=True)
    queries = np.divide(queries, length, out=np.zeros_like(queries), where=length > 0)
    dots = queries @ points.T
    dots[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-dots, axis=1, kind="stable")[:, :min(nearest, len(points) - 1)]
    apart = _distance(queries @ index.centroids.T, np.square(index.centroids).sum(axis=1))
    best = np.full((len(points), REPLICAS), -1)
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    best[rows, place] = lists
    own = best[near]  # query, neighbour, replica
    far = np.where(own >= 0, np.take_along_axis(apart, np.maximum(own, 0).reshape(len(asked), -1), axis=1).reshape(own.shape), np.inf).min(axis=2)
    return float(np.quantile(far / apart.min(axis=1, keepdims=True), RECALL)) if far.size else 1.0


def fit(classes: DataFrame, kind: str, scale: float, n: int, nearest: int, size: int) -> Index:
    """The index of a bounded sample of the distinct vectors."""
    rows = classes.orderBy(F.xxhash64("same"), "same").limit(SAMPLE).select("vec").collect()
    points = lifted(_matrix(pa.array([bytes(r["vec"]) for r in rows]), kind), scale, False)
    lists = max(1, min(MAX_LISTS, n // size, len(points) // 4))
    centroids = halved(points, lists)
    entries = np.unique(np.linspace(0, len(centroids) - 1, 8).astype(int))
    index = Index(centroids, neighbour_graph(centroids), entries, scale, 1.0, kind)
    index.ratio = calibrated(index, points, np.arange(min(512, len(points))), nearest)
    return index


def _vectors(table: DataFrame, vec: str, key: str) -> tuple[DataFrame, str]:
    """``id``, ``dim``, ``norm``, ``vec`` (bytes) and ``same`` (its digest) of
    the rows that take part, before lengths are compared; and the bytes' kind."""
    single = isinstance(table.schema[vec].dataType, ArrayType) and isinstance(table.schema[vec].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    rows = table.select(F.col(f"`{key}`").cast("long").alias("id"),
                        F.col(f"`{vec}`").cast("array<float>" if single else "array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    schema = _parse_datatype_string("id long, dim int, norm double, vec binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = np.array(v if None not in v else [], dtype=np.float64)
                top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                if top:
                    norm = min(float(top) * float(np.linalg.norm(x / top)), np.finfo(np.float64).max)
                    out.append((i, len(x), norm, x.astype(kind).tobytes()))
            if out:
                yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return shared.map_arrow(rows, run, schema).withColumn("same", F.unhex(F.sha2("vec", 256))), kind


def _portions(sizes: dict[int, int], most: int) -> Column:
    """Portions of each list; ``sizes`` has at most MAX_LISTS entries."""
    array = [0] * (max(sizes, default=0) + 1)
    for at, n in sizes.items():
        array[at] = max(1, -(-n // most))
    return F.element_at(F.lit(array), F.col("list") + 1)


class _Best:
    """The nearest found so far for each query of a block."""

    def __init__(self, vectors: np.ndarray, least: np.ndarray, scale: float, nearest: int):
        self.vectors, self.scale, self.nearest = vectors, scale, nearest
        self.light = lifted(vectors, scale, True)
        self.norms = np.linalg.norm(vectors / scale, axis=1)
        self.least = self._light(least, np.arange(len(vectors)))
        self.found = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))

    def _light(self, scores: np.ndarray, which: np.ndarray) -> np.ndarray:
        """What the products in single precision of as good a vector reach."""
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            worst = scores / self.scale / self.scale / self.norms[which]
        return np.nan_to_num(worst, nan=-np.inf, neginf=-np.inf) - SLACK

    def add(self, ids: np.ndarray, firsts: np.ndarray, vectors: np.ndarray) -> None:
        dots = self.light @ lifted(vectors, self.scale, False).T
        bound = self.least
        if len(ids) >= self.nearest:
            bound = np.maximum(bound, np.partition(dots, -self.nearest, axis=1)[:, -self.nearest] - SLACK)
        query, at = np.nonzero(dots >= bound[:, None])
        scores = np.concatenate([(self.vectors[query[k:k + 65536]] * vectors[at[k:k + 65536]]).sum(axis=1)
                                 for k in range(0, max(1, len(query)), 65536)])
        query, names, least, scores = (np.concatenate(x) for x in zip(self.found, (query, ids[at], firsts[at], scores), strict=True))
        order = np.lexsort((least, -scores, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[place < self.nearest]
        self.found = query[order], names[order], least[order], scores[order]
        last = np.flatnonzero(np.bincount(self.found[0], minlength=len(self.least)) == self.nearest)
        ends = np.searchsorted(self.found[0], last, side="right") - 1
        self.least[last] = np.maximum(self.least[last], self._light(self.found[3][ends], last))


def _compared(dealt: DataFrame, index, nearest: int) -> DataFrame:
    """``asked``, ``found``, ``first`` and ``score``: the nearest of a portion
    of a list for each query of a block, but for those below the query's
    ``least`` score.  Rows come by list and portions, queries first."""
    schema = _parse_datatype_string("asked long, found long, first long, score double")
    group = ["list", "portion", "block"]
    sorted_ = dealt.repartition(*group).sortWithinPartitions(*group, "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, current, names, rows, least, best = to_arrow_schema(schema), None, [], [], [], None
        kind, scale = index.value.kind, index.value.scale

        def closed() -> pa.RecordBatch:
            query, found, first, score = best.found
            return pa.record_batch([pa.array(np.concatenate(names)[query]), pa.array(found), pa.array(first), pa.array(score)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*group, "kind")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                for start in range(start, stop, 1024):
                    part = batch.slice(start, min(stop, start + 1024) - start)
                    key, asks = tuple(keys[start][:3]), keys[start][3] == 0
                    if key != current:
                        if best is not None:
                            yield closed()
                        current, names, rows, least, best = key, [], [], [], None
                    ids, vectors = part.column("id").to_numpy(), _matrix(part.column("vec"), kind)
                    if asks:
                        names.append(ids)
                        rows.append(vectors)
                        least.append(part.column("least").to_numpy(zero_copy_only=False))
                    elif rows:
                        if best is None:
                            best = _Best(np.concatenate(rows), np.concatenate(least), scale, nearest)
                        best.add(ids, part.column("first").to_numpy(zero_copy_only=False).astype(np.int64), vectors)
        if best is not None:
            yield closed()

    return shared.map_arrow(sorted_, run, schema)


def nearest_neighbours(table: DataFrame, queries: Column, nearest: int = NEAREST, size: int = LIST, vec: str = "embedding",
                       key: str = "vec_id") -> DataFrame:
    """``query_id``, ``rank``, ``key`` and ``score`` of the nearest rows found
    for the rows whose ``id`` fulfils ``queries``."""
    spark = table.sparkSession
    made, kind = _vectors(table, vec, key)
    made = shared.written(made, "vectors")
    result = _parse_datatype_string(f"query_id long, rank int, `{key}` long, score double")
    length = made.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).head()
    if length is None:
        return spark.createDataFrame([], result)
    rows = made.filter(F.col("dim") == length["dim"])
    # The ids of equal vectors that can be among the nearest; rows beyond are
    # dropped before the shuffle too (by the group limit of the window).
    own = Window.partitionBy("same").orderBy("id")
    classes = shared.written(rows.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= nearest + 1)
                             .groupBy("same").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"),
                                                  F.first("vec").alias("vec"), F.max("norm").alias("norm")), "classes")
    total = classes.agg(F.max("norm").alias("scale"), F.count("*").alias("n")).head()
    # Every class by a number of its own, since an id may have several vectors.
    classes = shared.written(classes.withColumn("class", F.monotonically_increasing_id()), "numbered")
    index = fit(classes, kind, total["scale"], total["n"], nearest, size)
    sent = spark.sparkContext.broadcast(index)

    def spread(rows: DataFrame, name: str, lists) -> DataFrame:
        """The rows, once for each of their lists."""
        listing = StructType([*rows.schema.fields, *_parse_datatype_string("list int").fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrow = to_arrow_schema(listing)
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    at, own = lists(sent.value, _matrix(part.column("vec"), sent.value.kind))
                    yield pa.record_batch([*(c.take(pa.array(at)) for c in part.columns), pa.array(own.astype(np.int32))], schema=arrow)

        return shared.written(shared.map_arrow(rows, run, listing), name)

    def sizes(rows: DataFrame) -> dict[int, int]:
        return {r["list"]: r["n"] for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}

    postings = spread(classes.select(F.col("class").alias("id"), F.col("id").alias("first"), "vec"), "postings",
                      lambda index, x: listed(index, lifted(x, index.scale, False)))
    held = sizes(postings)
    counts = np.array([held.get(k, 0) for k in range(len(index.centroids))])
    asked = rows.filter(queries).select(F.col("id").alias("query_id"), "same")
    asking = classes.join(asked.select("same").distinct(), "same", "left_semi").select(F.col("class").alias("id"), "vec")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "first", "found")

    def best_of(found: DataFrame) -> DataFrame:
        return found.distinct().withColumn("place", F.row_number().over(best)).filter(F.col("place") <= nearest + 1)

    def looked(asking: DataFrame, first: bool) -> DataFrame:
        """The best that the queries find in their first lists, or the others."""
        looks = spread(asking, "looks", lambda index, x: probed(index, lifted(x, index.scale, True), counts, 4 * (nearest + 1), first))
        portions, cut = _portions(held, PORTION), _portions(sizes(looks), QUERIES)
        every = looks.select("list").distinct()  # at most MAX_LISTS rows
        dealt = (looks.select("list", F.explode(F.sequence(F.lit(0), portions - 1)).alias("portion"),
                              F.pmod(F.xxhash64("id"), cut).cast("int").alias("block"), F.lit(0).alias("kind"), "id",
                              F.lit(None).cast("long").alias("first"), "least", "vec")
                 .unionByName(postings.join(F.broadcast(every), "list", "left_semi")
                              .select("list", F.pmod(F.xxhash64("id"), portions).cast("int").alias("portion"),
                                      F.explode(F.sequence(F.lit(0), cut - 1)).alias("block"), F.lit(1).alias("kind"), "id", "first",
                                      F.lit(None).cast("double").alias("least"), "vec")))
        return shared.written(best_of(_compared(dealt, sent, nearest + 1)), "found")

    # What a query finds at its nearest lists bounds what others must offer.
    ahead = looked(asking.withColumn("least", F.lit(float("-inf"))), True)
    least = (ahead.groupBy("asked").agg(F.min("score").alias("worst"), F.count("*").alias("n")).filter(F.col("n") > nearest)
             .select(F.col("asked").alias("id"), "worst"))
    rest = looked(asking.join(least, "id", "left").select("id", "vec", F.coalesce("worst", F.lit(float("-inf"))).alias("least")), False)
    found = best_of(ahead.unionByName(rest).drop("place"))
    names = classes.select(F.col("class").alias("found"), "ids")
    top = found.join(names, "found").groupBy("asked").agg(F.collect_list(F.struct("score", "ids")).alias("all"))
    flat = F.expr(f"slice(array_sort(flatten(transform(all, x -> transform(x.ids, i -> struct(-x.score AS far, i AS id))))), 1, {2 * nearest + 2})")
    near = top.join(classes.select(F.col("class").alias("asked"), "same"), "asked").select("same", flat.alias("near"))
    mine = F.expr(f"slice(filter(near, x -> x.id <> query_id), 1, {nearest})")
    return (asked.join(near, "same").select("query_id", F.posexplode(mine).alias("place", "x"))
            .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias(key), (-F.col("x.far")).alias("score")))


def op12_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product for every twentieth id."""
    return nearest_neighbours(shared.read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
