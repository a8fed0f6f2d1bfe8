"""Embedding near-duplicates by a dual traversal of cover trees.

The upper part of the tree is a farthest-first (nested) set of centers from a
bounded sample; every vector goes to its nearest center, each center's exact
covering radius is taken over all of its vectors, and pairs of centers farther
apart than the threshold and both radii are pruned.  Below, a center's vectors
are cut into blocks of bounded size, each with a cover tree of its own: nested
levels whose radii halve, as far as most nodes have several vectors.  Two
blocks' trees are traversed together, level by level; a pair of nodes is dropped
when their centers are farther apart than the threshold and both covering radii,
and links as a whole when they are nearer than the threshold less both.  Blocks
are dealt in groups of near cells, so that a block is sent once for each group
that it may meet.  What is left are the exact pairs.

Where vectors are scattered, radii rule out nearly nothing, and most of a
block's vectors are children of its root.  Their pairs are first bounded by a
few axes of great variance: the cosine is at most the dot product on them plus
the product of the norms of what they leave.  Only pairs that this bound lets
through are compared in full.

Equal vectors are merged first.  A task returns counts of links and a star of
each group that its pairs join, never the pairs.

Rows: a vector that is null or zero, or holds a null or a component that is
not finite, links with nothing, as do vectors of different lengths and rows
with a null id (which are kept and have no component).  Rows of equal ids and
vectors link with each other; ids are taken to name one vector, so rows of
equal ids and different vectors share their links and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.llm import shared
from tessera.llm.components import components

THRESHOLD = 0.9
#: Rows from which the upper centers are chosen, and centers, at most.
SAMPLE, MAX_CENTERS = 4096, 1024
#: Vectors of a block; a center has more of them the more vectors it covers.
BLOCK = 2048
#: Bytes in double precision of a group's blocks, if they are as full as all
#: are on average; a task holds those of one group while it meets others'.
#: Groups of a table, if that allows.
GROUP_BYTES, GROUPS = 64 << 20, 6
#: Radii of the levels of a block's tree; the last level are the vectors.
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: By which single-precision distances may be off.
SLACK = 2e-3


#: Relative times of a pair of vectors, of each component that is multiplied
#: for it, and of its exact comparison; up to so many components axes are turned.
PAIR, COMPONENT, EXACT, MOST_TURNED = 0.25, 0.04, 300.0, 1024
#: Rows of a tile of dot products, and bytes of vectors that are held against the centers at once.
TILE, SLICE = 512, 1 << 20


def _raw(rows: list[bytes], dim: int) -> np.ndarray:
    """Vectors from their bytes, which are in single precision where that loses nothing."""
    if all(len(r) == 4 * dim for r in rows):
        return np.frombuffer(b"".join(rows), "<f4").reshape(-1, dim)
    return np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8").astype("<f8") for r in rows])


def _units(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


def _cut(threshold: float) -> np.float32:
    """A single-precision dot product below which two vectors don't link."""
    return np.float32(1 - (np.sqrt(2 - 2 * threshold) + SLACK) ** 2 / 2)


def farthest_first(units: np.ndarray, most: int) -> np.ndarray:
    """Indices of centers, each farthest from those before it: any beginning
    of the list is a level of the tree."""
    chosen, near = [0], _distance(units @ units[0])
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distance(units @ units[chosen[-1]]))
    return np.array(chosen)


def sketch(units: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Coordinates on the axes (orthonormal columns) and the norm of what they
    leave: the dot product of two sketches is no less than that of the vectors."""
    if axes is None:
        return units.astype(np.float32)
    seen = units @ axes
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("nd,nd->n", seen, seen)))
    return np.column_stack([seen, rest]).astype(np.float32)


def sketch_axes(units: np.ndarray, threshold: float) -> np.ndarray | None:
    """As many axes of greatest variance as make comparisons of the sample's
    vectors cheapest; None if that is all components."""
    dim, half = units.shape[1], min(len(units) // 2, BLOCK)
    if half < 2 or dim > MOST_TURNED:
        return None
    axes = np.linalg.eigh(np.cov(units.T))[1][:, ::-1]
    cut, best, least, k = _cut(threshold), None, PAIR + COMPONENT * dim, 8
    while k < dim:
        sketches = sketch(units, axes[:, :k])
        passed = (sketches[:half] @ sketches[half:2 * half].T >= cut).mean()
        if (cost := PAIR + COMPONENT * (k + 1) + EXACT * passed) < least:
            best, least = k, cost
        k += max(8, k // 16 * 8)
    return None if best is None else np.ascontiguousarray(axes[:, :best])


def build(units: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """A block's tree: the order of its vectors in which every node is a run,
    and for each level the starts, centers and covering radii of its nodes."""
    n = len(units)
    apart = _distance((units.astype(np.float32) @ units.T.astype(np.float32)))
    np.fill_diagonal(apart, 0)
    labels = [np.zeros(n, dtype=np.int64)]
    for radius in RADII:
        # A level (and all below it) in which most nodes are one vector rules out nothing.
        if 2 * np.count_nonzero(np.count_nonzero(apart <= radius, axis=1) == 1) > n:
            break
        label = labels[-1].copy()
        for center in np.unique(label):
            members = np.flatnonzero(labels[-1] == center)
            at = int(center)
            while len(members) > 1:  # the node's own center stays one
                covered = apart[at, members] <= radius
                covered |= members == at
                label[members[covered]] = at
                members = members[~covered]
                if len(members):
                    at = int(members[0])
            label[members] = members
        if 2 * len(np.unique(label)) > n:
            break
        labels.append(label)
    labels.append(np.arange(n))
    order = np.lexsort(labels[::-1])
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    levels = []
    for label in labels:
        own = label[order]
        starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1]) if n else np.empty(0, dtype=np.int64)
        reach = apart[own, order]
        levels.append((starts, place[own[starts]], np.maximum.reduceat(reach, starts).astype(np.float64)))
    return order, levels


def _children(upper: np.ndarray, lower: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end child of each node, from the starts of two levels."""
    return np.searchsorted(lower, upper), np.searchsorted(lower, np.append(upper[1:], n))


def _beyond(a: np.ndarray, b: np.ndarray, cut: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose dot product is at least ``cut``."""
    room, across, at, to = np.empty((min(TILE, len(a)), len(b)), dtype=np.float32), np.ascontiguousarray(b.T), [], []
    for k in range(0, len(a), TILE):
        dots = np.matmul(a[k:k + TILE], across, out=room[:len(a) - k])
        met = np.flatnonzero(dots.max(axis=1) >= cut)  # few rows meet any
        x, y = np.nonzero(dots[met] >= cut)
        at.append(met[x] + k)
        to.append(y)
    return np.concatenate(at), np.concatenate(to)


def _rows(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """These rows, in single precision."""
    whole = len(at) == len(x) and (at == np.arange(len(x))).all()
    return (x if whole else x[at]).astype(np.float32, copy=False)


def _near_children(ci: np.ndarray, low_a: tuple, a: np.ndarray, sketch_a: np.ndarray, cj: np.ndarray, low_b: tuple,
                   b: np.ndarray, sketch_b: np.ndarray, limit: float, cut: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the children of two nodes that no bound rules out.  Distances
    stay dot products; children of one vector, which are most of them where
    vectors are scattered, have one bound, and their sketches meet it first."""
    at, to = [], []
    for one in (True, False):
        own = ci[(low_a[2][ci] == 0) == one]
        for other in (True, False):
            across = cj[(low_b[2][cj] == 0) == other]
            if not len(own) or not len(across):
                continue
            if one and other:
                x, y = _beyond(_rows(sketch_a, low_a[1][own]), _rows(sketch_b, low_b[1][across]), cut)
            else:
                dots = _rows(a, low_a[1][own]) @ _rows(b, low_b[1][across]).T
                reach = limit + SLACK + low_a[2][own][:, None].astype(np.float32) + low_b[2][across].astype(np.float32)
                x, y = np.nonzero(dots >= 1 - reach * reach / 2)
            at.append(own[x])
            to.append(across[y])
    return (np.concatenate(at), np.concatenate(to)) if at else (ci[:0], cj[:0])


def apart(of_a: list, of_b: list, a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the roots' covering radii rule out every pair of two blocks."""
    (_, (at,), (far,)), (_, (to,), (reach,)) = of_a[0], of_b[0]
    return bool(_distance(a[at] @ b[to]) > np.sqrt(2 - 2 * threshold) + far + reach + SLACK)


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have cosine >= threshold."""
    fit = np.empty(len(i), dtype=bool)
    for k in range(0, len(i), 1 << 18):
        p, q = i[k:k + (1 << 18)], j[k:k + (1 << 18)]
        in_a, in_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        in_a[p], in_b[q] = True, True
        if np.count_nonzero(in_a) * np.count_nonzero(in_b) > 8 * len(p):
            fit[k:k + (1 << 18)] = np.einsum("nd,nd->n", a[p], b[q]) >= threshold
            continue
        # Many pairs of few vectors: one product, of which only what rounding may decide is done again.
        dots = (a[in_a] @ b[in_b].T)[(np.cumsum(in_a) - 1)[p], (np.cumsum(in_b) - 1)[q]]
        close = np.flatnonzero(np.abs(dots - threshold) < 1e-12)
        dots[close] = np.einsum("nd,nd->n", a[p[close]], b[q[close]])
        fit[k:k + (1 << 18)] = dots >= threshold
    return fit


def traverse(a: np.ndarray, of_a: list, b: np.ndarray, of_b: list, threshold: float, same: bool,
             sketch_a: np.ndarray | None = None, sketch_b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of vectors of two blocks with cosine >= threshold."""
    limit, cut = float(np.sqrt(2 - 2 * threshold)), _cut(threshold)
    if sketch_a is None or sketch_b is None:
        sketch_a, sketch_b = a.astype(np.float32), b.astype(np.float32)
    i, j = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    depth = max(len(of_a), len(of_b))
    of_a, of_b = of_a + of_a[-1:] * (depth - len(of_a)), of_b + of_b[-1:] * (depth - len(of_b))
    sure_i, sure_j = [], []
    for level, ((up_a, low_a), (up_b, low_b)) in enumerate(zip(pairwise(of_a), pairwise(of_b), strict=True), 2):
        first_a, end_a = _children(up_a[0], low_a[0], len(a))
        first_b, end_b = _children(up_b[0], low_b[0], len(b))
        wide, high = (end_a - first_a)[i], (end_b - first_b)[j]
        many = wide * high
        kept_i, kept_j = [], []
        # Node pairs of many children alone, the others in portions, so that their children's pairs stay few.
        alone, rest = np.flatnonzero(many >= 4096), np.flatnonzero(many < 4096)
        for part in [*alone[:, None], *np.split(rest, np.flatnonzero(np.diff(np.cumsum(many[rest]) // (1 << 20))) + 1)]:
            if not len(part):
                continue
            if len(part) == 1:
                x, y = _near_children(np.arange(first_a[i[part[0]]], end_a[i[part[0]]]), low_a, a, sketch_a,
                                      np.arange(first_b[j[part[0]]], end_b[j[part[0]]]), low_b, b, sketch_b, limit, cut)
            else:
                which = np.repeat(part, many[part])
                step = np.arange(len(which)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
                x, y = first_a[i[which]] + step // high[which], first_b[j[which]] + step % high[which]
                fit = np.empty(len(x), dtype=bool)
                for k in range(0, len(x), 1 << 17):
                    p, q = x[k:k + (1 << 17)], y[k:k + (1 << 17)]
                    apart = _distance(np.einsum("nd,nd->n", a[low_a[1][p]], b[low_b[1][q]]))
                    fit[k:k + (1 << 17)] = apart <= limit + SLACK + low_a[2][p] + low_b[2][q]
                x, y = x[fit], y[fit]
            if same:
                x, y = x[x <= y], y[x <= y]
            kept_i.append(x)
            kept_j.append(y)
        i = np.concatenate(kept_i) if kept_i else np.empty(0, dtype=np.int64)
        j = np.concatenate(kept_j) if kept_j else np.empty(0, dtype=np.int64)
        if level < depth and len(i):
            # Nodes so near that all pairs of their vectors link are not gone into.
            across = _distance(np.concatenate([np.einsum("nd,nd->n", a[low_a[1][i[k:k + (1 << 17)]]], b[low_b[1][j[k:k + (1 << 17)]]])
                                               for k in range(0, len(i), 1 << 17)]))
            reach = low_a[2][i] + low_b[2][j]
            sure, open_ = across + reach <= limit - SLACK, across - reach <= limit + SLACK
            x, y = i[sure], j[sure]
            x, y = _runs(low_a[0][x], np.append(low_a[0][1:], len(a))[x], low_b[0][y], np.append(low_b[0][1:], len(b))[y])
            sure_i.append(x)
            sure_j.append(y)
            i, j = i[open_ & ~sure], j[open_ & ~sure]
    fit = _exact(a, b, i, j, threshold)
    i, j = np.concatenate([*sure_i, i[fit]]), np.concatenate([*sure_j, j[fit]])
    return (i[i < j], j[i < j]) if same else (i, j)


def _runs(first_a: np.ndarray, end_a: np.ndarray, first_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the members of two runs, for many two runs."""
    wide, high = end_a - first_a, end_b - first_b
    many = wide * high
    at, to = [], []
    for k in np.flatnonzero(many >= 4096):
        at.append(np.repeat(np.arange(first_a[k], end_a[k]), high[k]))
        to.append(np.tile(np.arange(first_b[k], end_b[k]), wide[k]))
    part = np.flatnonzero(many < 4096)
    which = np.repeat(part, many[part])
    step = np.arange(len(which)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
    return np.concatenate([*at, first_a[which] + step // high[which]]), np.concatenate([*to, first_b[which] + step % high[which]])


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's group under the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _slots(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a number that ``repartition`` by it brings there."""
    found = (spark.range(16 * n, numPartitions=1).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at"))
             .agg(F.min("id").alias("id")).collect())
    slots = list(range(n))
    for r in found:
        slots[r["at"]] = r["id"]
    return slots


def near_pairs(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, sample: int = SAMPLE,
               max_centers: int = MAX_CENTERS) -> DataFrame:
    """``id``, ``links`` (summed weight of the linked classes) and ``group``
    (an id that it is joined with) for the classes ``(id, weight, dim, vec)``
    that have a link; several rows for an id may have to be added up."""
    spark = classes.sparkSession
    sizes = classes.groupBy("dim").agg(F.count("*").alias("n")).collect()  # one row for each length
    centers: dict[int, np.ndarray] = {}
    axes: dict[int, np.ndarray | None] = {}
    for r in sizes:
        most, hashed = min(max_centers, max(1, r["n"] // block)), F.xxhash64("vec")
        # Only about as many rows as the sample has are sorted and reach the driver.
        share = (sample + 6 * np.sqrt(sample) + 20) / r["n"]
        low = F.col("dim") == r["dim"] if share >= 1 else (F.col("dim") == r["dim"]) & (hashed < int((share - 0.5) * 2**64))
        rows = classes.filter(low).orderBy(hashed, "id").limit(sample).select("vec").collect()
        units = _units(_raw([bytes(x["vec"]) for x in rows], r["dim"]))
        centers[r["dim"]] = units[farthest_first(units, most)]
        axes[r["dim"]] = sketch_axes(units, threshold)
    sent = spark.sparkContext.broadcast(centers)

    def assign(radii: dict[int, np.ndarray] | None = None):
        """The cell of each vector and the distance from its center.  With the
        cells' radii, only a cell that covers it: of two that are equally near,
        rounding may have chosen the other before."""
        def apply(batch):
            dims, rows = np.array(batch.column("dim")), batch.column("vec").to_pylist()
            cell, far = np.zeros(len(rows), dtype=np.int32), np.zeros(len(rows))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                apart = _distance(_units(_raw([rows[k] for k in at], dim)) @ sent.value[dim].T)
                if radii is not None:
                    apart[apart > radii[dim] + 1e-6] = np.inf
                cell[at], far[at] = apart.argmin(axis=1), apart.min(axis=1)
            return {n: batch.column(n) for n in batch.schema.names} | {"cell": cell, "far": far}

        return apply

    # At most max_centers rows for each length of vectors.
    cells = (shared.map_slices(classes.select("dim", "vec"), assign, "dim int, cell int, far double", "vec", SLICE)
             .groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect())
    limit = float(np.sqrt(2 - 2 * threshold))
    radii, near, blocks = {}, [], []
    for dim in centers:
        own = sorted((c for c in cells if c["dim"] == dim), key=lambda c: c["cell"])
        if not own:
            continue
        at, reach = np.array([c["cell"] for c in own]), np.array([c["radius"] for c in own])
        radii[dim] = np.full(len(centers[dim]), -1.0)
        radii[dim][at] = reach
        counts = np.array([-(-c["n"] // block) for c in own])
        apart_ = _distance(centers[dim][at] @ centers[dim][at].T)
        # Cells in a chain of near centers, so that groups of blocks lie together.
        chain, left = [0], set(range(1, len(own)))
        while left:
            chain.append(min(left, key=lambda c: (apart_[chain[-1], c], c)))
            left.remove(chain[-1])
        before = np.zeros(len(own), dtype=np.int64)
        before[chain] = np.cumsum(counts[chain]) - counts[chain]
        # A task compares the blocks of two groups: the larger they are, the
        # less often a block is sent.
        fill = sum(c["n"] for c in own) / counts.sum()
        size = int(min(max(1, GROUP_BYTES // (8 * dim * fill)), -(-counts.sum() // GROUPS)))
        blocks += [(dim, int(c), int(n), int(k), size) for c, n, k in zip(at, counts, before, strict=True)]
        first, last = before // size, (before + counts - 1) // size
        meet = np.zeros((last.max() + 1, last.max() + 1), dtype=bool)
        for p, q in zip(*np.nonzero(np.triu(apart_ <= limit + reach[:, None] + reach + SLACK)), strict=True):
            meet[first[p]:last[p] + 1, first[q]:last[q] + 1] = True
        # A task holds a group and meets two with it, one of which may be itself.
        meet |= meet.T
        for a in range(len(meet)):
            met = [a] * bool(meet[a, a]) + [int(b) for b in np.flatnonzero(meet[a]) if b != a and (abs(b - a) % 2 == 1) == (a < b)]
            near += [(dim, a, met[k:k + 2]) for k in range(0, len(met), 2)]
    if not blocks:
        return spark.createDataFrame([], "id long, links long, group long")
    counts = spark.createDataFrame(blocks, "dim int, cell int, blocks int, before long, size int")
    portion = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    assigned = shared.map_slices(classes.select("id", "weight", "dim", "vec"), lambda: assign(radii),
                                 "id long, weight long, dim int, vec binary, cell int", "vec", SLICE)
    dealt = (assigned.join(F.broadcast(counts), ["dim", "cell"]).withColumn("portion", portion)
             .select("dim", "cell", "portion", "id", "weight", "vec")
             .repartition("dim", "cell", "portion").sortWithinPartitions("dim", "cell", "portion", "id"))
    schema = _parse_datatype_string("dim int, cell int, portion int, ids binary, weights binary, matrix binary, "
                                    "starts array<binary>, centers array<binary>, radii array<binary>")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, current, rows = to_arrow_schema(schema), None, []

        def close() -> pa.RecordBatch:
            ids, weights, vectors = zip(*rows, strict=True)
            raw = _raw(vectors, current[0])
            order, levels = build(_units(raw))
            row = [*current, np.array(ids)[order].tobytes(), np.array(weights)[order].tobytes(), raw[order].tobytes(),
                   *([x[p].tobytes() for x in levels] for p in range(3))]
            return pa.record_batch([pa.array([v], type=f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in shared.slices(batches, "vec"):
            lists = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for name, row in zip(zip(lists["dim"], lists["cell"], lists["portion"], strict=True),
                                 zip(lists["id"], lists["weight"], lists["vec"], strict=True), strict=True):
                if name != current:
                    if rows:
                        yield close()
                    current, rows = name, []
                rows.append(row)
        if rows:
            yield close()

    # Not written: they are sent on at once, and rebuilt from what was dealt if a task is lost.
    grouped = (shared.map_arrow(dealt, trees, schema).join(F.broadcast(counts), ["dim", "cell"])
               .withColumn("own", F.expr("CAST((before + portion) DIV size AS INT)")).drop("blocks", "before", "size"))
    # Tasks that take longest come first; pairs inside a group are half as many.
    near.sort(key=lambda x: -sum(1.0 if b != x[1] else 0.5 for b in x[2]))
    slots = _slots(spark, len(near))
    sides = spark.createDataFrame([(dim, own, k, slots[k], a, a in met) for k, (dim, a, met) in enumerate(near) for own in {a, *met}],
                                  "dim int, own int, task int, slot long, a int, inside boolean")
    dealt_blocks = (grouped.join(F.broadcast(sides), ["dim", "own"]).repartition(len(near), "slot")
                    .sortWithinPartitions("task", F.col("own") != F.col("a"), "own", "cell", "portion"))
    out = _parse_datatype_string("id long, links long, group long")
    turned = spark.sparkContext.broadcast(axes)

    def dual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, current, held = to_arrow_schema(out), None, []
        for batch in shared.slices(batches, "matrix", 1):
            row = batch.to_pylist()[0]
            if row["task"] != current:
                current, held = row["task"], []
            ids, weights = (np.frombuffer(row[x], "<i8") for x in ("ids", "weights"))
            units = _units(np.frombuffer(row["matrix"], f"<f{len(row['matrix']) // (len(ids) * row['dim'])}").reshape(-1, row["dim"]))
            own = (ids, weights, units, [(np.frombuffer(x, "<i8"), np.frombuffer(c, "<i8"), np.frombuffer(r, "<f8"))
                                         for x, c, r in zip(row["starts"], row["centers"], row["radii"], strict=True)],
                   sketch(units, turned.value[row["dim"]]))
            if row["own"] == row["a"]:
                held.append(own)  # about GROUP_BYTES of vectors
                if not row["inside"]:
                    continue
            for other in held:
                same = other is own
                if not same and apart(other[3], own[3], other[2], own[2], threshold):
                    continue
                i, j = traverse(other[2], other[3], own[2], own[3], threshold, same, other[4], own[4])
                if not len(i):
                    continue
                ids, weight = other[0], other[1]
                if not same:
                    j = j + len(ids)
                    ids, weight = np.concatenate([ids, own[0]]), np.concatenate([weight, own[1]])
                links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
                group = _joined(len(ids), i, j)
                linked = np.flatnonzero(links)
                yield pa.record_batch([pa.array(ids[linked]), pa.array(links[linked].astype(np.int64)), pa.array(ids[group[linked]])], schema=arrow)

    return shared.map_arrow(dealt_blocks, dual, out)


def embedding_near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, sample: int = SAMPLE,
                              max_centers: int = MAX_CENTERS, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    source = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("v"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(plain)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sizes = batch.column("v").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                values = batch.column("v").flatten().to_numpy(zero_copy_only=False)  # a null is not a number
                ends, names, rows = np.cumsum(sizes), [None] * len(sizes), [None] * len(sizes)
                for dim in np.unique(sizes[sizes > 0]).tolist():
                    at = np.flatnonzero(sizes == dim)
                    x = values[(ends[at] - dim)[:, None] + np.arange(dim)]
                    proper = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                    at, x = at[proper], x[proper]
                    top = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
                    # Scaled, so that squares neither vanish nor overflow; zero is zero.
                    # By a power of two, which keeps all digits.
                    kept = np.ldexp(x, -np.frexp(top)[1]) + 0.0
                    short = kept.astype("<f4")
                    lossless = (short == kept).all(axis=1)
                    for k, one, full, small, fits in zip(at.tolist(), x / top + 0.0, kept, short, lossless, strict=True):
                        names[k] = hashlib.blake2b(one.tobytes(), digest_size=16).digest()
                        rows[k] = (small if fits else full).tobytes()
                yield pa.record_batch([batch.column("id"), pa.array([d if r else None for d, r in zip(sizes.tolist(), rows, strict=True)], type=pa.int32()),
                                       pa.array(names, type=pa.binary()), pa.array(rows, type=pa.binary())], schema=arrow)

    # Vectors of one direction and scale or another are a class, which is known by its digest.
    plain = _parse_datatype_string("id long, dim int, name binary, vec binary")
    rows = shared.written(shared.map_arrow(source, prepare, plain), "vectors")
    proper = rows.filter("id IS NOT NULL AND vec IS NOT NULL")
    classes = shared.written(proper.groupBy("dim", "name").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.min("vec").alias("vec")), "classes")
    found = shared.written(near_pairs(classes.select("id", "weight", "dim", "vec"), threshold, block, sample, max_centers), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("id").alias("a"), F.col("group").alias("b")))
    of_class = (classes.drop("vec").join(links, "id", "left").join(reached, "id", "left")
                .select("dim", "name", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"),
                        F.coalesce("component", "id").alias("component")))
    named = F.col("id").isNotNull()
    component = F.when(named, F.coalesce("component", "id"))
    return (rows.select("id", "dim", "name").join(of_class, ["dim", "name"], "left")
            .select(F.col("id").alias(key), F.when(named, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"),
                    F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")))


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether it stays, for every vector."""
    return embedding_near_duplicates(shared.read_table(spark, sf_dir, "embeddings"))


#: The same by comparing all vectors.
ORACLE = """
WITH RECURSIVE proper AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM proper a JOIN proper b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(any_value(c.n), 0) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id GROUP BY e.vec_id
"""
