"""Second-order gradient boosting (M5).

Each round grows a tree per class from the gradients and hessians of the
log-loss (logistic for two classes, softmax over all classes for more).  A level
is one aggregate: sums of gradient and hessian for each (class, node, feature,
bin), which merge by addition, and for each node the cut of greatest gain

    GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2)

Missing values (NaN or null) go to the side that gains more, learned at every
cut.  Sums are integers (gradients in units of 2^-30), so a model does not
depend on how rows are partitioned or on the order in which sums are merged.

Rows are kept as the bins of their non-zero features, so one-hot and hashed
vectors stay sparse; what a feature's bin of zero holds is the node's total
less its other bins.  A feature of at most ``maxBins`` distinct non-zero values
is cut between any two of them, another at quantiles (``percentile_approx``,
error 1e-4 of the rows).

A table whose binned rows take at most ``LOCAL_BYTES`` is grown in one task by
the same routine, which saves a job for each level; the trees are the same.
On larger ones the margins are written to the checkpoint folder every
``FLUSH`` rounds, so a lost executor costs at most so many rounds of one part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol,
                                     HasProbabilityCol, HasRawPredictionCol, HasStepSize)
from pyspark.ml.util import (DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import arrow_schema, map_arrow, rows_of
from tessera.session import checkpoint_dir

#: Integer units of a gradient or hessian of one.
UNIT = 1 << 30
#: The bin of missing values; cuts of a feature number less.
MISSING = 255
#: Least gain of a cut.
LEAST_GAIN = 1e-6
#: Bytes of binned rows that one task grows trees of.
LOCAL_BYTES = 64 << 20
#: Rounds after which margins are written.
FLUSH = 8


@dataclass
class Tree:
    """Nodes in heap order (children of i are 2i + 1 and 2i + 2); a feature of
    -1 marks a leaf.  Values below ``cut`` go left, as do missing ones where
    ``missing_left``."""

    feature: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    weight: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = (1 << (depth + 1)) - 1
        return Tree(np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=bool), np.zeros(n))


@dataclass
class Cuts:
    """Ascending cuts of each feature, end to end, and the bin of zero."""

    values: np.ndarray
    starts: np.ndarray
    zero: np.ndarray = field(init=False)

    def __post_init__(self):
        self.zero = np.array([np.searchsorted(self.of(f), 0.0, side="right") for f in range(len(self.starts) - 1)], dtype=np.int64)

    def of(self, feature: int) -> np.ndarray:
        return self.values[self.starts[feature]:self.starts[feature + 1]]

    def bins(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of its feature's cuts each value reaches."""
        out = np.full(len(value), MISSING, dtype=np.uint8)
        order = np.argsort(feature, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(feature[order])) + 1):
            if len(part):
                found = np.searchsorted(self.of(int(feature[part[0]])), value[part], side="right")
                out[part] = np.where(np.isnan(value[part]), MISSING, found)
        return out


@dataclass
class Block:
    """Binned rows: the entries (row, feature, bin) of all features that aren't
    zero, in order, and what each row is."""

    n: int
    row: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    label: np.ndarray
    margin: np.ndarray

    @staticmethod
    def of(features: list[np.ndarray], bins: list[np.ndarray], label: np.ndarray, margin: np.ndarray) -> "Block":
        sizes = np.array([len(f) for f in features], dtype=np.int64)
        return Block(len(features), np.repeat(np.arange(len(features)), sizes),
                     np.concatenate(features).astype(np.int64) if len(features) else np.zeros(0, dtype=np.int64),
                     np.concatenate(bins) if len(bins) else np.zeros(0, dtype=np.uint8), label, margin)

    def leaf(self, tree: Tree, cuts: Cuts, depth: int | None = None) -> np.ndarray:
        """The node that each row comes to."""
        width = len(cuts.zero)
        keys = self.row * width + self.feature
        node = np.zeros(self.n, dtype=np.int64)
        while True:
            feature = tree.feature[node]
            inner = np.flatnonzero(feature >= 0)
            if not len(inner):
                return node
            want = inner * width + feature[inner]
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            found = keys[at] == want if len(keys) else np.zeros(len(inner), dtype=bool)
            own = np.where(found, self.bin[at] if len(keys) else 0, cuts.zero[feature[inner]])
            left = np.where(own == MISSING, tree.missing_left[node[inner]], own <= tree.bin[node[inner]])
            node[inner] = 2 * node[inner] + 2 - left

    def add(self, trees: list[Tree], cuts: Cuts) -> None:
        """Add a round's trees, one for each margin."""
        for k, tree in enumerate(trees):
            self.margin[:, k] += tree.weight[self.leaf(tree, cuts)]

    def gradients(self) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and hessian of the log-loss, in integer units."""
        if self.margin.shape[1] == 1:
            p = 1.0 / (1.0 + np.exp(-self.margin))
            g, h = p - self.label[:, None], p * (1.0 - p)
        else:
            e = np.exp(self.margin - self.margin.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            g, h = p - (self.label[:, None] == np.arange(p.shape[1])), 2.0 * p * (1.0 - p)
        return np.rint(g * UNIT).astype(np.int64), np.rint(h * UNIT).astype(np.int64)

    def histogram(self, node: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys ((node, feature, bin) as one number) and sums over the rows
        whose node isn't -1; the feature ``width`` holds the nodes' totals."""
        mine = node[self.row] >= 0
        row, live = self.row[mine], np.flatnonzero(node >= 0)
        key = (node[row] * (width + 1) + self.feature[mine]) * 256 + self.bin[mine]
        key = np.concatenate([key, (node[live] * (width + 1) + width) * 256])
        return summed(key, np.concatenate([g[row], g[live]]), np.concatenate([h[row], h[live]]))


def summed(key: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact integer sums by key."""
    if len(key) and np.ptp(key) < 1 << 22 and len(key) * max(np.abs(g).max(), np.abs(h).max()) < 1 << 53:
        low = key.min()  # doubles hold these sums exactly
        at = np.flatnonzero(np.bincount(key - low))
        return at + low, *(np.bincount(key - low, x.astype(np.float64))[at].astype(np.int64) for x in (g, h))
    order = np.argsort(key, kind="stable")
    key = key[order]
    if not len(key):
        return key, g, h
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    return key[starts], np.add.reduceat(g[order], starts), np.add.reduceat(h[order], starts)


@dataclass
class Rule:
    """What a cut must fulfil, and how leaves are weighed."""

    depth: int
    l2: float
    least_weight: float
    step: float

    def leaf(self, g: int, h: int) -> float:
        return -self.step * (g / UNIT) / (h / UNIT + self.l2)


def best_cuts(key: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: Cuts, rule: Rule) -> dict[int, tuple]:
    """For each node of a histogram its totals and, if there is one, its best
    cut: (G, H, gain, feature, bin, missing left, G left, H left).  Of equal
    gains the first feature, the lowest cut and missing values to the right win."""
    width = len(cuts.zero)
    node, feature, bin_ = key // 256 // (width + 1), key // 256 % (width + 1), key % 256
    total = feature == width
    of_node = {int(n): (int(a), int(b)) for n, a, b in zip(node[total], g[total], h[total], strict=True)}
    out: dict[int, tuple] = {n: (*t, None) for n, t in of_node.items()}
    node, feature, bin_, g, h = (x[~total] for x in (node, feature, bin_, g, h))
    if not len(node):
        return out
    # What a feature's bin of zero holds besides.
    run = node * (width + 1) + feature
    first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
    rest_g = np.array([of_node[int(n)][0] for n in node[first]]) - np.add.reduceat(g, first)
    rest_h = np.array([of_node[int(n)][1] for n in node[first]]) - np.add.reduceat(h, first)
    key, g, h = summed(np.concatenate([run * 256 + bin_, run[first] * 256 + cuts.zero[feature[first]]]),
                       np.concatenate([g, rest_g]), np.concatenate([h, rest_h]))
    run, bin_ = key // 256, key % 256
    node, feature = run // (width + 1), run % (width + 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
    sizes = np.diff(np.append(first, len(run)))
    absent = bin_ == MISSING
    known_g, known_h = np.where(absent, 0, g), np.where(absent, 0, h)

    def before(x: np.ndarray) -> np.ndarray:
        c = np.cumsum(x)
        return c - np.repeat(c[first] - x[first], sizes)

    left_g, left_h = before(known_g), before(known_h)
    miss_g, miss_h = (np.repeat(np.add.reduceat(np.where(absent, x, 0), first), sizes) for x in (g, h))
    all_g = np.repeat(np.add.reduceat(g, first), sizes)
    all_h = np.repeat(np.add.reduceat(h, first), sizes)
    fits = ~absent & (bin_ < np.diff(cuts.starts)[feature])

    def worth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a / UNIT, b / UNIT
        return a * a / (b + rule.l2)

    found = []
    for missing_left in (0, 1):
        lg, lh = left_g + missing_left * miss_g, left_h + missing_left * miss_h
        gain = worth(lg, lh) + worth(all_g - lg, all_h - lh) - worth(all_g, all_h)
        fit = fits & (lh / UNIT >= rule.least_weight) & ((all_h - lh) / UNIT >= rule.least_weight) & (gain > LEAST_GAIN)
        at = np.flatnonzero(fit)
        found.append(np.stack([node[at], feature[at], bin_[at], np.full(len(at), missing_left), lg[at], lh[at]], axis=1))
        found[-1] = (found[-1], gain[at])
    rows, gains = np.concatenate([r for r, _ in found]), np.concatenate([x for _, x in found])
    order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], -gains, rows[:, 0]))
    rows, gains = rows[order], gains[order]
    for k in np.flatnonzero(np.diff(rows[:, 0], prepend=-1)):
        n, f, b, left, lg, lh = (int(x) for x in rows[k])
        out[n] = (*of_node[n], float(gains[k]), f, b, bool(left), lg, lh)
    return out


def grow(tree: Tree, cut: dict[int, tuple], cuts: Cuts, rule: Rule, level: int) -> list[int]:
    """Put a level's cuts into a tree; returns the nodes of the next level."""
    following = []
    for node, found in sorted(cut.items()):
        if found[2] is None or level == rule.depth:
            tree.weight[node] = rule.leaf(*found[:2])
            continue
        g, h, _, feature, bin_, left, lg, lh = found
        tree.feature[node], tree.bin[node], tree.missing_left[node] = feature, bin_, left
        tree.cut[node] = cuts.of(feature)[bin_]
        for child, (a, b) in ((2 * node + 1, (lg, lh)), (2 * node + 2, (g - lg, h - lh))):
            tree.weight[child] = rule.leaf(a, b)
            following.append(child)
    return following


def grow_round(cuts: Cuts, rule: Rule, n_margins: int, histogram) -> list[Tree]:
    """One round: ``histogram(trees, open nodes)`` gives for each margin the
    best cuts of its open nodes."""
    trees = [Tree.empty(rule.depth) for _ in range(n_margins)]
    open_nodes = [[0] for _ in range(n_margins)]
    for level in range(rule.depth):
        if not any(open_nodes):
            break
        found = histogram(trees, open_nodes)
        open_nodes = [grow(tree, found[k], cuts, rule, level) for k, tree in enumerate(trees)]
    return trees


def _node_of(block: Block, tree: Tree, open_nodes: list[int], cuts: Cuts) -> np.ndarray:
    node = block.leaf(tree, cuts)
    return np.where(np.isin(node, open_nodes), node, -1)


def boost_block(block: Block, cuts: Cuts, rule: Rule, rounds: int) -> list[list[Tree]]:
    """All rounds over one block."""
    width, out = len(cuts.zero), []
    for _ in range(rounds):
        g, h = block.gradients()

        def histogram(trees, open_nodes):
            return [best_cuts(*block.histogram(_node_of(block, t, nodes, cuts), g[:, k], h[:, k], width), cuts, rule) if nodes else {}
                    for k, (t, nodes) in enumerate(zip(trees, open_nodes, strict=True))]

        trees = grow_round(cuts, rule, block.margin.shape[1], histogram)
        block.add(trees, cuts)
        out.append(trees)
    return out


# -------------------------------------------------------------------- Spark

_BINNED = "feature binary, bin binary, label int, margin binary"


def sparse_array(x: str = "x") -> list:
    """``feature`` and ``value`` of an array's entries that aren't zero; null
    counts as NaN."""
    pairs = f"filter(transform({x}, (v, i) -> struct(i AS feature, coalesce(v, double('NaN')) AS value)), e -> e.value <> 0)"
    return [F.expr(f"transform({pairs}, e -> e.{c})").alias(c) for c in ("feature", "value")]


def vector_entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the entries of a column of ML vectors (sparse
    or dense) that aren't zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ExtensionArray):
        column = column.storage
    _, _, indices, values = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    feature = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    feature[np.repeat(indices.is_valid().to_numpy(zero_copy_only=False), sizes)] = indices.flatten().to_numpy(zero_copy_only=False)
    value = values.flatten().to_numpy(zero_copy_only=False)
    keep = value != 0
    return row[keep], feature[keep], value[keep]


def _lists(row: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values).cast(kind))


def _sparse_vectors(column: pa.Array) -> pa.Array:
    row, feature, value = vector_entries(column)
    return pa.StructArray.from_arrays([_lists(row, feature, len(column), pa.int32()), _lists(row, value, len(column), pa.float64())],
                                      names=["feature", "value"])


def find_cuts(rows: DataFrame, width: int, max_bins: int) -> Cuts:
    """Cuts of every feature; at most ``max_bins`` of one."""
    known = (rows.select(F.explode(F.arrays_zip("feature", "value")).alias("e")).select("e.feature", "e.value")
             .filter(~F.isnan("value")))
    counts = known.groupBy("feature", "value").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("feature").agg(F.count("*").alias("values"))
    few = (counts.join(sizes.filter(F.col("values") <= max_bins), "feature").groupBy("feature")
           .agg(F.sort_array(F.collect_list("value")).alias("cuts")))
    shares = [k / max_bins for k in range(max_bins)]
    many = (known.join(sizes.filter(F.col("values") > max_bins), "feature").groupBy("feature")
            .agg(F.percentile_approx("value", shares, 10_000).alias("cuts")))
    lists = {r["feature"]: r["cuts"] for r in few.unionByName(many).collect()}  # max_bins numbers a feature
    made = []
    for f in range(width):
        # Zero is a value of every feature; the least value needs no cut.
        values = np.unique(np.append(np.array(lists.get(f, []), dtype=float), 0.0)) if f in lists else np.zeros(0)
        made.append(values[1:])
    starts = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int64)
    return Cuts(np.concatenate(made) if made else np.zeros(0), starts)


def _bin_rows(rows: DataFrame, cuts: Cuts, n_margins: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(cuts)
    flat = rows.select("feature", "value", "label")
    arrow = arrow_schema(_BINNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("feature")
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            feature = column.flatten().to_numpy(zero_copy_only=False).astype("<i4")
            value = batch.column("value").flatten().to_numpy(zero_copy_only=False)
            bins = sent.value.bins(feature, value)
            cut = list(zip(offsets[:-1], offsets[1:], strict=True))
            yield pa.record_batch([pa.array([feature[a:b].tobytes() for a, b in cut], type=pa.binary()),
                                   pa.array([bins[a:b].tobytes() for a, b in cut], type=pa.binary()), batch.column("label"),
                                   pa.array([bytes(8 * n_margins)] * batch.num_rows, type=pa.binary())], schema=arrow)

    return map_arrow(flat, run, _BINNED)


def _block(batch: pa.RecordBatch, n_margins: int) -> Block:
    return Block.of(rows_of(batch.column("feature"), "<i4"), rows_of(batch.column("bin"), "u1"),
                    batch.column("label").to_numpy(zero_copy_only=False),
                    np.frombuffer(b"".join(batch.column("margin").to_pylist()), dtype="<f8").reshape(-1, n_margins).copy())


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/boosting-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def boost(rows: DataFrame, width: int, n_classes: int, rounds: int = 100, rule: Rule = Rule(6, 1.0, 1.0, 0.3), max_bins: int = 254,
          local_bytes: int = LOCAL_BYTES) -> tuple[Cuts, list[list[Tree]]]:
    """Cuts and trees of every round from rows ``feature`` and ``value`` (the
    entries that aren't zero, ascending, of ``width`` features; NaN where
    missing) and ``label`` (0 to ``n_classes`` - 1)."""
    if not 1 <= max_bins < MISSING:
        raise ValueError(f"max_bins must be between 1 and {MISSING - 1}")
    n_margins = 1 if n_classes <= 2 else n_classes
    cuts = find_cuts(rows, width, max_bins)
    state = _written(_bin_rows(rows, cuts, n_margins), "bins")
    size = state.agg(F.sum(F.octet_length("feature") + F.octet_length("bin") + 16 + 8 * n_margins)).first()[0] or 0
    if size <= local_bytes:
        return cuts, _boost_one_task(state, cuts, rule, rounds, n_margins)
    return cuts, _boost_levels(state, cuts, rule, rounds, n_margins)


def _boost_one_task(state: DataFrame, cuts: Cuts, rule: Rule, rounds: int, n_margins: int) -> list[list[Tree]]:
    schema = "round int, k int, feature binary, bin binary, cut binary, missing_left binary, weight binary"

    binned, arrow = arrow_schema(_BINNED), arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), binned).combine_chunks()
        block = _block(table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema), n_margins)
        made = boost_block(block, cuts, rule, rounds)
        yield pa.record_batch([pa.array(c) for c in zip(*(
            (r, k, t.feature.astype("<i8").tobytes(), t.bin.astype("<i8").tobytes(), t.cut.tobytes(), t.missing_left.tobytes(), t.weight.tobytes())
            for r, trees in enumerate(made) for k, t in enumerate(trees)), strict=True)], names=arrow.names).cast(arrow)

    out: list[list[Tree]] = [[None] * n_margins for _ in range(rounds)]
    for r in map_arrow(state.coalesce(1), run, schema).collect():
        out[r["round"]][r["k"]] = Tree(np.frombuffer(r["feature"], "<i8").copy(), np.frombuffer(r["bin"], "<i8").copy(), np.frombuffer(r["cut"]).copy(),
                                       np.frombuffer(r["missing_left"], "?").copy(), np.frombuffer(r["weight"]).copy())
    return out


def _boost_levels(state: DataFrame, cuts: Cuts, rule: Rule, rounds: int, n_margins: int) -> list[list[Tree]]:
    spark = state.sparkSession
    context, width = spark.sparkContext, len(cuts.zero)
    sent_cuts = context.broadcast(cuts)
    sums = "k int, node long, key long, g long, h long"
    found_schema = ("k int, node long, g long, h long, gain double, feature int, bin int, missing_left boolean, left_g long, left_h long")
    sums_arrow, found_arrow, binned = arrow_schema(sums), arrow_schema(found_schema), arrow_schema(_BINNED)
    done: list[list[Tree]] = []
    pending: list[list[Tree]] = []

    def histogram(trees, open_nodes):
        sent = context.broadcast((list(pending), trees, open_nodes))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            earlier, now, nodes = sent.value
            cuts = sent_cuts.value
            held = [[] for _ in range(n_margins)]
            for batch in batches:
                if not batch.num_rows:
                    continue
                block = _block(batch, n_margins)
                for trees in earlier:
                    block.add(trees, cuts)
                g, h = block.gradients()
                for k in range(n_margins):
                    if nodes[k]:
                        held[k].append(block.histogram(_node_of(block, now[k], nodes[k], cuts), g[:, k], h[:, k], width))
                        if len(held[k]) >= 16:
                            held[k] = [summed(*(np.concatenate(x) for x in zip(*held[k], strict=True)))]
            for k in range(n_margins):
                if held[k]:
                    key, g, h = summed(*(np.concatenate(x) for x in zip(*held[k], strict=True)))
                    yield pa.record_batch([pa.array(np.full(len(key), k, dtype=np.int32)), pa.array(key // 256 // (width + 1)),
                                           pa.array(key), pa.array(g), pa.array(h)], schema=sums_arrow)

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts, current, held = sent_cuts.value, None, []

            def closed() -> pa.RecordBatch:
                (node, best), = best_cuts(*(np.concatenate(x) for x in zip(*held, strict=True)), cuts, rule).items()
                row = (current[0], node, *(best if best[2] is not None else (*best, *[None] * 5)))
                return pa.RecordBatch.from_pylist([dict(zip(found_arrow.names, row, strict=True))], schema=found_arrow)

            for batch in batches:
                if not batch.num_rows:
                    continue
                k, node, key, g, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "node", "key", "g", "h"))
                edges = np.concatenate([[0], np.flatnonzero((np.diff(k) != 0) | (np.diff(node) != 0)) + 1, [len(k)]])
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if (int(k[a]), int(node[a])) != current:
                        if held:
                            yield closed()
                        current, held = (int(k[a]), int(node[a])), []
                    held.append((key[a:b], g[a:b], h[a:b]))
            if held:
                yield closed()

        merged = (map_arrow(state, partial, sums).groupBy("k", "node", "key").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                  .repartition("k", "node").sortWithinPartitions("k", "node", "key"))
        out: list[dict] = [{} for _ in range(n_margins)]
        for r in map_arrow(merged, chosen, found_schema).collect():  # a row for each open node
            cut = (r["g"], r["h"], None) if r["gain"] is None else tuple(r)[2:]
            out[r["k"]][r["node"]] = cut
        return out

    for round_ in range(rounds):
        trees = grow_round(cuts, rule, n_margins, histogram)
        done.append(trees)
        pending.append(trees)
        if len(pending) == FLUSH and round_ < rounds - 1:
            sent = context.broadcast(list(pending))

            def moved(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        block = _block(batch, n_margins)
                        for trees in sent.value:
                            block.add(trees, sent_cuts.value)
                        margin = pa.array([m.tobytes() for m in block.margin], type=pa.binary())
                        yield pa.record_batch([*(batch.column(c) for c in ("feature", "bin", "label")), margin], schema=binned)

            state = _written(map_arrow(state, moved, _BINNED), "margins")
            pending = []
    return done


def margins(trees: list[list[Tree]], x: np.ndarray) -> np.ndarray:
    """Margins of dense rows (NaN where missing)."""
    out = np.zeros((len(x), len(trees[0]) if trees else 1))
    for round_ in trees:
        for k, tree in enumerate(round_):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                feature = tree.feature[node]
                inner = np.flatnonzero(feature >= 0)
                if not len(inner):
                    break
                value = x[inner, feature[inner]]
                left = np.where(np.isnan(value), tree.missing_left[node[inner]], value < tree.cut[node[inner]])
                node[inner] = 2 * node[inner] + 2 - left
            out[:, k] += tree.weight[node]
    return out


class _Writer(MLWriter):
    """Params as metadata; a row for each tree as Parquet."""

    def __init__(self, instance: "BoostedModel"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"n_classes": m.n_classes})
        rows = [(r, k, t.feature.tolist(), t.bin.tolist(), t.cut.tolist(), t.missing_left.tolist(), t.weight.tolist())
                for r, trees in enumerate(m.trees) for k, t in enumerate(trees)]
        (self.sparkSession.createDataFrame(rows, "r int, k int, feature array<long>, bin array<long>, cut array<double>, "
                                                 "missing_left array<boolean>, weight array<double>")
         .write.mode("overwrite").parquet(f"{path}/data"))


class _Reader(MLReader):
    def load(self, path: str) -> "BoostedModel":
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        trees: list[list[Tree]] = []
        for r in sorted(self.sparkSession.read.parquet(f"{path}/data").collect(), key=lambda r: (r["r"], r["k"])):
            if r["k"] == 0:
                trees.append([])
            trees[-1].append(Tree(*(np.array(r[c]) for c in ("feature", "bin", "cut", "missing_left", "weight"))))
        model = BoostedModel(trees, int(meta["n_classes"]))
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


class BoostedModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, MLWritable, MLReadable):
    """Margins, probabilities (logistic or softmax) and the likeliest class;
    NaN features count as missing."""

    def __init__(self, trees: list[list[Tree]] | None = None, n_classes: int = 2):
        super().__init__()
        self.trees, self.n_classes = trees or [], n_classes

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        used = sorted({int(f) for trees in self.trees for t in trees for f in t.feature if f >= 0})
        place = {f: i for i, f in enumerate(used)}
        narrow = [[Tree(np.array([place.get(int(f), -1) for f in t.feature]), t.bin, t.cut, t.missing_left, t.weight) for t in trees]
                  for trees in self.trees]
        sent = dataset.sparkSession.sparkContext.broadcast((np.array(used, dtype=np.int64), narrow))

        @F.arrow_udf("array<double>")
        def score(column: pa.Array) -> pa.Array:
            used, trees = sent.value
            row, feature, value = vector_entries(column)
            x = np.zeros((len(column), max(1, len(used))))
            at = np.searchsorted(used, feature)
            mine = at < len(used)
            mine[mine] = used[at[mine]] == feature[mine]
            x[row[mine], at[mine]] = value[mine]
            return pa.array(margins(trees, x).tolist(), type=pa.list_(pa.float64()))

        scored = dataset.withColumn("_ts_margin", score(F.col(self.getFeaturesCol())))
        if self.n_classes <= 2:
            p = 1.0 / (1.0 + F.exp(-F.col("_ts_margin")[0]))
            raw, proba = F.array(-F.col("_ts_margin")[0], F.col("_ts_margin")[0]), F.array(1.0 - p, p)
        else:
            top = F.array_max("_ts_margin")
            each = F.transform("_ts_margin", lambda m: F.exp(m - top))
            total = F.aggregate(each, F.lit(0.0), lambda a, e: a + e)
            raw, proba = F.col("_ts_margin"), F.transform(each, lambda e: e / total)
        best = F.array_position(raw, F.array_max(raw)) - 1
        return (scored.withColumn(self.getRawPredictionCol(), array_to_vector(raw)).withColumn(self.getProbabilityCol(), array_to_vector(proba))
                .withColumn(self.getPredictionCol(), best.cast("double")).drop("_ts_margin"))


class BoostedClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol,
                        HasMaxIter, HasStepSize):
    """Boosted trees: ``maxIter`` rounds of depth ``maxDepth``."""

    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "most cuts of a feature (below 255)", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "added to a leaf's hessian", TypeConverters.toFloat)
    minWeight = Param(Params._dummy(), "minWeight", "least hessian of a leaf", TypeConverters.toFloat)

    def __init__(self, local_bytes: int = LOCAL_BYTES):
        super().__init__()
        self.local_bytes = local_bytes
        self._setDefault(maxIter=100, stepSize=0.3, maxDepth=6, maxBins=254, l2=1.0, minWeight=1.0)

    def setFeaturesCol(self, value: str) -> "BoostedClassifier":
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str) -> "BoostedClassifier":
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str) -> "BoostedClassifier":
        return self._set(predictionCol=value)

    def setProbabilityCol(self, value: str) -> "BoostedClassifier":
        return self._set(probabilityCol=value)

    def setRawPredictionCol(self, value: str) -> "BoostedClassifier":
        return self._set(rawPredictionCol=value)

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        first = dataset.select(self.getFeaturesCol()).first()  # all vectors of a column have one size
        width = first[0].size if first else 0
        sparse = F.arrow_udf(_sparse_vectors, "struct<feature:array<int>,value:array<double>>")
        rows = (dataset.select(sparse(F.col(self.getFeaturesCol())).alias("e"), F.col(self.getLabelCol()).cast("int").alias("label"))
                .select("e.feature", "e.value", "label"))
        seen = rows.agg(F.max("label").alias("last")).first()
        n_classes = int(seen["last"]) + 1 if seen["last"] is not None else 1
        rule = Rule(self.getOrDefault(self.maxDepth), self.getOrDefault(self.l2), self.getOrDefault(self.minWeight), self.getStepSize())
        _, trees = boost(rows, width, n_classes, self.getMaxIter(), rule, self.getOrDefault(self.maxBins), self.local_bytes)
        model = BoostedModel(trees, max(2, n_classes))
        model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol(),
                   rawPredictionCol=self.getRawPredictionCol())
        return model


def first_split(rows: DataFrame, width: int, n_classes: int = 2, rule: Rule = Rule(1, 1.0, 1.0, 0.3)) -> DataFrame:
    """The first cut of a model: ``feature`` (number), ``cut``,
    ``missing_left`` and the children's leaf weights."""
    _, rounds = boost(rows, width, n_classes, 1, rule)
    made = [(k, int(t.feature[0]), float(t.cut[0]), bool(t.missing_left[0]), float(t.weight[1]), float(t.weight[2]))
            for k, t in enumerate(rounds[0])]
    return rows.sparkSession.createDataFrame(made, "margin int, feature int, cut double, missing_left boolean, left_weight double, right_weight double")
