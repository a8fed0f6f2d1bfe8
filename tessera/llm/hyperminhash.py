"""Near-duplicate documents by HyperMinHash sketches.

A document's set is that of its distinct word shingles (A-Z lowered, words cut
at ASCII white space; fewer words than a shingle: the whole sequence).  Its
sketch has one register per hash function: the leading zeros of the least hash
and the bits after its leading one.  Bands of registers propose pairs, the
registers' agreement, corrected for chance collisions, estimates their
similarity, and the pairs that may pass are confirmed on the full sets.

The work stays linear where documents are alike: equal sets are merged first;
a bucket, and later a group of candidates, is compared in blocks of bounded
size, and only the edges that join what isn't joined yet leave a task.

Rows: a document without words (null, empty, white space) has an empty set
and is linked with nothing, as is one with a null key (which is kept and has no
component).  Rows with equal keys and texts share a component and are all kept
if the key is its smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.llm import shared
from tessera.llm.components import components

SHINGLE = 3
BANDS, ROWS = 25, 5
#: Bits after the leading one that a register keeps.
MANTISSA = 10
#: Documents in a block of a bucket, and of a group of candidates; the blocks
#: of one bucket or group are compared pairwise.
BUCKET_BLOCK, GROUP_BLOCK = 1024, 256
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 5.0
#: Words whose hash a worker keeps, about 150 bytes each.
MAX_WORDS = 200_000

_RANDOM = np.random.default_rng(20240229)
_MIX = (_RANDOM.integers(0, 1 << 63, 8, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ODD = (_RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_XOR = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


class _Words(dict):
    """Hash of a word, made when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


_WORDS = _Words()
shared.keeps_tables(_WORDS.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_WORDS) > MAX_WORDS:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(size, len(words))
    made = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        made = _mixed(made + h[i:len(h) - span + 1 + i])
    return np.unique(made)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (uint16) of non-empty sets, a row for each."""
    lengths = np.array([len(s) for s in sets])
    starts = np.cumsum(lengths) - lengths
    values = np.concatenate(sets)
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(_ODD), len(sets)), dtype=np.uint32)
    for i, (odd, flip) in enumerate(zip(_ODD, _XOR, strict=True)):
        x = (low ^ flip) * odd
        x ^= x >> np.uint32(15)
        x += high
        x *= odd
        least[i] = np.minimum.reduceat(x, starts)
    exponent = np.frexp(least.astype(np.float64))[1]  # bits of the number
    zeros = (32 - exponent).astype(np.uint32)
    tail = (least.astype(np.uint64) << (zeros + np.uint32(1)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return ((zeros << np.uint32(MANTISSA)) | (tail >> np.uint64(32 - MANTISSA)).astype(np.uint32)).astype(np.uint16).T


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    grouped = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for i in range(ROWS):
        key = _mixed(key * _MIX[2] + grouped[:, :, i] + np.uint64(1))
    return key.view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of these sizes agree: the
    least hashes share a power of two and then the mantissa."""
    left = 1.0 - 0.5 ** np.arange(32, -1, -1)
    share = -np.diff(left ** np.asarray(n)[..., None]) * -np.diff(left ** np.asarray(m)[..., None])
    return share.sum(axis=-1) / (1 << MANTISSA)


def likely_pairs(regs: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_sizes: np.ndarray,
                 threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose estimated similarity doesn't rule out the threshold,
    the likeliest first."""
    k = regs.shape[1]
    least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / k)
    at, to, alike = [], [], []
    for start in range(0, len(regs), 32):
        own = sizes[start:start + 32, None]
        share = (regs[start:start + 32, None, :] == other).sum(axis=2) / k
        # Chance only lowers the estimate, so this rules out no good pair.
        i, j = np.nonzero((share >= least) & (other_sizes >= own * threshold - 1e-9) & (own >= other_sizes * threshold - 1e-9))
        at.append(i + start)
        to.append(j)
        alike.append(share[i, j])
    i, j, share = np.concatenate(at), np.concatenate(to), np.concatenate(alike)
    by_chance = chance(sizes[i].astype(np.float64), other_sizes[j].astype(np.float64))
    estimate = (share - by_chance) / (1 - by_chance)
    order = np.argsort(-estimate, kind="stable")
    order = order[estimate[order] >= least]
    return i[order], j[order]


def _dealt(members: DataFrame, by: list[str], block: int) -> DataFrame:
    """Members (``by``, ``id``, ...) of groups, once for each pair of blocks
    of their group, with ``side`` 0 or 1 (2: both).  A small group is one
    block; the blocks of a large one are all paired."""
    counts = members.groupBy(*by).agg(F.count("*").alias("members")).filter("members > 1")
    known = members.join(counts, by)
    n = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(7)), n).cast("int")
    placed = known.withColumn("blocks", n).withColumn("own", own)
    pair = F.expr("transform(sequence(0, blocks - 1), o -> struct(least(own, o) AS low, greatest(own, o) AS high, "
                  "IF(o = own, 2, IF(own < o, 0, 1)) AS side))")
    return (placed.withColumn("pair", F.explode(pair)).withColumns({"low": F.col("pair.low"), "high": F.col("pair.high"),
                                                                   "side": F.col("pair.side")})
            .drop("pair", "blocks", "own", "members"))


def _compare(dealt: DataFrame, by: list[str], column: str, check) -> DataFrame:
    """Edges ``(a, b)`` within the pairs of blocks; ``check(rows_a, rows_b)``
    yields index pairs and says whether they hold."""
    schema = _parse_datatype_string("a long, b long")
    group = [*by, "low", "high"]
    shuffled = dealt.repartition(*group).sortWithinPartitions(*group, "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        current, rows = None, []

        def edges(rows: list[dict]) -> pa.RecordBatch:
            left = [r for r in rows if r["side"] != 1]
            right = left if left and left[0]["side"] == 2 else [r for r in rows if r["side"] == 1]
            found = check(left, right) if left and right else []
            return pa.record_batch([pa.array([left[i]["id"] for i, _ in found], type=pa.int64()),
                                    pa.array([right[j]["id"] for _, j in found], type=pa.int64())], schema=arrow)

        for batch in shared.slices(batches, column):
            for row in batch.to_pylist():
                name = tuple(row[c] for c in group)
                if name != current:
                    if len(rows) > 1:
                        yield edges(rows)
                    current, rows = name, []
                rows.append(row)
        if len(rows) > 1:
            yield edges(rows)

    return shared.map_arrow(shuffled, run, schema)


def _spanning(left: list, right: list, regs: str, threshold: float, holds=None) -> list[tuple[int, int]]:
    """A forest of the likely pairs (or of those that hold)."""
    same = left is right
    a = np.stack([np.frombuffer(r[regs], dtype="<u2") for r in left])
    b = a if same else np.stack([np.frombuffer(r[regs], dtype="<u2") for r in right])
    n, m = (np.array([r["n_shingles"] for r in rows]) for rows in (left, right))
    shift = 0 if same else len(left)
    tree, found = np.arange(shift + len(right)), []  # the tree that each stands in
    at, to = likely_pairs(a, n, b, m, threshold)
    if same:
        at, to = at[at < to], to[at < to]
    for k in range(0, len(at), 4096):
        x, y = at[k:k + 4096], to[k:k + 4096]
        apart = tree[x] != tree[shift + y]
        for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            if tree[i] != tree[shift + j] and (holds is None or holds(i, j)):
                tree[tree == tree[shift + j]] = tree[i]
                found.append((i, j))
    return found


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    body = F.col(f"`{text}`")
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(body).alias("source"), body.alias("text"))


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``source`` (a hash of the text), ``n_shingles``, ``same``
    (digest of the whole set, null if it is empty), ``regs`` and ``bands`` of
    every row."""
    rows = _rows(docs, text, key)

    def start():
        def apply(batch):
            sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            same, regs, bands = ([None] * len(sets) for _ in range(3))
            if full:
                made = registers([sets[i] for i in full])
                keys = band_keys(made)
                for row, i in enumerate(full):
                    same[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    regs[i] = made[row].tobytes()
                    bands[i] = keys[row]
            return {"id": batch.column("id"), "source": batch.column("source"), "n_shingles": [len(s) for s in sets], "same": same, "regs": regs, "bands": bands}

        return apply

    return shared.map_slices(rows, start, "id long, source long, n_shingles long, same binary, regs binary, bands array<long>")


def near_duplicates(docs: DataFrame, threshold: float = 0.85, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id",
                    blocks: tuple[int, int] = (BUCKET_BLOCK, GROUP_BLOCK), source: bool = False) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest key reachable by
    links of Jaccard similarity >= ``threshold``) and ``kept`` of every row;
    with ``source`` also the text's xxhash64, which tells rows of a key apart."""
    sketch = shared.written(sketches(docs, text, key, shingle), "sketches")
    proper = sketch.filter("id IS NOT NULL AND same IS NOT NULL")
    classes = shared.written(proper.groupBy("same").agg(F.min("id").alias("first")), "classes")
    firsts = shared.written(
        proper.join(classes.select("same", F.col("first").alias("id")), ["same", "id"]).dropDuplicates(["same"]), "firsts")
    members = firsts.select("id", F.explode("bands").alias("band"))
    crowded = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    light = firsts.select("id", "source", "n_shingles", "regs")
    colliding = members.join(crowded, "band").join(light, "id")
    likely = _compare(_dealt(colliding, ["band"], blocks[0]), ["band"], "regs",
                      lambda left, right: _spanning(left, right, "regs", threshold))
    groups = components(likely).withColumnRenamed("component", "candidates")
    full = shared.written(groups.join(light, "id").join(_rows(docs, text, key), ["id", "source"])
                          .dropDuplicates(["id", "source"]), "candidates")

    def confirmed(left: list, right: list) -> list[tuple[int, int]]:
        sets: dict[tuple[bool, int], frozenset] = {}

        def members_of(side: bool, i: int) -> frozenset:
            if (side, i) not in sets:
                sets[side, i] = frozenset(shingle_set((right if side else left)[i]["text"], shingle).tolist())
            return sets[side, i]

        def holds(i: int, j: int) -> bool:
            a, b = members_of(False, i), members_of(left is not right, j)
            both = len(a & b)
            return 100 * both >= round(100 * threshold) * (len(a) + len(b) - both)

        return _spanning(left, right, "regs", threshold, holds)

    links = _compare(_dealt(full, ["candidates"], blocks[1]), ["candidates"], "text", confirmed)
    reached = components(links).select(F.col("id").alias("first"), "component")
    of_class = classes.join(reached, "first", "left").select("same", F.coalesce("component", "first").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    named = ["source"] if source else []
    return (sketch.select("id", "n_shingles", "same", *named).join(of_class, "same", "left")
            .select(F.col("id").alias(key), *named, "n_shingles", component.alias("component_id"),
                    F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, component and whether it stays, for every document."""
    return near_duplicates(shared.read_table(spark, sf_dir, "documents"))


#: The same by joining documents on every shared shingle.
ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, [x for x in regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x20\\x09-\\x0D]+') if x <> ''] AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) END AS s
  FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
"""
