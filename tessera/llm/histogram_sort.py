"""Sharding by histogram sort: near-equal bytes, with DataFrame functions only.

Rows are ordered by the hash of their text, then by the hash of their key, so
equal texts lie side by side.  The splitters are found by counting the exact
bytes below candidate boundaries across all partitions: each round divides the
intervals that still hold a splitter, until a boundary is within ``tolerance``
of where the splitter should be, or only one row (or rows equal in text and
key) is left to cut.  A boundary between different texts is taken as soon as
one is near enough; a large group of copies is cut between its rows.  Inside a
shard, tasks take even stretches of hashes, and parts of a text whose copies
are more than a task takes.  The rows are then exchanged once.

Rows: the size of a row is its text's UTF-8 bytes plus 16 (null: 16).  A null
text orders with the empty one, a null key with the others by its hash; equal
rows are placed one by one in any order among themselves, and equal rows
alone can't be cut between two shards.  An empty table gives no row.  Columns
of the input that bear the name of an output column are replaced.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import shared

SHARDS = 40
#: Share of a shard's mean bytes by which a boundary may be off.
TOLERANCE = 0.01
#: Buckets into which a round divides an interval.
FAN = 256
#: Bytes that one task takes of a shard.
TASK_BYTES = 128 << 20
#: Ranges into which a table is cut at most, but for texts of many copies.
MAX_RANGES = 1 << 19

_FIRST = -(1 << 63)
_COARSE = 52  # the first look at a 64-bit hash is at its upper 12 bits


@dataclass
class Edge:
    """A boundary: rows with (text hash, key hash) from here on lie above."""

    text: int
    key: int
    bytes: int  # below it
    rows: int


@dataclass
class Interval:
    """Rows between two edges; ``level`` says which bits are looked at: 0 and
    1 the upper and all bits of the text hash, 2 and 3 those of the key's."""

    level: int
    text: int
    low: int
    width: int
    left: Edge
    right: Edge

    def edge(self, bucket: int, below: int, rows: int) -> Edge:
        at = self.low + bucket * self.width
        if self.level in (0, 2):
            at <<= _COARSE
        return Edge(at, _FIRST, below, rows) if self.level < 2 else Edge(self.text, at, below, rows)


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver, as a literal of the plan."""
    kind = f"array<struct<{schema}>>"
    return (spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("r")).select("r.*"))


def _divided(level: int, text: int, low: int, high: int, left: Edge, right: Edge) -> Interval:
    return Interval(level, text, low, max(1, -(-(high - low + 1) // FAN)), left, right)


def splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE) -> tuple[list[Edge], int]:
    """The ``parts - 1`` edges that cut ``keys`` (hashes ``h`` and ``k``,
    ``size``) into ranges of near-equal bytes, and the rounds taken.

    The driver gets one row per bucket that holds rows: at most 4096 in the
    first round, ``FAN`` for each splitter not settled later on."""
    spark = keys.sparkSession
    total = keys.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    size, n = total["b"] or 0, total["n"]
    wanted = {j: j * size / parts for j in range(1, parts)}
    slack = tolerance * size / parts
    ends = Edge(_FIRST, _FIRST, 0, 0), Edge(1 << 63, _FIRST, size, n)
    found: dict[int, Edge] = {}
    active = [Interval(0, 0, -(1 << 11), 1, *ends)]
    of_active, chosen = [sorted(wanted)], []
    rows, rounds = keys, 0
    upper = F.shiftright("h", _COARSE)
    while active and n:
        rounds += 1
        if rounds == 1:  # one interval, of all rows
            rows = keys.select("h", "k", "size", upper.alias("value"), (upper + (1 << 11)).alias("at"))
        else:
            table = literal_rows(spark, [{"of": o, "id": i, "level": v.level, "low": v.low, "width": v.width}
                                         for i, (o, v) in enumerate(zip(chosen, active, strict=True))],
                                 "of bigint, id bigint, level int, low bigint, width bigint")
            value = (F.when(F.col("level") == 1, F.col("h")).when(F.col("level") == 2, F.shiftright("k", _COARSE))
                     .otherwise(F.col("k")))
            rows = (rows.join(F.broadcast(table), F.col("at") == F.col("of")).withColumn("new", value)
                    .select("h", "k", "size", F.col("new").alias("value"),
                            (F.col("id") * 4096 + F.expr("(new - low) div width")).alias("at")))
        counted = rows.groupBy("at").agg(F.sum("size").alias("b"), F.count("*").alias("n"),
                                         F.min("value").alias("low"), F.max("value").alias("high"))
        buckets: dict[int, list] = {}
        for r in counted.orderBy("at").collect():
            buckets.setdefault(r["at"] // 4096, []).append((r["at"] % 4096, r["b"], r["n"], r["low"], r["high"]))
        following, chosen_next, of_following = [], [], []
        for i, (interval, targets) in enumerate(zip(active, of_active, strict=True)):
            below, count, edges = interval.left.bytes, interval.left.rows, [interval.left]
            held = buckets[i]
            for bucket, b, c, _, _ in held:
                if bucket and below > interval.left.bytes:
                    edges.append(interval.edge(bucket, below, count))
                below, count = below + b, count + c
            edges.append(interval.right)
            starts = [e.bytes for e in edges[:-1]]
            again: dict[int, list[int]] = {}
            for j in targets:
                at = bisect_right(starts, wanted[j]) - 1
                near = min(edges[at:at + 2], key=lambda e: abs(e.bytes - wanted[j]))
                bucket, _, c, low, high = held[at]
                single = c == 1 or interval.level == 3 and low == high
                if single or abs(near.bytes - wanted[j]) <= slack:
                    found[j] = near
                else:
                    again.setdefault(at, []).append(j)
            for at, js in again.items():
                bucket, _, _, low, high = held[at]
                level, text = interval.level, interval.text
                if level == 0:
                    level, low, high = 1, low << _COARSE, (low + 1 << _COARSE) - 1
                elif level == 1 and low == high:
                    level, text, low, high = 2, low, -(1 << 11), (1 << 11) - 1
                elif level == 2 and low == high:
                    level, low, high = 3, low << _COARSE, (low + 1 << _COARSE) - 1
                following.append(_divided(level, text, low, high, edges[at], edges[at + 1]))
                chosen_next.append(i * 4096 + bucket)
                of_following.append(js)
        active, chosen, of_active = following, chosen_next, of_following
    return [found[j] for j in sorted(found)], rounds


def _ranged(spark: SparkSession, rows: DataFrame, edges: list[Edge], h: str, k: str, name: str) -> DataFrame:
    """``rows`` with the number of edges at or below each row.  The edges are
    looked up by the upper bits of the text hash."""
    starts, table = [e.text >> _COARSE for e in edges], []
    for upper in range(-(1 << 11), 1 << 11):
        lo, hi = bisect_right(starts, upper - 1), bisect_right(starts, upper)
        table.append({"__hs_upper": upper, "__hs_base": lo,
                      "__hs_cuts": [{"h": e.text, "k": e.key} for e in edges[lo:hi]]})
    lookup = literal_rows(spark, table, "__hs_upper bigint, __hs_base int, __hs_cuts array<struct<h:bigint,k:bigint>>")

    def reached(cut: Column) -> Column:
        return (cut["h"] < F.col(h)) | ((cut["h"] == F.col(h)) & (cut["k"] <= F.col(k)))

    joined = rows.join(F.broadcast(lookup), F.shiftright(h, _COARSE) == F.col("__hs_upper"))
    number = F.col("__hs_base") + F.size(F.filter("__hs_cuts", reached))
    return joined.withColumn(name, number.cast("int")).drop("__hs_upper", "__hs_base", "__hs_cuts")


def _hot_texts(keys: DataFrame, task_bytes: int) -> DataFrame:
    """For each upper 12 bits of a text hash, the texts of more than
    ``task_bytes`` in all copies there, with the parts that their rows are
    dealt into (``__hs_hot``), and the number of such texts before
    (``__hs_hots``).  4,096 rows, and fewer texts than ranges."""
    hot = (keys.groupBy("h").agg(F.sum("size").alias("b")).filter(F.col("b") > task_bytes)
           .select(F.shiftright("h", _COARSE).alias("__hs_upper"),
                   F.struct("h", F.ceil(F.col("b") / task_bytes).alias("parts")).alias("hot"))
           .groupBy("__hs_upper").agg(F.collect_list("hot").alias("__hs_hot")))
    every = keys.sparkSession.range(-(1 << 11), 1 << 11).select(F.col("id").alias("__hs_upper"))
    none = F.array().cast("array<struct<h:bigint,parts:bigint>>")
    before = F.sum(F.size("__hs_hot")).over(W.orderBy("__hs_upper").rowsBetween(W.unboundedPreceding, -1))
    return (every.join(hot, "__hs_upper", "left").withColumn("__hs_hot", F.coalesce("__hs_hot", none))
            .withColumn("__hs_hots", F.coalesce(before, F.lit(0))))


def _placed(rows: DataFrame, edges: list[Edge], pieces: int, hot: DataFrame, h: str, k: str) -> DataFrame:
    """``rows`` with their shard and, rising with (h, k) in it, the range that
    holds them: the cell of the shard's stretch of hashes (``pieces`` even
    ones: hashes spread evenly, but for copies), the texts of many copies
    before or at the row, and the part of such a text by the key's hash."""
    spark = rows.sparkSession
    ends = [-(1 << 63), *(e.text for e in edges), (1 << 63) - 1]
    stretches = []
    for j in range(len(ends) - 1):
        low, high = (min(x, (1 << 63) - 1) >> 12 for x in (ends[j], ends[j + 1]))
        stretches.append({"__hs_of": j, "__hs_low": low, "__hs_width": max(1, -(-(high - low + 1) // pieces))})
    table = literal_rows(spark, stretches, "__hs_of int, __hs_low bigint, __hs_width bigint")
    sharded = (_ranged(spark, rows, edges, h, k, "__hs_shard").join(F.broadcast(table), F.col("__hs_shard") == F.col("__hs_of"))
               .withColumn("__hs_cell", F.expr(f"(shiftright({h}, 12) - __hs_low) div __hs_width")))
    looked = (sharded.withColumn("__hs_at", F.shiftright(h, _COARSE))
              .join(F.broadcast(hot), F.col("__hs_at") == F.col("__hs_upper")))
    below, upto = F.filter("__hs_hot", lambda c: c["h"] < F.col(h)), F.filter("__hs_hot", lambda c: c["h"] <= F.col(h))
    own = F.get(F.filter("__hs_hot", lambda c: c["h"] == F.col(h)), F.lit(0))["parts"]
    return (looked.withColumn("__hs_segment", 2 * F.col("__hs_hots") + F.size(below) + F.size(upto))
            .withColumn("__hs_parts", F.coalesce(own, F.lit(1)))
            .withColumn("__hs_part", F.expr(f"(shiftright({k}, 12) + {1 << 51}) div ({1 << 52} div __hs_parts + 1)"))
            .drop("__hs_of", "__hs_low", "__hs_width", "__hs_at", "__hs_upper", "__hs_hot", "__hs_hots", "__hs_parts"))


_RANGE = ["__hs_shard", "__hs_cell", "__hs_segment", "__hs_part"]


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, task_bytes: int = TASK_BYTES,
          text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with ``shard`` (0 to ``shards - 1``) and
    ``slot`` (gapless from 0 in a shard), physically placed: each partition
    holds one range of one shard, sorted.

    The driver settles the shards' splitters only and gets a number for each
    shard.  A shard's ranges, their sizes and first slots are a table that the
    executors make, of at most about three times ``MAX_RANGES`` rows; tables
    beyond ``MAX_RANGES * task_bytes`` get larger ranges."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hashed = (docs.drop(*[c for c in ("shard", "slot") if c in docs.columns])
              .withColumns({"__hs_h": F.xxhash64(body), "__hs_k": F.xxhash64(F.col(f"`{key}`"))}))
    keys = shared.written(
        hashed.select(F.col("__hs_h").alias("h"), F.col("__hs_k").alias("k"), (F.octet_length(body) + 16).cast("long").alias("size")),
        "shard-keys")
    size = keys.agg(F.sum("size")).first()[0] or 0
    task_bytes = max(task_bytes, -(-size // MAX_RANGES))
    pieces = max(1, -(-size // (shards * task_bytes)))
    edges, _ = splitters(keys, shards, tolerance)
    hot = shared.written(_hot_texts(keys, task_bytes), "shard-hot")
    order = W.partitionBy("__hs_shard").orderBy(*_RANGE[1:])
    counted = _placed(keys, edges, pieces, hot, "h", "k").groupBy(*_RANGE).agg(F.count("*").alias("n"))
    ranges = shared.written(
        counted.select(*_RANGE, (F.row_number().over(order) - 1).alias("__hs_number"),
                       (F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("__hs_offset")),
        "shard-ranges")
    firsts, total = [], 0
    for j, n in sorted(ranges.groupBy("__hs_shard").count().collect()):
        firsts.append({"__hs_of": j, "__hs_first": total})
        total += n
    if not total:
        return hashed.drop("__hs_h", "__hs_k").withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    numbered = (ranges.join(F.broadcast(literal_rows(spark, firsts, "__hs_of int, __hs_first int")),
                            F.col("__hs_shard") == F.col("__hs_of"))
                .select(*_RANGE, (F.col("__hs_first") + F.col("__hs_number")).cast("int").alias("__hs_range"), "__hs_offset"))
    ranged = (_placed(hashed, edges, pieces, hot, "__hs_h", "__hs_k").join(F.broadcast(numbered), _RANGE)
              .repartitionById(total, F.col("__hs_range")))
    position = F.row_number().over(W.partitionBy("__hs_range").orderBy("__hs_h", "__hs_k"))
    return (ranged.withColumn("shard", F.col("__hs_shard").cast("int"))
            .withColumn("slot", (position - 1 + F.col("__hs_offset")).cast("long"))
            .drop("__hs_h", "__hs_k", "__hs_range", "__hs_offset", *_RANGE))


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot, size and CRC-32 of all documents under the law ``bytes``."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return shard(shared.read_table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
