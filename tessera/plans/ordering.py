"""Row positions without a global window.

``Window.orderBy(...)`` with no partition pulls every row into one task.
Here rows are range-partitioned on the order key and sorted inside each
partition; a partition's first position is the sum of the sizes of the
partitions before it.  Only one number per partition reaches the driver, so
the driver-side table is bounded by the partition count, not the data.

The order key must be unique (append a key column); then a recomputation
after a lost executor reproduces the same positions, and the sorted, tagged
data is also checkpointed to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import reliable_checkpoint

PID = "_ts_pid"
MID = "_ts_mid"
OFFSET = "_ts_offset"

# A driver-side table is only broadcast below this many rows.
SMALL_TABLE_ROWS = 100_000


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sorted_tagged(df: DataFrame, order: Sequence[str | Column],
                  num_partitions: int | None = None) -> DataFrame:
    """Range-partition and sort by ``order``; tag partition id and row id.

    The result is checkpointed, so later passes see exactly the same
    partitions, order and ids.
    """
    n = _partitions(df, num_partitions)
    tagged = (df.repartitionByRange(n, *order)
                .sortWithinPartitions(*order)
                .withColumn(PID, F.spark_partition_id())
                .withColumn(MID, F.monotonically_increasing_id()))
    return reliable_checkpoint(tagged)


def local_index() -> Column:
    """Row index inside its partition (monotonic ids are pid << 33 + index)."""
    return F.col(MID) - F.shiftleft(F.col(PID).cast("long"), 33)


def partition_offsets(tagged: DataFrame) -> dict[int, tuple[int, int]]:
    """{pid: (first global position, row count)} for a tagged DataFrame."""
    counts = sorted((r[0], r[1]) for r in
                    tagged.groupBy(PID).agg(F.count(F.lit(1))).collect())
    offsets, running = {}, 0
    for pid, cnt in counts:
        offsets[pid] = (running, cnt)
        running += cnt
    return offsets


def offsets_frame(tagged: DataFrame, offsets: dict[int, tuple[int, int]]) -> DataFrame:
    """One row per partition; its size is bounded by the partition count."""
    spark = tagged.sparkSession
    schema = T.StructType([T.StructField(PID, T.IntegerType(), False),
                           T.StructField(OFFSET, T.LongType(), False)])
    rows = [(int(pid), int(off)) for pid, (off, _) in offsets.items()]
    return spark.createDataFrame(rows, schema)


def with_position(df: DataFrame, order: Sequence[str | Column], pos_col: str = "_pos",
                  num_partitions: int | None = None, keep_tags: bool = False) -> DataFrame:
    """Add a 0-based global position in ``order`` (a unique sort key)."""
    tagged = sorted_tagged(df, order, num_partitions)
    offsets = partition_offsets(tagged)
    small = offsets_frame(tagged, offsets)
    out = (tagged.join(F.broadcast(small), PID)
                 .withColumn(pos_col, F.col(OFFSET) + local_index())
                 .drop(OFFSET))
    if not keep_tags:
        out = out.drop(PID, MID)
    return out


def with_running_total(df: DataFrame, order: Sequence[str], amount: str, name: str,
                       num_partitions: int | None = None) -> DataFrame:
    """Add the sum of ``amount`` over all rows before each row in ``order`` (a
    unique sort key): totals per partition, and a window within each."""
    tagged = sorted_tagged(df, order, num_partitions)
    offsets, running = {}, 0
    for pid, total in sorted((r[0], r[1]) for r in tagged.groupBy(PID).agg(F.sum(amount)).collect()):
        offsets[pid] = (running, total)
        running += total
    before = Window.partitionBy(PID).orderBy(MID).rowsBetween(Window.unboundedPreceding, -1)
    return (tagged.join(F.broadcast(offsets_frame(tagged, offsets)), PID)
            .withColumn(name, F.col(OFFSET) + F.coalesce(F.sum(amount).over(before), F.lit(0)))
            .drop(OFFSET, PID, MID))


def with_running_totals(df: DataFrame, order: Sequence[str], amounts: dict[str, str], reset: str | None = None,
                        num_partitions: int | None = None) -> DataFrame:
    """Add, for each amount, the sum over all rows before each row in ``order``
    (a unique sort key), from one sort; with ``reset`` (the first column of
    ``order``) totals begin anew with each of its values."""
    tagged = sorted_tagged(df, order, num_partitions)
    keys = [PID, *([reset] if reset else [])]
    running: dict = {}
    rows = []
    # One row for each partition and value of ``reset`` in it.
    for r in sorted(tagged.groupBy(*keys).agg(*(F.sum(a).alias(a) for a in amounts)).collect(), key=lambda r: r[PID]):
        group = r[reset] if reset else None
        before = running.get(group, (0,) * len(amounts))
        rows.append((*(r[k] for k in keys), *before))
        running[group] = tuple(b + r[a] for b, a in zip(before, amounts, strict=True))
    offsets = [f"_ts_before_{i}" for i in range(len(amounts))]
    schema = T.StructType([tagged.schema[k] for k in keys] + [T.StructField(o, T.LongType()) for o in offsets])
    inside = Window.partitionBy(*keys).orderBy(MID).rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), keys)
    for (amount, name), offset in zip(amounts.items(), offsets, strict=True):
        out = out.withColumn(name, F.col(offset) + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return out.drop(*offsets, PID, MID)


def hash_thresholds(rows: DataFrame, wanted: dict) -> dict:
    """For each group of ``rows`` (columns ``g`` and ``h``, a 64-bit hash) the
    threshold below which exactly ``wanted[g]`` hashes lie, as (threshold,
    rows wanted of those that equal it, rows that equal it).

    No sort: each round counts the rows of the interval that holds a group's
    threshold by 12 more bits of the hash, so six narrow scans suffice and at
    most 4096 rows per group reach the driver in each.
    """
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    found, state = {}, {g: (0, n) for g, n in wanted.items() if n > 0}
    before = None
    for shift in (52, 40, 28, 16, 4, 0):
        if not state:
            break
        inside = rows
        if before is not None:
            table = rows.sparkSession.createDataFrame(
                [(g, prefix) for g, (prefix, _) in state.items()],
                T.StructType([T.StructField("of", rows.schema["g"].dataType), T.StructField("prefix", T.LongType())]))
            inside = rows.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("of"))
                               & (F.shiftrightunsigned(unsigned, before) == F.col("prefix")))
        counts: dict = {}
        for r in (inside.select("g", F.shiftrightunsigned(unsigned, shift).alias("p")).groupBy("g", "p")
                  .agg(F.count(F.lit(1)).alias("n")).collect()):
            counts.setdefault(r["g"], []).append((r["p"] % (1 << 64), r["n"]))
        following = {}
        for g, (_, need) in state.items():
            for prefix, n in sorted(counts.get(g, [])):
                if need <= n:
                    break
                need -= n
            else:  # every row is wanted
                found[g] = ((1 << 63) - 1, 0, 0)
                continue
            if need == n or shift == 0:
                found[g] = ((prefix + 1 << shift) - 1 - (1 << 63), need, n)
            else:
                following[g] = (prefix if prefix < 1 << 63 else prefix - (1 << 64), need)
        state, before = following, shift
    return found


def attach_small(df: DataFrame, small: DataFrame, on: str | Sequence[str],
                 how: str = "left", limit: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Join a derived table that is usually small.

    The table is collected only up to ``limit + 1`` rows: if it fits, it is
    rebuilt on the driver and broadcast (a proven size bound); otherwise the
    join stays a shuffle join, which AQE may split when a key is skewed.
    """
    rows = small.limit(limit + 1).collect()
    if len(rows) <= limit:
        local = df.sparkSession.createDataFrame(rows, small.schema)
        return df.join(F.broadcast(local), on, how)
    return df.join(small, on, how)


def with_group_index(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                     index_col: str = "_idx", size_col: str | None = None,
                     num_partitions: int | None = None) -> DataFrame:
    """0-based index of each row inside its group, by ``order``.

    A hot group is spread over many range partitions instead of one window
    task: positions are global and the group's first position is subtracted.
    """
    pos = "_ts_gpos"
    positioned = with_position(df, [*group, *order], pos, num_partitions)
    starts = positioned.groupBy(*group).agg(F.min(pos).alias("_ts_gstart"),
                                            F.count(F.lit(1)).alias("_ts_gsize"))
    out = attach_small(positioned, starts, list(group), "inner")
    out = out.withColumn(index_col, F.col(pos) - F.col("_ts_gstart"))
    if size_col:
        out = out.withColumnRenamed("_ts_gsize", size_col)
    else:
        out = out.drop("_ts_gsize")
    return out.drop(pos, "_ts_gstart")
