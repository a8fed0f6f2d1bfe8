"""Helpers that the corpus operators have in common."""

from __future__ import annotations

import ctypes
import math
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera.session import checkpoint_dir

#: Text bytes that a worker handles at once; a longer text is handled alone.
SLICE_BYTES = 8 << 20

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and return
    the table read back: the lineage is cut, and a lost executor loses none
    of it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What empties a module's worker-wide tables, and the operation they serve.
_TABLES: list[Callable[[], None]] = []
_SERVED: list[str] = [""]


def keeps_tables(clear: Callable[[], None]) -> None:
    """Register what empties a table that a worker keeps between tasks."""
    _TABLES.append(clear)


def _begin(operation: str) -> None:
    """Spark gives a worker to one stage after another: tables that served
    another operation are emptied, so that they don't add up."""
    if _SERVED[0] != operation:
        _SERVED[0] = operation
        for clear in _TABLES:
            clear()


def _end() -> None:
    """Give a task's freed memory back, which the next stage may need in the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` for functions of this package: workers look for it
    where the driver found it too, besides their own path."""
    environment = df.sparkSession.sparkContext.environment
    paths = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if PACKAGE_ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_ROOT])
    operation = uuid.uuid4().hex

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(operation)
        yield from run(batches)
        _end()

    return df.mapInArrow(tidy, schema)


def held_out(doc_id: Column | str) -> Column:
    """True for the rows whose label must not be learned from: crc32 of the
    id as text leaves 2 when divided by 4.  False for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    rest = F.crc32(column.cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def quotas(counts: dict, limit: int) -> dict:
    """Places of each class among ``limit``: small classes have all their rows,
    the others equal shares of what is left."""
    out, left = {}, limit
    for rest, (name, n) in zip(range(len(counts), 0, -1), sorted(counts.items(), key=lambda x: (x[1], str(x[0])))):
        out[name] = min(n, left // rest)
        left -= out[name]
    return out


def sample_by_class(rows: DataFrame, name: str, limit: int) -> tuple[DataFrame, dict, dict]:
    """At most ``limit`` of the rows (doc_id, class), whose ids are distinct:
    for each class its quota, taken in the order of a hash of the id.  Also the
    rows of each class in all and in the sample.  Of more classes than
    ``limit``, the most frequent are sampled.

    Rows are first filtered by a bound on the hash below which a class has its
    quota (short by less than six standard deviations), so that only about
    ``limit`` of them reach the driver and no class is sorted."""
    sizes = rows.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(limit).collect()
    counts = {r[name]: r["n"] for r in sizes}
    places = quotas(counts, limit)
    spark = rows.sparkSession
    bounds = spark.createDataFrame(
        [(c, 1.0 if places[c] == n else min(1.0, (places[c] + 6 * math.sqrt(places[c]) + 20) / n)) for c, n in counts.items()],
        StructType([rows.schema[name], *_parse_datatype_string("bound double").fields]))
    hashed = rows.withColumn("h", F.xxhash64("doc_id"))
    low = (hashed.join(F.broadcast(bounds), name).filter(F.pmod("h", F.lit(1 << 30)) < F.col("bound") * float(1 << 30))
           .select("doc_id", name, "h").collect())
    taken, sample = dict.fromkeys(counts, 0), []
    for r in sorted(low, key=lambda r: (r["h"] % (1 << 30), r["h"], r["doc_id"])):
        if taken[r[name]] < places[r[name]]:
            taken[r[name]] += 1
            sample.append((r["doc_id"], r[name]))
    return spark.createDataFrame(sample, StructType([rows.schema["doc_id"], rows.schema[name]])), counts, taken


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column`` (or
    one row), so that memory does not depend on how long the texts are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_slices(df: DataFrame, function: Callable[[], Callable[[pa.RecordBatch], dict]],
               schema: str | StructType, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Apply a per-worker function to Arrow slices.

    ``function()`` is called once in each task and returns the function that
    turns a record batch into a dict of columns.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        apply = function()
        for batch in slices(batches, column, limit):
            out = apply(batch)
            yield pa.record_batch([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array)
                                   else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, kind)
