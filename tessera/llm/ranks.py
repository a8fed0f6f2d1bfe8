"""Places of rows within their groups, however large a group is."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from tessera.llm import shared
from tessera.plans import ordering


def _starts(group: pa.Array) -> np.ndarray:
    """Where a batch's runs of equal groups begin."""
    codes = group.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])


def ranked(rows: DataFrame, group: str, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Add ``name``, the place (from 0) of each row among those of its
    ``group`` (a string without nulls) by ``order``.

    Rows are sorted by range and written, so a group of any size spans many
    partitions.  Only a partition's first and last group reach the driver; from
    them follows where its first group goes on.  Rows that are equal in
    ``order`` get places in any order, which stays since they are written.
    """
    tagged = ordering.sorted_tagged(rows.select(*rows.columns), [group, *order])
    ends = _parse_datatype_string("pid int, first string, n_first long, last string, n_last long")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(group)
            starts = _starts(column)
            for start, size in zip(starts[[0, -1]] if len(starts) > 1 else starts[:1],
                                   np.diff(np.append(starts, batch.num_rows))[[0, -1]], strict=False):
                own = column[int(start)].as_py()
                if found is None:
                    found = {"pid": batch.column(ordering.PID)[0].as_py(), "first": own, "n_first": 0, "last": own, "n_last": 0}
                if own != found["last"]:
                    found |= {"last": own, "n_last": 0}
                found["n_last"] += int(size)
                if own == found["first"]:
                    found["n_first"] += int(size)
        if found:
            yield pa.RecordBatch.from_pylist([found], schema=to_arrow_schema(ends))

    before, last, carried = {}, None, 0
    for r in sorted(shared.map_arrow(tagged.select(group, ordering.PID), summary, ends).collect(), key=lambda r: r["pid"]):
        before[r["pid"]] = carried if r["first"] == last else 0
        carried = r["n_last"] + (before[r["pid"]] if r["first"] == r["last"] else 0)
        last = r["last"]
    kept = [f for f in tagged.schema if f.name not in (ordering.PID, ordering.MID)]
    schema = StructType([*kept, StructField(name, LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, last, following = to_arrow_schema(schema), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(group)
            starts = _starts(column)
            if last is None:
                last, following = column[0].as_py(), before[batch.column(ordering.PID)[0].as_py()]
            sizes = np.diff(np.append(starts, batch.num_rows))
            begin = np.zeros(len(starts), dtype=np.int64)
            begin[0] = following if column[0].as_py() == last else 0
            places = np.arange(batch.num_rows) - np.repeat(starts - begin, sizes)
            last, following = column[batch.num_rows - 1].as_py(), int(places[-1]) + 1
            yield pa.record_batch([*(batch.column(f.name) for f in kept), pa.array(places, type=pa.int64())], schema=arrow)

    return shared.map_arrow(tagged, number, schema)
