"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows.  Whole windows of a long
document are sequences by themselves; what is left of it goes into the open
window where it leaves the least room.  When it fits into none, the fullest
window is emitted and a fresh one opened.  The windows still open at the end
of the partitions are merged: dealt into groups of bounded size, joined and
cut afresh, so that at most one sequence of a group is not full.

Rows: null text is empty, and every document ends with the end id, so each
has a piece; equal rows are packed one by one.  An empty table gives no piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.llm import pieces, shared

#: Open windows of a partition.
OPEN_WINDOWS = 128
#: Ids in a group of the final merge.
MERGE_IDS = 1 << 19


class Windows:
    """Open windows by the room they have left, for pieces shorter than a
    window.  ``place`` returns the pieces of the window that went, if any."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.room: list[tuple[int, int]] = []  # sorted; (room, window)
        self.held: dict[int, list] = {}
        self.opened = 0

    def place(self, length: int, piece: object) -> list | None:
        gone = None
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) == self.most:
                gone = self.held.pop(self.room.pop(0)[1])
            room, window = self.capacity, self.opened
            self.opened += 1
            self.held[window] = []
        self.held[window].append(piece)
        if room > length:
            insort(self.room, (room - length, window))
            return gone
        return self.held.pop(window)  # full; then none had to go


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, keeps_space: bool, capacity: int = 1024,
         open_windows: int = OPEN_WINDOWS, merge_ids: int = MERGE_IDS, text: str = "text",
         key: str = "doc_id") -> DataFrame:
    """One row per piece: key, ``start`` in its document, ``length``,
    ``doc_tokens``, ``sequence_id``, ``offset`` there, and ``token_ids``
    (little-endian uint32)."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces.tokenizer_json(tokenizer_path))
    kind = docs.schema[key].dataType.simpleString()
    schema = _parse_datatype_string(
        f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, token_ids binary, open int")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, coder = to_arrow_schema(schema), pieces.coder(sent.value, keeps_space)
        number = TaskContext.get().partitionId() << 40
        windows, rows = Windows(capacity, open_windows), []

        def emit(found: list, open_window: int | None = None) -> None:
            nonlocal number
            offset = 0
            for piece in found:
                name, start, length, total, ids = piece
                rows.append((name, start, length, total, number, offset, ids, open_window))
                offset += length
            number += 1

        def flush() -> pa.RecordBatch:
            columns = [*zip(*rows, strict=True)] if rows else [()] * len(arrow)
            rows.clear()
            return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in shared.slices(batches):
            texts = batch.column("text").to_pylist()
            for name, ids in zip(batch.column("key").to_pylist(), coder.encode(texts), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    length = min(capacity, total - start)
                    piece = (name, start, length, total, ids[4 * start:4 * (start + length)])
                    if length == capacity:
                        emit([piece])
                        continue
                    if gone := windows.place(length, piece):
                        emit(gone)
            yield flush()
        for window, found in windows.held.items():
            emit(found, window)
        yield flush()

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    first = shared.written(shared.map_arrow(source, run, schema), "packed")
    left = first.filter("open IS NOT NULL")
    total = left.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // merge_ids))
    dealt = (left.withColumn("merge_group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("int"))
             .repartition("merge_group").sortWithinPartitions("merge_group", "sequence_id", "offset"))
    merged_schema = _parse_datatype_string(schema.simpleString()[7:-1])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(merged_schema)
        group, number, fill = None, 0, 0
        for batch in shared.slices(batches, "token_ids"):
            rows = []
            for r in batch.to_pylist():
                if r["merge_group"] != group:
                    group, fill = r["merge_group"], 0
                    number = (1 << 62) + (group << 32)
                at = 0
                while at < r["length"]:
                    taken = min(capacity - fill, r["length"] - at)
                    rows.append((r["key"], r["start"] + at, taken, r["doc_tokens"], number, fill,
                                 r["token_ids"][4 * at:4 * (at + taken)], None))
                    at, fill = at + taken, fill + taken
                    if fill == capacity:
                        number, fill = number + 1, 0
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)],
                                  schema=arrow)

    merged = shared.map_arrow(dealt, merge, merged_schema)
    return first.filter("open IS NULL").unionByName(merged).drop("open").withColumnRenamed("key", key)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, keeps_space=True)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return digest(pack_documents(shared.read_table(spark, sf_dir, "documents")))
