"""Token-id files coded by a static range asymmetric numeral system (rANS).

A token file is a table of segments.  The documents of a segment share one
frequency table; the segment's ids are cut into blocks that are coded apart,
each by several interleaved states, so that any block can be decoded without
the others.  The block index is the list of checkpoints (where a block's
words start, how many ids it holds, its final states) with a CRC-32 of each
block's ids; the header has one of its own.

Layout of a payload (little-endian): ``HEADER``, symbols (u32), their
frequencies (u32), per block: first word (u64), ids (u32), CRC-32 (u32),
states (u64 each), then the words (u32), at last the CRC-32 of all that
stands before the words.

Rows: a null text is an empty document; documents are ordered by key (null
first), then by text, and equal rows are kept.  An empty table gives no
segment.  Other columns of the input are not stored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera.llm import pieces, shared

HEADER = struct.Struct("<4sIIIQII")  # magic, lanes, block, bits, ids, symbols, blocks
MAGIC = b"rTK1"
LANES = 32
BLOCK = 16 * 1024
#: Ids after which a segment is closed; a longer document is one segment.
SEGMENT = 1 << 21
LOW = np.uint64(1 << 31)


def frequencies(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Scale counts to a sum of two to the ``bits``, each at least 1."""
    bits = max(12, int(len(counts) - 1).bit_length() + 2)
    whole = 1 << bits
    scaled = np.maximum(1, counts * (whole / counts.sum())).astype(np.int64)
    order = np.argsort(-scaled, kind="stable")
    missing = whole - int(scaled.sum())
    if missing >= 0:
        scaled[order[0]] += missing
        return scaled, bits
    spare = scaled - 1
    scaled -= spare * -missing // spare.sum()
    for at in order:
        over = int(scaled.sum()) - whole
        if not over:
            break
        scaled[at] -= min(over, scaled[at] - 1)
    return scaled, bits


def _tables(scaled: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and starts; one more symbol leaves a state as it is, for
    the lanes beyond the end of the last block."""
    freq = np.append(scaled, 1 << bits).astype(np.uint64)
    start = np.append(np.cumsum(scaled) - scaled, 0).astype(np.uint64)
    return freq, start


def encode(ids: np.ndarray, lanes: int = LANES, block: int = BLOCK) -> bytes:
    """Payload of a segment for an array of ids (below 2**32)."""
    n = len(ids)
    n_blocks = -(-n // block)
    if not n:
        head = HEADER.pack(MAGIC, lanes, block, 0, 0, 0, 0)
        return head + struct.pack("<I", zlib.crc32(head))
    if (top := int(ids.max())) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        place = np.zeros(top + 1, dtype=np.int64)
        place[symbols] = np.arange(len(symbols))
        index, counts = place[ids], counts[symbols]
    else:
        symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    scaled, bits = frequencies(counts)
    freq, start = _tables(scaled, bits)
    steps = block // lanes if n_blocks > 1 else -(-n // lanes)
    grid = np.full(n_blocks * steps * lanes, len(symbols), dtype=np.int64)
    grid[:n] = index
    grid = np.ascontiguousarray(grid.reshape(n_blocks, steps, lanes).transpose(1, 0, 2))
    state = np.full((n_blocks, lanes), LOW, dtype=np.uint64)
    words = np.empty((steps, n_blocks, lanes), dtype=np.uint32)
    sent = np.empty((steps, n_blocks, lanes), dtype=bool)
    room, shift, word = np.uint64(63 - bits), np.uint64(bits), np.uint64(32)
    for s in range(steps - 1, -1, -1):
        f = freq[grid[s]]
        full = state >= f << room
        sent[s], words[s] = full, state  # the low 32 bits
        state = np.where(full, state >> word, state)
        high, low = np.divmod(state, f)
        state = (high << shift) + low + start[grid[s]]
    sent, words = sent.transpose(1, 0, 2), words.transpose(1, 0, 2)
    per_block = sent.sum(axis=(1, 2))
    ends = np.minimum(np.arange(1, n_blocks + 1) * block, n)
    raw = np.ascontiguousarray(ids, dtype="<u4")
    index_rows = [struct.pack("<QII", at, int(ends[b] - b * block), zlib.crc32(raw[b * block:ends[b]]))
                  for b, at in enumerate((np.cumsum(per_block) - per_block).tolist())]
    head = b"".join([HEADER.pack(MAGIC, lanes, block, bits, n, len(symbols), n_blocks),
                     symbols.astype("<u4").tobytes(), scaled.astype("<u4").tobytes(), *index_rows,
                     state.astype("<u8").tobytes()])
    return b"".join([head, words[sent].astype("<u4").tobytes(), struct.pack("<I", zlib.crc32(head))])


def decode(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (exclusive; all by default).
    Raises ValueError if a checksum doesn't hold."""
    magic, lanes, block, bits, n, n_symbols, n_blocks = HEADER.unpack_from(payload)
    index_at = HEADER.size + 8 * n_symbols
    states_at = index_at + 16 * n_blocks
    words_at = states_at + 8 * lanes * n_blocks
    if magic != MAGIC or zlib.crc32(payload[:words_at]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("the header of a token segment is damaged")
    last = n_blocks if last is None else last
    if first >= last:
        return np.empty(0, dtype=np.uint32)
    symbols = np.frombuffer(payload, "<u4", n_symbols, HEADER.size)
    scaled = np.frombuffer(payload, "<u4", n_symbols, HEADER.size + 4 * n_symbols).astype(np.int64)
    index = np.frombuffer(payload, [("word", "<u8"), ("ids", "<u4"), ("crc", "<u4")], n_blocks, index_at)[first:last]
    state = np.frombuffer(payload, "<u8", lanes * n_blocks, states_at).reshape(n_blocks, lanes)[first:last].astype(np.uint64)
    words = np.append(np.frombuffer(payload, "<u4", (len(payload) - 4 - words_at) // 4, words_at), [0]).astype(np.uint64)
    freq, start = _tables(scaled, bits)
    of_slot = np.repeat(np.arange(n_symbols), scaled)
    steps = -(-int(index["ids"].max()) // lanes)
    out = np.empty((steps, last - first, lanes), dtype=np.int64)
    at = index["word"].astype(np.int64)
    lane = np.arange(lanes)
    partial = int(index["ids"].min()) // lanes
    mask, shift, word, beyond = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32), len(words) - 1
    for s in range(steps):
        slot = state & mask
        symbol = of_slot[slot.astype(np.int64)]
        if s >= partial:
            symbol[s * lanes + lane[None, :] >= index["ids"][:, None]] = n_symbols
        out[s] = symbol
        state = freq[symbol] * (state >> shift) + slot - start[symbol]
        need = state < LOW
        taken = np.cumsum(need, axis=1)
        next_word = words[np.minimum(at[:, None] + taken - 1, beyond)]
        state = np.where(need, (state << word) | next_word, state)
        at = at + taken[:, -1]
    found = out.transpose(1, 0, 2).reshape(last - first, -1)
    parts = []
    for row, (_, count, crc) in zip(found, index, strict=True):
        ids = symbols[row[:count]]
        if zlib.crc32(np.ascontiguousarray(ids)) != crc:
            raise ValueError("a block of a token segment is damaged")
        parts.append(ids)
    return np.concatenate(parts)


def write_token_file(docs: DataFrame, tokenizer_path: str, end_id: int, keeps_space: bool, text: str = "text",
                     key: str = "doc_id") -> DataFrame:
    """Encode the documents in ascending key order and write their segments
    below the shared folder.  Returns the table of segments: ``part`` (its
    order is the key order), ``segment``, ``first_token`` within the part,
    ``keys``, ``lengths`` (with the end id) and ``payload``."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces.tokenizer_json(tokenizer_path))
    kind = docs.schema[key].dataType.simpleString()
    schema = _parse_datatype_string(f"part int, segment int, first_token long, n_tokens long, "
                                    f"keys array<{kind}>, lengths array<long>, payload binary")
    ordered = (docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
               .repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", "text"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, coder = to_arrow_schema(schema), pieces.coder(sent.value, keeps_space)
        part, segment, before = TaskContext.get().partitionId(), 0, 0
        keys, coded, held = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(coded), "<u4")
            row = [part, segment, before, len(ids), keys, [len(c) // 4 for c in coded], encode(ids)]
            return pa.record_batch([pa.array([v], type=f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in shared.slices(batches):
            texts = batch.column("text").to_pylist()
            for name, ids in zip(batch.column("key").to_pylist(), coder.encode(texts), strict=True):
                keys.append(name)
                coded.append(ids + end)
                held += len(coded[-1]) // 4
                if held >= SEGMENT:
                    yield close()
                    segment, before, keys, coded, held = segment + 1, before + held, [], [], 0
        if keys:
            yield close()

    return shared.written(shared.map_arrow(ordered, run, schema), "tokens")


def read_token_file(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document of a token file, decoded from the payloads:
    the key, ``start`` (ids of all documents before it) and ``token_ids``."""
    kind = segments.schema["keys"].dataType.elementType.simpleString()
    schema: StructType = _parse_datatype_string(f"`{key}` {kind}, start long, token_ids binary")
    # One row per part: its length does not depend on the documents' number.
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = totals.select(F.col("part").alias("of_part"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    placed = segments.join(base, F.col("part") == F.col("of_part")).select(
        "keys", "lengths", "payload", (F.col("base") + F.col("first_token")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in shared.slices(batches, "payload", 1):
            row = batch.to_pylist()[0]
            raw = decode(row["payload"]).tobytes()
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            yield pa.record_batch([
                pa.array(row["keys"], type=arrow.field(0).type), pa.array(starts + row["start"], type=pa.int64()),
                pa.array([raw[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], type=pa.binary())],
                schema=arrow)

    return shared.map_arrow(placed, run, schema)


def op6_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the token file, and their CRC-32."""
    import public_tokenizers

    segments = write_token_file(shared.read_table(spark, sf_dir, "documents"),
                                public_tokenizers.path("word_bpe_49k.json"), end_id=1, keeps_space=False)
    return read_token_file(segments).select(
        "doc_id", "start", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("token_ids").alias("ids_crc32"))
