"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly
linked symbol list, decoding by concatenating vocabulary strings.

``bpe_roundtrip`` turns each text into its ids and the ids back into text.
Null and empty texts have no ids and decode to the empty text; repeated rows
are coded one by one; other columns are kept unless they bear the name of an
output column, which then wins.
"""

from __future__ import annotations

import heapq
import itertools
import json
import zlib
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import pieces, shared

#: Fixed value: the split of byte-level BPE, with the white space of Unicode.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


class HeapBpe(pieces.PieceCoder):
    """Encoder and decoder for a tokenizer JSON of the byte-level kind."""

    def __init__(self, tokenizer_json: str, max_bytes: int = pieces.MAX_BYTES):
        super().__init__(max_bytes)
        spec = json.loads(tokenizer_json)
        model, letter = spec["model"], pieces.byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = tuple(self.added)
        self.vocabulary: dict[int, bytes] = {}
        for token, number in model["vocab"].items():
            if token not in self.added:
                self.vocabulary[number] = bytes(letter[c] for c in token)
        self.vocabulary.update({n: s.encode() for s, n in self.added.items()})
        of_bytes = {b: n for n, b in self.vocabulary.items() if n not in self.added.values()}
        self.first = [of_bytes[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        ids = model["vocab"]
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.split = regex.compile(SPLIT)
        self.words: dict[str, bytes] = {}
        self.marks = regex.compile("|".join(regex.escape(s) for s in self.added)) if self.added else None

    def word_ids(self, word: str) -> list[int]:
        """Merge the pairs of one word, lowest rank first, leftmost among
        equals.  An entry is stale when its symbols have changed since."""
        symbols = [self.first[b] for b in word.encode()]
        n, merges = len(symbols), self.merges
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        queue = []
        for at, pair in enumerate(zip(symbols, symbols[1:])):
            if pair in merges:
                queue.append((*merges[pair], at, pair))
        heapq.heapify(queue)
        while queue:
            _, merged, at, pair = heapq.heappop(queue)
            right = after[at]
            if right >= n or symbols[at] != pair[0] or symbols[right] != pair[1]:
                continue
            symbols[at], symbols[right] = merged, -1
            beyond = after[at] = after[right]
            if beyond < n:
                before[beyond] = at
                if found := merges.get((merged, symbols[beyond])):
                    heapq.heappush(queue, (*found, at, (merged, symbols[beyond])))
            if (left := before[at]) >= 0 and (found := merges.get((symbols[left], merged))):
                heapq.heappush(queue, (*found, left, (symbols[left], merged)))
        return [s for s in symbols if s >= 0]

    def word(self, word: str, spaced: bool) -> bytes:
        return array("I", self.word_ids(" " + word if spaced else word)).tobytes()

    def _plain(self, text: str) -> bytes:
        out = []
        for word in self.split.findall(text):
            ids = self.words.get(word)
            if ids is None:
                ids = array("I", self.word_ids(word)).tobytes()
                if len(word) <= 64:
                    self.words[word] = ids
            out.append(ids)
        return b"".join(out)

    def whole(self, texts: list[str]) -> list[bytes]:
        if len(self.words) * 2 * pieces.PIECE_BYTES > self.max_bytes // 2:
            self.words = dict(itertools.islice(self.words.items(), len(self.words) // 2))
        out = []
        for text in texts:
            if self.marks is None or not any(s in text for s in self.specials):
                out.append(self._plain(text))
                continue
            parts, at = [], 0
            for m in self.marks.finditer(text):
                parts += [self._plain(text[at:m.start()]), array("I", [self.added[m[0]]]).tobytes()]
                at = m.end()
            out.append(b"".join([*parts, self._plain(text[at:])]))
        return out

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.vocabulary.__getitem__, numbers)).decode("utf-8", errors="replace")


_CODERS: dict[int, HeapBpe] = {}
shared.keeps_tables(_CODERS.clear)


def coder(tokenizer_json: str) -> HeapBpe:
    """One coder per worker process, so that its table serves later tasks."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _CODERS:
        _CODERS[key] = HeapBpe(tokenizer_json)
    return _CODERS[key]


def bpe_roundtrip(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``token_ids`` (little-endian uint32 bytes) and ``decoded``
    (the text made from those ids alone) for every row; null text is empty."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces.tokenizer_json(tokenizer_path))
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def start():
        bpe = coder(sent.value)

        def apply(batch):
            ids = bpe.encode(batch.column("text").to_pylist())
            return {key: batch.column("key"), "token_ids": ids, "decoded": [*map(bpe.decode, ids)]}

        return apply

    kind = docs.schema[key].dataType.simpleString()
    return shared.map_slices(source, start, f"`{key}` {kind}, token_ids binary, decoded string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text."""
    import public_tokenizers

    made = bpe_roundtrip(shared.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return made.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


__all__ = ["HeapBpe", "bpe_roundtrip", "op9_bpe"]
