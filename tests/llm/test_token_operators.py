"""BPE, token files and packing on small fixtures."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe_heap, pieces, rans_tokens, window_packing

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
EDGE_ROWS = [(3, None), (1, ""), (2, "  two  spaces\n\n"), (None, "no id"), (4, "same"), (4, "same"), (5, "word " * 30_000),
             (6, "<|endoftext|> in a text"), (7, "naïve ΣΑΣ 中文 😀\x00\x1c")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "x") for r in EDGE_ROWS], "doc_id long, text string, length string")


def library_ids(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4") for t in texts]


def mixed_texts(n=3000):
    rng = np.random.default_rng(5)
    parts = [" ", "  ", "\n", "\t", "a", "b", "the", "É", "é", "́", "<|endoftext|>", "'s", "'ll", "1", "23", ".", "!",
             "\x1c", "\xa0", " ", "中", "😀", "\x00", "ß", "İ", "Σ", "\r\n", "x", "word,", "Word."]
    return ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("path, make", [
    (BYTE, lambda j: pieces.LibraryCoder(j, True)), (WORD, lambda j: pieces.LibraryCoder(j, False)),
    (BYTE, lambda j: bpe_heap.HeapBpe(j)), (BYTE, lambda j: bpe_heap.HeapBpe(j, max_bytes=9000))])
def test_ids_equal_the_library(path, make):
    coder, texts = make(pieces.tokenizer_json(path)), mixed_texts()
    for at in range(0, len(texts), 500):
        part = texts[at:at + 500]
        for got, want in zip(coder.encode(part), library_ids(path, part), strict=True):
            assert got == want.tobytes()


def test_decoding_equals_the_library():
    coder, tokenizer = bpe_heap.HeapBpe(pieces.tokenizer_json(BYTE)), Tokenizer.from_file(BYTE)
    for text in mixed_texts(500):
        ids = coder.encode([text])[0]
        assert coder.decode(ids) == tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False) == text


def test_bpe_query_and_edge_rows(spark, edge):
    got = bpe_heap.bpe_roundtrip(edge, BYTE).collect()
    assert sorted((r["decoded"] for r in got)) == sorted(t or "" for _, t in EDGE_ROWS)
    assert bpe_heap.bpe_roundtrip(edge.limit(0), BYTE).count() == 0
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, library_ids(BYTE, docs.values()), strict=True))
    for r in bpe_heap.op9_bpe(spark, SF).collect():
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


# Token files ----------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 4096, 16384, 16385, 70_000])
def test_rans_round_trip_and_blocks(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49_408).astype(np.uint32)
    payload = rans_tokens.encode(ids)
    assert (rans_tokens.decode(payload) == ids).all()
    block = rans_tokens.BLOCK
    for b in range(-(-n // block)):
        assert (rans_tokens.decode(payload, b, b + 1) == ids[b * block:(b + 1) * block]).all()


def test_rans_wide_alphabets_sizes_and_damage():
    rng = np.random.default_rng(0)
    for ids in (rng.permutation(100_000), rng.integers(0, 1 << 32, 5000), np.full(50_000, 9)):
        assert (rans_tokens.decode(rans_tokens.encode(ids.astype(np.uint32))) == ids).all()
    ids = (rng.zipf(1.5, 200_000) % 1000).astype(np.uint32)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    payload = rans_tokens.encode(ids)
    assert 8 * len(payload) < 1.15 * len(ids) * -(share * np.log2(share)).sum()
    for at in (30, len(payload) // 2, len(payload) - 2):
        broken = bytearray(payload)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            rans_tokens.decode(bytes(broken))


def test_token_file_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in rans_tokens.op6_rans(spark, SF).collect()}
    start = 0
    for (key, _), ids in zip(docs, library_ids(WORD, [t for _, t in docs]), strict=True):
        ids = np.append(ids, 1).astype("<u4")
        assert (got[key]["start"], got[key]["n_tokens"], got[key]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_file_edge_rows(spark, edge):
    file = rans_tokens.write_token_file(edge, WORD, 1, False)
    got = rans_tokens.read_token_file(file).orderBy("start").collect()
    ordered = sorted(EDGE_ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [k for k, _ in ordered]
    want = [np.append(i, 1).astype("<u4").tobytes() for i in library_ids(WORD, [t for _, t in ordered])]
    assert [r["token_ids"] for r in got] == want
    assert rans_tokens.read_token_file(rans_tokens.write_token_file(edge.limit(0), WORD, 1, False)).count() == 0


# Packing --------------------------------------------------------------------

def check_packing(rows, want, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] * 4 == len(r["token_ids"]) > 0
            at += r["length"]
        assert at <= capacity
    pieces_of = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["token_ids"]) for r in rows)
    expected = {}
    for key, ids in want:
        expected.setdefault(key, []).append(ids)
    for key, all_ids in expected.items():
        mine = [p for p in pieces_of if (p[1] if p[0] else None) == key]
        assert sum(len(p[3]) for p in mine) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            assert b"".join(p[3] for p in mine) == all_ids[0]
    return sum(r["length"] for r in rows) / (capacity * len(by_sequence))


def test_windows_place_best_fit_and_emit_the_fullest():
    windows = window_packing.Windows(10, 2)
    assert windows.place(6, "a") is None and windows.place(5, "b") is None
    assert windows.place(4, "c") == ["a", "c"]  # fills the window with the least room
    assert windows.place(6, "d") is None
    assert windows.place(7, "e") == ["d"]  # none fits: the fullest goes
    assert sorted(x for held in windows.held.values() for x in held) == ["b", "e"]


@pytest.mark.parametrize("merge_ids", [1 << 19, 100])
def test_packing_holds_each_id_once(spark, edge, merge_ids):
    rows = window_packing.pack(edge, BYTE, 0, True, capacity=64, open_windows=3, merge_ids=merge_ids).collect()
    want = [(k, np.append(i, 0).astype("<u4").tobytes())
            for (k, _), i in zip(EDGE_ROWS, library_ids(BYTE, [t for _, t in EDGE_ROWS]), strict=True)]
    check_packing(rows, want, 64)
    assert window_packing.pack(edge.limit(0), BYTE, 0, True).count() == 0


def test_packing_query_pads_little(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = window_packing.pack_documents(docs).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = [(k, np.append(i, 0).astype("<u4").tobytes()) for (k, _), i in zip(texts, library_ids(BYTE, [t for _, t in texts]), strict=True)]
    assert check_packing(rows, want, 1024) > 0.98
    query = window_packing.op8_packing(spark, SF)
    assert query.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    piece = max(rows, key=lambda r: r["start"])
    assert query.filter((F.col("doc_id") == piece["doc_id"]) & (F.col("start") == piece["start"])).first()["ids_crc32"] == \
        zlib.crc32(piece["token_ids"])
