"""Conversation repair, nearest neighbours, the Merkle manifest and ranks."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import balanced_postings, conversation_repair, merkle_manifest, ranks
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# Ranks -----------------------------------------------------------------------

def test_ranks_of_a_hot_group(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"g{i % 40}", i) for i in range(400)] + [("z", 1)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x long").repartition(7)
    want = {}
    for g, x in sorted(rows):
        want[g, x] = sum(1 for k in want if k[0] == g) if g != "hot" else x
    assert {(r["g"], r["x"]): r["rank"] for r in ranks.ranked(df, "g", ["x"]).collect()} == want
    assert ranks.ranked(df.limit(0), "g", ["x"]).count() == 0


# Conversations -----------------------------------------------------------------

STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """The contract by dynamic programming over whole conversations."""
    every = {}
    for conv, turn, role, text in rows:
        kept = every.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in every.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in own if r[0] is not None]
        faults, seen = [], set()
        for _, role, text in own:
            body = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        best = None
        for i in range(len(own), -1, -1):
            made = {q: (0, "", ()) if i == len(own) and q in (0, 3) else None for q in range(4)}
            for q in range(4) if i < len(own) else ():
                _, role, text = own[i]
                ways = [(best[q][0] + 3, "D" + best[q][1], best[q][2])] if best[q] else []
                if faults[i] not in ("blank", "duplicate"):
                    for letter, cost, edit, name in ((role[:1], 0, "K", role), ("u", 2, "R", "user"), ("a", 2, "R", "assistant")):
                        to = best.get(STEP[q].get(letter))
                        if to:
                            ways.append((to[0] + cost + (faults[i] == "truncated"), edit + to[1], (f"{name}:{text}", *to[2])))
                made[q] = min(ways, default=None)
            for _ in range(6):
                for q in range(4):
                    for letter, name in NAMES.items():
                        to = made.get(STEP[q].get(letter))
                        if to:
                            made[q] = min(x for x in (made[q], (to[0] + 2, "I" + to[1], (f"{name}:", *to[2]))) if x)
            best = made
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), pairs, best[0][0], best[0][1], hashlib.sha256("\n".join(best[0][2]).encode()).hexdigest())
    return out


def repaired(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_conversations_equal_dynamic_programming(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    assert repaired(QUERIES["op11_conversation_repair"](spark, SF)) == plain_repair(rows)


def test_long_conversation_nulls_ties_and_clashing_names(spark):
    rnd, rows = random.Random(1), []
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", None, ""], ["a.", "b?", "c", "", None, " x! ", "\n"]
    for i in range(900):  # of more than three runs
        rows.append((7, i if rnd.random() < 0.97 else None, rnd.choice(roles), rnd.choice([*texts, f"t{i}."])))
    for _ in range(300):
        rows.append((rnd.choice([1, 2, None, 3]), rnd.randint(0, 40), rnd.choice(roles), "long " * rnd.choice([1, 20000]) + "."))
    df = (spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
          .withColumns({"conv": F.lit("x"), "rank": F.lit(1), "copy": F.lit(2), "digest": F.lit(0), "kind": F.lit(9)}))
    assert repaired(conversation_repair.repair_conversations(df)) == plain_repair(rows)
    assert conversation_repair.repair_conversations(df.limit(0)).count() == 0


def test_dropped_conversation_needs_no_edit(spark):
    key = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*key, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert repaired(conversation_repair.repair_conversations(df)) == {key[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_lattice_and_runs_agree():
    """One lattice for all rows against runs of six, carried on."""
    rnd = random.Random(5)
    for _ in range(300):
        symbols = "".join(rnd.choice("suaxSUAX0123uaua") for _ in range(rnd.randint(1, 30)))
        vector = {0: (0, None)}
        for i in range(0, len(symbols), 6):
            made = [conversation_repair.cheapest(symbols[i:i + 6], q, (to,)) or (-1, "") for q in range(4) for to in range(4)]
            vector = conversation_repair._carried(vector, [m[0] for m in made], [m[1] for m in made])
        ends = min((vector[q][0], conversation_repair._joined(vector[q][1])) for q in (0, 3) if q in vector)
        assert ends == conversation_repair.cheapest(symbols, 0, (0, 3))
    assert conversation_repair.cheapest("", 0, (0, 3)) == (0, "")
    assert conversation_repair.cheapest("a", 0, (0, 3)) == (2, "IK")


# Nearest neighbours ------------------------------------------------------------

def plain_nearest(ids, vectors, asked, k):
    out = {}
    for i in np.flatnonzero(asked):
        scores = (vectors * vectors[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(df, key="vec_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r[key], r["score"]))
    return out


def recall(got, want):
    return sum(len({x for x, _ in got[q]} & {x for x, _ in near}) for q, near in want.items()) / sum(map(len, want.values()))


def test_neighbours_query_recall(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet")
    ids, vectors = np.array(table["vec_id"]), np.array(table["embedding"].to_pylist(), dtype=np.float64)
    got, want = found(QUERIES["op12_balanced_postings"](spark, SF)), plain_nearest(ids, vectors, ids % 20 == 0, 20)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in want)
    assert recall(got, want) >= 0.9


def test_neighbours_over_many_lists_with_norms_and_copies(spark):
    rnd = np.random.default_rng(11)
    vectors = rnd.normal(size=(3000, 16)) * rnd.lognormal(sigma=0.5, size=(3000, 1))
    vectors[1000:2000] = vectors[5]  # a third are copies
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    got = found(balanced_postings.nearest_neighbours(df, F.col("id") % 20 == 0, size=64))
    want = plain_nearest(ids, vectors, ids % 20 == 0, 20)
    assert recall(got, want) >= 0.9
    near = got[1000]  # its copies have one score and come by id
    assert [i for i, _ in near] == [i for i, _ in want[1000]]
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0])) and q not in [i for i, _ in rows]
        assert all(abs(s - float((vectors[q] * vectors[i]).sum())) <= 1e-9 * max(1.0, abs(s)) for i, s in rows)


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 1.0, 1.0]), (40, [0.0, 0.0]), (None, [1.0, 1.0]), (60, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "score": F.lit("x"), "id": F.lit(3)})
    got = found(balanced_postings.nearest_neighbours(df, F.col("id") % 20 == 0))
    assert got == {20: [(1, 2.0), (2, 2.0), (3, -1.0)]}
    assert balanced_postings.nearest_neighbours(df.limit(0), F.col("id") % 20 == 0).count() == 0


# Merkle manifest ---------------------------------------------------------------

def plain_manifest(rows):
    """The contract with lists: {doc_id: row} of rows (doc_id, source, lang,
    n_chars, text) with distinct ids."""
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    sources = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [grow([leaf(r) for r in sources[s]]) for s in order]
    upper = grow([t[-1][0] for t in trees])
    out = {}
    for place, (source, tree) in enumerate(zip(order, trees, strict=True)):
        for i, row in enumerate(sources[source]):
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            folded = leaf((*row[:4], row[4].replace("\n", "") if even and row[4] is not None else row[4]))
            proof = ""
            for levels, at in ((tree, i), (upper, place)):
                for level in levels[:-1]:
                    run = level[at // 3 * 3:at // 3 * 3 + 3]
                    proof += "".join(run[:at % 3] + run[at % 3 + 1:])
                    folded = h(*run[:at % 3], folded, *run[at % 3 + 1:])
                    at //= 3
            out[row[0]] = (leaf(row), tree[-1][0], upper[-1][0], h(proof), folded, folded == upper[-1][0])
    return out


def proven(df):
    leaves = merkle_manifest.document_leaves(df)
    return merkle_manifest.prove(merkle_manifest.build(leaves, "source", ["doc_id"], "leaf"), "doc_id", "altered")


@pytest.mark.parametrize("sizes", [(1,), (81,), (82, 1), (3, 243, 0, 7), (1, 1, 1, 1, 800)])
def test_manifest_equals_lists(spark, sizes):
    rnd, rows = random.Random(sum(sizes)), []
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((len(rows) * 7 - 50, None if s == 1 else f"é{s}", rnd.choice([None, "en"]), rnd.choice([None, 3]),
                         rnd.choice([None, "", "a\nb", "plain", "ü\n" * 3000])))
    rows.append((None, "é0", None, None, "x"))
    rnd.shuffle(rows)
    df = (spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
          .withColumns({"tree": F.lit(1), "digest": F.lit("x"), "rank": F.lit(2), "leaf": F.lit("y"), "block": F.lit(0)}))
    assert {r[0]: tuple(r)[1:] for r in proven(df).collect()} == plain_manifest(rows)


def test_manifest_of_equal_rows_and_of_none(spark):
    df = spark.createDataFrame([(5, "s", "en", 1, "a\nb")] * 300, "doc_id long, source string, lang string, n_chars long, text string")
    got = proven(df).collect()
    assert len(got) == 300 and len({r["leaf"] for r in got}) == 1
    manifest = merkle_manifest.build(merkle_manifest.document_leaves(df), "source", ["doc_id"], "leaf")
    assert manifest.records().count() < 20  # equal subtrees have one record
    assert proven(df.limit(0)).count() == 0
