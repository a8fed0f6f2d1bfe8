"""Near-duplicates, embeddings, sharding, components and the pipeline."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import cover_tree, histogram_sort, hyperminhash, pii_spans, shared
from tessera.llm.components import components
from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def reached(n, links):
    above = list(range(n))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < 3 else set(zip(words, words[1:], words[2:]))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    got = QUERIES[name](spark, SF)
    with duckdb.connect() as con:
        for file in os.listdir(SF):
            con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
        want = con.sql(ORACLES[name])
        columns = want.columns
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7)] + [(100, 101 + i) for i in range(50)] + [(120, 6)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 6)) and got[8] == got[9] == 8
    assert got[100] == got[150] == got[6] == 6
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# HyperMinHash ---------------------------------------------------------------

def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for share in (0.1, 0.5, 0.8, 0.95):
        for _ in range(20):
            n = int(rng.integers(50, 3000))
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = a.copy()
            b[:int(n * (1 - share))] = rng.integers(0, 1 << 63, int(n * (1 - share)))
            regs = hyperminhash.registers([np.unique(a), np.unique(b)])
            both = len(np.intersect1d(a, b))
            by_chance = hyperminhash.chance(np.float64(n), np.float64(n))
            errors.append(((regs[0] == regs[1]).mean() - by_chance) / (1 - by_chance) - both / (2 * n - both))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def near_copies(n):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.integers(0, 12)):
            words[rng.integers(150)] = f"z{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("blocks", [(1024, 256), (70, 40)])
def test_near_copies_equal_brute_force(spark, blocks):
    rows = near_copies(300)
    sets = [plain_set(t) for _, t in rows]
    links = [(i, j) for i in range(300) for j in range(i)
             if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in hyperminhash.near_duplicates(docs, blocks=blocks).collect()}
    assert [got[i]["component_id"] for i in range(300)] == reached(300, links)
    assert all(got[i]["n_shingles"] == len(sets[i]) for i in range(300))


def test_near_duplicates_edge_rows(spark):
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "A"), (5, "a b"), (6, "a b"), (6, "a b"), (None, "a b"),
            (7, "É b c"), (8, "é b c"), (9, "x " * 50_000), (10, "X " * 60_000), (11, "one two three four")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = hyperminhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["n_shingles"] for i in range(5)] == [0, 0, 0, 1, 1]
    assert all(by_id[i]["kept"] and by_id[i]["component_id"] == i for i in (0, 1, 2, 3, 5, 7, 8, 9, 11))
    assert (by_id[4]["component_id"], by_id[6]["component_id"], by_id[10]["component_id"]) == (3, 5, 9)
    assert by_id[None]["kept"] and by_id[None]["component_id"] is None
    assert hyperminhash.near_duplicates(docs.limit(0)).count() == 0


# Cover trees ------------------------------------------------------------------

def clustered(n, d):
    rng = np.random.default_rng(n + d)
    centers = rng.normal(size=(12, d))
    spread = rng.choice([0.01, 0.05, 0.2, 0.4], size=(n // 2, 1))
    x = np.concatenate([centers[rng.integers(12, size=n // 2)] + rng.normal(size=(n // 2, d)) * spread,
                        rng.normal(size=(n - n // 2, d))])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n, d", [(1, 4), (2, 4), (60, 3), (500, 16), (400, 64)])
def test_dual_traversal_finds_the_exact_pairs(n, d):
    a, b = clustered(n, d), clustered(n, d)[: max(1, n // 3)]
    (order_a, tree_a), (order_b, tree_b) = cover_tree.build(a), cover_tree.build(b)
    a, b = a[order_a], b[order_b]
    for starts, center, radius in tree_a:  # every node is covered by its center
        for s, e, c, r in zip(starts, [*starts[1:], n], center, radius, strict=True):
            assert s <= c < e and cover_tree._distance(a[s:e] @ a[c]).max() <= r + cover_tree.SLACK
    i, j = cover_tree.traverse(a, tree_a, a, tree_a, 0.9, True)
    assert sorted(zip(i, j)) == sorted((x, y) for x, y in zip(*np.nonzero(a @ a.T >= 0.9)) if x < y)
    i, j = cover_tree.traverse(a, tree_a, b, tree_b, 0.9, False)
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(a @ b.T >= 0.9)))


def test_embeddings_equal_brute_force(spark):
    x = clustered(400, 8)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None, *[0.0] * 6]), (1004, []),
             (None, x[0].tolist()), (1005, (x[0] * 2).tolist()), (1006, x[0].tolist()), (1007, [3.0, 4.0]), (1008, [1e-200, 0.0] * 4),
             (1009, [float("inf")] * 8), (1010, [1e200, 0.0] * 4)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string")
    got = {r["vec_id"]: r for r in cover_tree.embedding_near_duplicates(vectors, block=50, max_centers=6).collect()}
    assert len(got) == len(rows)
    alike = np.concatenate([x, x[:1], x[:1], [[0.5, 0.0] * 4, [0.5, 0.0] * 4]])
    ids = [*range(400), 1005, 1006, 1008, 1010]
    near = alike @ alike.T >= 0.9
    group = reached(len(ids), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    for k, i in enumerate(ids):
        assert got[i]["n_links"] == near[k].sum() - 1 and got[i]["component_id"] == ids[group[k]]
    for i in (1000, 1001, 1002, 1003, 1004, 1007, 1009):
        assert got[i]["n_links"] == 0 and got[i]["kept"]
    assert cover_tree.embedding_near_duplicates(vectors.limit(0)).count() == 0


def test_scattered_blocks_are_compared_by_sketches():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 64))
    x[1500:1600] = x[:100] + rng.normal(size=(100, 64)) * rng.choice([0.05, 0.4, 0.48], size=(100, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = cover_tree.sketch_axes(x, 0.9)
    s = cover_tree.sketch(x, axes)
    assert s.shape[1] < 40 and (s @ s.T - x @ x.T).min() > -1e-5
    a, b = x[:1500], x[1500:]
    assert (s[:1500] @ s[1500:].T >= 0.9).mean() < 1e-3
    (order_a, tree_a), (order_b, tree_b) = cover_tree.build(a), cover_tree.build(b)
    assert len(tree_a) == len(tree_b) == 2  # levels that would rule out nothing are left out
    i, j = cover_tree.traverse(a[order_a], tree_a, b[order_b], tree_b, 0.9, False, s[:1500][order_a], s[1500:][order_b])
    assert sorted(zip(order_a[i], order_b[j])) == sorted(zip(*np.nonzero(a @ b.T >= 0.9)))


@pytest.mark.parametrize("dim, double", [(64, False), (64, True), (24, None)])
def test_scattered_embeddings_equal_brute_force(spark, dim, double, monkeypatch):
    monkeypatch.setattr(cover_tree, "GROUP_BYTES", 8 * dim * 200)  # several blocks a group, many groups
    x = clustered(900, dim)
    x = x if double else x.astype("<f4").astype("<f8")
    if double is None:
        x[::3] *= 1 + 1e-9  # some vectors have more digits than others
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in cover_tree.embedding_near_duplicates(vectors, block=60, max_centers=6).collect()}
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = units @ units.T >= 0.9
    group = reached(900, [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(900)] == [
        (near[i].sum() - 1, group[i], group[i] == i) for i in range(900)]


# Histogram sort -----------------------------------------------------------------

def check_shards(rows, shards):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
    for s, found in by_shard.items():
        assert 0 <= s < shards and sorted(r["slot"] for r in found) == list(range(len(found)))
    return {s: sum(len((r["text"] or "").encode()) + 16 for r in found) for s, found in by_shard.items()}


@pytest.mark.parametrize("task_bytes", [128 << 20, 3000])
def test_shards_are_even_with_a_hot_text(spark, task_bytes):
    rows = [(i, "the same text " * 8) for i in range(1500)] + [(i, f"text {i} " * 12) for i in range(1500, 4000)]
    rows += [(None, None), (1, ""), (7, "the same text " * 8), (7, "the same text " * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x"))
    out = histogram_sort.shard(docs, task_bytes=task_bytes)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "shard", "slot"]
    sizes = check_shards(got, 40)
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * histogram_sort.TOLERANCE * mean + 260
    # Equal texts are cut by a boundary only if they fill shards.
    texts = {}
    for r in got:
        texts.setdefault(r["text"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in texts.values()) <= 2
    hot = sorted(texts["the same text " * 8])
    assert hot == list(range(hot[0], hot[-1] + 1))


def test_shards_of_few_rows_and_rounds(spark):
    docs = spark.createDataFrame([(i, "x" * (1000 * i)) for i in range(5)], "doc_id long, text string")
    check_shards(histogram_sort.shard(docs).collect(), 40)
    assert histogram_sort.shard(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "same")] * 100, "doc_id long, text string")
    check_shards(histogram_sort.shard(same, shards=4).collect(), 4)
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"), F.col("id").alias("k"), F.lit(100).cast("long").alias("size"))
    edges, rounds = histogram_sort.splitters(keys, 16, 0.001)
    assert rounds <= 4 and len(edges) == 15
    assert all(abs(e.bytes - (j + 1) * 125_000) <= 125 for j, e in enumerate(edges))
    below = [keys.filter((F.col("h") < e.text)).count() * 100 for e in edges[:3]]
    assert below == [e.bytes for e in edges[:3]]


@pytest.mark.parametrize("task_bytes", [1 << 10, 1 << 14, 1 << 30])
def test_shards_equal_plain_order(spark, monkeypatch, task_bytes):
    """Brute force: rows in the order of their hashes, cut where bytes are even;
    what the driver gets doesn't grow as ranges get smaller."""
    rows = [(i % 900, "copies " * 6) for i in range(1800)] + [(i, f"{i} " * (i % 50)) for i in range(1500)] + [(5, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    tables, literal = [], histogram_sort.literal_rows
    monkeypatch.setattr(histogram_sort, "literal_rows", lambda spark, rows, schema: tables.append(len(rows)) or literal(spark, rows, schema))
    out = histogram_sort.shard(docs, shards=5, task_bytes=task_bytes)
    assert max(tables) <= 4096
    got = (out.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("k", F.xxhash64("doc_id"))
           .withColumn("part", F.spark_partition_id()).orderBy("shard", "slot").collect())
    assert len(got) == len(rows) and [(r["h"], r["k"]) for r in got] == sorted((r["h"], r["k"]) for r in got)
    check_shards(got, 5)
    sizes = [len((r["text"] or "").encode()) + 16 for r in got]
    total, below = sum(sizes), 0
    for shard in range(4):
        below += sum(n for n, r in zip(sizes, got) if r["shard"] == shard)
        assert abs(below - total * (shard + 1) / 5) <= histogram_sort.TOLERANCE * total / 5 + max(sizes)
    held = {}
    for n, r in zip(sizes, got):
        held[r["part"]] = held.get(r["part"], 0) + n
    if task_bytes == 1 << 14:  # hot text or not, a task takes about as much
        assert max(held.values()) <= 3 * task_bytes
        assert out.drop("doc_id", "text").rdd.getNumPartitions() <= 4 * (total // task_bytes + 5)


def test_shard_query_is_native_and_whole(spark):
    out = histogram_sort.op7_histogram_sort(spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(texts)
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
               and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)


# Pipeline ------------------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = shared.read_table(spark, SF, "documents")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 5), (None, "the of and with on is by " * 3, "en", "s", 1)],
                                  docs.schema)
    hot = docs.filter("doc_id = 1").crossJoin(spark.range(3)).select((F.col("id") + 9100).alias("doc_id"), *docs.columns[1:])
    contact = spark.createDataFrame([(9200, "My mail is ab@c.de and my phone +49 151 1234567, so much for that.", "en", "s", 1)],
                                    docs.schema)
    now = shared.written(docs.unionByName(extra).unionByName(hot).unionByName(contact), "start")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = shared.written(stage(spark, now, SF), "stage")
        if name != "packing":
            assert now.columns == docs.columns
        ids[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        if name == "language":
            assert not {9001, 9002} & ids[name] and None in ids[name]
        if name == "near-duplicates":
            assert not {9100, 9101, 9102} & ids[name] and None in ids[name]
            kept = {r["doc_id"]: r["text"] for r in before.collect() if r["doc_id"] is not None}
            sets = {k: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for k, t in kept.items() if (w := t.lower().split())}
            stay = sorted(ids[name] - {None})
            for i, a in enumerate(stay):
                for b in stay[:i]:
                    if 0.8 <= len(sets[a]) / len(sets[b]) <= 1.25:
                        assert len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
        if name == "personal data":
            assert now.filter("n_chars <> length(text)").isEmpty() and not before.filter("text LIKE '%@%'").isEmpty()
            assert not any(pii_spans.spans(r["text"]) for r in now.collect())
    assert ids["packing"] == ids["personal data"] == ids["near-duplicates"]


def test_pipeline_keeps_documents_if_no_language_is_known(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (5, "énfin", None)],
                                 "doc_id long, text string, lang string")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 5]


def test_pipeline_of_an_empty_table(spark):
    now = shared.read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = shared.written(stage(spark, now, SF), "stage")
        assert now.isEmpty()


def test_pipeline_keeps_columns_named_like_outputs_and_rows_of_repeated_ids(spark):
    """Input columns named like what the operators add come out as they were;
    rows of one id are judged by their own texts; a very long text passes."""
    prose = [r["text"] for r in shared.read_table(spark, SF, "documents").filter("lang = 'en' AND length(text) BETWEEN 300 AND 900").limit(6).collect()]
    rows = [(1, prose[0], "en"), (2, prose[1], "en"), (2, prose[2], "en"), (3, prose[1], "en"), (4, prose[3], "en"), (4, prose[3], "en"),
            (5, prose[4] * 300, "en")]
    docs = (spark.createDataFrame(rows, "doc_id long, text string, lang string")
            .withColumns({"lang_pred": F.lit("mine"), "tox_score": F.lit("high"), "tox_segments": F.lit(3), "lang_score": F.lit(True),
                          "source": F.col("doc_id") % 2, "id": F.lit(0), "same": F.lit("s"), "n_shingles": F.lit(-1), "pii": F.lit("p")}))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = shared.written(stage(spark, now, SF), "stage")
        assert now.dtypes == docs.dtypes
    got = now.collect()
    assert all((r["lang_pred"], r["tox_score"], r["tox_segments"], r["lang_score"], r["pii"]) == ("mine", "high", 3, True, "p") for r in got)
    assert sorted(r["doc_id"] for r in got) == [1, 2, 2, 4, 5]
    assert corpus_pipeline.packing(spark, now, SF).count() > 5
