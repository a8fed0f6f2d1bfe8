"""Language, quality rules, personal data and toxicity on small fixtures."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import compression_bands, langid_crf, pii_spans, shared, toxic_segments

SF = "/root/testdata/sf0.01"
EDGE_ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "12 34 !!"), (None, "the words of a row without an id"),
             (5, "twice the same row"), (5, "twice the same row"), (6, "word " * 60_000)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, "doc_id long, text string")


def auc(score, label):
    ranks = np.asarray(score).argsort(kind="stable").argsort(kind="stable").astype(float)
    for s in set(score):
        at = np.flatnonzero(np.asarray(score) == s)
        ranks[at] = ranks[at].mean()
    label = np.asarray(label).astype(bool)
    n1, n0 = label.sum(), (~label).sum()
    return (ranks[label].sum() - n1 * (n1 - 1) / 2) / n1 / n0


# Language ------------------------------------------------------------------

def test_chains_equal_a_loop_over_each_text():
    rng = np.random.default_rng(0)
    step, lengths = rng.random((3, 3)) + 0.1, np.array([1, 5, 64, 65, 200, 130])
    e = rng.random((lengths.sum(), 3)) + 0.05
    got, _ = langid_crf.chains(e, lengths, step)
    at = 0
    for n in lengths:
        x = e[at:at + n]
        alpha, beta, v = np.zeros((n, 3)), np.zeros((n, 3)), np.ones(3) / 3
        for t in range(n):
            v = (v @ step) * x[t]
            alpha[t] = v = v / v.sum()
        v = np.ones(3)
        for t in range(n - 1, -1, -1):
            beta[t] = v
            v = step @ (x[t] * v)
            v /= v.sum()
        want = alpha * beta
        assert np.allclose(got[at:at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_language_held_out_accuracy_and_schema(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid_crf.op1_crf_langid(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    row = (got.join(docs, "doc_id").filter("held_out")
           .agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first())
    assert row[0] > 0.97 and row[1] >= 0 and row[2] <= 1


def test_code_switched_words_are_labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    crf = langid_crf.fit(docs)
    texts = {x: docs.filter(F.col("lang") == x).orderBy("doc_id").first()["text"].split()[:25] for x in ("en", "de")}
    labelled = langid_crf.Labeller(crf).label(" ".join(texts["en"] + texts["de"] + texts["en"]))
    want = ["en"] * 25 + ["de"] * 25 + ["en"] * 25
    assert sum(a == b for (_, a), b in zip(labelled, want, strict=True)) >= 70


def test_a_rare_language_is_learned_from_one_row_of_each_id(spark):
    # 3,000 rows of one language, 12 of another, one id a thousand times.
    rng = np.random.default_rng(3)
    vocabulary = {"aa": ["kolmi", "taslo", "venta", "rupi"], "bb": ["zhuq", "xwyf", "qhaz", "wyx"]}
    rows = [(i, " ".join(rng.choice(vocabulary[x], 30)), x) for i, x in enumerate(["aa"] * 3000 + ["bb"] * 12)]
    rows += [(rows[0][0], rows[0][1] + f" {i}", "aa") for i in range(1000)] + [(9000 + i, "12 34", "cc") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = langid_crf.fit(docs, max_labelled=40)
    assert crf.languages == ["aa", "bb"]
    assert [langid_crf.Labeller(crf).texts([" ".join(v)])[0][0] for v in vocabulary.values()] == ["aa", "bb"]


def test_quotas_leave_no_class_out():
    assert shared.quotas({"a": 10**9, "b": 3, "c": 900}, 1000) == {"a": 499, "b": 3, "c": 498}
    assert shared.quotas({0: 5, 1: 2}, 100) == {0: 5, 1: 2} and shared.quotas({}, 5) == {}


def test_language_edge_rows(spark, edge):
    crf = langid_crf.train([(["the", "words", "and", "row"] * 6, "en"), (["der", "und", "wort", "zeile"] * 6, "de")], epochs=10)
    got = {(r["doc_id"], r["text"]): r for r in langid_crf.predict(edge, crf).collect()}
    for text in (None, "", " \t\n", "12 34 !!"):
        found = [r for (_, t), r in got.items() if t == text]
        assert [(r["lang_pred"], r["lang_score"]) for r in found] == [("und", 0.0)]
    assert all(r["lang_pred"] == "en" for (k, _), r in got.items() if k is None)
    assert langid_crf.predict(edge.limit(0), crf).count() == 0
    assert {r["lang_pred"] for r in langid_crf.predict(edge, None).collect()} == {"und"}
    clash = langid_crf.predict(edge.withColumn("lang_pred", F.lit(7)), crf)
    assert dict(clash.dtypes)["lang_pred"] == "string" and clash.count() == len(EDGE_ROWS)


# Quality rules -------------------------------------------------------------

def brute_rules(text):
    text = text or ""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search("[^\\x20\\x09-\\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_base_rules_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    parts = ["a ", "b ", "c ", "a b c d e ", "\n", "# ", "é ", "\x1c", "\x85", "x|y ", "\t", "a\n"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 60))) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in texts:
        assert compression_bands.base(text) == brute_rules(text)


def test_bands_reject_repetition_and_noise_and_keep_prose(spark):
    rng = np.random.default_rng(2)
    prose = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(
        spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("quality = 1").select("text").collect()]
    fine = [t for t in prose if not compression_bands.base(t)[-1]]
    assert all(compression_bands.bands(t)[2] for t in fine)
    assert not compression_bands.bands("once and again, " * 4000)[2]
    assert not compression_bands.bands("".join(map(chr, rng.integers(33, 127, 20_000))))[2]
    # Noise in a third of the chunks of a long text.
    long = " ".join(fine)[:40_000] + "".join(map(chr, rng.integers(33, 127, 25_000)))
    assert not compression_bands.bands(long)[2]


def test_rules_edge_rows(spark, edge):
    got = compression_bands.judge(edge.withColumn("kept", F.lit("x"))).collect()
    assert len(got) == len(EDGE_ROWS)
    by_text = {r["text"]: r for r in got}
    assert by_text[None]["n_words"] == by_text[""]["n_words"] == 0
    assert not by_text[None]["kept"] and by_text[None]["base_failed"]
    assert by_text[EDGE_ROWS[-1][1]]["n_repeat_words"] == 60_000
    assert compression_bands.judge(edge.limit(0)).count() == 0


# Personal data -------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute_spans(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
        if 14 <= len(digits) <= 19 and sum(sum(divmod(d, 10)) for d in doubled) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], pii_spans.KINDS.index(x[0])))


def test_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(3)
    parts = ["a", "@", ".", "1", "255", "3", "-", "+", " ", "\n", "12", "4111111111111111", "x.y", "é", "(", "300"]
    for _ in range(5000):
        text = "".join(rng.choice(parts, rng.integers(0, 50)))
        got = [(s["kind"], s["start"], s["end"]) for s in pii_spans.spans(text) if s["kind"] in pii_spans.BASE]
        assert got == brute_spans(text)


def test_checksums_context_and_masking():
    assert pii_spans.luhn("4111111111111111") and not pii_spans.luhn("4111111111111112")
    assert pii_spans.mod97("GB82 WEST 1234 5698 7654 32") and not pii_spans.mod97("GB83 WEST 1234 5698 7654 32")
    text = "Wire to GB82 WEST 1234 5698 7654 32 today. SSN 123-45-6789. " + "x" * 50 + " Part 123-45-6789."
    assert [s["kind"] for s in pii_spans.spans(text)] == ["iban", "ssn"]
    assert pii_spans.joined(pii_spans.spans("é ab@c.de")) == "email:2:9"
    assert pii_spans.masked("mail ab@c.de or 10.0.0.1.") == "mail <EMAIL> or <IP>."
    assert pii_spans.masked(None) is None and pii_spans.masked("") == ""
    # Overlapping spans leave no digit behind.
    assert not re.search("[0-9]", pii_spans.masked("call +378282246310005 now"))


def test_iban_ends_where_its_country_says():
    for text, want in [("to DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["iban:3:30"]),
                       ("GB82WEST12345698765432 2024-01-05", ["iban:0:22"]),
                       ("GB82 WEST 1234 5698 7654 32 A bank", ["iban:0:27"]),
                       ("AB12 REF DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", ["iban:9:36", "iban:37:64"]),
                       ("GB82WEST12345698765432X and GB83 WEST 1234 5698 7654 32 A", [])]:
        assert [s for s in pii_spans.joined(pii_spans.spans(text)).split(",") if s.startswith("iban")] == want
    assert pii_spans.masked("pay DE89 3704 0044 0532 0130 00 BIC X") == "pay <IBAN> BIC X"


def test_spans_edge_rows(spark, edge):
    got = pii_spans.find(edge.withColumn("pii", F.lit(1))).collect()
    assert len(got) == len(EDGE_ROWS) and all(r["pii"] == [] for r in got)
    assert pii_spans.find(edge.limit(0)).count() == 0
    assert [r["text"] for r in pii_spans.mask(edge).orderBy("doc_id").collect()].count(None) == 1
    long = "1" * 300_000 + "@" * 1000 + "a" * 300_000 + "@x.yz"
    assert [s["kind"] for s in pii_spans.spans(long)] == ["email"]


# Toxicity ------------------------------------------------------------------

def brute_segments(scores):
    """Maximal segments by their definition: no proper part or extension that
    is maximal itself scores as much (Ruzzo and Tompa)."""
    def split(lo, hi):
        best = max(((scores[a:b].sum(), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, a, b = best
        return split(lo, a) + [(a, b)] + split(b, hi)
    return split(0, len(scores))


def test_segments_equal_their_definition():
    rng = np.random.default_rng(4)
    for _ in range(400):
        scores = rng.integers(-4, 5, rng.integers(0, 14)).astype(float) + rng.random() * 1e-3 + rng.random() * 0
        scores = scores + rng.random(len(scores)) * 1e-4  # no ties
        got = toxic_segments.segments(scores)
        assert [(a, b) for _, a, b in got] == brute_segments(scores)
        assert all(abs(s - scores[a:b].sum()) < 1e-9 for s, a, b in got)


def toxic_rows(n=400):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in ("lin", "mor", "tas", "pek")]
    rows, labels = [], []
    for i in range(n):
        body = list(rng.choice(words, rng.integers(30, 120)))
        toxic = int(i % 5 == 0)
        for _ in range(6 * toxic):
            body[rng.integers(len(body))] = rng.choice(["vilescum", "vilerot", "vilemud", "wretch"])
        rows.append((i, " ".join(body)))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_learns_words_and_beginnings(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = toxic_segments.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    new = spark.createDataFrame([(1, rows[1][1] + " viledreg wretch vilescum"), (2, rows[2][1])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxic_segments.score(new, fitted).collect()}
    assert got[1]["tox_score"] >= toxic_segments.THRESHOLD > got[2]["tox_score"]
    last = max(got[1]["tox_segments"], key=lambda s: s["score"])
    assert len(rows[1][1].split()) == last["first"] and last["end"] - last["first"] == 3


def test_log_odds_of_many_toxic_documents_are_finite():
    counts = {"^vilescum"[:k + 1]: (9_000.0, 0.0) for k in toxic_segments.BEGINNINGS}
    scores = toxic_segments.log_odds(counts, 0.5)
    assert all(0 < x < 200 for x in scores.values())


def test_rare_toxic_rows_are_all_learned_from(spark):
    rows, labels = toxic_rows(1500)
    # 16 toxic rows, 1,200 clean ones and labels of ids that aren't there, which
    # take no places.
    toxic = [i for i, t in labels if t][:16]
    kept = [(i, t) for i, t in labels if not t or i in toxic]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(kept + [(10**6 + i, i % 2) for i in range(3000)], "doc_id long, toxic int")
    fitted = toxic_segments.fit(docs, table, max_labelled=80)
    new = [(1, rows[1][1] + " vilescum wretch vilerot"), *rows[2:5], *rows[6:10]]
    got = {r["doc_id"]: r["tox_score"] for r in
           toxic_segments.score(spark.createDataFrame(new, "doc_id long, text string"), fitted).collect()}
    assert got.pop(1) >= toxic_segments.THRESHOLD > max(got.values())


def test_toxicity_edge_rows(spark, edge):
    rows, labels = toxic_rows(100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    fitted = toxic_segments.fit(docs, table)
    got = toxic_segments.score(edge.withColumn("tox_score", F.lit("x")), fitted).collect()
    assert len(got) == len(EDGE_ROWS) and all(0 <= r["tox_score"] < toxic_segments.THRESHOLD for r in got)
    assert toxic_segments.fit(docs, table.limit(0)) is None
    assert {r["tox_score"] for r in toxic_segments.score(edge, None).collect()} == {0.0}
    assert toxic_segments.score(edge.limit(0), fitted).count() == 0


def test_toxicity_query(spark):
    got = toxic_segments.op4_toxicity(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert auc([r["score"] for r in rows], [r["toxic"] for r in rows]) > 0.75
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(clean) <= 0.03 * len(clean)


def test_pii_long_digit_runs():
    """Runs of thousands of digits pass through every kind's check."""
    zeros, ones = "0" * 5000, "1" * 5000
    assert [s["kind"] for s in pii_spans.spans(f"x 1.2.3.{zeros}")] == ["ip"]
    assert [s["kind"] for s in pii_spans.spans(f"x 1.2.3.{zeros}4")] == ["ip"]
    assert pii_spans.spans(f"x 1.2.3.{zeros}256") == []
    for text in (ones, f"+{ones}", f"DE{ones}", f"{ones}@{ones}.{ones}", f"{ones}-{ones}-{ones}", f"1.{ones}.3.4", f"AA{zeros} " * 3):
        assert all(s["kind"] == "email" for s in pii_spans.spans(text))
        assert isinstance(pii_spans.masked(text), str)


def test_toxicity_fit_does_not_depend_on_how_rows_are_dealt(spark):
    docs = shared.read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = shared.read_table(spark, "/root/testdata/sf0.01", "labels")
    first = toxic_segments.fit(docs, labels)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        second = toxic_segments.fit(docs.repartition(9, F.rand(5)), labels.repartition(3, F.rand(6)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == second


def test_toxicity_repeated_ids_keep_the_bound(spark):
    rows = [(i, f"text number {i} version {k} " + ("awful words" if i % 2 else "kind words")) for i in range(60) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    collected = []
    plain = toxic_segments.calibrate
    toxic_segments.calibrate = lambda rows: collected.append(len(rows)) or plain(rows)
    try:
        toxic_segments.fit(docs, labels, max_labelled=20)
    finally:
        toxic_segments.calibrate = plain
    assert 0 < collected[0] <= 20


def test_fitted_bands_reject_what_the_base_rules_pass(spark):
    """Junk planted among prose: the base rules pass it, only the limits fitted
    for its length reject it, and prose stays."""
    rng = np.random.default_rng(8)
    docs = shared.read_table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text").filter("length(text) BETWEEN 1100 AND 1900")
    prose = [r["text"] for r in docs.limit(300).collect()]
    marks = [" ".join(w + ("***", "$$$", "&&&")[int(rng.integers(3))] for w in t.split()[:130]) for t in prose[:20]]
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 9)) for _ in range(140)) for _ in range(20)]
    few = [" ".join("".join(rng.choice(list("ab"), 9)) for _ in range(140)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate([*prose, *prose[:100], *marks, *noise, *few])]
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    limits = compression_bands.fit(planted)
    assert limits[0] and limits == compression_bands.fit(planted.repartition(5))
    got = {r["doc_id"]: r for r in compression_bands.judge(planted, limits=limits).collect()}
    junk = [got[i] for i in range(400, 460)]
    passed = [r for r in junk if not r["base_failed"]]
    assert len(passed) > 50 and sum(not r["kept"] for r in passed[-40:]) >= 38
    clean = [got[i] for i in range(400) if not got[i]["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.97 * len(clean)
    assert compression_bands.fit(planted.limit(0)) == ({}, {})


def test_bands_decide_on_the_corpus(spark):
    """At sf0.1 the method rejects symbol junk that passes the base rules."""
    docs = shared.read_table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    got = compression_bands.judge(docs, limits=compression_bands.fit(docs)).filter("NOT base_failed AND NOT kept").collect()
    assert 80 <= len(got) <= 300
    assert sum(r["n_symbols"] >= 0.4 * r["n_words"] for r in got) >= 0.9 * len(got)
