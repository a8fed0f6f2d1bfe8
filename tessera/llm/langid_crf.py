"""Language of texts by a linear-chain conditional random field over words.

A word's emission is the sum of the weights of its features: hashed byte
n-grams of the word between boundary marks (those with a mark are its affixes)
and its place in the languages' lexicons.  Learned transitions label the words
of code-switched text; forward-backward gives each word's marginals, and a
text's language is the one with the greatest sum of them over its words.

The model is fitted on at most ``max_labelled`` rows with a language, one for
each key: a quota for each language, so that a rare one is learned too, taken
in the order of a hash of the key.  A key that occurs in several languages
counts for the least of them, by name.  Windows of their words are strung together,
switching language now and then, so that the transitions are learned from
code-switched sequences.  Held-out rows are not learned from; language, source
and key are no inputs of a prediction.

Rows: a text that is null or has no letter is ``und`` with score 0, and so is
every text if no row has a language; equal rows are labelled alike.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera.llm import shared

#: Labelled rows from which the model is fitted, windows of each, and words in
#: all training sequences, at most.
MAX_LABELLED, WINDOWS, TRAINING_WORDS = 2_000, 8, 200_000
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Words in a language's lexicon, and in a training sequence.
LEXICON, SEQUENCE = 2_000, 64
#: Words of a window of one language, on the average.
WINDOW = 12
EPOCHS, RATE, RIDGE = 40, 0.15, 1e-5
MAX_WORDS = 300_000
#: Text bytes that are labelled at once; a word takes some hundred bytes then.
SLICE_BYTES = 2 << 20
#: Words whose steps are multiplied out before texts are scanned.
CHUNK = 64
UNDETERMINED = "und"


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, and the word of each."""
    raw = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    buckets, owners = [], []
    for n in ORDERS:
        if len(raw) < n:
            continue
        code = np.zeros(len(raw) - n + 1, dtype=np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + raw[k:len(raw) - n + 1 + k]
        inside = owner[:len(code)] == owner[n - 1:]
        code = (code[inside] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((code >> np.uint64(48)).astype(np.int64))
        owners.append(owner[:len(inside)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def letters(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # buckets and languages
    lexicon: dict[bytes, np.ndarray]  # share of each language among the word's training uses
    lexical: np.ndarray  # weights of the lexicon features
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Emission scores of words; a word without a letter says nothing."""
        raw = [w.lower().encode() if letters(w) else b"" for w in words]
        buckets, owners = ngrams(raw)
        count = np.bincount(owners, minlength=len(raw)).astype(np.float64)
        out = np.empty((len(raw), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owners, self.weights[buckets, k], len(raw))
        out /= np.sqrt(np.maximum(count, 1))[:, None]
        for i, w in enumerate(raw):
            if not w:
                out[i] = 0.0
            elif w in self.lexicon:
                out[i] += self.lexicon[w] * self.lexical
        return out


def chains(e: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward of many texts at once: each word's marginals, and what
    the words after it say (the backward factors).

    ``e``: factors of all words in a row, ``lengths``: words of each text (at
    least 1), ``step``: transition factors.  Texts are cut into chunks; the
    chunks' matrices are multiplied out together, the texts then scanned over
    their chunks, and the words done within the chunks."""
    k = e.shape[1]
    per_text = -(-lengths // CHUNK)
    first = np.cumsum(per_text) - per_text
    m = int(per_text.sum())
    text = np.repeat(np.arange(len(lengths)), per_text)
    place = np.arange(m) - first[text]
    size = np.minimum(CHUNK, lengths[text] - place * CHUNK)
    begin = (np.cumsum(lengths) - lengths)[text] + place * CHUNK
    # Chunks stand by falling size, so those that have a t-th word come first.
    by_size = np.argsort(-size, kind="stable")
    rank = np.empty(m, dtype=np.int64)
    rank[by_size] = np.arange(m)
    live = [int(x) for x in m - np.cumsum(np.bincount(size, minlength=CHUNK + 1))[:CHUNK]]
    at = np.minimum(begin[by_size] + np.arange(CHUNK)[:, None], len(e) - 1)
    factors = np.ascontiguousarray(e[at].transpose(0, 2, 1))
    product = np.broadcast_to(np.eye(k)[:, None, :], (k, m, k)).copy()  # [to, chunk, from]
    flat = product.reshape(k, m * k)
    for t, n in enumerate(live):
        flat[:, :n * k] = step.T @ flat[:, :n * k]
        product[:, :n] *= factors[t, :, :n, None]
        if t % 8 == 7:
            product /= product.sum(axis=(0, 2), keepdims=True)
    product = product / product.sum(axis=(0, 2), keepdims=True)
    into, out = np.full((k, m), 1.0 / k), np.ones((k, m))
    order = np.argsort(-per_text, kind="stable")
    of_length = [int((per_text > j).sum()) for j in range(int(per_text.max()))]
    for j in range(1, len(of_length)):
        now = first[order[:of_length[j]]] + j
        v = np.einsum("lmi,im->lm", product[:, rank[now - 1]], into[:, rank[now - 1]])
        into[:, rank[now]] = v / v.sum(axis=0)
    for j in range(len(of_length) - 1, 0, -1):
        now = first[order[:of_length[j]]] + j
        v = np.einsum("lmi,lm->im", product[:, rank[now]], out[:, rank[now]])
        out[:, rank[now - 1]] = v / v.sum(axis=0)
    alpha, beta = np.ones((CHUNK, k, m)), np.ones((CHUNK, k, m))
    v = into
    for t, n in enumerate(live):
        np.multiply(step.T @ v[:, :n], factors[t, :, :n], out=alpha[t, :, :n])
        v = alpha[t] / alpha[t].sum(axis=0) if t % 8 == 7 else alpha[t]
    v = out
    for t in range(CHUNK - 1, -1, -1):
        n = live[t]
        beta[t] = v
        v[:, :n] = step @ (v[:, :n] * factors[t, :, :n])
        if t % 8 == 7:
            v /= v.sum(axis=0)
    chunk = np.repeat(rank, size)
    word = np.arange(len(e)) - np.repeat(begin, size)
    back = beta[word, :, chunk]
    gamma = alpha[word, :, chunk] * back
    return gamma / gamma.sum(axis=1, keepdims=True), back


def windows(text: str | None) -> list[list[str]]:
    """Windows of a text's words, spread evenly over all of it."""
    words = [w for w in (text or "").split() if letters(w)]
    starts = {round(x) for x in np.linspace(0, max(0, len(words) - 2 * WINDOW), WINDOWS)}
    return [words[a:a + 2 * WINDOW] for a in sorted(starts)] if words else []


def train(of_row: list[tuple[list[str], str]], epochs: int = EPOCHS) -> Crf | None:
    """Fit on ``(words, language)`` windows by gradient ascent on the likelihood
    of code-switched training sequences (Adam, all sequences at once)."""
    rng = np.random.default_rng(7)
    if not of_row:
        return None
    languages = sorted({lang for _, lang in of_row})
    k = len(languages)
    number = {lang: i for i, lang in enumerate(languages)}
    uses: dict[bytes, np.ndarray] = {}
    for words, lang in of_row:
        for w in words:
            uses.setdefault(w.lower().encode(), np.zeros(k))[number[lang]] += 1
    common = [{w for w, _ in sorted(((w, u[i]) for w, u in uses.items() if u[i] > 1), key=lambda x: (-x[1], x[0]))[:LEXICON]}
              for i in range(k)]
    lexicon = {w: uses[w] / uses[w].sum() for w in set().union(*common)}
    # Windows of words, each of one text, until there are enough words.
    sequence, labels = [], []
    by_language = [[w for w, lang in of_row if lang == x] for x in languages]
    total = min(TRAINING_WORDS, max(SEQUENCE * 64, sum(len(w) for w, _ in of_row)))
    current = int(rng.integers(k))
    while len(sequence) < total:
        if rng.random() < 0.3:
            current = int(rng.integers(k))
        words = by_language[current][rng.integers(len(by_language[current]))]
        begin = int(rng.integers(len(words)))
        taken = words[begin:begin + 1 + int(rng.geometric(1 / WINDOW))]
        sequence += taken
        labels += [current] * len(taken)
    n = len(sequence) - len(sequence) % SEQUENCE
    distinct = {w: i for i, w in enumerate(dict.fromkeys(sequence[:n]))}
    ids = np.array([distinct[w] for w in sequence[:n]])
    truth = np.eye(k)[np.array(labels[:n])]
    crf = Crf(languages, np.zeros((BUCKETS, k)), lexicon, np.zeros(k), np.zeros((k, k)))
    raw = [w.lower().encode() for w in distinct]
    buckets, owners = ngrams(raw)
    norm = 1 / np.sqrt(np.bincount(owners, minlength=len(raw)))
    shares = np.stack([lexicon.get(w, np.zeros(k)) for w in raw])
    lengths = np.full(n // SEQUENCE, SEQUENCE)
    follows = np.arange(n) % SEQUENCE > 0
    both_true = truth[:-1].T @ (truth[1:] * follows[1:, None])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (crf.weights, crf.lexical, crf.transitions)]
    for epoch in range(1, epochs + 1):
        emit = np.stack([np.bincount(owners, crf.weights[buckets, i], len(raw)) for i in range(k)], axis=1)
        emit = emit * norm[:, None] + shares * crf.lexical
        e = np.exp(emit - emit.max(axis=1, keepdims=True))[ids]
        step = np.exp(crf.transitions - crf.transitions.max())
        gamma, beta = chains(e, lengths, step)
        # Expected transitions: a word's marginals, divided among what may follow.
        onward = step[None] * (e[1:] * beta[1:])[:, None, :]
        onward *= (gamma[:-1] * follows[1:, None] / onward.sum(axis=2))[:, :, None]
        expected = onward.sum(axis=0)
        gap = truth - gamma
        per_word = np.stack([np.bincount(ids, gap[:, i], len(raw)) for i in range(k)], axis=1)
        slope = np.stack([np.bincount(buckets, (per_word[:, i] * norm)[owners], BUCKETS) for i in range(k)], axis=1)
        gradients = (slope / n - RIDGE * crf.weights, (per_word * shares).sum(axis=0) / n,
                     (both_true - expected) / n)
        for value, grad, (mean, square) in zip((crf.weights, crf.lexical, crf.transitions), gradients, state, strict=True):
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            value += RATE * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.99**epoch)) + 1e-8)
    return crf


class Labeller:
    """Word marginals of texts, with each distinct word's emission kept."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.step = np.exp(crf.transitions - crf.transitions.max())
        self.index: dict[str, int] = {}
        self.factors = np.ones((0, len(crf.languages)))

    def marginals(self, texts: list[list[str]]) -> np.ndarray:
        """One row for each word of all texts, in order; no text is empty."""
        if len(self.index) > MAX_WORDS:
            self.index = dict(itertools.islice(self.index.items(), MAX_WORDS // 2))
            self.factors = self.factors[:MAX_WORDS // 2]
        fresh = list(set().union(*texts).difference(self.index))
        if fresh:
            scores = self.crf.emissions(fresh)
            made = np.exp(scores - scores.max(axis=1, keepdims=True))
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh)), strict=True))
            self.factors = np.concatenate([self.factors, np.maximum(made, 1e-12)])
        lengths = np.array([len(t) for t in texts])
        ids = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(texts)), dtype=np.int64, count=lengths.sum())
        return chains(self.factors[ids], lengths, self.step)[0]

    def label(self, text: str) -> list[tuple[str, str]]:
        """Each word of a text with its likeliest language."""
        words = text.split()
        if not words:
            return []
        best = self.marginals([words]).argmax(axis=1)
        return [(w, self.crf.languages[b] if letters(w) else UNDETERMINED) for w, b in zip(words, best, strict=True)]

    def texts(self, bodies: list[str | None]) -> list[tuple[str, float, int]]:
        """Language, score (mean marginal of that language over the words) and
        number of switches between languages of each text."""
        out: list[tuple[str, float, int]] = [(UNDETERMINED, 0.0, 0)] * len(bodies)
        split = [(i, body.split()) for i, body in enumerate(bodies) if body and letters(body)]
        if not split:
            return out
        gamma = self.marginals([w for _, w in split])
        ends = np.cumsum([len(w) for _, w in split])
        sums = np.add.reduceat(gamma, np.concatenate([[0], ends[:-1]]))
        best = gamma.argmax(axis=1)
        switch = np.concatenate([[0], np.cumsum(best[1:] != best[:-1])])
        for (i, words), total, end in zip(split, sums, ends.tolist(), strict=True):
            top = int(total.argmax())
            out[i] = (self.crf.languages[top], float(min(1.0, total[top] / len(words))),
                      int(switch[end - 1] - switch[end - len(words)]))
        return out


def fit(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> Crf | None:
    """Fit on rows of ``docs`` (doc_id, text, lang) that are not held out."""
    rows = (docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
            .filter(~shared.held_out("doc_id")).select("doc_id", "lang", "text"))
    known = shared.written(rows.groupBy("doc_id").agg(F.min("lang").alias("lang")), "languages")
    sample, _, _ = shared.sample_by_class(known, "lang", max_labelled)
    taken = rows.join(F.broadcast(sample), ["doc_id", "lang"], "left_semi")

    def cut():
        def apply(batch):
            return {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"),
                    "windows": [*map(windows, batch.column("text").to_pylist())]}

        return apply

    # At most max_labelled rows of a few windows each: one of those with equal ids.
    found = (shared.map_slices(taken, cut, "doc_id long, lang string, windows array<array<string>>")
             .groupBy("doc_id", "lang").agg(F.max("windows").alias("windows")).collect())
    return train([(w, r["lang"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["lang"])) for w in r["windows"]])


def predict(docs: DataFrame, crf: Crf | None, text: str = "text") -> DataFrame:
    """All columns with ``lang_pred``, ``lang_score`` and ``lang_switches``."""
    made = _parse_datatype_string("lang_pred string, lang_score double, lang_switches long")
    kept = [f for f in docs.schema if f.name not in made.names]
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    def start():
        labeller = Labeller(sent.value) if sent.value else None

        def apply(batch):
            bodies = batch.column(text).to_pylist()
            found = labeller.texts(bodies) if labeller else [(UNDETERMINED, 0.0, 0)] * len(bodies)
            return {f.name: batch.column(f.name) for f in kept} | dict(zip(made.names, zip(*found, strict=True), strict=True))

        return apply

    return shared.map_slices(docs.select(*(F.col(f"`{f.name}`") for f in kept)), start, StructType([*kept, *made.fields]), text,
                             SLICE_BYTES)


def op1_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = shared.read_table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), fit(docs)).select(
        "doc_id", shared.held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_switches").alias("n_switches"))
