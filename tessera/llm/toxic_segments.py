"""Toxic passages by maximum-scoring segments.

Every token has a log-odds score of the toxic against the clean class, that of
its most specific known unit: the word, or else its longest beginning.  Each
unit's class shares have a Dirichlet prior centered on those of the next
shorter unit, so that a rare word scores like its beginning.  A linear-time scan finds all maximal segments of a text; the
tail of the segment scores in clean texts (peaks over a threshold) says how
many such segments chance gives a text of that length, and a logistic curve
turns the surprise of the best few into a probability.

The model is fitted on at most ``max_labelled`` labelled rows of the documents:
a quota for each class (a rare class whole, up to half of them), taken in the
order of a hash of their key, one row of each id; of near copies in one class
(with equal least hashes of word pairs) one, chosen by a hash of the text,
counts.  So fits on the same rows are equal however these are dealt.  Units and
curve are cross-fitted in two folds.
A unit's share is compared with that of the sample it is counted in, which the
quotas don't change; the curve is then moved to the class counts of all
labelled rows.
Labels of held-out rows, language, source and key are never used in a score.

Rows: a null, empty or wordless text has no segment and gets the score of no
evidence; equal rows are scored alike; rows with a null key are scored but
not learned from.  Without a toxic or a clean labelled row every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera.llm import shared

#: Labelled rows from which the model is fitted, at most.
MAX_LABELLED = 20_000
#: Toxic units, the strongest first, and units that extend them, the most
#: frequent first.
MAX_UNITS = 50_000
#: Strength of the Dirichlet prior, in documents.
PRIOR = 4.0
#: Posterior standard deviations by which a unit's share is taken lower.
MARGIN = 2.0
#: Lengths of the beginnings that are units.
BEGINNINGS = range(3, 9)
#: What each token costs, so that segments end where evidence does.
DRIFT = 0.25
#: Segment score from which the tail in clean texts is fitted.
PEAK = 1.0
#: Best segments of a text that count together.
BEST = 8
#: A text is toxic from this probability on.
THRESHOLD = 0.3
#: Words whose score a task keeps, and text bytes whose units are counted at once.
MAX_WORDS = 300_000
COUNT_BYTES = 2 << 20

_EDGES = ".,;:!?#$%&*|\"'()[]"


def units(word: str) -> list[str]:
    """A word in the units of the model, the most specific first: itself, and
    its beginnings."""
    return ["=" + word, *("^" + word[:k] for k in reversed(BEGINNINGS) if len(word) >= k)]


def log_odds(counts: dict[str, tuple[float, float]], base: float) -> dict[str, float]:
    """Log-odds of each unit's toxic share against the ``base`` share, from
    the numbers of toxic and clean documents that hold it.  The share's
    Dirichlet prior is centered on that of the longest beginning known, or on
    the base; it is taken ``MARGIN`` posterior deviations lower, and a share
    not above the base then says nothing."""
    share: dict[str, tuple[float, float]] = {}  # toxic and clean, each by itself: one may be far below the other's rounding
    out = {}
    for unit in sorted(counts, key=lambda u: (len(u), u[0] == "=", u)):
        toxic, clean = counts[unit]
        word = unit[1:]
        above = (f"^{word[:k]}" for k in range(min(len(word), BEGINNINGS.stop - 1), BEGINNINGS.start - 1, -1))
        parent = next((share[u] for u in above if u != unit and u in share), (base, 1 - base))
        n = toxic + clean + PRIOR
        share[unit] = mean, rest = (toxic + PRIOR * parent[0]) / n, (clean + PRIOR * parent[1]) / n
        margin = MARGIN * math.sqrt(mean * rest / (n + 1))
        out[unit] = math.log((mean - margin) / (rest + margin) * (1 - base) / base) if mean - margin > base else 0.0
    return out


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments ``(score, first, end)`` of a sequence, in
    one pass over its positive runs."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, end, back
    for at in np.flatnonzero(scores > 0).tolist():
        left, right, first = float(total[at]), float(total[at + 1]), at
        while True:
            back = len(held) - 1
            while back >= 0 and held[back][0] >= left:
                back = held[back][4]
            if back < 0 or held[back][1] >= right:
                held.append((left, right, first, at + 1, back))
                break
            left, first = held[back][0], held[back][2]
            del held[back:]
    return [(right - left, first, end) for left, right, first, end, _ in held]


class WordScores(dict):
    """Score of a word as it stands in a text: that of its most specific
    unit, less the drift."""

    def __init__(self, model: dict[str, float]):
        super().__init__()
        self.model = model

    def __missing__(self, raw: str) -> float:
        found = (self.model[u] for u in units(raw.lower().strip(_EDGES)) if u in self.model)
        self[raw] = score = next(found, 0.0) - DRIFT
        return score

    def segments(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        if len(self) > MAX_WORDS:
            self.clear()
        words = (text or "").split()
        scores = np.fromiter(map(self.__getitem__, words), dtype=np.float64, count=len(words))
        return len(words), segments(scores)


@dataclass
class Calibration:
    """Tail of clean segment scores, and the logistic curve."""

    rate: float
    decay: float
    slope: float
    offset: float

    def surprise(self, n: int, scores: list[float]) -> float:
        """How unlikely, in powers of e, the best segments are by chance in a
        clean text of ``n`` words."""
        most = 0.0
        for r, score in enumerate(sorted(scores, reverse=True)[:BEST], 1):
            expected = max(n, 1) * self.rate * math.exp(-self.decay * (score - PEAK))
            most = max(most, math.lgamma(r + 1) - r * math.log(max(expected, 1e-30)))
        return min(most, 60.0)

    def probability(self, surprise: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * surprise + self.offset))))


def calibrate(rows: list[tuple[int, list[float], int]]) -> Calibration:
    """From ``(words, segment scores, label)`` of cross-fitted texts."""
    peaks = [s - PEAK for n, scores, toxic in rows if not toxic for s in scores if s >= PEAK]
    words = sum(n for n, _, toxic in rows if not toxic)
    out = Calibration((len(peaks) + 0.5) / max(words, 1), (len(peaks) + 1) / (sum(peaks) + 1), 0.0, 0.0)
    x = np.array([out.surprise(n, scores) for n, scores, _ in rows])
    y = np.array([toxic for _, _, toxic in rows], dtype=float)
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):  # Newton's method with a little ridge
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 1e-2 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    out.slope, out.offset = float(w[0]), float(w[1])
    return out


def _family(text: str | None) -> tuple[int, int]:
    """Two least hashes of word pairs, which near copies mostly share."""
    words = (text or "").lower().split()
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:])} or {" ".join(words)}
    return min(map(xxhash.xxh3_64_intdigest, pairs)), min(xxhash.xxh3_64_intdigest(p, 1) for p in pairs)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict, Calibration] | None:
    """Units and calibration, learned from labelled rows not held out."""
    known = (labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~shared.held_out("doc_id"))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    known = shared.written(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "known")
    sample, of_all, of_sample = shared.sample_by_class(known, "toxic", max_labelled)
    if not all(of_sample.get(c) for c in (0, 1)):
        return None
    # One row of each id, chosen by a hash, so that the bound holds and every
    # run takes the same.
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    joined = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(one.alias("x"))
              .select("x.text", "toxic"))

    def family():
        def apply(batch):
            found = [_family(t) for t in batch.column("text").to_pylist()]
            return {"text": batch.column("text"), "toxic": batch.column("toxic"), "family": [f"{a}.{b}" for a, b in found],
                    "fold": [a % 2 for a, _ in found]}

        return apply

    # Copies and near copies count once, and never stand in both folds.
    kept = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "fold"))
    taken = shared.written(shared.map_slices(joined, family, "text string, toxic int, family string, fold int")
                           .groupBy("family", "toxic").agg(kept.alias("x")).select("x.text", "toxic", "x.fold"), "labelled")
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in taken.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    total = [sizes.get((0, c), 0) + sizes.get((1, c), 0) for c in (0, 1)]
    if not all(total):
        return None

    def count():
        def apply(batch):
            found = [Counter() for _ in range(4)]
            for text, toxic, part in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                words = {w.lower().strip(_EDGES) for w in (text or "").split()}
                found[2 * part + toxic].update({u for w in words if w for u in units(w)})
            names = list(set().union(*found))
            return {"unit": names} | {f"n{i}": [c[u] for u in names] for i, c in enumerate(found)}

        return apply

    counted = shared.written(
        shared.map_slices(taken, count, "unit string, n0 long, n1 long, n2 long, n3 long", limit=COUNT_BYTES)
        .groupBy("unit").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4))).filter("n0 + n1 + n2 + n3 > 1"), "units")
    # Units of the toxic class: met there more often than by its share.
    lift = F.expr(f"(n1 + n3) * sqrt((n1 + n3) / (n0 + n2 + {total[0] / sum(total)}))")
    lifted = shared.written(
        counted.filter(f"(n1 + n3) * {total[0]} > 2 * (n0 + n2) * {total[1]} AND n1 + n3 > 1")
        .orderBy(F.desc(lift), "unit").limit(MAX_UNITS), "toxic-units")
    # What begins like one of them has a score of its own.
    beginning = F.explode(F.expr(
        f"transform(sequence({BEGINNINGS.start}, greatest({BEGINNINGS.start}, least({BEGINNINGS.stop - 1}, length(unit) - 1))), "
        "k -> concat('^', substring(unit, 2, k)))"))
    toxic_beginnings = lifted.filter("unit LIKE '^%'").select(F.col("unit").alias("beginning"))
    extended = (counted.withColumn("beginning", beginning).join(F.broadcast(toxic_beginnings), "beginning", "left_semi")
                .drop("beginning").distinct().orderBy(F.expr("n0 + n1 + n2 + n3").desc(), "unit").limit(MAX_UNITS))
    known_units = lifted.unionByName(extended).distinct().toPandas()  # at most twice MAX_UNITS rows
    n = known_units[["n0", "n1", "n2", "n3"]].to_numpy(dtype=float)

    def model(folds: tuple[int, ...]) -> dict[str, float]:
        toxic, clean = sum(n[:, 2 * f + 1] for f in folds), sum(n[:, 2 * f] for f in folds)
        n_toxic, n_clean = (sum(sizes.get((f, c), 0) for f in folds) for c in (1, 0))
        if not n_toxic or not n_clean:
            return {}
        met = toxic + clean > 0
        counts = dict(zip(known_units["unit"][met], zip(toxic[met].tolist(), clean[met].tolist(), strict=True), strict=True))
        return log_odds(counts, n_toxic / (n_toxic + n_clean))

    other = [model((1,)), model((0,))]

    def scan():
        scores = [WordScores(m) for m in other]

        def apply(batch):
            made = [scores[f].segments(t) for t, f in zip(*(batch.column(c).to_pylist() for c in ("text", "fold")), strict=True)]
            return {"n": [x for x, _ in made], "toxic": batch.column("toxic"),
                    "best": [sorted((s for s, _, _ in found), reverse=True)[:BEST] for _, found in made]}

        return apply

    rows = shared.map_slices(taken, scan, "n long, toxic int, best array<double>").collect()  # at most max_labelled
    curve = calibrate(sorted((r["n"], r["best"], r["toxic"]) for r in rows))  # sums in one order
    # From the odds of the sample's classes to those of all labelled rows.
    curve.offset += math.log(of_all[1] / of_sample[1]) - math.log(of_all[0] / of_sample[0])
    return model((0, 1)), curve


def score(docs: DataFrame, fitted: tuple[dict, Calibration] | None, text: str = "text") -> DataFrame:
    """All columns with ``tox_score`` (0 to 1) and ``tox_segments`` (score,
    first word, end word) of the significant passages."""
    schema = [f for f in docs.schema if f.name not in ("tox_score", "tox_segments")]
    source = docs.select(*(F.col(f"`{f.name}`") for f in schema))
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def start():
        model, curve = sent.value or ({}, None)
        words = WordScores(model)

        def apply(batch):
            scores, passages = [], []
            for body in batch.column(text).to_pylist():
                if curve is None:
                    scores.append(0.0)
                    passages.append([])
                    continue
                n, found = words.segments(body)
                scores.append(curve.probability(curve.surprise(n, [s for s, _, _ in found])))
                passages.append([{"score": s, "first": a, "end": b} for s, a, b in found
                                 if curve.surprise(n, [s]) > 0])
            return {f.name: batch.column(f.name) for f in schema} | {"tox_score": scores, "tox_segments": passages}

        return apply

    made = _parse_datatype_string("tox_score double, tox_segments array<struct<score:double,first:bigint,end:bigint>>")
    return shared.map_slices(source, start, StructType([*schema, *made.fields]), text)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and decision for every document."""
    docs = shared.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, shared.read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", shared.held_out("doc_id").alias("held_out"), F.col("tox_score").alias("score"),
                         (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"))
