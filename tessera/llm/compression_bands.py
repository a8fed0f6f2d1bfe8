"""Quality rules on a text's words, and bands of its compression ratio.

The base rules count words, symbols, repeated lines and repeated five-word
windows.  The method compresses the whole text and fixed chunks of it with
zstandard: the ratio (compressed to plain bytes) of repetitive text lies below
the limits of its length, that of incompressible text above them.  The limits
of a length (between two powers of two bytes) lie ``FENCE`` quartile distances
beyond the quartiles of all distinct texts of it that pass the base rules, so
copies count once; lengths of fewer than ``LEAST_TEXTS`` have fixed limits.

Rows: a null text has no words; a text without words fails the base rules;
equal rows are treated alike; texts of any length are compressed whole, one by
one; an empty table has no limits fitted and gives no rows.  Other columns are kept but for those named
like an output.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera.llm import shared

LEVEL = 3
CHUNK = 4096
#: How far beyond the quartiles a ratio may lie, in distances between them
#: (which count as ``LEAST_SPREAD`` at least).
FENCE, LEAST_SPREAD = 4.0, 0.01
#: Distinct texts or chunks from which limits of a length are fitted.
LEAST_TEXTS = 100
#: Least and greatest ratio of a text shorter than so many bytes, where fewer
#: are of its length.
WHOLE_BANDS = ((128, 0.30, 1.35), (256, 0.25, 1.05), (512, 0.22, 0.90), (2048, 0.20, 0.80), (8192, 0.18, 0.72),
               (65536, 0.15, 0.70), (1 << 62, 0.12, 0.70))
#: Share of a text's chunks that may lie outside.  A last chunk of under half
#: the size belongs to the one before.
CHUNKS_OUTSIDE = 0.25
WINDOW = 5



def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five words that the text holds more than once."""
    if len(words) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    n = len(words) - WINDOW + 1
    seen = ids[:n]  # one number for the first words of a window, exact at any length
    for k in range(1, WINDOW):
        seen = np.unique(seen, return_inverse=True)[1] * len(number) + ids[k:n + k]
    _, which, count = np.unique(seen, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[which] > 1)
    if not len(often):
        return 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, often, 1)
    np.add.at(edges, often + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """Words, their code points, symbols, repeated lines and repeated words of
    a text, and whether it fails."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = repeated_words(words)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, n < 10 or 100 * repeated > 20 * n


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)


def ratio(raw: bytes) -> float:
    return len(_compressor().compress(raw)) / len(raw) if raw else 1.0


def chunks(raw: bytes, size: int = CHUNK) -> list[bytes]:
    """Fixed chunks; a short last one is joined to the one before."""
    starts = [*range(0, len(raw), size)]
    if len(starts) > 1 and len(raw) - starts[-1] < size // 2:
        starts.pop()
    return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]


Limits = dict[int, tuple[float, float]]


def size_class(n: int) -> int:
    """Lengths between two powers of two share their limits."""
    return n.bit_length()


def limits_of(n: int, fitted: Limits) -> tuple[float, float]:
    return fitted.get(size_class(n)) or next((low, high) for limit, low, high in WHOLE_BANDS if n < limit)


def bands(text: str | None, whole_limits: Limits | None = None, chunk_limits: Limits | None = None) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its chunks outside the limits of their
    length, and whether it lies within those of its own."""
    raw = (text or "").encode()
    whole = ratio(raw)
    low, high = limits_of(len(raw), whole_limits or {})
    outside = 0.0
    if len(raw) > CHUNK:
        parts = chunks(raw)
        made = [(ratio(c), *limits_of(len(c), chunk_limits or {})) for c in parts]
        outside = sum(not least <= r <= most for r, least, most in made) / len(made)
    return whole, outside, low <= whole <= high and outside <= CHUNKS_OUTSIDE


def _fences(counts: list[tuple[int, int]]) -> tuple[float, float] | None:
    """Limits from ``(ratio in thousandths, texts)``."""
    total = sum(n for _, n in counts)
    if total < LEAST_TEXTS:
        return None
    quartile, seen = [], 0
    for value, n in sorted(counts):
        seen += n
        while len(quartile) < 2 and seen >= total * (0.25, 0.75)[len(quartile)]:
            quartile.append(value / 1000)
    reach = FENCE * max(quartile[1] - quartile[0], LEAST_SPREAD)
    return quartile[0] - reach, quartile[1] + reach


def fit(docs: DataFrame, text: str = "text") -> tuple[Limits, Limits]:
    """Limits of whole texts and of chunks by length, from the quartiles of the
    ratios of all distinct texts that pass the base rules.  What reaches the
    driver are counts of ratios in thousandths for each length."""

    def start():
        def apply(batch):
            out = {"h": [], "sizes": [], "ratios": []}
            for body in batch.column("text").to_pylist():
                if base(body)[-1]:
                    continue
                raw = body.encode()
                parts = [raw, *(chunks(raw) if len(raw) > CHUNK else [])]
                out["h"].append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                out["sizes"].append([size_class(len(x)) for x in parts])
                out["ratios"].append([round(1000 * ratio(x)) for x in parts])
            return out

        return apply

    source = docs.select(F.col(f"`{text}`").alias("text")).filter(F.length("text") > 0)
    found = shared.map_slices(source, start, "h long, sizes array<int>, ratios array<int>")
    one = found.groupBy("h").agg(F.min(F.struct("sizes", "ratios")).alias("x")).select("x.*")
    each = one.select(F.posexplode(F.arrays_zip("sizes", "ratios")).alias("at", "x"))
    counted = each.groupBy((F.col("at") > 0).alias("chunk"), "x.sizes", "x.ratios").agg(F.count("*").alias("n")).collect()
    out: tuple[Limits, Limits] = ({}, {})
    for kind in (False, True):
        for size in {r["sizes"] for r in counted if r["chunk"] == kind}:
            fences = _fences([(r["ratios"], r["n"]) for r in counted if r["chunk"] == kind and r["sizes"] == size])
            if fences:
                out[kind][size] = fences
    return out


_OUT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "kept boolean, ratio double, chunks_outside double")


def judge(docs: DataFrame, text: str = "text", limits: tuple[Limits, Limits] = ({}, {})) -> DataFrame:
    """All columns with the counts, ratios and verdicts by fitted limits (by
    fixed ones where none are fitted)."""
    made = _parse_datatype_string(_OUT)
    kept = [f for f in docs.schema if f.name not in made.names]

    def start():
        def apply(batch):
            rows = []
            for body in batch.column(text).to_pylist():
                counts = base(body)
                whole, outside, fine = bands(body, *limits)
                rows.append((*counts, fine and not counts[-1], whole, outside))
            columns = zip(*rows, strict=True)
            return {f.name: batch.column(f.name) for f in kept} | dict(zip(made.names, columns, strict=True))

        return apply

    return shared.map_slices(docs.select(*(F.col(f"`{f.name}`") for f in kept)), start, StructType([*kept, *made.fields]), text)


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and verdict of every document."""
    docs = shared.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, limits=fit(docs)).drop("text")
