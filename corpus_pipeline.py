"""The corpus pipeline: stages over ``documents``, each written as Parquet and
read again as the next one's input.

Toxic documents go, then those without a main language, then all but one of
each group of near-duplicates; personal data is masked in the rest, which is
packed into sequences.  All stages but the last return the input's columns, also
those named like an operator's output.
An empty table passes through; null texts are no toxic documents, have no
language and so go in the second stage.  If no row has a language to learn
from, that stage keeps every document with a letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import hyperminhash, langid_crf, pii_spans, shared, toxic_segments, window_packing

#: Least mean marginal of a document's language.
MAIN_LANGUAGE = 0.35


def _sheltered(docs: DataFrame, made: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns that are named like an operator's output
    renamed, and the names to rename them back."""
    hidden = {name: f"_input_{i}_{name}" for i, name in enumerate(docs.columns) if name in made}
    return docs.withColumnsRenamed(hidden), {new: old for old, new in hidden.items()}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model learned from those
    of the labelled documents that are not held out."""
    fitted = toxic_segments.fit(docs, shared.read_table(spark, sf_dir, "labels"))
    made = ("tox_score", "tox_segments")
    hidden, back = _sheltered(docs, made)
    scored = toxic_segments.score(hidden, fitted)
    return (scored.filter(F.col("tox_score") < toxic_segments.THRESHOLD).drop(*made).withColumnsRenamed(back)
            .select(*(F.col(f"`{c}`") for c in docs.columns)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose likeliest language has a mean marginal of
    ``MAIN_LANGUAGE`` at least.  The languages are those learned, so next to
    null and letterless texts this rejects only texts spread evenly over them:
    with four languages hardly any, nor text of a language not learned; with
    one or two, none.  Without a language to learn from, documents with a
    letter stay."""
    fitted = langid_crf.fit(docs)
    if fitted is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    made = ("lang_pred", "lang_score", "lang_switches")
    hidden, back = _sheltered(docs, made)
    found = langid_crf.predict(hidden, fitted)
    clear = (F.col("lang_pred") != langid_crf.UNDETERMINED) & (F.col("lang_score") >= MAIN_LANGUAGE)
    return found.filter(clear).drop(*made).withColumnsRenamed(back).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (word shingles of five,
    similarity 0.8): the one with the smallest id.  Documents without an id
    or without words stay.  Rows of one id are judged by their own texts; of
    rows with equal id and text one stays.  A pair at 0.8 shares no band, so that its link is
    not found, with a probability of about 4.9e-5."""
    found = hyperminhash.near_duplicates(docs, threshold=0.8, shingle=5, source=True)
    stay = found.filter("doc_id IS NOT NULL AND kept").select("doc_id", F.col("source").alias("_source")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(*columns)
    # Of rows with equal id and text one, chosen by a hash of all its columns.
    one = F.min_by(whole, F.xxhash64(*columns)).alias("_row")
    named = (docs.withColumn("_source", F.xxhash64("text")).join(stay, ["doc_id", "_source"], "left_semi")
             .groupBy("doc_id", "_source").agg(one).select("_row.*"))
    return named.select(*columns).unionByName(docs.filter("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked, ``n_chars`` brought in line."""
    masked = pii_spans.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 ids."""
    return window_packing.digest(window_packing.pack_documents(docs))


STAGES = [("toxicity", toxicity), ("language", language), ("near-duplicates", near_duplicates),
          ("personal data", personal_data), ("packing", packing)]

#: Learned models, tokenizers and sketches can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
