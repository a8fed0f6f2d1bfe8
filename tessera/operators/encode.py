"""Categorical encodings (N1-N5): group aggregate, then a size-checked join.

Category tables are aggregates of the data, usually tiny; they are broadcast
only when their size is proven small (``attach_small``), otherwise joined by
shuffle (AQE splits a skewed category).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import col
from tessera.functions.schema import categorical_columns
from tessera.functions.stats import collect_stats
from tessera.plans.ordering import SMALL_TABLE_ROWS, attach_small, with_position

METHODS = ("onehot", "label", "ordinal", "target", "frequency")
# Text of a missing value after the reference's ``astype(str)``.
MISSING_LABEL = "nan"


def encoding_columns(df: DataFrame, cols: Sequence[str] | None,
                     exclude: Sequence[str] = ()) -> list[str]:
    """None means every string column (minus ``exclude``); an empty list
    means none."""
    if cols is None:
        return categorical_columns(df, exclude=exclude)
    return [c for c in cols if c in df.columns and c not in exclude]


@dataclass(frozen=True)
class OneHot:
    """Fitted categories per column, in sorted order, missing last."""

    categories: dict[str, list]

    def output_names(self) -> list[str]:
        return [f"{c}_{MISSING_LABEL if v is None else v}"
                for c, vals in self.categories.items() for v in vals]

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [col(c) for c in df.columns if c not in self.categories]
        new = []
        for c, vals in self.categories.items():
            for v in vals:
                if v in (None, MISSING_LABEL):  # one column for both
                    hit = F.coalesce(col(c).cast("string"), F.lit(MISSING_LABEL)) == MISSING_LABEL
                else:
                    hit = col(c).eqNullSafe(F.lit(v))
                name = f"{c}_{MISSING_LABEL if v is None else v}"
                new.append(F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0)).alias(name))
        return df.select(*keep, *new)


def fit_onehot(df: DataFrame, cols: Sequence[str], max_categories: int | None = None) -> OneHot:
    """Distinct values of each column (missing is its own category).

    Every category becomes a column, so their names pass through the driver;
    ``max_categories`` raises beyond so many of one column, counted exactly.
    ``onehot_long`` has the same cells without that.
    """
    cols = list(cols)
    if not cols:
        return OneHot({})
    cats: dict[str, list] = {}
    for c in cols:
        found = df.select(col(c).cast("string").alias("value")).distinct()
        if max_categories is not None:
            found = found.limit(max_categories + 1)
        values = [r["value"] for r in found.collect()]
        if max_categories is not None and len(values) > max_categories:
            raise ValueError(f"column {c} has more than max_categories={max_categories} categories")
        present = sorted(v for v in values if v is not None)
        cats[c] = present + ([None] if None in values and MISSING_LABEL not in present else [])
    return OneHot(cats)


def onehot(df: DataFrame, cols: Sequence[str] | None = None,
           max_categories: int | None = None) -> DataFrame:
    """One 0.0/1.0 column ``{c}_{value}`` per category; originals dropped."""
    cols = encoding_columns(df, cols)
    return fit_onehot(df, cols, max_categories).transform(df)


def onehot_long(df: DataFrame, key: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """The cells of the one-hot encoding that hold 1.0, as rows (key,
    ``feature``, ``value``): any number of categories, nothing on the driver."""
    cols = encoding_columns(df, cols, exclude=key)
    names = [F.concat(F.lit(f"{c}_"), F.coalesce(col(c).cast("string"), F.lit(MISSING_LABEL))) for c in cols]
    return df.select(*[col(k) for k in key], F.explode(F.array(*names)).alias("feature"), F.lit(1.0).alias("value"))


def label_codes(df: DataFrame, c: str) -> DataFrame:
    """(value, code): distinct texts of ``c`` numbered 0.. in sorted order.

    The numbering is a distributed sort of the distinct values (no global
    window), so it also works for very many categories.
    """
    text = F.coalesce(col(c).cast("string"), F.lit(MISSING_LABEL))
    distinct = df.select(text.alias("_ts_value")).distinct()
    coded = with_position(distinct, ["_ts_value"], "_ts_code")
    return coded.select("_ts_value", F.col("_ts_code").cast("long").alias("_ts_code"))


def label_encode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """label/ordinal encoding; a missing value is coded as the text 'nan'."""
    for c in encoding_columns(df, cols):
        codes = label_codes(df, c)
        keyed = df.withColumn("_ts_value", F.coalesce(col(c).cast("string"),
                                                      F.lit(MISSING_LABEL)))
        joined = attach_small(keyed, codes, "_ts_value", "left")
        df = joined.select(*[F.col("_ts_code").alias(x) if x == c else col(x)
                             for x in df.columns])
    return df


def target_encode(df: DataFrame, cols: Sequence[str] | None, target: str) -> DataFrame:
    """Per-category mean of the target (in-sample, as in the reference);
    a missing or unseen category gets the global target mean.

    One aggregation per column gives (category, sum, count) including the
    missing category, so the global mean needs no extra scan.
    """
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    y = col(target).cast("double")
    for c in encoding_columns(df, cols, exclude=[target]):
        stats = (df.groupBy(col(c).alias("_ts_key"))
                   .agg(F.sum(y).alias("_ts_sum"), F.count(y).alias("_ts_cnt")))
        rows = stats.limit(SMALL_TABLE_ROWS + 1).collect()
        if len(rows) <= SMALL_TABLE_ROWS:
            total = sum(r["_ts_sum"] or 0.0 for r in rows)
            count = sum(r["_ts_cnt"] for r in rows)
            local = df.sparkSession.createDataFrame(
                [(r["_ts_key"], r["_ts_sum"] / r["_ts_cnt"] if r["_ts_cnt"] else None)
                 for r in rows if r["_ts_key"] is not None],
                f"_ts_key {df.schema[c].dataType.simpleString()}, _ts_mean double")
            joined = df.withColumn("_ts_key", col(c)).join(F.broadcast(local), "_ts_key", "left")
        else:
            totals = collect_stats(stats, {"s": F.sum("_ts_sum"), "n": F.sum("_ts_cnt")})
            total, count = totals["s"] or 0.0, totals["n"] or 0
            means = stats.where(F.col("_ts_key").isNotNull()).select(
                "_ts_key", (F.col("_ts_sum") / F.col("_ts_cnt")).alias("_ts_mean"))
            joined = df.withColumn("_ts_key", col(c)).join(means, "_ts_key", "left")
        overall = total / count if count else None
        enc = F.coalesce(F.col("_ts_mean"), F.lit(overall).cast("double"))
        df = joined.select(*[enc.alias(x) if x == c else col(x) for x in df.columns])
    return df


def frequency_encode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of the non-missing rows holding the value; missing stays
    missing.  The total comes from the (small) count table itself."""
    for c in encoding_columns(df, cols):
        counts = (df.where(col(c).isNotNull()).groupBy(col(c).alias("_ts_key"))
                    .agg(F.count(F.lit(1)).alias("_ts_n")))
        rows = counts.limit(SMALL_TABLE_ROWS + 1).collect()
        if len(rows) <= SMALL_TABLE_ROWS:
            total = sum(r["_ts_n"] for r in rows)
            local = df.sparkSession.createDataFrame(rows, counts.schema)
            joined = df.withColumn("_ts_key", col(c)).join(F.broadcast(local), "_ts_key", "left")
        else:
            total = collect_stats(counts, {"n": F.sum("_ts_n")})["n"]
            joined = df.withColumn("_ts_key", col(c)).join(counts, "_ts_key", "left")
        enc = (F.col("_ts_n") / F.lit(float(total))) if total else F.lit(None).cast("double")
        df = joined.select(*[enc.cast("double").alias(x) if x == c else col(x)
                             for x in df.columns])
    return df


def encode(df: DataFrame, method: str | None, cols: Sequence[str] | None = None,
           target: str | None = None) -> DataFrame:
    """Encoding step of the reference pipeline."""
    if not method or method == "none":
        return df
    if method == "onehot":
        return onehot(df, cols)
    if method in ("label", "ordinal"):
        return label_encode(df, cols)
    if method == "target":
        return target_encode(df, cols, target) if target else df
    if method == "frequency":
        return frequency_encode(df, cols)
    raise ValueError(f"unknown encoding method: {method}")
