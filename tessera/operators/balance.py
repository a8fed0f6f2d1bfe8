"""Class balancing.

Random choices are seeded hashes of a row key, never partition-dependent
``rand()``, so a rerun (or a recomputed partition after a lost executor)
picks the same rows.  Per-class ranks come from a distributed sort
(``with_group_index``): a majority class holding most of the rows is spread
over many range partitions instead of one window task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expressions import col, quoted
from tessera.plans.ordering import hash_thresholds, with_group_index

METHODS = ("undersample", "oversample", "smote")
DEFAULT_SEED = 42


def _key_hash(key: Sequence[str], seed: int, salt: str = ""):
    return F.xxhash64(F.lit(seed), F.lit(salt), *[col(k) for k in key])


# Classes that a table of them may have; a target with more is no class label.
MAX_CLASSES = 10_000


def class_counts(df: DataFrame, target: str) -> dict:
    """{class: rows}, at most ``MAX_CLASSES``; more raise before they are
    collected."""
    rows = df.groupBy(col(target)).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"column {target!r} has more than {MAX_CLASSES} values and can't be a class label")
    return {r[0]: r[1] for r in rows}


def undersample(df: DataFrame, target: str, key: Sequence[str],
                seed: int = DEFAULT_SEED) -> DataFrame:
    """B1: every class cut to the minority count, without replacement.

    Each class keeps its ``n_min`` rows with the smallest seeded hash of the
    key (a uniform random subset), below an exact threshold per class found
    by counting; only rows of equal keys that straddle it are ranked.
    """
    df = df.where(col(target).isNotNull())
    counts = class_counts(df, target)
    if not counts:
        return df
    n_min = min(counts.values())
    hashed = df.withColumn("_ts_h", _key_hash(key, seed))
    found = hash_thresholds(hashed.select(col(target).alias("g"), F.col("_ts_h").alias("h")), {c: n_min for c in counts})
    table = df.sparkSession.createDataFrame(
        [(c, limit, need, need == equal) for c, (limit, need, equal) in found.items()],
        T.StructType([T.StructField("_ts_c", df.schema[target].dataType), T.StructField("_ts_limit", T.LongType()),
                      T.StructField("_ts_need", T.LongType()), T.StructField("_ts_whole", T.BooleanType())]))
    limited = hashed.join(F.broadcast(table), col(target) == F.col("_ts_c"))  # at most MAX_CLASSES rows
    names = [col(c) for c in df.columns]
    whole = limited.where((F.col("_ts_h") < F.col("_ts_limit")) | (F.col("_ts_whole") & (F.col("_ts_h") == F.col("_ts_limit"))))
    if all(need == equal for _, need, equal in found.values()):
        return whole.select(*names)
    tied = limited.where(~F.col("_ts_whole") & (F.col("_ts_h") == F.col("_ts_limit")))
    ranked = with_group_index(tied, ["_ts_c"], [quoted(k) for k in key], "_ts_idx")
    return whole.select(*names).unionByName(ranked.where(F.col("_ts_idx") < F.col("_ts_need")).select(*names))


def oversample(df: DataFrame, target: str, key: Sequence[str],
               seed: int = DEFAULT_SEED) -> DataFrame:
    """B2: every class raised to the majority count: all original rows plus
    ``n_max - n_c`` draws with replacement from the class.

    Draw ``j`` of class ``c`` takes the row whose in-class index is
    ``hash(seed, c, j) mod n_c``; the draws are generated by ``range`` and
    equi-joined on (class, index), so no class is gathered in one place.
    """
    df = df.where(col(target).isNotNull())
    counts = class_counts(df, target)
    if not counts:
        return df
    n_max = max(counts.values())
    spark = df.sparkSession
    indexed = with_group_index(df, [target], list(key), "_ts_idx", "_ts_n")
    draws = None
    tdt = df.schema[target].dataType
    for cls, n in counts.items():
        deficit = n_max - n
        if deficit <= 0:
            continue
        d = spark.range(deficit).select(
            F.lit(cls).cast(tdt).alias(target),
            F.pmod(F.xxhash64(F.lit(seed), F.lit(str(cls)), F.col("id")), F.lit(n))
            .alias("_ts_idx"))
        draws = d if draws is None else draws.unionByName(d)
    if draws is None:
        return df
    picked = draws.join(indexed, [target, "_ts_idx"], "inner").select(*df.columns)
    return df.unionByName(picked)


def smote(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str],
          k: int = 5, seed: int = DEFAULT_SEED) -> DataFrame:
    """Synthetic minority rows (Chawla et al. 2002) up to the majority
    count; see ``tessera.operators.neighbors`` for the neighbour search."""
    from tessera.operators.neighbors import smote_resample

    return smote_resample(df, target, features, key, k, seed)


def balance(df: DataFrame, method: str | None, target: str | None,
            key: Sequence[str] | None = None, features: Sequence[str] | None = None,
            seed: int = DEFAULT_SEED) -> DataFrame:
    """Class-balancing step of the reference pipeline (needs a target)."""
    if not method or method == "none" or not target:
        return df
    key = list(key) if key else [c for c in df.columns if c != target]
    if method == "undersample":
        return undersample(df, target, key, seed)
    if method == "oversample":
        return oversample(df, target, key, seed)
    if method == "smote":
        from tessera.functions.schema import numeric_columns
        feats = list(features) if features else numeric_columns(df, exclude=[target])
        return smote(df, target, feats, key, seed=seed)
    raise ValueError(f"unknown imbalance method: {method}")

