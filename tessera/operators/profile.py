"""Profiling aggregates (A1-A12), returned as tidy DataFrames.

Each report is one (or two) aggregation jobs over all columns at once; the
single aggregate row is unpivoted with ``explode`` inside Spark, so nothing
but the final small report is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import (adjusted_kurtosis_col, adjusted_skewness_col, col,
                                           jarque_bera_pvalue_col, nan_to_null)
from tessera.functions.schema import categorical_columns, is_numeric, numeric_columns
from tessera.functions.stats import collect_stats, quantiles


def _x(c: str) -> Column:
    return nan_to_null(col(c).cast("double"))


def _unpivot_row(row_df: DataFrame, items: list[Column]) -> DataFrame:
    """Explode an array of structs built from a one-row aggregate."""
    return row_df.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, count) of non-missing values, one shuffle for all
    columns; partial aggregation keeps a hot value out of a single task."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                         col(c).cast("string").alias("value"))
                                for c in cols])).alias("p")
    return (df.select(pairs).select("p.column_name", "p.value")
              .where(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))


def describe(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """A1: pandas ``describe(include='all')`` as one row per column.

    Numeric columns: count, mean, std (sample), min, quartiles, max.
    Other columns: count, unique, top (ties -> smallest value), freq.
    """
    cols = list(cols) if cols else list(df.columns)
    num = [c for c in cols if is_numeric(df.schema[c].dataType)]
    cat = [c for c in cols if c not in num]
    parts = []
    if num:
        qs = quantiles(df, num, [0.25, 0.5, 0.75], exact)
        aggs = []
        for i, c in enumerate(num):
            x = _x(c)
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"),
                     F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                     F.max(x).alias(f"hi{i}")]
        row = df.agg(*aggs)

        def q(c: str, j: int) -> Column:
            return F.lit(qs[c][j]).cast("double")

        items = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"),
                          F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                          F.col(f"lo{i}").alias("min"), q(c, 0).alias("p25"),
                          q(c, 1).alias("p50"), q(c, 2).alias("p75"),
                          F.col(f"hi{i}").alias("max"))
                 for i, c in enumerate(num)]
        parts.append(_unpivot_row(row, items))
    if cat:
        counts = value_counts(df, cat)
        summary = counts.groupBy("column_name").agg(
            F.sum("count").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min(F.struct((-F.col("count")).alias("neg"), F.col("value").alias("value")))
            .alias("best"))
        summary = summary.select("column_name", "count", "unique",
                                 F.col("best.value").alias("top"),
                                 (-F.col("best.neg")).alias("freq"))
        # Columns with no value at all still get a row (count 0).
        present = df.sparkSession.createDataFrame([(c,) for c in cat], "column_name string")
        summary = present.join(summary, "column_name", "left").withColumn(
            "count", F.coalesce(F.col("count"), F.lit(0).cast("long")))
        parts.append(summary)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    columns = ["column_name", "count", "unique", "top", "freq", "mean", "std",
               "min", "p25", "p50", "p75", "max"]
    defaults = {"unique": "long", "top": "string", "freq": "long", "mean": "double",
                "std": "double", "min": "double", "p25": "double", "p50": "double",
                "p75": "double", "max": "double"}
    for c, t in defaults.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out.select(*columns)


def info(df: DataFrame) -> DataFrame:
    """A2: column, Spark type and non-null count, one job."""
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    items = [F.struct(F.lit(f.name).alias("column_name"),
                      F.lit(f.dataType.simpleString()).alias("data_type"),
                      F.col(f"n{i}").alias("non_null"))
             for i, f in enumerate(df.schema.fields)]
    return _unpivot_row(row, items)


def correlation(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A3: Pearson correlation of every numeric pair (pairwise complete), all
    n(n+1)/2 in one aggregation; output (col_a, col_b, corr), both orders."""
    cols = list(cols) if cols else numeric_columns(df)
    if not cols:
        raise ValueError("no numeric columns for correlation analysis")
    aggs = []
    for i, a in enumerate(cols):
        aggs.append(F.stddev_pop(_x(a)).alias(f"s{i}"))
        for j in range(i + 1, len(cols)):
            aggs.append(F.corr(_x(a), _x(cols[j])).alias(f"c{i}_{j}"))
    row = df.agg(*aggs)
    items = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                value = F.when(F.col(f"s{i}") > 0, F.lit(1.0))
            else:
                value = F.col(f"c{min(i, j)}_{max(i, j)}")
            items.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                  value.cast("double").alias("corr")))
    return _unpivot_row(row, items)


def distribution(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4/A5: per numeric column n, bias-adjusted skewness and excess
    kurtosis, and a Jarque-Bera normality p-value (null when n <= 1)."""
    cols = list(cols) if cols else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = _x(c)
        aggs += [F.count(x).alias(f"n{i}"), F.skewness(x).alias(f"g{i}"),
                 F.kurtosis(x).alias(f"k{i}")]
    row = df.agg(*aggs)
    items = []
    for i, c in enumerate(cols):
        n, g1, g2 = F.col(f"n{i}"), F.col(f"g{i}"), F.col(f"k{i}")
        ok = n > 1
        items.append(F.struct(F.lit(c).alias("column_name"), n.alias("n"),
                              F.when(ok, adjusted_skewness_col(g1, n)).alias("skewness"),
                              F.when(ok, adjusted_kurtosis_col(g2, n)).alias("kurtosis"),
                              F.when(ok, jarque_bera_pvalue_col(g1, g2, n)).alias("normality_p")))
    return _unpivot_row(row, items)


def missing(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column (null % on an empty table)."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.sum(col(c).isNull().cast("long")).alias(f"m{i}")
             for i, c in enumerate(df.columns)]
    row = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column_name"),
                      F.coalesce(F.col(f"m{i}"), F.lit(0).cast("long")).alias("missing_count"),
                      F.when(F.col("_rows") > 0, F.col(f"m{i}") * 100.0 / F.col("_rows"))
                      .alias("missing_pct"))
             for i, c in enumerate(df.columns)]
    return _unpivot_row(row, items)


def categorical_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Value counts of each non-numeric column, missing excluded."""
    cols = list(cols) if cols else [f.name for f in df.schema.fields
                                    if not is_numeric(f.dataType)]
    return value_counts(df, cols)


def outlier_summary(df: DataFrame, cols: Sequence[str] | None = None,
                    exact: bool = True) -> DataFrame:
    """IQR fences and the count / % (of all rows) outside them."""
    cols = list(cols) if cols else numeric_columns(df)
    qs = quantiles(df, cols, [0.25, 0.75], exact)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    bounds = {}
    for i, c in enumerate(cols):
        q = qs[c]
        if q and q[0] is not None:
            iqr = q[1] - q[0]
            lo, hi = q[0] - 1.5 * iqr, q[1] + 1.5 * iqr
            bounds[c] = (q[0], q[1], lo, hi)
            aggs.append(F.sum(((_x(c) < lo) | (_x(c) > hi)).cast("long")).alias(f"o{i}"))
        else:
            bounds[c] = (None, None, None, None)
            aggs.append(F.lit(0).cast("long").alias(f"o{i}"))
    row = df.agg(*aggs)
    items = []
    for i, c in enumerate(cols):
        q1, q3, lo, hi = bounds[c]
        n = F.coalesce(F.col(f"o{i}"), F.lit(0).cast("long"))
        items.append(F.struct(F.lit(c).alias("column_name"),
                              F.lit(q1).cast("double").alias("q1"),
                              F.lit(q3).cast("double").alias("q3"),
                              F.lit(lo).cast("double").alias("lower"),
                              F.lit(hi).cast("double").alias("upper"),
                              n.alias("outlier_count"),
                              F.when(F.col("_rows") > 0, n * 100.0 / F.col("_rows"))
                              .alias("outlier_pct")))
    return _unpivot_row(row, items)


def duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Total rows, duplicate rows (rows minus distinct rows) and %."""
    cols = list(cols) if cols else list(df.columns)
    groups = df.groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.sum("_n").alias("total_rows"),
                      F.sum(F.col("_n") - 1).alias("duplicates")).select(
        F.coalesce(F.col("total_rows"), F.lit(0).cast("long")).alias("total_rows"),
        F.coalesce(F.col("duplicates"), F.lit(0).cast("long")).alias("duplicates"),
        F.when(F.col("total_rows") > 0, F.col("duplicates") * 100.0 / F.col("total_rows"))
        .alias("duplicate_pct"))


def class_balance(df: DataFrame, target: str = "target") -> DataFrame:
    """A10: class counts of the target column (missing excluded)."""
    if target not in df.columns:
        raise ValueError(f"no {target!r} column found for imbalance check")
    return (df.where(col(target).isNotNull()).groupBy(col(target).alias("class"))
              .agg(F.count(F.lit(1)).alias("count")))


def skewness_check(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Adjusted skewness and whether Box-Cox applies (all values > 0,
    a missing value counts as not > 0, and |skew| > 0.5)."""
    cols = list(cols) if cols else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = _x(c)
        aggs += [F.count(x).alias(f"n{i}"), F.skewness(x).alias(f"g{i}"),
                 F.min(F.coalesce(x > 0, F.lit(False))).alias(f"p{i}")]
    row = df.agg(*aggs)
    items = []
    for i, c in enumerate(cols):
        skew = adjusted_skewness_col(F.col(f"g{i}"), F.col(f"n{i}"))
        positive = F.coalesce(F.col(f"p{i}"), F.lit(True))
        items.append(F.struct(F.lit(c).alias("column_name"), skew.alias("skewness"),
                              (positive & F.coalesce(F.abs(skew) > 0.5, F.lit(False)))
                              .alias("boxcox_applicable")))
    return _unpivot_row(row, items)


def pair_bins(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """The data behind a pair plot, without drawing it: 2-D binned counts
    for each pair of numeric columns (col_a < col_b in column order) and a
    histogram on the diagonal (col_a = col_b).  Bins split [min, max] evenly;
    the max falls in the last bin."""
    cols = list(cols) if cols else numeric_columns(df)
    if not cols:
        raise ValueError("no numeric columns for a pair plot")
    stats = collect_stats(df, {**{f"lo{i}": F.min(_x(c)) for i, c in enumerate(cols)},
                               **{f"hi{i}": F.max(_x(c)) for i, c in enumerate(cols)}})

    def bin_of(i: int, c: str) -> Column:
        lo, hi = stats[f"lo{i}"], stats[f"hi{i}"]
        if lo is None:
            return F.lit(None).cast("int")
        if hi == lo:
            return F.when(_x(c).isNotNull(), F.lit(0))
        raw = F.floor((_x(c) - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))).cast("int")
        return F.least(raw, F.lit(bins - 1))

    binned = [bin_of(i, c) for i, c in enumerate(cols)]
    items = []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            items.append(F.struct(F.lit(a).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                                  binned[i].alias("bin_a"), binned[j].alias("bin_b")))
    cells = df.select(F.explode(F.array(*items)).alias("p")).select("p.*")
    return (cells.where(F.col("bin_a").isNotNull() & F.col("bin_b").isNotNull())
                 .groupBy("col_a", "col_b", "bin_a", "bin_b")
                 .agg(F.count(F.lit(1)).alias("count")))


__all__ = ["describe", "info", "correlation", "distribution", "missing",
           "categorical_counts", "outlier_summary", "duplicates", "class_balance",
           "skewness_check", "pair_bins", "value_counts", "categorical_columns"]
