"""Feature generation, selection and reduction.

Generated features are Column expressions (name-stable, codegen'd).
Selection statistics are one aggregation job.  PCA and LDA need a d x d
matrix: it is aggregated on the executors (``ml.stat`` tree aggregation),
decomposed on the driver (d is the number of features, not rows), and the
projection is again a Column expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expressions import col, nan_to_null
from tessera.functions.schema import numeric_columns, temporal_columns
from tessera.functions.stats import collect_stats
from tessera.operators.balance import MAX_CLASSES

VARIANCE_THRESHOLD = 0.01
DEFAULT_K = 5
DEFAULT_COMPONENTS = 3


def _x(c: str) -> Column:
    return nan_to_null(col(c).cast("double"))


# ---------------------------------------------------------------- generation

def polynomial_names(cols: Sequence[str], interaction_only: bool = False) -> list[tuple]:
    """Degree-2 terms without bias, in scikit-learn's order and naming:
    ``a``, ``b``, ``a^2``, ``a b``, ``b^2`` (squares left out for
    interaction-only)."""
    terms = [(c,) for c in cols]
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            if i == j and interaction_only:
                continue
            terms.append((a, cols[j]))
    return terms


def _term_name(term: tuple) -> str:
    if len(term) == 1:
        return term[0]
    return f"{term[0]}^2" if term[0] == term[1] else f"{term[0]} {term[1]}"


def polynomial(df: DataFrame, cols: Sequence[str] | None = None, interaction_only: bool = False,
               keep: Sequence[str] = ()) -> DataFrame:
    """Degree-2 polynomial (or interaction) features of the numeric
    columns; other columns are dropped except those in ``keep``."""
    cols = list(cols) if cols else numeric_columns(df, exclude=keep)
    out = [col(k) for k in keep]
    for term in polynomial_names(cols, interaction_only):
        expr = _x(term[0]) if len(term) == 1 else _x(term[0]) * _x(term[1])
        out.append(expr.alias(_term_name(term)))
    return df.select(*out)


def datetime_parts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``{c}_year``, ``{c}_month``, ``{c}_day`` for timestamp/date
    columns; the source column is kept."""
    cols = list(cols) if cols else temporal_columns(df)
    new = {}
    for c in cols:
        new[f"{c}_year"] = F.year(col(c))
        new[f"{c}_month"] = F.month(col(c))
        new[f"{c}_day"] = F.dayofmonth(col(c))
    return df.withColumns(new) if new else df


# ----------------------------------------------------------------- selection

def variance_report(df: DataFrame, cols: Sequence[str] | None = None,
                    threshold: float = VARIANCE_THRESHOLD) -> DataFrame:
    """G4 statistics: population variance per column and whether it passes."""
    cols = list(cols) if cols else numeric_columns(df)
    row = df.agg(*[F.var_pop(_x(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("variance"),
                      F.coalesce(F.col(f"v{i}") > threshold, F.lit(False)).alias("selected"))
             for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def variance_select(df: DataFrame, cols: Sequence[str] | None = None,
                    threshold: float = VARIANCE_THRESHOLD,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Keep the columns whose population variance exceeds ``threshold``."""
    cols = list(cols) if cols else numeric_columns(df, exclude=keep)
    stats = collect_stats(df, {f"v{i}": F.var_pop(_x(c)) for i, c in enumerate(cols)})
    chosen = [c for i, c in enumerate(cols)
              if stats[f"v{i}"] is not None and stats[f"v{i}"] > threshold]
    return df.select(*[col(c) for c in [*keep, *chosen]])


def anova_report(df: DataFrame, target: str, cols: Sequence[str] | None = None,
                 k: int = DEFAULT_K) -> DataFrame:
    """G5 statistics: one-way ANOVA F of each feature against the classes,
    from per-class count, mean and population variance (one ``groupBy``),
    and whether it is among the ``min(k, p)`` best."""
    cols = list(cols) if cols else numeric_columns(df, exclude=[target])
    k = min(k, len(cols))
    data = df.where(col(target).isNotNull())
    per_class = data.groupBy(col(target)).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(_x(c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.var_pop(_x(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    # per_class has one row per class, so these unpartitioned windows and the
    # final aggregate run over a handful of rows.
    everything = Window.partitionBy()
    with_totals = per_class.select(
        "*", F.sum("_n").over(everything).alias("n"),
        F.count(F.lit(1)).over(everything).alias("g"),
        *[(F.sum(F.col("_n") * F.col(f"m{i}")).over(everything) /
           F.sum("_n").over(everything)).alias(f"gm{i}") for i in range(len(cols))])
    sums = with_totals.agg(
        F.first("n").alias("n"), F.first("g").alias("g"),
        *[F.sum(F.col("_n") * F.pow(F.col(f"m{i}") - F.col(f"gm{i}"), 2)).alias(f"b{i}")
          for i in range(len(cols))],
        *[F.sum(F.col("_n") * F.col(f"v{i}")).alias(f"w{i}") for i in range(len(cols))])
    items = []
    for i, c in enumerate(cols):
        between = F.try_divide(F.col(f"b{i}"), F.col("g") - 1)
        within = F.try_divide(F.col(f"w{i}"), F.col("n") - F.col("g"))
        # A feature constant within every class separates them perfectly;
        # a constant feature, or one class, has no F.
        f = F.when((within == 0) & (between > 0), F.lit(float("inf"))).otherwise(F.try_divide(between, within))
        items.append(F.struct(F.lit(c).alias("column_name"), f.alias("f_score")))
    report = sums.select(F.explode(F.array(*items)).alias("r")).select("r.*")
    order = F.row_number().over(
        Window.orderBy(F.col("f_score").desc_nulls_last(), F.col("column_name")))
    # The report has one row per feature, so this window is over p rows.
    return report.withColumn("selected", order <= k)


def kbest_select(df: DataFrame, target: str, cols: Sequence[str] | None = None,
                 k: int = DEFAULT_K) -> DataFrame:
    """Keep the k features with the highest ANOVA F (infinite ones first),
    plus the target."""
    report = anova_report(df, target, cols, k).collect()
    chosen = {r["column_name"] for r in report if r["selected"]}
    cols = list(cols) if cols else numeric_columns(df, exclude=[target])
    return df.select(*[col(c) for c in cols if c in chosen], col(target))


def rfe_select(df: DataFrame, target: str, cols: Sequence[str] | None = None,
               n_features: int = DEFAULT_K, max_iter: int = 500) -> list[str]:
    """Recursive feature elimination with logistic regression (C = 1,
    no standardisation, as scikit-learn): drop the feature with the smallest
    squared coefficients, one per round, until ``n_features`` remain.

    A missing feature gets the column's mean, as in training (0 if the column
    has no value), so that no row with a target is lost."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    cols = list(cols) if cols else numeric_columns(df, exclude=[target])
    values = [F.nanvl(col(c).cast("double"), F.lit(None)) for c in cols]
    data = df.dropna(subset=[target])
    means = data.agg(*(F.avg(v).alias(f"m{i}") for i, v in enumerate(values))).first()
    data = data.select(*(F.coalesce(v, F.lit(means[i] or 0.0)).alias(c) for i, (c, v) in enumerate(zip(cols, values))), target)
    data = StringIndexer(inputCol=target, outputCol="_ts_label",
                         stringOrderType="alphabetAsc").fit(data).transform(data)
    n = data.count()
    data = data.persist()
    remaining = list(cols)
    try:
        while len(remaining) > n_features:
            vec = VectorAssembler(inputCols=remaining, outputCol="_ts_f").transform(data)
            lr = LogisticRegression(featuresCol="_ts_f", labelCol="_ts_label",
                                    maxIter=max_iter, regParam=1.0 / n,
                                    elasticNetParam=0.0, standardization=False)
            model = lr.fit(vec)
            coef = model.coefficientMatrix.toArray()
            weight = (coef ** 2).sum(axis=0)
            remaining.pop(int(np.argmin(weight)))
    finally:
        data.unpersist()
    return remaining


# ----------------------------------------------------------------- reduction

def as_array(cols: Sequence[str]) -> Column:
    """All feature columns as one array<double> column.  A single array
    keeps plans small when there are many features (one null predicate
    instead of one per column)."""
    return F.array(*[col(c).cast("double") for c in cols])


def complete(arr: Column) -> Column:
    """True when no element is null or NaN."""
    return F.forall(arr, lambda x: x.isNotNull() & ~F.isnan(x))


def covariance_of(vectors: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, sample covariance, n) of a vector column, aggregated on the
    executors (``Summarizer`` and ``Correlation`` tree-aggregate); only d and
    d x d numbers come back."""
    summary = vectors.select(Summarizer.metrics("mean", "variance", "count")
                             .summary(col(vec)).alias("s")).first()["s"]
    mean = summary["mean"].toArray()
    var = summary["variance"].toArray()
    n = int(summary["count"])
    corr = Correlation.corr(vectors, vec).first()[0].toArray()
    std = np.sqrt(np.maximum(var, 0.0))
    cov = np.nan_to_num(corr) * np.outer(std, std)
    np.fill_diagonal(cov, var)
    return mean, cov, n


def covariance(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Covariance of the rows without a missing value in ``cols``."""
    arr = df.select(as_array(cols).alias("_ts_a")).where(complete(F.col("_ts_a")))
    return covariance_of(arr.select(array_to_vector("_ts_a").alias("_ts_v")), "_ts_v")


def _flip_signs(components: np.ndarray) -> np.ndarray:
    """Largest-magnitude loading of every component made positive."""
    out = components.copy()
    for r in range(out.shape[0]):
        if out[r, np.argmax(np.abs(out[r]))] < 0:
            out[r] = -out[r]
    return out


@dataclass(frozen=True)
class Projection:
    """Fitted linear projection ``(x - centre) @ weights.T``, evaluated as
    array expressions (``zip_with`` + ``aggregate``), not per-row Python."""

    cols: tuple[str, ...]
    centre: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    names: tuple[str, ...]

    def columns(self) -> list[Column]:
        centred = F.zip_with(as_array(self.cols), F.array(*[F.lit(float(m)) for m in self.centre]),
                             lambda x, m: x - m)
        out = []
        for name, w in zip(self.names, self.weights):
            terms = F.zip_with(centred, F.array(*[F.lit(float(v)) for v in w]),
                               lambda x, v: x * v)
            out.append(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t).alias(name))
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*keep, *self.columns())


def fit_pca(df: DataFrame, cols: Sequence[str], k: int = DEFAULT_COMPONENTS) -> Projection:
    """Centred PCA with ``min(k, p)`` components ``PC1..``."""
    mean, cov, _ = covariance(df, cols)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:min(k, len(cols))]
    comps = _flip_signs(vectors[:, order].T)
    return Projection(tuple(cols), tuple(mean), tuple(map(tuple, comps)),
                      tuple(f"PC{i + 1}" for i in range(len(order))))


def pca(df: DataFrame, target: str | None = None, cols: Sequence[str] | None = None,
        k: int = DEFAULT_COMPONENTS) -> DataFrame:
    cols = list(cols) if cols else numeric_columns(df, exclude=[target] if target else [])
    model = fit_pca(df, cols, k)
    keep = [target] if target else []
    return model.transform(df, keep)


def fit_lda(df: DataFrame, target: str, cols: Sequence[str], n_components: int = 1) -> Projection:
    """Linear discriminant directions (the SVD formulation of scikit-
    learn) from class sizes, class means and the within-class covariance.

    Class means are one ``groupBy``; the within-class covariance is the
    covariance of class-centred rows (means attached by a broadcast join of
    a table with one row per class).
    """
    data = (df.select(col(target), as_array(cols).alias("_ts_a"))
              .where(col(target).isNotNull() & complete(F.col("_ts_a"))))
    per_class = data.groupBy(col(target)).agg(
        F.count(F.lit(1)).alias("_n"),
        Summarizer.mean(array_to_vector("_ts_a")).alias("_m"))
    rows = per_class.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"column {target!r} has more than {MAX_CLASSES} values and can't be a class label")
    if len(rows) < 2:
        raise ValueError("LDA needs at least two classes")
    counts = np.array([r["_n"] for r in rows], dtype=float)
    means = np.array([r["_m"].toArray() for r in rows])
    n, g = counts.sum(), len(rows)
    priors = counts / n
    xbar = priors @ means
    tdt = df.schema[target].dataType.simpleString()
    small = df.sparkSession.createDataFrame(
        [(r[target], [float(v) for v in r["_m"].toArray()]) for r in rows],
        f"_ts_c {tdt}, _ts_m array<double>")
    centred = data.join(F.broadcast(small), col(target) == F.col("_ts_c")).select(
        array_to_vector(F.zip_with("_ts_a", "_ts_m", lambda a, b: a - b)).alias("_ts_v"))
    _, within_cov, _ = covariance_of(centred, "_ts_v")
    # Xc has zero mean, so its Gram matrix is (n-1) * sample covariance.
    gram = within_cov * (n - 1)
    std = np.sqrt(np.diag(gram) / n)
    std[std == 0] = 1.0
    fac = 1.0 / (n - g)
    inner = fac * gram / np.outer(std, std)
    s2, v = np.linalg.eigh(inner)
    order = np.argsort(s2)[::-1]
    s = np.sqrt(np.maximum(s2[order], 0.0))
    v = v[:, order]
    rank = int(np.sum(s > 1e-4))
    scalings = (v[:, :rank] / std[:, None]) / s[:rank]
    fac2 = 1.0 / (g - 1)
    between = (np.sqrt(n * priors * fac2) * (means - xbar).T).T @ scalings
    _, s_b, vt_b = np.linalg.svd(between, full_matrices=False)
    rank_b = int(np.sum(s_b > 1e-4 * s_b[0]))
    final = scalings @ vt_b.T[:, :rank_b]
    k = min(n_components, final.shape[1])
    comps = _flip_signs(final[:, :k].T)
    return Projection(tuple(cols), tuple(xbar), tuple(map(tuple, comps)),
                      tuple(f"LD{i + 1}" for i in range(k)))


def lda(df: DataFrame, target: str, cols: Sequence[str] | None = None,
        n_components: int = 1) -> DataFrame:
    cols = list(cols) if cols else numeric_columns(df, exclude=[target])
    return fit_lda(df, target, cols, n_components).transform(df, [target])


def array_columns(df: DataFrame, array_col: str, prefix: str = "f",
                  size: int | None = None) -> tuple[DataFrame, list[str]]:
    """Spread a fixed-size numeric array (an embedding) into columns."""
    if size is None:
        size = df.select(F.max(F.size(array_col))).first()[0] or 0
    names = [f"{prefix}{i}" for i in range(size)]
    arr = col(array_col)
    if str(df.schema[array_col].dataType).startswith("VectorUDT"):
        arr = vector_to_array(arr)
    out = df.select(*[c for c in df.columns if c != array_col],
                    *[arr[i].cast("double").alias(n) for i, n in enumerate(names)])
    return out, names
