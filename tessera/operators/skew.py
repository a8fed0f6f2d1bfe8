"""Skewness transforms (K1-K5), including maximum-likelihood Box-Cox and
Yeo-Johnson.

The power-transform lambda maximises the profile log-likelihood.  Each search
round evaluates a whole grid of lambdas for every column in ONE aggregation
(``var_pop`` of each candidate transform), then moves or narrows the grid; the
final estimate is the vertex of a parabola through the best three points.
Only the per-lambda variances reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import boxcox, col, nan_to_null, safe_sqrt, yeojohnson
from tessera.functions.schema import numeric_columns
from tessera.functions.stats import collect_stats

METHODS = ("log", "sqrt", "boxcox", "yeojohnson")


def skew_columns(df: DataFrame, cols: Sequence[str] | None, target: str | None = None) -> list[str]:
    """K5: None means every numeric column except the target, an empty list
    none."""
    if cols is None:
        return numeric_columns(df, exclude=[target] if target else [])
    return [c for c in cols if c in df.columns]


def _x(c: str) -> Column:
    return nan_to_null(col(c).cast("double"))


def column_minimums(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    stats = collect_stats(df, {f"m{i}": F.min(_x(c)) for i, c in enumerate(cols)})
    return {c: stats[f"m{i}"] for i, c in enumerate(cols)}


def log_shifted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K1: ln(1 + (x - min + 1))."""
    mins = column_minimums(df, cols)
    return df.withColumns({c: F.log1p(_x(c) - F.lit(mins[c]) + F.lit(1.0))
                           for c in cols if mins[c] is not None})


def sqrt_shifted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K2: sqrt(x - min)."""
    mins = column_minimums(df, cols)
    return df.withColumns({c: safe_sqrt(_x(c) - F.lit(mins[c]))
                           for c in cols if mins[c] is not None})


@dataclass(frozen=True)
class PowerTransform:
    """Fitted power transform: per column (shift, lambda)."""

    kind: str
    params: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        fn = boxcox if self.kind == "boxcox" else yeojohnson
        out = {}
        for c, (shift, lam) in self.params.items():
            x = _x(c) + F.lit(shift) if shift else _x(c)
            out[c] = F.when(_x(c).isNull(), F.lit(None).cast("double")).otherwise(fn(x, lam))
        return df.withColumns(out)


# How far from the first bracket a maximum is looked for.
MAX_LAMBDA = 1e4
_POINTS = 21


def _spread(kind: str, mode: str, x: Column, mean: Column, lam: Column) -> Column:
    """A value whose population variance V gives the profile log-likelihood
    of lambda: -n/2 ln V, plus (lambda - 1) times the sum of log terms where
    the data have both signs.

    Data of one sign are taken relative to their geometric mean, which takes
    (lambda - 1) into V: no power of the data's own size is formed, so that
    nothing cancels at large |lambda|.
    """
    def power(u: Column, k: Column) -> Column:
        return F.when(F.abs(k) < 1e-12, u).otherwise(F.expm1(k * u) / k)

    if mode == "positive":
        log = F.ln(x) if kind == "boxcox" else F.log1p(x)
        return power(log - mean, lam)
    if mode == "negative":
        return power(F.log1p(-x) - mean, F.lit(2.0) - lam)
    return F.when(x >= 0, power(F.log1p(x), lam)).otherwise(-power(F.log1p(-x), F.lit(2.0) - lam))


def fit_power(df: DataFrame, cols: Sequence[str], kind: str = "boxcox") -> PowerTransform:
    """Maximum-likelihood lambda per column (Box-Cox on positive data after a
    shift when the minimum is <= 0, as in the reference).

    A bracket of lambdas moves outward with growing steps until the maximum
    lies inside, and is then refined.  A column without a maximum (fewer than
    two distinct values keep lambda 1) raises ValueError.
    """
    if kind not in ("boxcox", "yeojohnson"):
        raise ValueError(f"unknown power transform: {kind}")
    cols = list(cols)
    low = column_minimums(df, cols)
    shifts = {c: 1.0 - low[c] if kind == "boxcox" and low[c] is not None and low[c] <= 0 else 0.0 for c in cols}
    xs = {c: (_x(c) + F.lit(shifts[c])) if shifts[c] else _x(c) for c in cols}
    terms = {}
    for i, c in enumerate(cols):
        log = F.ln(xs[c]) if kind == "boxcox" else F.signum(xs[c]) * F.log1p(F.abs(xs[c]))
        terms |= {f"n{i}": F.count(xs[c]), f"g{i}": F.sum(log), f"lo{i}": F.min(xs[c]), f"hi{i}": F.max(xs[c])}
    stats = collect_stats(df, terms)
    mode, sign = {}, {}
    for i, c in enumerate(cols):
        if not stats[f"n{i}"] or stats[f"lo{i}"] == stats[f"hi{i}"]:
            continue
        mode[c] = ("positive" if kind == "boxcox" or stats[f"lo{i}"] >= 0
                   else "negative" if stats[f"hi{i}"] <= 0 else "both")
        sign[c] = -1.0 if mode[c] == "negative" else 1.0
    live = list(mode)
    where = {c: cols.index(c) for c in live}

    def evaluate(grids: dict[str, list[float]]) -> dict[str, list[float]]:
        """Log-likelihoods on every (column, lambda) of the grids in one job.

        The grid is data, not code: each row is paired with every (column,
        lambda) and ``var_pop`` is grouped by the pair, so one small
        expression is compiled whatever the grid size, and map-side partial
        aggregation keeps the shuffle at columns x grid points per partition.
        """
        out: dict[str, list[float]] = {}
        for kind_of in ("positive", "negative", "both"):
            chosen = [c for c in grids if mode[c] == kind_of]
            if not chosen:
                continue
            items = [F.struct(F.lit(i).alias("c"), F.lit(j).alias("j"), F.lit(float(lam)).alias("lam"),
                              F.lit(sign[c] * stats[f"g{where[c]}"] / stats[f"n{where[c]}"]).alias("mean"))
                     for i, c in enumerate(chosen) for j, lam in enumerate(grids[c])]
            pairs = df.select(F.array(*[xs[c] for c in chosen]).alias("_xs"), F.explode(F.array(*items)).alias("_p"))
            x = F.element_at(F.col("_xs"), F.col("_p.c") + 1)
            value = _spread(kind, kind_of, x, F.col("_p.mean"), F.col("_p.lam"))
            rows = (pairs.select("_p.c", "_p.j", value.alias("t")).groupBy("c", "j")
                    .agg(F.var_pop("t").alias("v")).collect())
            var = {(r["c"], r["j"]): r["v"] for r in rows}
            for i, c in enumerate(chosen):
                n, g = stats[f"n{where[c]}"], stats[f"g{where[c]}"]
                out[c] = []
                for j, lam in enumerate(grids[c]):
                    v = var.get((i, j))
                    good = v is not None and 0 < v < float("inf")
                    extra = (lam - 1.0) * g if kind_of == "both" else 0.0
                    out[c].append(extra - n / 2.0 * math.log(v) if good else float("-inf"))
        return out

    half = _POINTS // 2
    step, centre, best = ({c: v for c in live} for v in (4.0 / (_POINTS - 1), 0.0, 1.0))
    last: dict[str, tuple[list[float], list[float]]] = {}
    todo = list(live)
    while todo:  # from [-2, 2], where scipy starts too
        grids = {c: [centre[c] + (j - half) * step[c] for j in range(_POINTS)] for c in todo}
        values, moved = evaluate(grids), []
        for c in todo:
            k = max(range(_POINTS), key=lambda j: values[c][j])
            best[c], last[c] = grids[c][k], (grids[c], values[c])
            if k in (0, _POINTS - 1):
                if abs(best[c]) > MAX_LAMBDA:
                    raise ValueError(f"the likelihood of column {c!r} has no maximum up to lambda {best[c]:g}")
                step[c] *= 2.0
                centre[c] = best[c] + (half - 1) * step[c] * (1 if k else -1)
                moved.append(c)
        todo = moved
    while todo := [c for c in live if step[c] > 1e-4 * max(1.0, abs(best[c]))]:
        grids = {}
        for c in todo:  # one step either side, ten times finer
            span = step[c]
            step[c] = 2.0 * span / (_POINTS - 1)
            grids[c] = [best[c] - span + j * step[c] for j in range(_POINTS)]
        for c, values in evaluate(grids).items():
            k = max(range(_POINTS), key=lambda j: values[j])
            best[c], last[c] = grids[c][k], (grids[c], values)
    return PowerTransform(kind, {c: (shifts[c], _parabola_vertex(*last[c], best[c]) if c in last else 1.0) for c in cols})


def _parabola_vertex(grid: list[float], vals: list[float], fallback: float) -> float:
    k = max(range(len(vals)), key=lambda j: vals[j])
    if k == 0 or k == len(vals) - 1:
        return fallback
    x0, x1, x2 = grid[k - 1], grid[k], grid[k + 1]
    y0, y1, y2 = vals[k - 1], vals[k], vals[k + 1]
    denom = (x0 - x1) * (x0 - x2) * (x1 - x2)
    a = (x2 * (y1 - y0) + x1 * (y0 - y2) + x0 * (y2 - y1)) / denom
    b = (x2 * x2 * (y0 - y1) + x1 * x1 * (y2 - y0) + x0 * x0 * (y1 - y2)) / denom
    if a >= 0:
        return fallback
    vertex = -b / (2 * a)
    return vertex if x0 <= vertex <= x2 else fallback


def boxcox_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K3: Box-Cox with MLE lambda on the non-null values; nulls stay null."""
    return fit_power(df, cols, "boxcox").transform(df)


def yeojohnson_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K4: Yeo-Johnson with MLE lambda on the non-null values."""
    return fit_power(df, cols, "yeojohnson").transform(df)


def handle_skewness(df: DataFrame, method: str | None, cols: Sequence[str] | None = None,
                    target: str | None = None) -> DataFrame:
    """Skewness step of the reference pipeline."""
    if not method or method == "none":
        return df
    cols = skew_columns(df, cols, target)
    if not cols:
        return df
    if method == "log":
        return log_shifted(df, cols)
    if method == "sqrt":
        return sqrt_shifted(df, cols)
    if method == "boxcox":
        return boxcox_columns(df, cols)
    if method == "yeojohnson":
        return yeojohnson_columns(df, cols)
    raise ValueError(f"unknown skewness method: {method}")
