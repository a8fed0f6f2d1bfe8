"""Outlier clipping, removal and transforms.

Statistics of all columns are computed in one aggregation job where the
semantics allow it; row removal is sequential as in the reference (each
column's fences are computed on the rows the previous columns kept), so it
costs one scan per column.  Those scans only read the columns involved.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import clip, col, nan_to_null, safe_sqrt
from tessera.functions.schema import numeric_columns
from tessera.functions.stats import collect_stats, quantiles

DETECTIONS = ("iqr", "zscore")
IQR_K = 1.5
Z_LIMIT = 3.0


def outlier_columns(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    """None means every numeric column (the target too), an empty list
    none; unknown names are skipped."""
    if cols is None:
        return numeric_columns(df)
    return [c for c in cols if c in df.columns]


def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = IQR_K,
               exact: bool = True) -> dict[str, tuple[float | None, float | None]]:
    """Q1 - k*IQR and Q3 + k*IQR for every column, one job."""
    qs = quantiles(df, cols, [0.25, 0.75], exact)
    out = {}
    for c in cols:
        q = qs[c]
        if not q or q[0] is None:
            out[c] = (None, None)
            continue
        iqr = q[1] - q[0]
        out[c] = (q[0] - k * iqr, q[1] + k * iqr)
    return out


def zscore_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    """(mean, sample std, min, max) per column, one job."""
    exprs = {}
    for i, c in enumerate(cols):
        x = nan_to_null(col(c).cast("double"))
        exprs.update({f"m{i}": F.avg(x), f"s{i}": F.stddev_samp(x),
                      f"lo{i}": F.min(x), f"hi{i}": F.max(x)})
    stats = collect_stats(df, exprs)
    return {c: (stats[f"m{i}"], stats[f"s{i}"], stats[f"lo{i}"], stats[f"hi{i}"])
            for i, c in enumerate(cols)}


def _abs_z(c: str, mean: float | None, std: float | None):
    x = nan_to_null(col(c).cast("double"))
    if mean is None or std is None or std == 0:
        return None
    return F.abs((x - F.lit(mean)) / F.lit(std))


def zscore_clip_bounds(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    """Reference semantics: lower = column min, upper = largest value whose
    |z| < 3 (sample std), or the max when no value qualifies."""
    moments = zscore_moments(df, cols)
    exprs = {}
    for i, c in enumerate(cols):
        z = _abs_z(c, moments[c][0], moments[c][1])
        if z is not None:
            exprs[f"u{i}"] = F.max(F.when(z < Z_LIMIT, col(c).cast("double")))
    stats = collect_stats(df, exprs)
    out = {}
    for i, c in enumerate(cols):
        _, _, lo, hi = moments[c]
        upper = stats.get(f"u{i}")
        out[c] = (lo, upper if upper is not None else hi)
    return out


@dataclass(frozen=True)
class Bounds:
    """Fitted clip bounds per column."""

    bounds: dict[str, tuple[float | None, float | None]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: clip(c, lo, hi) for c, (lo, hi) in self.bounds.items()})


def fit_clip(df: DataFrame, cols: Sequence[str] | None = None, detection: str = "iqr",
             exact: bool = True) -> Bounds:
    cols = outlier_columns(df, cols)
    if detection == "iqr":
        return Bounds(iqr_fences(df, cols, exact=exact))
    if detection == "zscore":
        return Bounds(zscore_clip_bounds(df, cols))
    raise ValueError(f"unknown outlier detection: {detection}")


def clip_outliers(df: DataFrame, cols: Sequence[str] | None = None, detection: str = "iqr",
                  exact: bool = True) -> DataFrame:
    """O1/O2: clip every column to its fences.  Clipping never drops rows,
    so the bounds of all columns come from one job."""
    return fit_clip(df, cols, detection, exact).transform(df)


def remove_outliers(df: DataFrame, cols: Sequence[str] | None = None, detection: str = "iqr",
                    sequential: bool = True, exact: bool = True) -> DataFrame:
    """Keep rows inside the fences (a null is outside).

    ``sequential=True`` is the reference: column by column, each on the rows
    kept so far.  ``sequential=False`` computes all fences on the input in one
    job and filters once.
    """
    if detection not in DETECTIONS:
        raise ValueError(f"unknown outlier detection: {detection}")
    cols = outlier_columns(df, cols)
    if not sequential:
        return df.where(_keep_all(df, cols, detection, exact))
    for c in cols:
        df = df.where(_keep_all(df, [c], detection, exact))
    return df


def _keep_all(df: DataFrame, cols: Sequence[str], detection: str, exact: bool):
    cond = F.lit(True)
    if detection == "iqr":
        for c, (lo, hi) in iqr_fences(df, cols, exact=exact).items():
            x = nan_to_null(col(c).cast("double"))
            keep = F.lit(False) if lo is None else x.between(F.lit(lo), F.lit(hi))
            cond = cond & F.coalesce(keep, F.lit(False))
    else:
        for c, (mean, std, _, _) in zscore_moments(df, cols).items():
            z = _abs_z(c, mean, std)
            keep = F.lit(False) if z is None else (z < Z_LIMIT)
            cond = cond & F.coalesce(keep, F.lit(False))
    return cond


def transform_outliers(df: DataFrame, cols: Sequence[str] | None = None,
                       method: str = "log") -> DataFrame:
    """log1p, sqrt or Box-Cox of each column.  Values outside the
    domain become null (never NaN or infinity)."""
    from tessera.operators.skew import boxcox_columns

    cols = outlier_columns(df, cols)
    if method == "log":
        return df.withColumns({c: F.log1p(nan_to_null(col(c).cast("double"))) for c in cols})
    if method == "sqrt":
        return df.withColumns({c: safe_sqrt(nan_to_null(col(c).cast("double"))) for c in cols})
    if method == "boxcox":
        return boxcox_columns(df, cols)
    raise ValueError(f"unknown outlier transform: {method}")


def handle_outliers(df: DataFrame, method: str | None, cols: Sequence[str] | None = None,
                    detection: str = "iqr", transform: str = "log",
                    exact: bool = True) -> DataFrame:
    """Outlier step of the reference pipeline."""
    if not method or method == "none":
        return df
    if method == "clip":
        return clip_outliers(df, cols, detection, exact)
    if method == "remove":
        return remove_outliers(df, cols, detection, exact=exact)
    if method == "transform":
        return transform_outliers(df, cols, transform)
    raise ValueError(f"unknown outlier method: {method}")
