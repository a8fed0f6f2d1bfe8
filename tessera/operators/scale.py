"""Column scaling (F1-F4): one aggregation job fits every column, the
transform is a plain projection (so it also applies to streams)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import col, nan_to_null
from tessera.functions.schema import numeric_columns
from tessera.functions.stats import collect_stats, quantiles

METHODS = ("standard", "minmax", "robust", "normalize")


def scaling_columns(df: DataFrame, cols: Sequence[str] | None, target: str | None = None,
                    exclude_suffix: str | None = None) -> list[str]:
    """None means every numeric column, an empty list none; the target is
    always excluded."""
    chosen = numeric_columns(df) if cols is None else [c for c in cols if c in df.columns]
    if exclude_suffix:
        chosen = [c for c in chosen if not c.endswith(exclude_suffix)]
    return [c for c in chosen if c != target]


@dataclass(frozen=True)
class Scaler:
    """Fitted (centre, scale) per column; ``constant`` columns map to 0."""

    method: str
    params: dict[str, tuple[float | None, float | None]]

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (centre, scale) in self.params.items():
            x = nan_to_null(col(c).cast("double"))
            if self.method == "normalize" and (scale is None or scale <= 0):
                out[c] = F.lit(0.0)  # the reference returns a scalar 0 for the column
            elif centre is None:
                out[c] = x
            else:
                out[c] = (x - F.lit(centre)) / F.lit(scale)
        return df.withColumns(out)


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "standard",
               exact: bool = True) -> Scaler:
    cols = list(cols)
    exprs = {}
    for i, c in enumerate(cols):
        x = nan_to_null(col(c).cast("double"))
        if method == "standard":
            exprs.update({f"a{i}": F.avg(x), f"b{i}": F.stddev_pop(x)})
        elif method in ("minmax", "normalize"):
            exprs.update({f"a{i}": F.min(x), f"b{i}": F.max(x)})
        elif method != "robust":
            raise ValueError(f"unknown scaler: {method}")
    stats = collect_stats(df, exprs)
    if method == "robust":
        qs = quantiles(df, cols, [0.25, 0.5, 0.75], exact)
        stats.update({f"q{i}": qs[c] for i, c in enumerate(cols)})
    params = {}
    for i, c in enumerate(cols):
        if method == "standard":
            mean, std = stats[f"a{i}"], stats[f"b{i}"]
            params[c] = (mean, std if std else 1.0)
        elif method in ("minmax", "normalize"):
            lo, hi = stats[f"a{i}"], stats[f"b{i}"]
            rng = (hi - lo) if lo is not None else None
            if method == "minmax":
                params[c] = (lo, rng if rng else 1.0)
            else:
                params[c] = (lo, rng)
        else:
            q = stats[f"q{i}"]
            if not q or q[0] is None:
                params[c] = (None, None)
            else:
                iqr = q[2] - q[0]
                params[c] = (q[1], iqr if iqr else 1.0)
    return Scaler(method, params)


def scale(df: DataFrame, method: str | None, cols: Sequence[str] | None = None,
          target: str | None = None, exact: bool = True) -> DataFrame:
    """Scaling step of the reference pipeline: standard (population std),
    minmax, robust (median / IQR) or normalize (min-max, constant -> 0)."""
    if not method or method == "none":
        return df
    chosen = scaling_columns(df, cols, target)
    if not chosen:
        return df
    return fit_scaler(df, chosen, method, exact).transform(df)
