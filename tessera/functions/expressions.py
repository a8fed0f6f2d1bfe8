"""Column expressions shared by the operators (all JVM-side, no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The literal tokens the reference turns into missing values
# before any preprocessing (exact, case-sensitive match, no trimming).
MISSING_TOKENS = ["", " ", "null", "N/A", "na", "-", "unknown", "NaN"]


def quoted(name: str) -> str:
    """A column name as Spark SQL reads it literally (dots and backticks)."""
    return "`" + name.replace("`", "``") + "`"


def col(c: str | Column) -> Column:
    """The column of that very name; a dot in it is no struct access."""
    return F.col(quoted(c)) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN becomes null; null is the only missing value in this library."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def token_to_null(c: str | Column, tokens=MISSING_TOKENS) -> Column:
    c = col(c)
    return F.when(c.isin(*tokens), F.lit(None)).otherwise(c)


def clip(c: str | Column, lower: float | None, upper: float | None) -> Column:
    """Clip to [lower, upper]; a null stays null (greatest/least skip nulls)."""
    c = col(c)
    out = c.cast("double")
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(out)


def safe_sqrt(c: Column) -> Column:
    """sqrt with negatives mapped to null (Spark gives NaN)."""
    return F.when(c >= 0, F.sqrt(c))


def boxcox(c: Column, lam: float) -> Column:
    """Box-Cox transform for positive x: (x^l - 1)/l, or ln x at l = 0."""
    c = c.cast("double")
    if abs(lam) < 1e-12:
        return F.ln(c)
    return F.expm1(F.lit(lam) * F.ln(c)) / F.lit(lam)


def yeojohnson(c: Column, lam: float) -> Column:
    """Yeo-Johnson transform, defined for any sign."""
    c = c.cast("double")
    if abs(lam) < 1e-12:
        pos = F.log1p(c)
    else:
        pos = F.expm1(F.lit(lam) * F.log1p(c)) / F.lit(lam)
    if abs(lam - 2.0) < 1e-12:
        neg = -F.log1p(-c)
    else:
        neg = -F.expm1(F.lit(2.0 - lam) * F.log1p(-c)) / F.lit(2.0 - lam)
    return F.when(c.isNull(), F.lit(None).cast("double")).when(c >= 0, pos).otherwise(neg)


def adjusted_skewness(g1: float | None, n: int) -> float | None:
    """Bias-adjusted sample skewness G1 from the population value g1."""
    if g1 is None or n < 3 or (isinstance(g1, float) and math.isnan(g1)):
        return None
    return g1 * math.sqrt(n * (n - 1)) / (n - 2)


def adjusted_kurtosis(g2: float | None, n: int) -> float | None:
    """Bias-adjusted excess kurtosis G2 from the population excess g2."""
    if g2 is None or n < 4 or (isinstance(g2, float) and math.isnan(g2)):
        return None
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def adjusted_skewness_col(g1: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis_col(g2: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def jarque_bera_pvalue_col(g1: Column, g2: Column, n: Column) -> Column:
    """p-value of the Jarque-Bera test (chi-square, 2 dof: exp(-JB/2))."""
    n = n.cast("double")
    jb = n / 6.0 * (g1 * g1 + g2 * g2 / 4.0)
    return F.when(n > 1, F.exp(-jb / 2.0))
