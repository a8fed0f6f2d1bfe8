"""Shapiro-Francia test of normality from order statistics (A5).

W' is the squared correlation of the values with their normal scores, the
normal quantiles of (rank - 3/8) / (n + 1/4); equal values share their
mid-rank.  Values are counted first, ranks are running totals of the counts
from one distributed sort of all columns, and W' follows from weighted sums, so
no task holds a column.  The p-value is Royston's normal approximation of
ln(1 - W') (1993; fitted for 5 to 5,000 rows, extrapolated beyond).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import col, nan_to_null
from tessera.functions.schema import numeric_columns
from tessera.plans.ordering import with_running_totals

# Acklam's rational approximation of the normal quantile
# (relative error below 1.2e-9), for the center and the tails.
CENTER = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239),
          (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
        (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))
TAIL_BELOW = 0.02425
# Chebyshev coefficients of the complementary error function.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def polynomial(x: str, coefficients: Sequence[float]) -> str:
    """SQL of a polynomial, highest power first."""
    out = f"{coefficients[0]!r}e0"  # with an exponent it is no decimal
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}e0)"
    return out


def normal_quantile_sql(p: str) -> str:
    """SQL of the normal quantile of a probability between 0 and 1."""
    def tail(q: str) -> str:
        t = f"sqrt(-2.0e0 * ln({q}))"
        return f"({polynomial(t, TAIL[0])} / {polynomial(t, TAIL[1])})"

    r = f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    center = f"(({p} - 0.5e0) * {polynomial(r, CENTER[0])} / {polynomial(r, CENTER[1])})"
    return f"(CASE WHEN {p} < {TAIL_BELOW}e0 THEN {tail(p)} WHEN {p} > {1 - TAIL_BELOW}e0 THEN -{tail(f'(1.0e0 - {p})')} ELSE {center} END)"


def upper_tail_sql(z: str) -> str:
    """SQL of the probability that a normal value exceeds ``z``."""
    x = f"(abs({z}) / sqrt(2.0e0))"
    t = f"(1.0e0 / (1.0e0 + 0.5e0 * {x}))"
    below = f"({t} * exp(-{x} * {x} + {polynomial(t, ERFC[::-1])}))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5e0 * {below} ELSE 1.0e0 - 0.5e0 * {below} END)"


def p_value_sql(w: str, n: str) -> str:
    """SQL of Royston's p-value."""
    u, v = f"ln(CAST({n} AS DOUBLE))", f"ln(ln(CAST({n} AS DOUBLE)))"
    mean, spread = f"(-1.2725e0 + 1.0521e0 * ({v} - {u}))", f"(1.0308e0 - 0.26758e0 * ({v} + 2.0e0 / {u}))"
    return upper_tail_sql(f"((ln(1.0e0 - {w}) - {mean}) / {spread})")


def normality(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``column_name``, ``n``, ``w`` and ``p`` of each numeric column; nulls and
    NaN are left out; null below five values or without two different ones,
    and ``p`` is 1 where W' is 1."""
    cols = list(cols) if cols else numeric_columns(df)

    def value(c: str) -> Column:
        return nan_to_null(col(c).cast("double"))

    means = df.agg(*(F.avg(value(c)).alias(f"m{i}") for i, c in enumerate(cols))).first()
    # Values are taken from the mean, so that sums of squares keep their digits.
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("_c"), (value(c) - F.lit(means[i] or 0.0)).alias("_v")) for i, c in enumerate(cols)))).alias("_p")
    counted = (df.select(pairs).select("_p._c", "_p._v").where("_v IS NOT NULL").groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n")))
    ranked = with_running_totals(counted, ["_c", "_v"], {"_n": "_before"}, reset="_c")
    sizes = ranked.groupBy("_c").agg(F.sum("_n").alias("_size"))
    p = "((_before + (_n + 1) / 2.0e0 - 0.375e0) / (_size + 0.25e0))"
    scored = ranked.join(F.broadcast(sizes), "_c").withColumn("_m", F.expr(normal_quantile_sql(p)))
    sums = scored.groupBy("_c").agg(F.expr("max(_size)").alias("n"), *(F.expr(f"sum(_n * {e})").alias(a) for a, e in (
        ("m", "_m"), ("x", "_v"), ("mm", "_m * _m"), ("xx", "_v * _v"), ("mx", "_m * _v"))))
    w = "least(1.0e0, pow(mx - m * x / n, 2) / ((mm - m * m / n) * (xx - x * x / n)))"
    tested = sums.withColumn("w", F.expr(f"CASE WHEN n >= 5 AND xx - x * x / n > 0 THEN {w} END"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "_c int, column_name string")
    p_value = F.expr(f"CASE WHEN w < 1 THEN {p_value_sql('w', 'n')} WHEN w = 1 THEN 1.0e0 END")
    return (F.broadcast(names).join(tested, "_c", "left")
            .select("column_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "w", p_value.alias("p")))
