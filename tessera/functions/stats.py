"""Fused per-column statistics: many columns, one aggregation job."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import col, nan_to_null


def quantile_expr(c: str | Column, probs: Sequence[float], accuracy: int = 100000) -> Column:
    """Approximate quantiles as one array column (``percentile_approx``:
    bounded memory, rank error about n/accuracy)."""
    return F.percentile_approx(nan_to_null(col(c).cast("double")), [float(p) for p in probs], accuracy)


def collect_stats(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Evaluate named aggregate expressions in a single ``agg`` job."""
    if not exprs:
        return {}
    row = df.agg(*[e.alias(k) for k, e in exprs.items()]).collect()[0]
    return row.asDict()


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              exact: bool = True, accuracy: int = 100000) -> dict[str, list]:
    """Linear-interpolated quantiles of several columns: {col: [q_p ...]}.

    ``exact=True`` is one method for any number of rows and distinct values: a
    radix selection.  Values are counted by cells of a sixteenth of an octave,
    then the cell that holds a wanted rank by 4096 equal parts of it, and so
    on until a cell holds one value.  Each round is a scan of these columns
    with map-side counts; nothing is sorted and no row moves.  A double has so
    few bits that six rounds are the most, and two or three are common.  ``df``
    is read in each round and must give the same rows.  ``exact=False`` is one
    ``percentile_approx`` aggregation.
    """
    cols = list(cols)
    if not cols:
        return {}
    if not exact:
        stats = collect_stats(df, {f"q{i}": quantile_expr(c, probs, accuracy) for i, c in enumerate(cols)})
        return {c: (list(stats[f"q{i}"]) if stats[f"q{i}"] is not None else [None] * len(probs))
                for i, c in enumerate(cols)}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("_c"), nan_to_null(col(c).cast("double")).alias("_v"))
        for i, c in enumerate(cols)])).alias("_p")
    values = df.select(pairs).select("_p._c", "_p._v").where(F.col("_v").isNotNull())

    first = _cells(values.select(F.col("_c").alias("_g"), _octave_cell("_v").alias("_k"), "_v"))
    totals = {i: sum(n for _, n, _, _ in cells) for i, cells in first.items()}
    plan: dict[tuple[int, int], tuple[int, int, float]] = {}  # column, place of the quantile: ranks, part
    for i, total in totals.items():
        for j, p in enumerate(probs):
            h = (total - 1) * float(p)
            low = int(math.floor(h))
            plan[i, j] = (low, min(low + 1, total - 1), h - low)
    value: dict[tuple[int, int], float] = {}
    inside = _choose(first, {i: {(i, r): r for k, (low, high, _) in plan.items() if k[0] == i for r in (low, high)}
                             for i in totals}, value)
    while inside:
        group = {interval: g for g, interval in enumerate(inside)}
        table = df.sparkSession.createDataFrame([(g, *interval) for interval, g in group.items()],
                                                "_g int, _of int, _lo double, _hi double")
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        hits = (values.join(F.broadcast(table), (F.col("_c") == F.col("_of")) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
                .select("_g", F.floor(share * CELLS).alias("_k"), "_v"))
        column = {g: interval[0] for interval, g in group.items()}
        inside = _choose(_cells(hits), {g: inside[interval] for interval, g in group.items()}, value, column)
    out = {}
    for i, c in enumerate(cols):
        out[c] = []
        for j in range(len(probs)):
            if (i, j) not in plan:
                out[c].append(None)
                continue
            low, high, part = plan[i, j]
            a, b = value[i, low], value[i, high]
            out[c].append(a + (b - a) * part if part and a != b else a)
    return out


# Parts of an interval that one round counts.
CELLS = 4096


def _octave_cell(name: str) -> Column:
    """The number of a value's sixteenth of an octave, never falling as values
    rise: logarithms rise with their argument, also when rounded."""
    v = F.col(name)
    octaves = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * 16) + 20_000
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, octaves).otherwise(-octaves)


def _cells(rows: DataFrame) -> dict[int, list[tuple[int, int, float, float]]]:
    """{group: [(cell, rows, least value, greatest value)]} in ascending order:
    at most 4,097 cells of an interval, and of a whole column those of a
    double's range."""
    out: dict[int, list] = {}
    for g, k, n, low, high in (rows.groupBy("_g", "_k").agg(F.count(F.lit(1)), F.min("_v"), F.max("_v")).collect()):
        out.setdefault(g, []).append((k, n, low + 0.0, high + 0.0))
    return {g: sorted(cells) for g, cells in out.items()}


def _choose(cells: dict, wanted: dict, value: dict, column: dict | None = None) -> dict:
    """Settle each wanted rank (``{group: {name: rank in the group}}``) that is
    the first or last of its cell, or lies in a cell of one value, in
    ``value``; return the others as ``{(column, least, greatest): {name: rank
    there}}``."""
    inside: dict = {}
    for g, names in wanted.items():
        before, todo = 0, sorted(names.items(), key=lambda x: x[1])
        for _, n, low, high in cells[g]:
            while todo and todo[0][1] < before + n:
                name, rank = todo.pop(0)
                if low == high or rank == before:
                    value[name] = low
                elif rank == before + n - 1:
                    value[name] = high
                else:
                    inside.setdefault((column[g] if column else g, low, high), {})[name] = rank - before
            before += n
    return inside
