"""Missing values, column dropping, de-duplication, head and shape."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrow import arrow_schema, map_arrow
from tessera.functions.expressions import MISSING_TOKENS, col, nan_to_null
from tessera.functions.schema import FLOATING_TYPES, is_numeric, select_columns
from tessera.functions.stats import collect_stats, quantiles
from tessera.plans import ordering

# Rows of a sorted partition, and rows whose gaps are filled at once.
SORT_ROWS, CHUNK_ROWS = 1 << 18, 1 << 14
STRATEGIES = ("mean", "median", "most_frequent", "drop", "interpolate")


def standardize_missing(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """The literal missing tokens in string columns, and NaN in float
    columns, become null.  Other columns are untouched."""
    exprs = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)
        elif isinstance(f.dataType, FLOATING_TYPES):
            c = nan_to_null(c)
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def drop_columns(df: DataFrame, cols: Sequence[str] | None) -> DataFrame:
    """Drop the named columns; unknown names are ignored."""
    present = [c for c in (cols or []) if c in df.columns]
    return df.drop(*present) if present else df


def columns_with_nulls(df: DataFrame, cols: Sequence[str]) -> list[str]:
    if not cols:
        return []
    stats = collect_stats(df, {f"n{i}": F.max(col(c).isNull().cast("int"))
                               for i, c in enumerate(cols)})
    return [c for i, c in enumerate(cols) if stats[f"n{i}"] == 1]


def add_missing_indicators(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``{c}_missing`` (0/1) for each listed column that has a null."""
    flagged = columns_with_nulls(df, cols)
    if not flagged:
        return df
    return df.withColumns({f"{c}_missing": col(c).isNull().cast("int") for c in flagged})


@dataclass(frozen=True)
class Imputation:
    """Fitted fill values, reusable on other data (for example a test split)."""

    values: dict[str, object] = field(default_factory=dict)
    to_double: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {}
        for c in self.to_double:
            exprs[c] = col(c).cast("double")
        for c, v in self.values.items():
            base = exprs.get(c, col(c))
            if v is None:
                exprs[c] = base
            else:
                dtype = df.schema[c].dataType if c not in self.to_double else T.DoubleType()
                exprs[c] = F.coalesce(base, F.lit(v).cast(dtype))
        return df.withColumns(exprs) if exprs else df


def most_frequent(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column; ties go to the smallest value.

    Values are counted by a distributed ``groupBy`` with map-side partial
    aggregation (a hot value does not land in one task), then the top value
    per column is picked by a second small aggregation.
    """
    out: dict[str, object] = {}
    for kind, cast in (("num", "double"), ("str", "string")):
        group = [c for c in cols if (is_numeric(df.schema[c].dataType) if kind == "num"
                                     else not is_numeric(df.schema[c].dataType))]
        if not group:
            continue
        pairs = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), col(c).cast(cast).alias("value"))
            for c in group])).alias("p")
        counts = (df.select(pairs).select("p.column", "p.value")
                    .where(F.col("value").isNotNull())
                    .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
        best = counts.groupBy("column").agg(
            F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))
            .alias("best"))
        for r in best.select("column", "best.value").collect():
            out[r[0]] = r[1]
    return {c: out.get(c) for c in cols}


def fit_imputer(df: DataFrame, strategy: str, cols: Sequence[str] | None = None,
                exact: bool = True) -> Imputation:
    """Fill values for ``mean``, ``median`` (numeric columns only) or
    ``most_frequent`` (numeric and categorical)."""
    num = select_columns(df, cols, "numeric")
    if strategy in ("mean", "median"):
        if strategy == "mean":
            exprs = {f"v{i}": F.avg(nan_to_null(col(c).cast("double"))) for i, c in enumerate(num)}
            stats = collect_stats(df, exprs)
            values = {c: stats[f"v{i}"] for i, c in enumerate(num)}
        else:
            medians = quantiles(df, num, [0.5], exact)
            values = {c: medians[c][0] for c in num}
        return Imputation(values, tuple(num))
    if strategy == "most_frequent":
        cat = _categorical_for(df, cols)
        return Imputation(most_frequent(df, num + cat), ())
    raise ValueError(f"unknown imputation strategy: {strategy}")


def _categorical_for(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    """Non-numeric columns (the reference's ``exclude=np.number``)."""
    if not cols:
        return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    return [c for c in cols if c in df.columns and not is_numeric(df.schema[c].dataType)]


def impute(df: DataFrame, strategy: str | None, cols: Sequence[str] | None = None,
           indicator: bool = False, order_by: Sequence[str] | None = None,
           exact: bool = True) -> DataFrame:
    """Missing-value step of the reference pipeline."""
    if not strategy or strategy == "none":
        return df
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown imputation strategy: {strategy}")
    num = select_columns(df, cols, "numeric")
    cat = _categorical_for(df, cols)
    if indicator and strategy == "mean":
        # Null flags and means from the same scan.
        stats = collect_stats(df, {
            **{f"n{i}": F.max(col(c).isNull().cast("int")) for i, c in enumerate(num + cat)},
            **{f"v{i}": F.avg(nan_to_null(col(c).cast("double"))) for i, c in enumerate(num)}})
        flagged = [c for i, c in enumerate(num + cat) if stats[f"n{i}"] == 1]
        fitted = Imputation({c: stats[f"v{i}"] for i, c in enumerate(num)}, tuple(num))
        df = df.withColumns({f"{c}_missing": col(c).isNull().cast("int") for c in flagged})
        return fitted.transform(df)
    if indicator:
        df = add_missing_indicators(df, num + cat)
    if strategy == "drop":
        subset = num + cat
        return df.dropna(subset=subset) if subset else df
    if strategy == "interpolate":
        if not order_by:
            raise ValueError("interpolate needs an explicit order_by (a unique key)")
        return interpolate(df, num, order_by)
    return fit_imputer(df, strategy, cols, exact).transform(df)


def fill_zero(df: DataFrame) -> DataFrame:
    """The older preprocessing variant, ``fillna(0)`` on every column."""
    out = df.fillna(0)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return out.fillna("0", subset=strings) if strings else out


def _fill_gaps(x: pa.Array, start: int, before: tuple | None, after: tuple | None) -> pa.Array:
    """Values of rows ``start`` .. with their inner gaps interpolated between
    the neighbours (position, value), those outside being given; trailing gaps
    repeat the last value, leading ones stay null."""
    known, at = x.is_valid().to_numpy(zero_copy_only=False), np.arange(len(x))
    v = x.fill_null(0.0).to_numpy(zero_copy_only=False)
    last = np.maximum.accumulate(np.where(known, at, -1))
    following = np.minimum.accumulate(np.where(known, at, len(x))[::-1])[::-1]
    inside, ahead = last >= 0, following < len(x)
    p0, v0 = before or (0, 0.0)
    p1, v1 = after or (0, 0.0)
    pp, pv = np.where(inside, start + last, p0), np.where(inside, v[last], v0)
    to, tv = np.where(ahead, start + following, p1), np.where(ahead, v[np.minimum(following, len(x) - 1)], v1)
    has_before, has_after = inside | (before is not None), ahead | (after is not None)
    with np.errstate(all="ignore"):
        inner = pv + (tv - pv) * (start + at - pp).astype(float) / (to - pp).astype(float)
    out = np.where(known, v, np.where(has_after, inner, pv))
    return pa.array(out, mask=~(known | has_before))


def interpolate(df: DataFrame, cols: Sequence[str], order_by: Sequence[str],
                num_partitions: int | None = None) -> DataFrame:
    """Linear interpolation by row position in ``order_by``.

    pandas semantics: inner gaps are interpolated linearly in position,
    trailing gaps repeat the last value, leading gaps stay empty and are then
    filled with the mean of the interpolated column.

    Scale: rows are range-partitioned and sorted (no global window), in
    partitions of at most about ``SORT_ROWS`` rows.  A task fills its rows in
    chunks of ``CHUNK_ROWS``, in their order and without another sort; what
    lies outside of a chunk comes from a table of one row per chunk (first and
    last known value of each column), which is what reaches the driver.
    """
    cols = list(cols)
    if not cols:
        return df
    order_cols = list(order_by)
    if not num_partitions:
        num_partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SORT_ROWS))
    idx = ordering.local_index()
    chunk = "_ts_chunk"
    tagged = ordering.sorted_tagged(df, order_cols, num_partitions).withColumn(chunk, (idx / CHUNK_ROWS).cast("long"))

    # Per chunk: size, and first/last (index, value) of known values.
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        known = F.when(col(c).isNotNull(), F.struct(idx.alias("i"),
                                                       col(c).cast("double").alias("v")))
        aggs += [F.min(known).alias(f"f{i}"), F.max(known).alias(f"l{i}")]
    summary = sorted(tagged.groupBy(ordering.PID, chunk).agg(*aggs).collect(), key=lambda r: (r[0], r[1]))

    # Carry-ins per chunk: last known value before it, first known after.
    # One forward and one backward scan over the table of chunks.
    starts, offset = [], 0
    for r in summary:
        starts.append(offset)
        offset += r["n"]
    k = len(cols)
    prev_of = [[None] * k for _ in summary]
    next_of = [[None] * k for _ in summary]
    running = [None] * k
    for j, r in enumerate(summary):
        for i in range(k):
            prev_of[j][i] = running[i]
            last = r[f"l{i}"]
            if last is not None:
                running[i] = (starts[j] + last["i"] - r[chunk] * CHUNK_ROWS, last["v"])
    running = [None] * k
    for j in range(len(summary) - 1, -1, -1):
        r = summary[j]
        for i in range(k):
            next_of[j][i] = running[i]
            first = r[f"f{i}"]
            if first is not None:
                running[i] = (starts[j] + first["i"] - r[chunk] * CHUNK_ROWS, first["v"])
    carry = df.sparkSession.sparkContext.broadcast(
        {(r[0], r[1]): (starts[j], prev_of[j], next_of[j]) for j, r in enumerate(summary)})
    # A column has leading gaps when its first known value is not at position 0.
    any_leading = []
    for i in range(k):
        first_known = next(((starts[j] + r[f"f{i}"]["i"] - r[chunk] * CHUNK_ROWS) for j, r in enumerate(summary)
                            if r[f"f{i}"] is not None), None)
        any_leading.append(first_known is not None and first_known > 0)

    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in cols else f for f in df.schema.fields])
    numbers = {f"_ts_x{i}": col(c).cast("double") for i, c in enumerate(cols)}
    arrow = arrow_schema(schema)

    def filled(key: tuple, held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        start, before, after = carry.value[key]
        done = {c: _fill_gaps(rows.column(f"_ts_x{i}").combine_chunks(), start, before[i], after[i]) for i, c in enumerate(cols)}
        return pa.Table.from_arrays([done[n] if n in done else rows.column(n) for n in arrow.names],
                                    names=arrow.names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (ordering.PID, chunk)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if begin == end:
                    continue
                if tuple(keys[begin].tolist()) != key and held:
                    yield from filled(key, held)
                    held = []
                key = tuple(keys[begin].tolist())
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from filled(key, held)

    result = map_arrow(tagged.withColumns(numbers).drop(ordering.MID), run, schema)
    leading_cols = [c for i, c in enumerate(cols) if any_leading[i]]
    if not leading_cols:
        return result
    result = ordering.reliable_checkpoint(result)
    means = collect_stats(result, {f"m{i}": F.avg(col(c)) for i, c in enumerate(leading_cols)})
    return result.withColumns({c: F.coalesce(col(c), F.lit(means[f"m{i}"]).cast("double"))
                               for i, c in enumerate(leading_cols)})


def deduplicate(df: DataFrame, keep: str = "first", subset: Sequence[str] | None = None,
                order_by: Sequence[str] | None = None) -> DataFrame:
    """Remove duplicate rows.

    Full-row duplicates (the reference) are identical, so ``drop``,
    ``keep_first`` and ``keep_last`` give the same rows.  With a ``subset``
    key, ``order_by`` picks which row survives: the smallest (first) or the
    largest (last).  That pick is an aggregate with map-side combining, so a
    key holding a third of the rows is reduced before the shuffle.
    """
    if keep in ("none", None):
        return df
    keep = {"drop": "first", "keep_first": "first", "keep_last": "last"}.get(keep, keep)
    if keep not in ("first", "last"):
        raise ValueError(f"unknown duplicate handling: {keep}")
    if not subset or set(subset) >= set(df.columns):
        return df.dropDuplicates()
    if not order_by:
        raise ValueError("a key subset needs order_by to decide which row is first/last")
    order = list(order_by)
    rest = [c for c in df.columns if c not in subset and c not in order]
    # The order columns lead the struct, so min/max of the struct picks the
    # first/last row; each column is carried once.
    payload = F.struct(*[col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                       *[col(c) for c in rest])
    pick = F.min(payload) if keep == "first" else F.max(payload)
    kept = df.groupBy(*[col(c) for c in subset]).agg(pick.alias("_row"))
    source = {c: f"_o{i}" for i, c in enumerate(order) if c not in subset}
    return kept.select(*[col(c) if c in subset else F.col("_row")[source.get(c, c)].alias(c)
                         for c in df.columns])


def head(df: DataFrame, n: int = 5, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """The first ``n`` rows in ``order_by`` (top-k, no global sort)."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def shape(df: DataFrame) -> DataFrame:
    """C14: one row with the row and column counts."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("long"))

