"""Registered queries over the driver's test tables, each with its DuckDB
oracle SQL where the operator is SQL-expressible.

Every query reads whole tables.  Doubles are passed through ``num`` in
Spark and ``sql_num`` in SQL: values below 1e-9 in magnitude become 0.0,
others are rounded to 9 significant digits.  Both engines then produce the
same double from values that differ only in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import (balance, clean, encode, evaluate, features, outliers, profile,
                               scale, skew, train)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ rounding

def _half_away(y: Column) -> Column:
    """Round to an integer, halves away from zero (C's ``round``)."""
    return F.signum(y) * F.floor(F.abs(y) + F.lit(0.5)).cast("double")


def num(c: str | Column) -> Column:
    """Round a double to 9 significant digits; |x| < 1e-9 becomes 0.0.

    Plain double arithmetic (no decimal rounding), identical to ``sql_num``.
    """
    c = F.col(c) if isinstance(c, str) else c
    x = c.cast("double")
    a = F.abs(x)
    e = F.floor(F.log10(a)).cast("double")
    up = F.pow(F.lit(10.0), F.lit(8.0) - e)
    down = F.pow(F.lit(10.0), e - F.lit(8.0))
    return (F.when(x.isNull(), F.lit(None).cast("double"))
             .when(a < F.lit(1e-9), F.lit(0.0))
             .when(e <= 8, _half_away(x * up) / up)
             .otherwise(_half_away(x / down) * down))


def sql_num(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    e = f"floor(log10(abs({v})))"
    up = f"pow(10.0, 8.0 - {e})"
    down = f"pow(10.0, {e} - 8.0)"

    def half_away(y: str) -> str:
        return f"(sign({y}) * CAST(floor(abs({y}) + 0.5) AS DOUBLE))"

    return (f"(CASE WHEN {v} IS NULL THEN NULL::DOUBLE WHEN abs({v}) < 1e-9 THEN 0.0::DOUBLE "
            f"WHEN {e} <= 8 THEN {half_away(f'{v} * {up}')} / {up} "
            f"ELSE {half_away(f'{v} / {down}')} * {down} END)")


def rounded(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: num(c) for c in cols})


def sql_select_rounded(src: str, keep: Sequence[str], cols: Sequence[str]) -> str:
    parts = [_q(k) for k in keep] + [f"{sql_num(_q(c))} AS {_q(c)}" for c in cols]
    return f"SELECT {', '.join(parts)} FROM {src}"


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def docs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents LEFT JOIN labels: the tables' real missing values."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


DOCS_LABELS_SQL = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"
def grade() -> Column:
    """Text label derived from quality; null where the label is missing."""
    return F.when(F.col("quality") == 1, F.lit("good")).when(F.col("quality") == 0, F.lit("bad"))
GRADE_SQL = "CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END"

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


# ================================================================ profiling

DESCRIBE_DOUBLES = ["mean", "std", "min", "p25", "p50", "p75", "max"]


def _sql_describe_numeric(src: str, c: str) -> str:
    x = f"CAST({_q(c)} AS DOUBLE)"
    return (f"SELECT '{c}' AS column_name, count({x}) AS \"count\", NULL::BIGINT AS \"unique\", "
            f"NULL::VARCHAR AS top, NULL::BIGINT AS freq, avg({x}) AS mean, "
            f"stddev_samp({x}) AS std, min({x}) AS \"min\", quantile_cont({x}, 0.25) AS p25, "
            f"quantile_cont({x}, 0.5) AS p50, quantile_cont({x}, 0.75) AS p75, "
            f"max({x}) AS \"max\" FROM {src}")


def _sql_describe_text(src: str, c: str) -> str:
    x = _q(c)
    return (f"SELECT '{c}' AS column_name, (SELECT count({x}) FROM {src}) AS \"count\", "
            f"(SELECT count(DISTINCT {x}) FROM {src}) AS \"unique\", t.v AS top, t.n AS freq, "
            + ", ".join(f"NULL::DOUBLE AS \"{d}\"" for d in DESCRIBE_DOUBLES)
            + f" FROM (SELECT CAST({x} AS VARCHAR) AS v, count(*) AS n FROM {src} "
            f"WHERE {x} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1) t")


def sql_describe(src: str, numeric: Sequence[str], text: Sequence[str]) -> str:
    parts = [_sql_describe_numeric(src, c) for c in numeric]
    parts += [_sql_describe_text(src, c) for c in text]
    inner = union_all(parts)
    keep = ["column_name", "count", "unique", "top", "freq"]
    return sql_select_rounded(f"({inner}) d", keep, DESCRIBE_DOUBLES)


FLAGSHIP_SQL = f"""
WITH q AS (
  SELECT quantile_cont(l_quantity, [0.25, 0.75]) AS a,
         quantile_cont(l_extendedprice, [0.25, 0.75]) AS b,
         quantile_cont(l_discount, [0.25, 0.75]) AS c
  FROM lineitem),
f AS (
  SELECT a[1] - 1.5 * (a[2] - a[1]) AS alo, a[2] + 1.5 * (a[2] - a[1]) AS ahi,
         b[1] - 1.5 * (b[2] - b[1]) AS blo, b[2] + 1.5 * (b[2] - b[1]) AS bhi,
         c[1] - 1.5 * (c[2] - c[1]) AS clo, c[2] + 1.5 * (c[2] - c[1]) AS chi
  FROM q),
clipped AS (
  SELECT least(greatest(l_quantity, alo), ahi) AS l_quantity,
         least(greatest(l_extendedprice, blo), bhi) AS l_extendedprice,
         least(greatest(l_discount, clo), chi) AS l_discount,
         l_returnflag
  FROM lineitem, f),
fr AS (
  SELECT l_returnflag, count(*) / sum(count(*)) OVER () AS share
  FROM clipped WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag),
enc AS (
  SELECT l_quantity, l_extendedprice, l_discount, share AS l_returnflag
  FROM clipped LEFT JOIN fr USING (l_returnflag)),
st AS (
  SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1,
         avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2,
         avg(l_discount) AS m3, stddev_pop(l_discount) AS s3,
         avg(l_returnflag) AS m4, stddev_pop(l_returnflag) AS s4
  FROM enc),
z AS (
  SELECT (l_quantity - m1) / s1 AS l_quantity, (l_extendedprice - m2) / s2 AS l_extendedprice,
         (l_discount - m3) / s3 AS l_discount, (l_returnflag - m4) / s4 AS l_returnflag
  FROM enc, st)
SELECT column_name, "count", mean, std, "min", p25, p50, p75, "max" FROM (
{sql_describe("z", LI_NUM + ["l_returnflag"], [])}
) r
"""


@register("flagship_clip_encode_scale_describe", FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: IQR clip three lineitem columns, frequency-encode the
    return flag, standardise, describe."""
    li = table(spark, sf_dir, "lineitem").select(*LI_NUM, "l_returnflag")
    clipped = outliers.clip_outliers(li, LI_NUM, "iqr")
    encoded = encode.frequency_encode(clipped, ["l_returnflag"])
    scaled = scale.scale(encoded, "standard", LI_NUM + ["l_returnflag"])
    report = profile.describe(scaled, LI_NUM + ["l_returnflag"])
    return rounded(report, DESCRIBE_DOUBLES).select(
        "column_name", "count", *DESCRIBE_DOUBLES)


LI_DESCRIBE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                   "l_extendedprice", "l_discount", "l_tax"]
LI_DESCRIBE_TEXT = ["l_returnflag", "l_linestatus"]


@register("describe_lineitem", sql_describe("lineitem", LI_DESCRIBE_NUM, LI_DESCRIBE_TEXT))
def describe_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over every numeric and string column of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return rounded(profile.describe(li, LI_DESCRIBE_NUM + LI_DESCRIBE_TEXT), DESCRIBE_DOUBLES)


ORDERS_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
                ("o_orderpriority", "string")]


@register("info_orders", union_all([
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null FROM orders"
    for c, t in ORDERS_TYPES]))
def info_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: column, type, non-null count."""
    return profile.info(table(spark, sf_dir, "orders"))


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _sql_corr() -> str:
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            v = (f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0::DOUBLE END" if a == b
                 else f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {v} AS corr FROM lineitem")
    return sql_select_rounded(f"({union_all(parts)}) c", ["col_a", "col_b"], ["corr"])


@register("correlation_lineitem", _sql_corr())
def correlation_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: Pearson matrix in long form."""
    return rounded(profile.correlation(table(spark, sf_dir, "lineitem"), CORR_COLS), ["corr"])


DIST_COLS = ["o_totalprice", "o_custkey", "o_orderkey"]


def _sql_moments(src: str, c: str) -> str:
    """n, population g1 and g2 of one column (two-pass central moments)."""
    x = f"CAST({c} AS DOUBLE)"
    return (f"(SELECT n, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) - 3.0 AS g2 FROM ("
            f"SELECT count({x}) AS n, avg(pow({x} - mu, 2)) AS m2, avg(pow({x} - mu, 3)) AS m3, "
            f"avg(pow({x} - mu, 4)) AS m4 FROM {src}, (SELECT avg({x}) AS mu FROM {src}) s) t)")


def _sql_distribution() -> str:
    parts = []
    for c in DIST_COLS:
        parts.append(
            f"SELECT '{c}' AS column_name, n, "
            f"CASE WHEN n > 1 AND n >= 3 THEN g1 * sqrt(CAST(n * (n - 1) AS DOUBLE)) / (n - 2) END AS skewness, "
            f"CASE WHEN n > 1 AND n >= 4 THEN (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0) END AS kurtosis, "
            f"CASE WHEN n > 1 THEN exp(-(CAST(n AS DOUBLE) / 6.0 * (g1 * g1 + g2 * g2 / 4.0)) / 2.0) END AS normality_p "
            f"FROM {_sql_moments('orders', c)} m")
    return sql_select_rounded(f"({union_all(parts)}) d", ["column_name", "n"],
                              ["skewness", "kurtosis", "normality_p"])


@register("distribution_orders", _sql_distribution())
def distribution_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4/A5: adjusted skewness, kurtosis, Jarque-Bera p."""
    out = profile.distribution(table(spark, sf_dir, "orders"), DIST_COLS)
    return rounded(out, ["skewness", "kurtosis", "normality_p"])


DL_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def _sql_missing(src: str, cols: Sequence[str]) -> str:
    parts = [f"SELECT '{c}' AS column_name, CAST(sum(CASE WHEN {_q(c)} IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
             f"AS missing_count, CASE WHEN count(*) > 0 THEN sum(CASE WHEN {_q(c)} IS NULL THEN 1 ELSE 0 END) "
             f"* 100.0::DOUBLE / count(*) END AS missing_pct FROM {src}" for c in cols]
    return sql_select_rounded(f"({union_all(parts)}) m", ["column_name", "missing_count"],
                              ["missing_pct"])


@register("missing_documents_labels", _sql_missing(DOCS_LABELS_SQL + " dl", DL_COLS))
def missing_documents_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 on documents LEFT JOIN labels."""
    return rounded(profile.missing(docs_labels(spark, sf_dir).select(*DL_COLS)), ["missing_pct"])


@register("categorical_counts_events", union_all([
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS \"count\" "
    f"FROM events WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("event_type", "props")]))
def categorical_counts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of the string columns of events."""
    return profile.categorical_counts(table(spark, sf_dir, "events"), ["event_type", "props"])


OUT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sql_outliers(src: str = "lineitem", cols: Sequence[str] = OUT_COLS) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS column_name, q[1] AS q1, q[2] AS q3, q[1] - 1.5 * (q[2] - q[1]) AS lower, "
            f"q[2] + 1.5 * (q[2] - q[1]) AS upper, "
            f"(SELECT count(*) FROM {src} WHERE {c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])) AS outlier_count, "
            f"(SELECT count(*) FROM {src} WHERE {c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])) * 100.0::DOUBLE "
            f"/ (SELECT count(*) FROM {src}) AS outlier_pct "
            f"FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.75]) AS q FROM {src}) s")
    return sql_select_rounded(f"({union_all(parts)}) o", ["column_name", "outlier_count"],
                              ["q1", "q3", "lower", "upper", "outlier_pct"])


@register("outliers_lineitem", _sql_outliers())
def outliers_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IQR fences and outlier share."""
    out = profile.outlier_summary(table(spark, sf_dir, "lineitem"), OUT_COLS)
    return rounded(out, ["q1", "q3", "lower", "upper", "outlier_pct"])


@register("outliers_events", _sql_outliers("events", ["value", "user_id"]))
def outliers_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 on a column that has outliers."""
    out = profile.outlier_summary(table(spark, sf_dir, "events"), ["value", "user_id"])
    return rounded(out, ["q1", "q3", "lower", "upper", "outlier_pct"])


DUP_COLS = ["l_returnflag", "l_linestatus", "l_quantity"]


@register("duplicates_lineitem", sql_select_rounded(
    "(SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT "
    + ", ".join(DUP_COLS) + " FROM lineitem) d) AS duplicates, "
    "(count(*) - (SELECT count(*) FROM (SELECT DISTINCT " + ", ".join(DUP_COLS)
    + " FROM lineitem) d)) * 100.0::DOUBLE / count(*) AS duplicate_pct FROM lineitem) t",
    ["total_rows", "duplicates"], ["duplicate_pct"]))
def duplicates_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 on a projection of lineitem that has duplicates."""
    li = table(spark, sf_dir, "lineitem").select(*DUP_COLS)
    return rounded(profile.duplicates(li), ["duplicate_pct"])


@register("imbalance_labels_quality",
          'SELECT quality AS "class", count(*) AS "count" FROM labels '
          "WHERE quality IS NOT NULL GROUP BY quality")
def imbalance_labels_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 with the target as a parameter."""
    return profile.class_balance(table(spark, sf_dir, "labels"), "quality")


SKEW_CHECK_COLS = ["p_partkey", "p_size", "p_retailprice"]


def _sql_skew_check() -> str:
    parts = []
    for c in SKEW_CHECK_COLS:
        parts.append(
            f"SELECT '{c}' AS column_name, CASE WHEN n >= 3 THEN g1 * sqrt(CAST(n * (n - 1) AS DOUBLE)) / (n - 2) END AS skewness, "
            f"coalesce((SELECT bool_and(coalesce({c} > 0, false)) FROM part), true) "
            f"AND coalesce(abs(CASE WHEN n >= 3 THEN g1 * sqrt(CAST(n * (n - 1) AS DOUBLE)) / (n - 2) END) > 0.5, false) "
            f"AS boxcox_applicable FROM {_sql_moments('part', c)} m")
    return sql_select_rounded(f"({union_all(parts)}) s", ["column_name", "boxcox_applicable"],
                              ["skewness"])


@register("skewness_check_part", _sql_skew_check())
def skewness_check_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewness and Box-Cox applicability."""
    return rounded(profile.skewness_check(table(spark, sf_dir, "part"), SKEW_CHECK_COLS),
                   ["skewness"])


PAIR_COLS = ["l_quantity", "l_discount", "l_tax"]


def _sql_pair_bins(bins: int = 10) -> str:
    def b(c: str) -> str:
        return (f"CASE WHEN {c} IS NULL THEN NULL WHEN hi_{c} = lo_{c} THEN 0 ELSE "
                f"least(CAST(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * {float(bins)}) AS INTEGER), {bins - 1}) END")
    mm = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in PAIR_COLS)
    parts = []
    for i, a in enumerate(PAIR_COLS):
        for c in PAIR_COLS[i:]:
            parts.append(f"SELECT '{a}' AS col_a, '{c}' AS col_b, CAST({b(a)} AS INTEGER) AS bin_a, "
                         f"CAST({b(c)} AS INTEGER) AS bin_b FROM lineitem, (SELECT {mm} FROM lineitem) mm")
    return (f"SELECT col_a, col_b, bin_a, bin_b, count(*) AS \"count\" FROM ({union_all(parts)}) p "
            f"WHERE bin_a IS NOT NULL AND bin_b IS NOT NULL GROUP BY ALL")


@register("pair_bins_lineitem", _sql_pair_bins())
def pair_bins_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binned pair-plot counts."""
    return profile.pair_bins(table(spark, sf_dir, "lineitem"), PAIR_COLS, 10)


# ================================================================= cleaning

@register("standardize_missing_conversations", _sql_missing(
    "(SELECT conv_id, turn, CASE WHEN role IN ('', ' ', 'null', 'N/A', 'na', '-', 'unknown', 'NaN') "
    "THEN NULL ELSE role END AS role, CASE WHEN text IN ('', ' ', 'null', 'N/A', 'na', '-', 'unknown', "
    "'NaN') THEN NULL ELSE text END AS text FROM conversations) c",
    ["conv_id", "turn", "role", "text"]))
def standardize_missing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 then the missing report."""
    conv = clean.standardize_missing(table(spark, sf_dir, "conversations"))
    return rounded(profile.missing(conv), ["missing_pct"])


# Injected by a rule on the key: the eight tokens, and three near misses.
INJECTED = ["", " ", "null", "N/A", "na", "-", "unknown", "NaN", "NULL", "  ", "n/a "]
_INJECTED_SQL = "CASE WHEN (conv_id * 7 + turn) % 16 < 11 THEN ([" + ", ".join(f"'{v}'" for v in INJECTED) + \
    "])[(conv_id * 7 + turn) % 16 + 1] ELSE role END"


@register("standardize_missing_injected",
          "SELECT conv_id, turn, CASE WHEN role IN ('', ' ', 'null', 'N/A', 'na', '-', 'unknown', 'NaN') THEN NULL "
          f"ELSE role END AS role FROM (SELECT conv_id, turn, {_INJECTED_SQL} AS role FROM conversations) c")
def standardize_missing_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight tokens become missing, near misses stay."""
    at = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(16)).cast("int")
    tokens = F.array(*[F.lit(v) for v in INJECTED])
    role = F.when(at < len(INJECTED), F.get(tokens, at)).otherwise(F.col("role"))
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"))
    return clean.standardize_missing(conv)


@register("drop_columns_documents", "SELECT doc_id, lang, source, n_chars FROM documents")
def drop_columns_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown names are ignored."""
    return clean.drop_columns(table(spark, sf_dir, "documents"), ["text", "no_such_column"])


def _dl_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_labels(spark, sf_dir).select("doc_id", "n_chars", "quality", "toxic")


DL_NUM_SQL = f"(SELECT doc_id, n_chars, quality, toxic FROM {DOCS_LABELS_SQL} x)"


@register("impute_mean_documents", sql_select_rounded(
    f"(SELECT doc_id, n_chars, coalesce(CAST(quality AS DOUBLE), avg(quality) OVER ()) AS quality, "
    f"coalesce(CAST(toxic AS DOUBLE), avg(toxic) OVER ()) AS toxic, "
    f"CAST(quality IS NULL AS INTEGER) AS quality_missing, CAST(toxic IS NULL AS INTEGER) AS toxic_missing "
    f"FROM {DL_NUM_SQL} b) t", ["doc_id", "n_chars", "quality_missing", "toxic_missing"],
    ["quality", "toxic"]))
def impute_mean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 indicators + C4 mean imputation."""
    out = clean.impute(_dl_numeric(spark, sf_dir), "mean", ["quality", "toxic"], indicator=True)
    return rounded(out, ["quality", "toxic"])


@register("impute_median_documents", sql_select_rounded(
    f"(SELECT doc_id, n_chars, coalesce(CAST(quality AS DOUBLE), (SELECT quantile_cont(quality, 0.5) FROM {DL_NUM_SQL} s)) AS quality, "
    f"coalesce(CAST(toxic AS DOUBLE), (SELECT quantile_cont(toxic, 0.5) FROM {DL_NUM_SQL} s)) AS toxic "
    f"FROM {DL_NUM_SQL} b) t", ["doc_id", "n_chars"], ["quality", "toxic"]))
def impute_median_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median."""
    return rounded(clean.impute(_dl_numeric(spark, sf_dir), "median", ["quality", "toxic"]),
                   ["quality", "toxic"])


def _sql_mode(src: str, c: str) -> str:
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {src} s WHERE {c} IS NOT NULL "
            f"GROUP BY 1) ORDER BY n DESC, v LIMIT 1)")


DL_GRADE_SQL = f"(SELECT doc_id, quality, toxic, {GRADE_SQL} AS grade FROM {DOCS_LABELS_SQL} x)"


@register("impute_most_frequent_documents",
          f"SELECT doc_id, coalesce(quality, {_sql_mode(DL_GRADE_SQL, 'quality')}) AS quality, "
          f"coalesce(toxic, {_sql_mode(DL_GRADE_SQL, 'toxic')}) AS toxic, "
          f"coalesce(grade, {_sql_mode(DL_GRADE_SQL, 'grade')}) AS grade FROM {DL_GRADE_SQL} b")
def impute_most_frequent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric and string columns, ties to the smallest value."""
    base = docs_labels(spark, sf_dir).select("doc_id", "quality", "toxic", grade().alias("grade"))
    return clean.impute(base, "most_frequent", ["quality", "toxic", "grade"])


@register("impute_drop_documents",
          f"SELECT doc_id, n_chars, quality, toxic FROM {DL_NUM_SQL} b "
          "WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def impute_drop_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop rows with a missing value in the chosen columns."""
    return clean.impute(_dl_numeric(spark, sf_dir), "drop", ["quality", "toxic"])


@register("fill_zero_documents",
          f"SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, "
          f"coalesce(grade, '0') AS grade FROM {DL_GRADE_SQL} b")
def fill_zero_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older fill-with-zero variant."""
    base = docs_labels(spark, sf_dir).select("doc_id", "quality", "toxic", grade().alias("grade"))
    return clean.fill_zero(base)


def _events_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id",
                     F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value"))
                     .alias("value"),
                     F.when(F.col("event_type").isin("view", "click"), F.lit(None))
                     .otherwise(F.col("value")).alias("value2"))


def _sql_interpolate(c: str, rule: str) -> str:
    w_before = "OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    w_after = "OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""(SELECT event_id, coalesce(v, avg(v) OVER ()) AS {c} FROM (
  SELECT event_id, CASE WHEN x IS NOT NULL THEN x
    WHEN pp IS NOT NULL AND np IS NOT NULL THEN pv + (nv - pv) * CAST(pos - pp AS DOUBLE) / CAST(np - pp AS DOUBLE)
    WHEN pp IS NOT NULL THEN pv END AS v
  FROM (
    SELECT event_id, pos, x,
      last_value(CASE WHEN x IS NOT NULL THEN pos END IGNORE NULLS) {w_before} AS pp,
      last_value(x IGNORE NULLS) {w_before} AS pv,
      first_value(CASE WHEN x IS NOT NULL THEN pos END IGNORE NULLS) {w_after} AS np,
      first_value(x IGNORE NULLS) {w_after} AS nv
    FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos,
                 CASE WHEN {rule} THEN NULL ELSE value END AS x FROM events) b) n) i)"""


@register("interpolate_events", sql_select_rounded(
    f"({_sql_interpolate('value', chr(39).join(['event_type = ', 'error', '']))}) a "
    f"JOIN {_sql_interpolate('value2', 'event_type IN (' + chr(39) + 'view' + chr(39) + ', ' + chr(39) + 'click' + chr(39) + ')')} b "
    "USING (event_id)", ["event_id"], ["value", "value2"]))
def interpolate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear interpolation in event_id order, leftovers to the mean."""
    out = clean.interpolate(_events_gaps(spark, sf_dir), ["value", "value2"], ["event_id"])
    return rounded(out, ["value", "value2"])


@register("dedupe_distinct_lineitem",
          "SELECT DISTINCT " + ", ".join(DUP_COLS) + " FROM lineitem")
def dedupe_distinct_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: full-row duplicates removed (nulls equal)."""
    return clean.deduplicate(table(spark, sf_dir, "lineitem").select(*DUP_COLS), "drop")


@register("dedupe_keep_last_events",
          "SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER "
          "(PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) "
          "WHERE rn = 1")
def dedupe_keep_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the last event per (user, type) by time."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    out = clean.deduplicate(ev, "keep_last", ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("event_id", "user_id", "event_type", "value")


@register("head_orders",
          "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority "
          "FROM orders ORDER BY o_orderkey LIMIT 5")
def head_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five rows (a top-k, the limit is the feature)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                              "o_totalprice", "o_orderpriority")
    return clean.head(o, 5, ["o_orderkey"])


@register("shape_lineitem", "SELECT count(*) AS \"rows\", CAST(11 AS BIGINT) AS \"columns\" FROM lineitem")
def shape_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: rows x columns."""
    return clean.shape(table(spark, sf_dir, "lineitem"))


# ================================================================= outliers

CLIP_KEYS = ["l_orderkey", "l_linenumber"]
CLIP_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sql_iqr_fence(src: str, c: str) -> str:
    return (f"(SELECT q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi FROM "
            f"(SELECT quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.75]) AS q FROM {src}) s)")


def _sql_clip(kind: str, src: str = "lineitem", keys: Sequence[str] = CLIP_KEYS,
              cols: Sequence[str] = CLIP_COLS) -> str:
    sel = []
    for c in cols:
        if kind == "iqr":
            f = _sql_iqr_fence(src, c)
        else:
            f = (f"(SELECT mn AS lo, coalesce((SELECT max({c}) FROM {src}, (SELECT avg({c}) AS mu, "
                 f"stddev_samp({c}) AS sd FROM {src}) z WHERE sd > 0 AND abs(({c} - mu) / sd) < 3.0), mx) AS hi "
                 f"FROM (SELECT min({c}) AS mn, max({c}) AS mx FROM {src}) m)")
        sel.append(f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(CAST({c} AS DOUBLE), "
                   f"(SELECT lo FROM {f} f)), (SELECT hi FROM {f} f)) END AS {c}")
    return sql_select_rounded(f"(SELECT {', '.join(keys)}, {', '.join(sel)} FROM {src}) t", keys, cols)


@register("clip_iqr_lineitem", _sql_clip("iqr"))
def clip_iqr_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: clip to the IQR fences."""
    li = table(spark, sf_dir, "lineitem").select(*CLIP_KEYS, *CLIP_COLS)
    return rounded(outliers.clip_outliers(li, CLIP_COLS, "iqr"), CLIP_COLS)


@register("clip_zscore_lineitem", _sql_clip("zscore"))
def clip_zscore_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: lower = min, upper = largest value with |z| < 3."""
    li = table(spark, sf_dir, "lineitem").select(*CLIP_KEYS, *CLIP_COLS)
    return rounded(outliers.clip_outliers(li, CLIP_COLS, "zscore"), CLIP_COLS)


@register("clip_iqr_events", _sql_clip("iqr", "events", ["event_id"], ["value"]))
def clip_iqr_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 on a column that has outliers."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return rounded(outliers.clip_outliers(events, ["value"], "iqr"), ["value"])


@register("clip_zscore_documents", _sql_clip("zscore", "documents", ["doc_id"], ["n_chars"]))
def clip_zscore_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2 on a column that has outliers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return rounded(outliers.clip_outliers(docs, ["n_chars"], "zscore"), ["n_chars"])


REMOVE_COLS = ["l_extendedprice", "l_quantity", "l_tax"]


def _sql_remove_iqr(src: str = "lineitem", cols: Sequence[str] = REMOVE_COLS,
                    keys: str = "l_orderkey, l_linenumber") -> str:
    ctes = []
    for i, c in enumerate(cols):
        fence = _sql_iqr_fence(src, c)
        ctes.append(f"s{i} AS (SELECT * FROM {src} WHERE {c} BETWEEN (SELECT lo FROM {fence} f) "
                    f"AND (SELECT hi FROM {fence} f))")
        src = f"s{i}"
    return f"WITH {', '.join(ctes)} SELECT {keys} FROM {src}"


@register("remove_iqr_lineitem", _sql_remove_iqr())
def remove_iqr_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: sequential removal, each column's fences on the rows kept so far."""
    li = table(spark, sf_dir, "lineitem")
    return outliers.remove_outliers(li, REMOVE_COLS, "iqr").select("l_orderkey", "l_linenumber")


ZREMOVE_COLS = ["o_totalprice", "o_custkey"]


def _sql_remove_z(src: str = "orders", cols: Sequence[str] = ZREMOVE_COLS, keys: str = "o_orderkey") -> str:
    ctes = []
    for i, c in enumerate(cols):
        ctes.append(f"s{i} AS (SELECT {src}.* FROM {src}, (SELECT avg({c}) AS mu, stddev_samp({c}) AS sd "
                    f"FROM {src}) z WHERE sd > 0 AND abs(({c} - mu) / sd) < 3.0)")
        src = f"s{i}"
    return f"WITH {', '.join(ctes)} SELECT {keys} FROM {src}"


@register("remove_zscore_orders", _sql_remove_z())
def remove_zscore_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep |z| < 3, column after column."""
    o = table(spark, sf_dir, "orders")
    return outliers.remove_outliers(o, ZREMOVE_COLS, "zscore").select("o_orderkey")


# Both columns lose rows: value has outliers, and so has what depends on it.
_SPREAD_SQL = "(SELECT event_id, value, value * value AS square FROM events)"


@register("remove_iqr_events", _sql_remove_iqr(_SPREAD_SQL, ["value", "square"], "event_id"))
def remove_iqr_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3 where each column's fences depend on the rows removed before."""
    events = table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") * F.col("value")).alias("square"))
    return outliers.remove_outliers(events, ["value", "square"], "iqr").select("event_id")


@register("remove_zscore_events", _sql_remove_z("spread", ["value", "square"], "event_id").replace(
    "WITH ", f"WITH spread AS (SELECT * FROM {_SPREAD_SQL} e), ", 1))
def remove_zscore_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4 where each column's moments depend on the rows removed before."""
    events = table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") * F.col("value")).alias("square"))
    return outliers.remove_outliers(events, ["value", "square"], "zscore").select("event_id")


PART_COLS = ["p_retailprice", "p_size"]


@register("transform_log_part", sql_select_rounded(
    "(SELECT p_partkey, " + ", ".join(f"CASE WHEN {c} > -1 THEN ln(1 + CAST({c} AS DOUBLE)) END AS {c}"
                                       for c in PART_COLS) + " FROM part) t", ["p_partkey"], PART_COLS))
def transform_log_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log1p."""
    p = table(spark, sf_dir, "part").select("p_partkey", *PART_COLS)
    return rounded(outliers.transform_outliers(p, PART_COLS, "log"), PART_COLS)


@register("transform_sqrt_part", sql_select_rounded(
    "(SELECT p_partkey, " + ", ".join(f"CASE WHEN {c} >= 0 THEN sqrt(CAST({c} AS DOUBLE)) END AS {c}"
                                       for c in PART_COLS) + " FROM part) t", ["p_partkey"], PART_COLS))
def transform_sqrt_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square root (negative -> null)."""
    p = table(spark, sf_dir, "part").select("p_partkey", *PART_COLS)
    return rounded(outliers.transform_outliers(p, PART_COLS, "sqrt"), PART_COLS)


@register("transform_boxcox_customer")
def transform_boxcox_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift when min <= 0, then Box-Cox with the MLE lambda (an
    iterative fit: checked against a brute-force likelihood in tests)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(outliers.transform_outliers(c, ["c_acctbal"], "boxcox"), ["c_acctbal"])


# ================================================================= skewness

SKEW_COLS = ["o_totalprice", "o_custkey"]


@register("skew_log_orders", sql_select_rounded(
    "(SELECT o_orderkey, " + ", ".join(
        f"ln(1 + (CAST({c} AS DOUBLE) - (SELECT min({c}) FROM orders) + 1.0)) AS {c}" for c in SKEW_COLS)
    + " FROM orders) t", ["o_orderkey"], SKEW_COLS))
def skew_log_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: ln(x - min + 2)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", *SKEW_COLS)
    return rounded(skew.handle_skewness(o, "log", SKEW_COLS), SKEW_COLS)


@register("skew_sqrt_orders", sql_select_rounded(
    "(SELECT o_orderkey, " + ", ".join(
        f"sqrt(CAST({c} AS DOUBLE) - (SELECT min({c}) FROM orders)) AS {c}" for c in SKEW_COLS)
    + " FROM orders) t", ["o_orderkey"], SKEW_COLS))
def skew_sqrt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: sqrt(x - min)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", *SKEW_COLS)
    return rounded(skew.handle_skewness(o, "sqrt", SKEW_COLS), SKEW_COLS)


@register("skew_boxcox_part")
def skew_boxcox_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: Box-Cox, MLE lambda per column (iterative; brute-force tested)."""
    p = table(spark, sf_dir, "part").select("p_partkey", *PART_COLS)
    return rounded(skew.handle_skewness(p, "boxcox", PART_COLS), PART_COLS)


@register("skew_yeojohnson_customer")
def skew_yeojohnson_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: Yeo-Johnson, MLE lambda (any sign)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(skew.handle_skewness(c, "yeojohnson", ["c_acctbal"]), ["c_acctbal"])


# ================================================================= encoding

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


@register("onehot_orders", "SELECT o_orderkey, " + ", ".join(
    [f"CASE WHEN o_orderpriority = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"o_orderpriority_{v}\""
     for v in PRIORITIES]
    + [f"CASE WHEN o_orderstatus = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"o_orderstatus_{v}\""
       for v in STATUSES]) + " FROM orders")
def onehot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column per category, originals dropped."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return encode.encode(o, "onehot", ["o_orderpriority", "o_orderstatus"])


@register("onehot_documents",
          "SELECT doc_id, CASE WHEN grade = 'bad' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS grade_bad, "
          "CASE WHEN grade = 'good' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS grade_good, "
          "CASE WHEN grade IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS grade_nan "
          f"FROM (SELECT doc_id, {GRADE_SQL} AS grade FROM {DOCS_LABELS_SQL} x) b")
def onehot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1 with missing values: they have a column of their own."""
    data = docs_labels(spark, sf_dir).select("doc_id", grade().alias("grade"))
    return encode.encode(data, "onehot", ["grade"])


@register("label_encode_documents",
          "SELECT doc_id, "
          "CAST(dense_rank() OVER (ORDER BY coalesce(lang, 'nan')) - 1 AS BIGINT) AS lang, "
          "CAST(dense_rank() OVER (ORDER BY coalesce(grade, 'nan')) - 1 AS BIGINT) AS grade "
          f"FROM (SELECT doc_id, lang, {GRADE_SQL} AS grade FROM {DOCS_LABELS_SQL} x) b")
def label_encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted codes; a missing value is coded as the text 'nan'."""
    base = docs_labels(spark, sf_dir).select("doc_id", "lang", grade().alias("grade"))
    return encode.encode(base, "label", ["lang", "grade"])


@register("target_encode_customer", sql_select_rounded(
    "(SELECT c_custkey, coalesce(m.mean, (SELECT avg(c_acctbal) FROM customer)) AS c_mktsegment, "
    "c_acctbal FROM customer LEFT JOIN (SELECT c_mktsegment AS seg, avg(c_acctbal) AS mean FROM customer "
    "WHERE c_mktsegment IS NOT NULL GROUP BY 1) m ON customer.c_mktsegment = m.seg) t",
    ["c_custkey"], ["c_mktsegment", "c_acctbal"]))
def target_encode_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category -> mean of the target (global mean if missing)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rounded(encode.encode(c, "target", ["c_mktsegment"], target="c_acctbal"),
                   ["c_mktsegment", "c_acctbal"])


@register("frequency_encode_orders", sql_select_rounded(
    "(SELECT o_orderkey, f.share AS o_orderpriority FROM orders LEFT JOIN (SELECT o_orderpriority AS p, "
    "count(*) / sum(count(*)) OVER () AS share FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1) f "
    "ON orders.o_orderpriority = f.p) t", ["o_orderkey"], ["o_orderpriority"]))
def frequency_encode_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of non-missing rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return rounded(encode.encode(o, "frequency", ["o_orderpriority"]), ["o_orderpriority"])


# ================================================================== scaling

def _sql_scaled(method: str) -> str:
    sel = []
    for c in LI_NUM:
        x = f"CAST({c} AS DOUBLE)"
        if method == "standard":
            e = (f"({x} - (SELECT avg({c}) FROM lineitem)) / (SELECT CASE WHEN stddev_pop({c}) > 0 "
                 f"THEN stddev_pop({c}) ELSE 1.0 END FROM lineitem)")
        elif method == "minmax":
            e = (f"({x} - (SELECT min({c}) FROM lineitem)) / (SELECT CASE WHEN max({c}) > min({c}) "
                 f"THEN CAST(max({c}) - min({c}) AS DOUBLE) ELSE 1.0 END FROM lineitem)")
        elif method == "normalize":
            e = (f"(SELECT CASE WHEN max({c}) > min({c}) THEN NULL ELSE 0.0 END FROM lineitem) IS NULL")
            e = (f"CASE WHEN (SELECT max({c}) > min({c}) FROM lineitem) THEN ({x} - (SELECT min({c}) "
                 f"FROM lineitem)) / (SELECT CAST(max({c}) - min({c}) AS DOUBLE) FROM lineitem) ELSE 0.0 END")
        else:
            e = (f"({x} - (SELECT quantile_cont({x}, 0.5) FROM lineitem)) / (SELECT CASE WHEN "
                 f"quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) <> 0 THEN quantile_cont({x}, 0.75) "
                 f"- quantile_cont({x}, 0.25) ELSE 1.0 END FROM lineitem)")
        sel.append(f"{e} AS {c}")
    return sql_select_rounded(f"(SELECT l_orderkey, l_linenumber, {', '.join(sel)} FROM lineitem) t",
                              ["l_orderkey", "l_linenumber"], LI_NUM)


def _scaled_query(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LI_NUM)
        return rounded(scale.scale(li, method, LI_NUM), LI_NUM)
    run.__doc__ = f"F1-F4: {method} scaling of three lineitem columns."
    return run


for _method in scale.METHODS:
    register(f"scale_{_method}_lineitem", _sql_scaled(_method))(_scaled_query(_method))


# ================================================================ balancing

@register("undersample_labels",
          "SELECT quality, CAST((SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS BIGINT) "
          "AS n_rows, CAST((SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS BIGINT) "
          "AS n_docs FROM labels WHERE quality IS NOT NULL GROUP BY quality")
def undersample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: each class cut to the minority size, no row repeated."""
    lab = table(spark, sf_dir, "labels")
    out = balance.balance(lab, "undersample", "quality", key=["doc_id"])
    return out.groupBy("quality").agg(F.count(F.lit(1)).alias("n_rows"),
                                      F.countDistinct("doc_id").alias("n_docs"))


@register("oversample_labels",
          "SELECT quality, CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS BIGINT) "
          "AS n_rows, count(*) AS n_docs FROM labels WHERE quality IS NOT NULL GROUP BY quality")
def oversample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: each class raised to the majority size; all originals kept."""
    lab = table(spark, sf_dir, "labels")
    out = balance.balance(lab, "oversample", "quality", key=["doc_id"])
    return out.groupBy("quality").agg(F.count(F.lit(1)).alias("n_rows"),
                                      F.countDistinct("doc_id").alias("n_docs"))


# ====================================================== feature engineering

POLY_PART = ["p_size", "p_retailprice"]


def _sql_poly(cols: Sequence[str], interaction_only: bool, src: str, keep: Sequence[str]) -> str:
    terms = features.polynomial_names(list(cols), interaction_only)
    sel = []
    names = []
    for t in terms:
        if len(t) == 1:
            e, name = f"CAST({t[0]} AS DOUBLE)", t[0]
        else:
            e = f"CAST({t[0]} AS DOUBLE) * CAST({t[1]} AS DOUBLE)"
            name = f"{t[0]}^2" if t[0] == t[1] else f"{t[0]} {t[1]}"
        sel.append(f"{e} AS {_q(name)}")
        names.append(name)
    return sql_select_rounded(f"(SELECT {', '.join(keep)}, {', '.join(sel)} FROM {src}) t", keep, names)


@register("polynomial_part", _sql_poly(POLY_PART, False, "part", ["p_partkey"]))
def polynomial_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: degree-2 features with scikit-learn names."""
    p = table(spark, sf_dir, "part")
    out = features.polynomial(p, POLY_PART, keep=["p_partkey"])
    return rounded(out, [c for c in out.columns if c != "p_partkey"])


INTER_LI = ["l_quantity", "l_discount", "l_tax"]


@register("interaction_lineitem", _sql_poly(INTER_LI, True, "lineitem", ["l_orderkey", "l_linenumber"]))
def interaction_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise products without squares."""
    li = table(spark, sf_dir, "lineitem")
    out = features.polynomial(li, INTER_LI, interaction_only=True, keep=["l_orderkey", "l_linenumber"])
    return rounded(out, [c for c in out.columns if c not in ("l_orderkey", "l_linenumber")])


@register("datetime_orders",
          "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, "
          "CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, "
          "CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day FROM orders")
def datetime_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, month, day parts."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return features.datetime_parts(o).drop("o_orderdate")


VAR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("variance_lineitem", sql_select_rounded(
    "(" + union_all([f"SELECT '{c}' AS column_name, var_pop(CAST({c} AS DOUBLE)) AS variance, "
                     f"coalesce(var_pop(CAST({c} AS DOUBLE)) > 0.01, false) AS selected FROM lineitem"
                     for c in VAR_COLS]) + ") v", ["column_name", "selected"], ["variance"]))
def variance_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population variance against the 0.01 threshold."""
    return rounded(features.variance_report(table(spark, sf_dir, "lineitem"), VAR_COLS), ["variance"])


KBEST_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey"]


def _sql_anova() -> str:
    parts = []
    for c in KBEST_COLS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, (sum(n * pow(m - gm, 2)) / (count(*) - 1)) / "
            f"(sum(n * v) / (sum(n) - count(*))) AS f_score FROM (SELECT n, m, v, "
            f"sum(n * m) OVER () / sum(n) OVER () AS gm FROM (SELECT l_returnflag, count(*) AS n, "
            f"avg({x}) AS m, var_pop({x}) AS v FROM lineitem WHERE l_returnflag IS NOT NULL "
            f"GROUP BY l_returnflag) g) s")
    return sql_select_rounded(
        f"(SELECT column_name, f_score, row_number() OVER (ORDER BY f_score DESC NULLS LAST, column_name) "
        f"<= 5 AS selected FROM ({union_all(parts)}) a) r", ["column_name", "selected"], ["f_score"])


@register("kbest_anova_lineitem", _sql_anova())
def kbest_anova_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANOVA F against the return flag; the best five are selected."""
    rep = features.anova_report(table(spark, sf_dir, "lineitem"), "l_returnflag", KBEST_COLS, 5)
    return rounded(rep, ["f_score"])


def embedding_frame(spark: SparkSession, sf_dir: str):
    emb = table(spark, sf_dir, "embeddings")
    lengths = emb.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if lengths["low"] != lengths["high"]:
        raise ValueError(f"embeddings have {lengths['low']} to {lengths['high']} components")
    return features.array_columns(emb, "embedding", "e", lengths["high"])


@register("pca_embeddings")
def pca_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred PCA, 3 components, target carried."""
    wide, cols = embedding_frame(spark, sf_dir)
    model = features.fit_pca(wide, cols, 3)
    return rounded(model.transform(wide, ["vec_id", "label"]), ["PC1", "PC2", "PC3"])


@register("lda_embeddings")
def lda_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First linear discriminant of the 64-d embeddings by label."""
    wide, cols = embedding_frame(spark, sf_dir)
    model = features.fit_lda(wide, "label", cols, 1)
    return rounded(model.transform(wide, ["vec_id", "label"]), ["LD1"])


@register("rfe_lineitem")
def rfe_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive elimination with logistic regression down to 5."""
    li = table(spark, sf_dir, "lineitem")
    chosen = features.rfe_select(li, "l_returnflag", KBEST_COLS, 5)
    return spark.createDataFrame([(c,) for c in chosen], "column_name string")


# ============================================== training, evaluation, prediction

@register("split_orders",
          "SELECT 'test' AS split, CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS n_rows, "
          "CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS n_keys, 0::BIGINT AS n_in_both FROM orders "
          "UNION ALL SELECT 'train' AS split, count(*) - CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT), "
          "count(DISTINCT o_orderkey) - CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT), 0::BIGINT FROM orders")
def split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: exact ceil(0.2 n) test rows, seeded hash order."""
    o = table(spark, sf_dir, "orders")
    marked = train.split_column(o, 0.2, 42, ["o_orderkey"])
    sides = marked.groupBy("o_orderkey").agg(F.countDistinct("split").alias("sides"))
    return marked.join(sides, "o_orderkey").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys"),
        F.count_if(F.col("sides") > 1).alias("n_in_both"))


def _sql_folds(k: int = 5, by_key: bool = False) -> str:
    return f"""
WITH cls AS (SELECT o_orderstatus, min(o_orderkey) AS first_key, count(*) AS n FROM orders
             WHERE o_orderstatus IS NOT NULL GROUP BY 1),
st AS (SELECT o_orderstatus, n, coalesce(sum(n) OVER (ORDER BY first_key ROWS BETWEEN UNBOUNDED PRECEDING
       AND 1 PRECEDING), 0) AS s0 FROM cls),
al AS (SELECT o_orderstatus, r.i,
         (CASE WHEN s0 + n > r.i THEN (s0 + n - r.i + {k - 1}) // {k} ELSE 0 END)
       - (CASE WHEN s0 > r.i THEN (s0 - r.i + {k - 1}) // {k} ELSE 0 END) AS a
       FROM st, (SELECT range AS i FROM range({k})) r),
cum AS (SELECT o_orderstatus, i, sum(a) OVER (PARTITION BY o_orderstatus ORDER BY i) AS c FROM al),
rw AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS j
       FROM orders WHERE o_orderstatus IS NOT NULL),
f AS (SELECT rw.o_orderkey, rw.o_orderstatus, (SELECT count(*) FROM cum WHERE cum.o_orderstatus = rw.o_orderstatus
        AND cum.i < {k - 1} AND cum.c <= rw.j) AS fold FROM rw)
""" + ("SELECT o_orderkey, CAST(fold AS INTEGER) AS fold FROM f" if by_key else
       "SELECT o_orderstatus, CAST(fold AS INTEGER) AS fold, count(*) AS n_rows FROM f GROUP BY 1, 2")


@register("stratified_folds_orders", _sql_folds())
def stratified_folds_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 folds: scikit-learn's unshuffled stratified 5-fold assignment."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    folded = train.stratified_folds(o, "o_orderstatus", 5, ["o_orderkey"])
    return folded.groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


@register("stratified_fold_keys_orders", _sql_folds(by_key=True))
def stratified_fold_keys_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of every row."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return train.stratified_folds(o, "o_orderstatus", 5, ["o_orderkey"]).select("o_orderkey", "fold")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training table: document features with the quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")


def _train_query(algorithm: str, cv: int | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = labelled_documents(spark, sf_dir).select("doc_id", "n_chars", "lang", "source",
                                                         "toxic", "quality")
        result = train.train_model(data, "quality", algorithm, 0.2, cv, key=["doc_id"],
                                   features=["n_chars", "lang", "source", "toxic"])
        rows = [("accuracy", float(result.accuracy))]
        if isinstance(result.cv_scores, list):
            rows += [(f"cv_fold_{i}", float(s)) for i, s in enumerate(result.cv_scores)]
        return spark.createDataFrame(rows, "metric string, value double")
    run.__doc__ = f"M3-M11: train {algorithm} on labelled documents; hold-out accuracy."
    return run


for _algo, _cv in (("logistic_regression", 5), ("random_forest", None),
                   ("decision_tree", None), ("neural_network", None), ("xgboost", None),
                   ("svm", None), ("knn", None)):
    register(f"train_{_algo}_documents")(_train_query(_algo, _cv))


@register("train_evaluate_embeddings")
def train_evaluate_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2/M3 + V1-V3 on a 10-class problem: multinomial logistic regression
    on the 64-d embeddings, evaluated on the held-out split (macro OvR AUC)."""
    wide, _ = embedding_frame(spark, sf_dir)
    data = wide.withColumn("label_name", F.col("label").cast("string")).drop("label")
    marked = train.split_column(data, 0.2, 42, ["vec_id"], "_split")
    tr = marked.where(F.col("_split") == "train").drop("_split", "vec_id")
    te = marked.where(F.col("_split") == "test").drop("_split", "vec_id")
    model, _, labels = train.fit_pipeline(tr, "label_name", "logistic_regression")
    return evaluate.evaluate(model.transform(te), "label_name", labels=labels)


@register("predict_documents")
def predict_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model trained on the labelled documents scores every document."""
    from tessera.operators.predict import predict

    data = labelled_documents(spark, sf_dir).select("n_chars", "lang", "source", "quality")
    model, used, _ = train.fit_pipeline(data, "quality", "logistic_regression")
    docs = table(spark, sf_dir, "documents")
    types = {f.name: f.dataType.simpleString() for f in data.schema.fields}
    return predict(model, docs, used, types, keep=["doc_id"])


RULE_SQL = ("(SELECT CAST(quality AS VARCHAR) AS actual, CASE WHEN n_chars >= 2000 THEN '1' ELSE '0' END "
            "AS predicted, n_chars FROM documents JOIN labels USING (doc_id))")
LANG_RULE_SQL = ("(SELECT lang AS actual, CASE WHEN n_chars < 1000 THEN 'en' WHEN n_chars < 3000 THEN 'fr' "
                 "ELSE 'de' END AS predicted FROM documents)")


def _rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled_documents(spark, sf_dir)
    return d.select(F.col("quality").cast("string").alias("actual"),
                    F.when(F.col("n_chars") >= 2000, F.lit("1")).otherwise(F.lit("0"))
                    .alias("predicted"), "n_chars")


def _lang_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("actual"),
                    F.when(F.col("n_chars") < 1000, F.lit("en"))
                    .when(F.col("n_chars") < 3000, F.lit("fr")).otherwise(F.lit("de"))
                    .alias("predicted"))


def _sql_report(src: str) -> str:
    return f"""
WITH cm AS (SELECT actual, predicted, count(*) AS n FROM {src} p GROUP BY ALL),
cls AS (SELECT actual AS c FROM cm UNION SELECT predicted AS c FROM cm),
per AS (SELECT c,
  coalesce((SELECT sum(n) FROM cm WHERE actual = c), 0) AS support,
  coalesce((SELECT sum(n) FROM cm WHERE predicted = c), 0) AS npred,
  coalesce((SELECT sum(n) FROM cm WHERE actual = c AND predicted = c), 0) AS tp FROM cls),
m AS (SELECT support, tp, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS pr,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM per),
r AS (
SELECT 'accuracy' AS metric, sum(tp) / sum(support) AS value FROM m
UNION ALL SELECT 'precision', sum(support * pr) / sum(support) FROM m
UNION ALL SELECT 'recall', sum(support * rc) / sum(support) FROM m
UNION ALL SELECT 'f1', sum(support * CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END)
  / sum(support) FROM m)
{sql_select_rounded('r', ['metric'], ['value'])}"""


def _report_rows(report: DataFrame) -> DataFrame:
    out = report.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
        for m in ("accuracy", "precision", "recall", "f1")])).alias("r")).select("r.*")
    return rounded(out, ["value"])


@register("evaluate_rule_documents", _sql_report(RULE_SQL))
def evaluate_rule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1/V2: accuracy and weighted precision/recall/F1 of a rule."""
    return _report_rows(evaluate.classification_report(_rule_predictions(spark, sf_dir),
                                                       "actual", "predicted"))


@register("evaluate_lang_rule_documents", _sql_report(LANG_RULE_SQL))
def evaluate_lang_rule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 with four classes, one never predicted (zero division -> 0)."""
    return _report_rows(evaluate.classification_report(_lang_predictions(spark, sf_dir),
                                                       "actual", "predicted"))


@register("roc_auc_documents", sql_select_rounded(f"""(
SELECT (sum(CASE WHEN y = 1 THEN mid ELSE 0 END) - p * (p + 1) / 2.0) / (p * (n - p)) AS roc_auc
FROM (SELECT y, (rank() OVER (ORDER BY s) + rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) - 1)
             / 2.0 AS mid, sum(y) OVER () AS p, count(*) OVER () AS n
      FROM (SELECT CASE WHEN actual = '1' THEN 1 ELSE 0 END AS y, CAST(n_chars AS DOUBLE) AS s
            FROM {RULE_SQL} q) a) b GROUP BY p, n) t""", [], ["roc_auc"]))
def roc_auc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: exact AUC of n_chars as a score for quality (ties mid-ranked)."""
    preds = _rule_predictions(spark, sf_dir)
    return rounded(evaluate.binary_auc(preds, F.col("actual") == "1", F.col("n_chars")),
                   ["roc_auc"])


@register("confusion_lang_documents",
          f"SELECT actual, predicted, count(*) AS \"count\" FROM {LANG_RULE_SQL} p GROUP BY ALL")
def confusion_lang_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: confusion counts."""
    return evaluate.confusion_matrix(_lang_predictions(spark, sf_dir), "actual", "predicted")


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@register("catalog_tables", " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parquet datasets of a folder from a file listing, each counted."""
    from tessera.sources.catalog import list_tables

    out = None
    for name in sorted(r["name"] for r in list_tables(spark, sf_dir).select("name").collect()):
        counted = spark.read.parquet(f"{sf_dir}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"))
        out = counted if out is None else out.unionByName(counted)
    return out.select("name", "n_rows")


# ======================================================= end-to-end requests

def _sql_lambda(kind: str) -> str:
    """Lambda by nested grids over the conditioned likelihood."""
    if kind == "boxcox":
        base = ("v AS (SELECT ln(c_acctbal + CASE WHEN lo <= 0 THEN 1 - lo ELSE 0 END) AS a FROM customer, "
                "(SELECT min(c_acctbal) AS lo FROM customer) m), m AS (SELECT avg(a) AS mu, count(*) AS n FROM v), "
                "x AS (SELECT a - mu AS u FROM v, m)")
        value, extra = "CASE WHEN abs(l) < 1e-9 THEN u ELSE (exp(l * u) - 1) / l END", "0"
    else:
        base = ("x AS (SELECT c_acctbal AS u FROM customer), m AS (SELECT count(*) AS n, "
                "sum(sign(u) * ln(1 + abs(u))) AS g FROM x)")
        value = ("CASE WHEN u >= 0 THEN CASE WHEN abs(l) < 1e-9 THEN ln(1 + u) ELSE (pow(1 + u, l) - 1) / l END "
                 "ELSE CASE WHEN abs(2 - l) < 1e-9 THEN -ln(1 - u) ELSE -(pow(1 - u, 2 - l) - 1) / (2 - l) END END")
        extra = "(l - 1) * max(g)"
    steps, centre = [], "SELECT 0.0::DOUBLE AS c"
    for i, (points, width) in enumerate(((60, 0.05), (60, 0.001), (60, 0.00002))):
        steps.append(f"g{i} AS (SELECT c + r.range * {width} AS l FROM ({centre}) s, range(-{points}, {points + 1}) r)")
        steps.append(f"f{i} AS (SELECT l, {extra} - max(n) / 2.0 * ln(var_pop({value})) AS f FROM g{i}, x, m GROUP BY l)")
        centre = f"SELECT l AS c FROM f{i} ORDER BY f DESC, l LIMIT 1"
    return f"WITH {base}, {', '.join(steps)} SELECT '{kind}' AS kind, round(c, 2) AS lambda FROM ({centre}) b"


@register("power_lambda_customer", f"SELECT * FROM ({_sql_lambda('boxcox')}) a UNION ALL SELECT * FROM ({_sql_lambda('yeojohnson')}) b")
def power_lambda_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3/K4: the maximum-likelihood lambdas (two digits)."""
    data = table(spark, sf_dir, "customer").select("c_acctbal")
    found = [(kind, round(skew.fit_power(data, ["c_acctbal"], kind).params["c_acctbal"][1], 2))
             for kind in ("boxcox", "yeojohnson")]
    return spark.createDataFrame(found, "kind string, lambda double")


def _sql_power_values() -> str:
    """Both transforms of the balance, at their lambdas of two digits."""
    def power(base: str, k: str) -> str:
        return f"CASE WHEN abs({k}) < 1e-12 THEN ln({base}) ELSE (pow({base}, {k}) - 1) / ({k}) END"

    boxcox = power("a + CASE WHEN lo <= 0 THEN 1 - lo ELSE 0 END", "b")
    johnson = f"CASE WHEN a >= 0 THEN {power('1 + a', 'y')} ELSE -({power('1 - a', '2 - y')}) END"
    return (f"SELECT c_custkey, {sql_num(boxcox)} AS boxcox, {sql_num(johnson)} AS yeojohnson FROM "
            f"(SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS a, min(CAST(c_acctbal AS DOUBLE)) OVER () AS lo FROM customer) c, "
            f"(SELECT \"lambda\" AS b FROM ({_sql_lambda('boxcox')}) p) l, (SELECT \"lambda\" AS y FROM ({_sql_lambda('yeojohnson')}) q) m")


@register("power_values_customer", _sql_power_values())
def power_values_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every balance transformed, at lambdas of two digits."""
    data = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_acctbal").alias("boxcox"),
                                                   F.col("c_acctbal").alias("yeojohnson"))
    for kind in ("boxcox", "yeojohnson"):
        shift, lam = skew.fit_power(data, [kind], kind).params[kind]
        data = skew.PowerTransform(kind, {kind: (shift, round(lam, 2))}).transform(data)
    return rounded(data.drop("c_acctbal"), ["boxcox", "yeojohnson"])


PRE_CONFIG = {
    "target_column": "quality", "missing_strategy": "mean", "missing_columns": ["quality", "toxic"],
    "missing_indicator": True, "outlier_method": "clip", "outlier_columns": ["n_chars"],
    "outlier_detection": "iqr", "skewness_method": "log", "skewness_columns": ["n_chars"],
    "encoding_method": "frequency", "encoding_columns": ["lang", "source"], "scaler": "standard",
    "scaling_columns": ["n_chars", "toxic", "lang", "source"], "duplicate_handling": "drop"}
PRE_DOUBLES = ["n_chars", "lang", "source", "quality", "toxic"]


def _sql_preprocess() -> str:
    def freq(c: str) -> str:
        return (f"(SELECT f.share FROM (SELECT {c} AS v, count(*) / sum(count(*)) OVER () AS share "
                f"FROM sk WHERE {c} IS NOT NULL GROUP BY 1) f WHERE f.v = sk.{c})")

    def std(c: str) -> str:
        return (f"({c} - (SELECT avg({c}) FROM enc)) / (SELECT CASE WHEN stddev_pop({c}) > 0 "
                f"THEN stddev_pop({c}) ELSE 1.0 END FROM enc)")

    return f"""
WITH b AS (SELECT doc_id, n_chars, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
imp AS (SELECT doc_id, n_chars, lang, source,
        coalesce(CAST(quality AS DOUBLE), (SELECT avg(quality) FROM b)) AS quality,
        coalesce(CAST(toxic AS DOUBLE), (SELECT avg(toxic) FROM b)) AS toxic,
        CAST(quality IS NULL AS INTEGER) AS quality_missing,
        CAST(toxic IS NULL AS INTEGER) AS toxic_missing FROM b),
fe AS (SELECT q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi
       FROM (SELECT quantile_cont(CAST(n_chars AS DOUBLE), [0.25, 0.75]) AS q FROM imp) s),
cl AS (SELECT doc_id, least(greatest(CAST(n_chars AS DOUBLE), lo), hi) AS n_chars, lang, source,
              quality, toxic, quality_missing, toxic_missing FROM imp, fe),
sk AS (SELECT doc_id, ln(1 + (n_chars - (SELECT min(n_chars) FROM cl) + 1.0)) AS n_chars, lang, source,
              quality, toxic, quality_missing, toxic_missing FROM cl),
enc AS (SELECT doc_id, n_chars, {freq('lang')} AS lang, {freq('source')} AS source,
               quality, toxic, quality_missing, toxic_missing FROM sk),
sc AS (SELECT DISTINCT doc_id, {std('n_chars')} AS n_chars, {std('lang')} AS lang,
              {std('source')} AS source, quality, {std('toxic')} AS toxic, quality_missing, toxic_missing
       FROM enc)
{sql_select_rounded('sc', ['doc_id', 'quality_missing', 'toxic_missing'], PRE_DOUBLES)}"""


@register("preprocess_documents", _sql_preprocess())
def preprocess_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's preprocessing request end to end (impute with
    indicators, clip, log skew, frequency encoding, standard scaling,
    de-duplication) on documents LEFT JOIN labels."""
    from tessera.plans.preprocess import preprocess

    base = docs_labels(spark, sf_dir).select("doc_id", "n_chars", "lang", "source", "quality", "toxic")
    return rounded(preprocess(base, PRE_CONFIG), PRE_DOUBLES)


FE_COLS = ["l_quantity", "l_discount", "l_tax"]


def _sql_engineer() -> str:
    terms = features.polynomial_names(FE_COLS, True)
    names = [t[0] if len(t) == 1 else f"{t[0]} {t[1]}" for t in terms]
    exprs = [f"CAST({t[0]} AS DOUBLE)" if len(t) == 1 else f"CAST({t[0]} AS DOUBLE) * CAST({t[1]} AS DOUBLE)"
             for t in terms]
    gen = ", ".join(f"{e} AS {_q(n)}" for e, n in zip(exprs, names))
    var = union_all([f"SELECT '{n}' AS feature, var_pop({_q(n)}) AS v FROM g" for n in names])
    long = union_all([f"SELECT l_orderkey, l_linenumber, l_returnflag, '{n}' AS feature, {_q(n)} AS value FROM g"
                      for n in names])
    return f"""
WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag, {gen} FROM lineitem),
v AS ({var}),
lf AS ({long}),
r AS (SELECT lf.* FROM lf JOIN v USING (feature) WHERE v.v > 0.01)
{sql_select_rounded('r', ['l_orderkey', 'l_linenumber', 'l_returnflag', 'feature'], ['value'])}"""


@register("engineer_lineitem", _sql_engineer())
def engineer_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's feature-engineering request: interaction features,
    then variance selection, target and row keys carried; returned in long
    form (row keys, feature, value)."""
    from tessera.plans.engineering import engineer

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *FE_COLS)
    result = engineer(li, "interaction", "variance", "none", "l_returnflag",
                      carry=("l_orderkey", "l_linenumber"))
    ids = ["l_orderkey", "l_linenumber", "l_returnflag"]
    feats = [c for c in result.columns if c not in ids]
    long = result.frame.unpivot(ids, feats, "feature", "value")
    return rounded(long, ["value"])


_ORDERS_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
                 "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@register("columns_orders", " UNION ALL ".join(
    f"SELECT {i}::INTEGER AS position, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS n_values FROM orders"
    for i, (c, t) in enumerate(_ORDERS_TYPES.items())))
def columns_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset's columns and types, with the values that each holds."""
    from tessera.sources.files import dataset_columns

    orders = table(spark, sf_dir, "orders")
    values = orders.agg(*[F.count(c).alias(c) for c in orders.columns]).unpivot(
        [], orders.columns, "column_name", "n_values")
    return dataset_columns(orders).join(F.broadcast(values), "column_name").select(
        "position", "column_name", "data_type", "n_values")


@register("smote_documents",
          "SELECT quality, CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM documents JOIN labels "
          "USING (doc_id) GROUP BY quality)) AS BIGINT) AS n_rows, 0::BIGINT AS n_outside FROM documents JOIN labels "
          "USING (doc_id) WHERE quality IS NOT NULL GROUP BY quality")
def smote_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMOTE on (n_chars, toxic) by quality; every class reaches the
    majority count (synthetic rows interpolate same-class neighbours)."""
    data = labelled_documents(spark, sf_dir).select("doc_id", "n_chars", "toxic", "quality")
    out = balance.balance(data, "smote", "quality", key=["doc_id"], features=["n_chars", "toxic"])
    # Rows outside their class's range can't lie between two of its rows.
    reach = data.groupBy("quality").agg(*[f(c).alias(f"{c}_{n}") for c in ("n_chars", "toxic") for n, f in (("lo", F.min), ("hi", F.max))])
    inside = (F.col("n_chars").between(F.col("n_chars_lo"), F.col("n_chars_hi"))
              & F.col("toxic").between(F.col("toxic_lo"), F.col("toxic_hi")))
    return out.join(reach, "quality").groupBy("quality").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~inside).alias("n_outside"))


# Registered when everything above stands.
from tessera import model_workloads  # noqa: E402, F401
