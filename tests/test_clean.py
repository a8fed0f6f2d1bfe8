import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions.expressions import MISSING_TOKENS
from tessera.operators import clean


def test_standardize_missing_tokens_and_near_misses(spark):
    values = MISSING_TOKENS + ["NULL", "  ", "ok", None]
    df = spark.createDataFrame([(i, v, float("nan") if i == 0 else 1.0) for i, v in enumerate(values)],
                               "id long, s string, x double")
    out = {r["id"]: (r["s"], r["x"]) for r in clean.standardize_missing(df).collect()}
    for i, tok in enumerate(MISSING_TOKENS):
        assert out[i][0] is None, tok
    assert out[len(MISSING_TOKENS)][0] == "NULL"
    assert out[len(MISSING_TOKENS) + 1][0] == "  "
    assert out[len(MISSING_TOKENS) + 2][0] == "ok"
    assert out[0][1] is None  # NaN -> null


def test_drop_columns_ignores_unknown(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert clean.drop_columns(df, ["b", "zzz"]).columns == ["a"]


def test_missing_indicator_only_for_columns_with_nulls(spark):
    df = spark.createDataFrame([(1, None, 3.0), (2, 5.0, 4.0)], "id long, x double, y double")
    out = clean.add_missing_indicators(df, ["x", "y"])
    assert "x_missing" in out.columns and "y_missing" not in out.columns
    assert [r["x_missing"] for r in out.orderBy("id").collect()] == [1, 0]


def test_impute_mean_median_mode(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 4.0, None), (4, 10.0, "b"),
                                (5, None, "a")], "id long, x double, s string")
    mean = {r["id"]: r["x"] for r in clean.impute(df, "mean", ["x"]).collect()}
    assert mean[2] == 5.0
    med = {r["id"]: r["x"] for r in clean.impute(df, "median", ["x"]).collect()}
    assert med[2] == 4.0
    mode = {r["id"]: (r["x"], r["s"]) for r in clean.impute(df, "most_frequent", ["x", "s"]).collect()}
    # numeric tie between 1, 4, 10 -> smallest; string tie a/b -> smallest
    assert mode[2][0] == 1.0 and mode[3][1] == "a"
    dropped = clean.impute(df, "drop", ["x", "s"])
    assert sorted(r["id"] for r in dropped.collect()) == [1, 4]


def test_interpolate_matches_pandas_across_partitions(spark):
    rng = np.random.default_rng(7)
    n = 300
    x = rng.normal(size=n)
    x[rng.random(n) < 0.35] = np.nan
    x[:5] = np.nan
    x[-7:] = np.nan
    x[100:160] = np.nan
    pdf = pd.DataFrame({"id": np.arange(n) * 2 + 11, "x": x})
    rows = [(int(i), None if math.isnan(v) else float(v)) for i, v in zip(pdf.id, pdf.x)]
    df = spark.createDataFrame(rows, "id long, x double")
    out = clean.interpolate(df, ["x"], ["id"], num_partitions=9).orderBy("id").toPandas()
    exp = pdf["x"].interpolate()
    exp = exp.fillna(exp.mean())
    np.testing.assert_allclose(out["x"].to_numpy(dtype=float), exp.to_numpy(), rtol=1e-12, atol=1e-12)


def test_interpolate_fills_chunks_in_place(spark, monkeypatch):
    """Chunks of 16 rows, some without a known value, other columns carried;
    rows aren't sorted or shuffled again once they are in order."""
    monkeypatch.setattr(clean, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(9)
    n = 400
    x, k = rng.normal(size=n), rng.integers(0, 9, n).astype(float)
    x[rng.random(n) < 0.5] = np.nan
    x[60:150] = np.nan
    k[:40] = np.nan
    pdf = pd.DataFrame({"x": x, "k": k})
    rows = [(i, f"row {i}", None if math.isnan(a) else float(a), None if math.isnan(b) else int(b), [i]) for i, (a, b) in enumerate(zip(x, k))]
    df = spark.createDataFrame(rows, "id long, s string, x double, k int, l array<long>").repartition(5)
    made = clean.interpolate(df, ["x", "k"], ["id"], num_partitions=3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    out = made.orderBy("id").toPandas()
    want = pdf.interpolate()
    want = want.fillna(want.mean())
    np.testing.assert_allclose(out[["x", "k"]].to_numpy(dtype=float), want.to_numpy(), rtol=1e-12, atol=1e-12)
    assert out["s"].tolist() == [f"row {i}" for i in range(n)] and [list(v) for v in out["l"]] == [[i] for i in range(n)]


def test_interpolate_all_known_and_all_missing(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None)], "id long, x double, y double")
    out = clean.interpolate(df, ["x", "y"], ["id"]).orderBy("id").collect()
    assert [r["x"] for r in out] == [1.0, 2.0]
    assert [r["y"] for r in out] == [None, None]


def test_deduplicate_full_rows_and_keep_last_subset(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "b", 3.0)], "k long, s string, v double")
    assert clean.deduplicate(df, "drop").count() == 2  # nulls compare equal
    ev = spark.createDataFrame([(1, "u", 10), (2, "u", 30), (3, "u", 20), (4, "w", 5)],
                               "id long, user string, ts long")
    last = clean.deduplicate(ev, "keep_last", ["user"], ["ts"]).collect()
    assert sorted((r["user"], r["id"]) for r in last) == [("u", 2), ("w", 4)]
    first = clean.deduplicate(ev, "keep_first", ["user"], ["ts"]).collect()
    assert sorted((r["user"], r["id"]) for r in first) == [("u", 1), ("w", 4)]


def test_head_shape_fill_zero(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x", None) for i in range(10)],
                               "i long, s string, v double")
    assert [r["i"] for r in clean.head(df, 5, [F.col("i").desc()]).collect()] == [9, 8, 7, 6, 5]
    row = clean.shape(df).first()
    assert (row["rows"], row["columns"]) == (10, 3)
    filled = clean.fill_zero(df).where("i = 1").first()
    assert filled["s"] == "0" and filled["v"] == 0.0
