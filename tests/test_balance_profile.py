import numpy as np
import pandas as pd
import pytest

from tessera.operators import balance, profile


@pytest.fixture
def unbalanced(spark):
    rng = np.random.default_rng(11)
    n = 230
    target = np.where(np.arange(n) < 30, "rare", np.where(np.arange(n) < 80, "mid", "common"))
    pdf = pd.DataFrame({"key": np.arange(n), "f1": rng.normal(size=n), "f2": rng.normal(size=n),
                        "target": target})
    return spark.createDataFrame(pdf)


def test_undersample_exact_counts_no_repeats(spark, unbalanced):
    out = balance.balance(unbalanced, "undersample", "target", key=["key"])
    rows = out.collect()
    counts = pd.Series([r["target"] for r in rows]).value_counts()
    assert set(counts) == {30}
    keys = [r["key"] for r in rows]
    assert len(keys) == len(set(keys))
    again = sorted(r["key"] for r in balance.balance(unbalanced, "undersample", "target",
                                                     key=["key"]).collect())
    assert again == sorted(keys)  # seeded: repeatable


def test_oversample_keeps_originals_and_equalises(spark, unbalanced):
    out = balance.balance(unbalanced, "oversample", "target", key=["key"]).toPandas()
    assert set(out.target.value_counts()) == {150}
    assert set(out.key) == set(range(230))
    rare = out[out.target == "rare"]
    assert set(rare.key) <= set(range(30))


def test_describe_matches_pandas(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, None, 4.0, 10.0], "s": ["a", "b", "b", None, "a"]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "x double, s string")
    rep = {r["column_name"]: r for r in profile.describe(df).collect()}
    d = pdf.x.describe()
    assert rep["x"]["count"] == 4
    assert rep["x"]["mean"] == pytest.approx(d["mean"])
    assert rep["x"]["std"] == pytest.approx(d["std"])
    assert rep["x"]["p25"] == pytest.approx(d["25%"]) and rep["x"]["p75"] == pytest.approx(d["75%"])
    assert (rep["s"]["count"], rep["s"]["unique"], rep["s"]["top"], rep["s"]["freq"]) == (4, 2, "a", 2)


def test_correlation_distribution_match_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.exponential(size=200)})
    pdf["c"] = pdf.a * 2 + rng.normal(size=200)
    pdf.loc[3, "b"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    corr = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.correlation(df).collect()}
    exp = pdf.corr()
    for a in "abc":
        for b in "abc":
            assert corr[(a, b)] == pytest.approx(exp.loc[a, b], abs=1e-12)
    dist = {r["column_name"]: r for r in profile.distribution(df).collect()}
    for c in "abc":
        s = pdf[c].dropna()
        assert dist[c]["skewness"] == pytest.approx(s.skew(), rel=1e-9)
        assert dist[c]["kurtosis"] == pytest.approx(s.kurt(), rel=1e-9)
        assert 0 <= dist[c]["normality_p"] <= 1


def test_missing_duplicates_counts_balance(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "b")], "k long, s string")
    miss = {r["column_name"]: (r["missing_count"], r["missing_pct"]) for r in profile.missing(df).collect()}
    assert miss["s"] == (2, 40.0) and miss["k"] == (0, 0.0)
    dup = profile.duplicates(df).first()
    assert (dup["total_rows"], dup["duplicates"], dup["duplicate_pct"]) == (5, 2, 40.0)
    counts = {(r["column_name"], r["value"]): r["count"] for r in profile.categorical_counts(df).collect()}
    assert counts == {("s", "a"): 2, ("s", "b"): 1}
    bal = {r["class"]: r["count"] for r in profile.class_balance(df, "k").collect()}
    assert bal == {1: 2, 2: 2, 3: 1}
    with pytest.raises(ValueError):
        profile.class_balance(df, "target")


def test_outliers_skewness_pairbins(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 3.0, 4.0, 100.0, None], "y": [1.0, 1.0, 2.0, 2.0, 3.0, 3.0]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "x double, y double")
    out = {r["column_name"]: r for r in profile.outlier_summary(df).collect()}
    assert out["x"]["outlier_count"] == 1
    assert out["x"]["outlier_pct"] == pytest.approx(100 / 6)
    sk = {r["column_name"]: r for r in profile.skewness_check(df).collect()}
    assert sk["x"]["skewness"] == pytest.approx(pdf.x.skew())
    assert sk["x"]["boxcox_applicable"] is False  # a missing value is not > 0
    assert sk["y"]["boxcox_applicable"] is False  # |skew| <= 0.5
    bins = profile.pair_bins(df, ["y"], bins=2).collect()
    assert sorted((r["bin_a"], r["count"]) for r in bins) == [(0, 2), (1, 4)]
