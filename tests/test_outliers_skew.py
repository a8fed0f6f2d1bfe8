import numpy as np
import pandas as pd
import pytest

from tessera.operators import outliers, skew


@pytest.fixture
def skewed(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.lognormal(0, 1, 400), [-3.0, 0.0, 55.0, 80.0]])
    pdf = pd.DataFrame({"id": np.arange(len(x)), "x": x, "y": rng.normal(10, 2, len(x))})
    return pdf, spark.createDataFrame(pdf)


def test_clip_iqr_matches_pandas_and_is_idempotent(spark, skewed):
    pdf, df = skewed
    out = outliers.clip_outliers(df, ["x", "y"], "iqr")
    got = out.orderBy("id").toPandas()
    for c in ("x", "y"):
        q1, q3 = pdf[c].quantile(0.25), pdf[c].quantile(0.75)
        exp = np.clip(pdf[c], q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        np.testing.assert_allclose(got[c], exp, rtol=1e-12)
    again = outliers.clip_outliers(out, ["x"], "iqr").orderBy("id").toPandas()
    assert again["x"].max() <= got["x"].max() + 1e-12


def test_clip_zscore_is_asymmetric(spark, skewed):
    pdf, df = skewed
    got = outliers.clip_outliers(df, ["x"], "zscore").orderBy("id").toPandas()
    z = np.abs((pdf.x - pdf.x.mean()) / pdf.x.std())
    exp = np.clip(pdf.x, pdf.x.min(), pdf.x[z < 3].max())
    np.testing.assert_allclose(got["x"], exp, rtol=1e-12)


def test_remove_sequential_matches_pandas_loop(spark, skewed):
    pdf, df = skewed
    exp = pdf.copy()
    for c in ("x", "y"):
        q1, q3 = exp[c].quantile(0.25), exp[c].quantile(0.75)
        exp = exp[(exp[c] >= q1 - 1.5 * (q3 - q1)) & (exp[c] <= q3 + 1.5 * (q3 - q1))]
    got = outliers.remove_outliers(df, ["x", "y"], "iqr")
    assert sorted(r["id"] for r in got.collect()) == sorted(exp.id.tolist())
    exp = pdf.copy()
    for c in ("x", "y"):
        exp = exp[np.abs((exp[c] - exp[c].mean()) / exp[c].std()) < 3]
    got = outliers.remove_outliers(df, ["x", "y"], "zscore")
    assert sorted(r["id"] for r in got.collect()) == sorted(exp.id.tolist())


def test_transform_log_sqrt_out_of_domain_is_null(spark):
    df = spark.createDataFrame([(1, -2.0), (2, 3.0)], "id long, x double")
    log = {r["id"]: r["x"] for r in outliers.transform_outliers(df, ["x"], "log").collect()}
    assert log[1] is None and abs(log[2] - np.log1p(3.0)) < 1e-12
    sq = {r["id"]: r["x"] for r in outliers.transform_outliers(df, ["x"], "sqrt").collect()}
    assert sq[1] is None and abs(sq[2] - np.sqrt(3.0)) < 1e-12


def test_unknown_detection_raises(spark, skewed):
    with pytest.raises(ValueError):
        outliers.clip_outliers(skewed[1], ["x"], "mad")


def _boxcox_llf(lam, x):
    y = np.log(x) if lam == 0 else (x ** lam - 1) / lam
    return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())


def _yj(x, lam):
    out = np.empty_like(x)
    p = x >= 0
    out[p] = np.log1p(x[p]) if lam == 0 else ((x[p] + 1) ** lam - 1) / lam
    out[~p] = -np.log1p(-x[~p]) if lam == 2 else -((1 - x[~p]) ** (2 - lam) - 1) / (2 - lam)
    return out


def _yj_llf(lam, x):
    return -len(x) / 2 * np.log(_yj(x, lam).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def _golden(f, lo, hi, tol=1e-10):
    g = (np.sqrt(5) - 1) / 2
    a, b = lo, hi
    while b - a > tol:
        c, d = b - g * (b - a), a + g * (b - a)
        if f(c) > f(d):
            b = d
        else:
            a = c
    return (a + b) / 2


def test_boxcox_lambda_matches_brute_force(spark, skewed):
    pdf, df = skewed
    fitted = skew.fit_power(df, ["x"], "boxcox")
    shift, lam = fitted.params["x"]
    x = pdf.x.to_numpy()
    assert shift == pytest.approx(1 - x.min())
    x = x + shift
    best = _golden(lambda l: _boxcox_llf(l, x), -2, 2)
    assert lam == pytest.approx(best, abs=1e-5)
    got = fitted.transform(df).orderBy("id").toPandas()["x"].to_numpy()
    np.testing.assert_allclose(got, (x ** lam - 1) / lam, rtol=1e-9)


def test_yeojohnson_lambda_matches_brute_force(spark, skewed):
    pdf, df = skewed
    fitted = skew.fit_power(df, ["x", "y"], "yeojohnson")
    for c in ("x", "y"):
        x = pdf[c].to_numpy()
        best = _golden(lambda l: _yj_llf(l, x), -4, 6)
        assert fitted.params[c][1] == pytest.approx(best, abs=1e-5)


def test_skew_log_sqrt_shifted(spark, skewed):
    pdf, df = skewed
    got = skew.handle_skewness(df, "log", ["x"]).orderBy("id").toPandas()
    np.testing.assert_allclose(got.x, np.log1p(pdf.x - pdf.x.min() + 1), rtol=1e-12)
    got = skew.handle_skewness(df, "sqrt", ["x"]).orderBy("id").toPandas()
    np.testing.assert_allclose(got.x, np.sqrt(pdf.x - pdf.x.min()), rtol=1e-12)


def test_sorted_quantiles_match_pandas(spark):
    from tessera.functions.stats import quantiles

    rng = np.random.default_rng(17)
    pdf = pd.DataFrame({"a": rng.normal(size=999), "b": rng.integers(0, 4, 999).astype(float),
                        "c": np.full(999, 2.5)})
    pdf.loc[[3, 50], "a"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles(df, ["a", "b", "c"], probs)
    for c in "abc":
        np.testing.assert_allclose(got[c], [pdf[c].quantile(p) for p in probs], rtol=1e-12)
    empty = quantiles(df.limit(0), ["a"], probs)
    assert empty == {"a": [None] * len(probs)}


def test_quantiles_of_any_doubles(spark):
    """Values of all sizes and signs, hot values, neighbours one bit apart."""
    from tessera.functions.stats import quantiles

    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({
        "wide": rng.choice([-1.0, 1.0], n) * np.exp(rng.normal(size=n) * 150),
        "tiny": rng.normal(size=n) * 1e-310,
        "hot": np.where(rng.random(n) < 0.4, 7.25, 7.25 + rng.integers(0, 2**20, n) * 2.0**-50),
        "zero": rng.choice([0.0, -0.0, 1.0, -1.0], n),
        "gaps": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n)),
        "endless": rng.choice([np.inf, -np.inf, 3.0], n)})
    probs = [0.0, 0.2, 0.5, 0.9, 1.0]
    got = quantiles(spark.createDataFrame(pdf).repartition(7), list(pdf.columns), probs)
    for c in pdf.columns:
        v = np.sort(pdf[c].dropna().to_numpy())
        for p, q in zip(probs, got[c]):
            h = (len(v) - 1) * p
            a, b = v[int(h)], v[min(int(h) + 1, len(v) - 1)]
            part = h - int(h)
            assert q == (a + (b - a) * part if part and a != b else a)


def test_quantiles_need_no_sort(spark, monkeypatch):
    from tessera.functions import stats

    plans, cells = [], stats._cells

    def spied(rows):
        counted = rows.groupBy("_g", "_k").count()
        plans.append(counted._jdf.queryExecution().executedPlan().toString())
        return cells(rows)

    monkeypatch.setattr(stats, "_cells", spied)
    df = spark.range(0, 200_000, 1, 8).selectExpr("sqrt(id) AS x", "id % 7 AS y")
    assert stats.quantiles(df, ["x", "y"], [0.5])["y"] == [3.0]
    assert 2 <= len(plans) <= 4
    for plan in plans:
        assert "partial_count" in plan and "Sort" not in plan and "rangepartitioning" not in plan
