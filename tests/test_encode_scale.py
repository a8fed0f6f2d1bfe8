import numpy as np
import pandas as pd
import pytest

from tessera.operators import encode, scale


@pytest.fixture
def cats(spark):
    rows = [(1, "b", 10.0), (2, "a", 20.0), (3, None, 30.0), (4, "b", 40.0), (5, "c", None)]
    return spark.createDataFrame(rows, "id long, s string, y double")


def test_onehot_sorted_with_missing_category(spark, cats):
    out = encode.onehot(cats, ["s"])
    assert out.columns == ["id", "y", "s_a", "s_b", "s_c", "s_nan"]
    row = {r["id"]: r for r in out.collect()}
    assert (row[3]["s_nan"], row[3]["s_a"]) == (1.0, 0.0)
    assert row[1]["s_b"] == 1.0


def test_onehot_cardinality_guard(spark):
    df = spark.range(50).selectExpr("cast(id as string) as s")
    with pytest.raises(ValueError):
        encode.onehot(df, ["s"], max_categories=10)


def test_label_codes_missing_as_nan_text(spark, cats):
    codes = {r["id"]: r["s"] for r in encode.label_encode(cats, ["s"]).collect()}
    assert codes == {1: 1, 2: 0, 3: 3, 4: 1, 5: 2}  # a, b, c, nan


def test_target_and_frequency_encoding(spark, cats):
    t = {r["id"]: r["s"] for r in encode.target_encode(cats, ["s"], "y").collect()}
    assert t[1] == 25.0 and t[2] == 20.0
    assert t[3] == pytest.approx(25.0)  # missing category -> global mean
    assert t[5] == pytest.approx(25.0)  # all-missing category mean -> global mean
    f = {r["id"]: r["s"] for r in encode.frequency_encode(cats, ["s"]).collect()}
    assert f[1] == 0.5 and f[2] == 0.25 and f[3] is None


def test_scalers_match_reference_semantics(spark):
    pdf = pd.DataFrame({"id": range(6), "x": [1.0, 2.0, 3.0, 4.0, 100.0, None], "k": [5.0] * 6})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, x double, k double")
    x = pdf.x.dropna()
    std = scale.scale(df, "standard", ["x", "k"]).orderBy("id").toPandas()
    np.testing.assert_allclose(std.x[:5], (x - x.mean()) / x.std(ddof=0))
    assert std.x[5] is None or np.isnan(std.x[5])
    assert (std.k == 0).all()
    mm = scale.scale(df, "minmax", ["x", "k"]).orderBy("id").toPandas()
    np.testing.assert_allclose(mm.x[:5], (x - x.min()) / (x.max() - x.min()))
    assert (mm.k == 0).all()
    rb = scale.scale(df, "robust", ["x"]).orderBy("id").toPandas()
    np.testing.assert_allclose(rb.x[:5], (x - x.median()) / (x.quantile(0.75) - x.quantile(0.25)))
    nz = scale.scale(df, "normalize", ["k"]).orderBy("id").toPandas()
    assert (nz.k == 0).all()


def test_scaling_excludes_target(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 1.0)], "x double, target double")
    out = scale.scale(df, "minmax", None, target="target").collect()
    assert sorted(r["target"] for r in out) == [0.0, 1.0]
