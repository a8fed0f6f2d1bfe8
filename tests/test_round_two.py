"""Defects found by probing: each case here failed before."""

import csv
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import encode, evaluate, features, predict, scale, skew, train
from tessera.plans import preprocess
from tessera.sources import files


def three_classes(spark, n=240):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        k = i % 3
        x, y = rng.normal(size=2) * 0.4 + [(0, 0), (3, 0), (0, 3)][k]
        rows.append((i, float(x), float(y), "uvw"[k], k))
    return spark.createDataFrame(rows, "id long, x double, y double, seg string, cls int")


@pytest.mark.parametrize("algorithm", ["xgboost", "svm"])
def test_three_classes(spark, algorithm):
    df = three_classes(spark)
    options = {"maxIter": 5} if algorithm == "xgboost" else None
    model, _, labels = train.fit_pipeline(df, "cls", algorithm, ["x", "y"], options=options)
    scored = model.transform(df)
    assert train.accuracy_of(scored, "cls") > 0.95
    got = {r["metric"]: r["value"] for r in evaluate.evaluate(scored, "cls", labels=labels).collect()}
    assert got["roc_auc"] > 0.97
    total = scored.select(train.PROBABILITY).first()[0]
    assert len(total) == 3 and abs(sum(total) - 1) < 1e-9


def test_prediction_takes_missing_numbers_and_has_the_targets_type(spark):
    df = three_classes(spark)
    model, used, _ = train.fit_pipeline(df, "cls", "logistic_regression", ["x", "y", "seg"])
    new = spark.createDataFrame([(1, None, 3.0), (2, float("nan"), 0.0)], "id long, x double, y double")
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    out = predict.predict(model, new, used, types, ["id"], types["cls"])
    assert dict(out.dtypes) == {"id": "bigint", "prediction": "int"} and out.count() == 2


def test_unknown_category_is_all_zeros_and_missing_one_its_own(spark):
    df = spark.createDataFrame([(1.0, "u", "a"), (2.0, "v", "b"), (3.0, None, "a"), (4.0, "u", "b")], "x double, seg string, y string")
    model, _, _ = train.fit_pipeline(df, "y", "decision_tree")
    new = spark.createDataFrame([(1.0, "u"), (1.0, None), (1.0, "zzz")], "x double, seg string").withColumn("y", F.lit("a"))
    vectors = [r[0].toArray()[1:].tolist() for r in model.transform(new).select(train.FEATURES).collect()]
    assert sorted(map(sum, vectors)) == [0, 1, 1] and vectors[2] == [0, 0, 0] and vectors[0] != vectors[1]


@pytest.mark.parametrize("values", [
    [1000 + (i % 50) ** 2 / 100 for i in range(500)],
    [math.exp(0.3 * math.sin(i)) for i in range(400)],
    [1e6 + i for i in range(300)],
])
def test_boxcox_lambda_is_the_likelihoods_maximum(spark, values):
    x = np.array(values)
    u = np.log(x) - np.log(x).mean()

    def likelihood(lam):
        return -len(x) / 2 * np.log((np.expm1(lam * u) / lam).var())

    lam = skew.fit_power(spark.createDataFrame([(v,) for v in values], "x double"), ["x"]).params["x"][1]
    span = max(0.05, abs(lam) * 0.02)
    assert likelihood(lam) >= max(likelihood(lam - span), likelihood(lam + span))
    grid = np.linspace(-120, 120, 4801)
    best = max((likelihood(g), g) for g in grid if abs(g) > 1e-6)
    assert likelihood(lam) >= best[0] - 1e-6


def test_yeojohnson_lambda_for_one_sign(spark):
    x = np.array([1000 + (i % 50) ** 2 / 100 for i in range(500)])
    df = spark.createDataFrame([(float(v), float(-v)) for v in x], "x double, y double")
    params = skew.fit_power(df, ["x", "y"], "yeojohnson").params
    assert params["x"][1] < -20
    assert params["y"][1] == pytest.approx(2 - params["x"][1], rel=1e-3)


def test_no_column_is_not_every_column(spark):
    df = spark.createDataFrame([(1.0, "no"), (2.0, "yes")], "x double, y string")
    assert encode.encode(df, "onehot", []).columns == ["x", "y"]
    out = preprocess.preprocess(df, {"target_column": "y", "encoding_method": "label"})
    assert dict(out.dtypes)["y"] == "string"
    assert scale.scale(df, "standard", []).collect() == df.collect()


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, "u", "a"), (2.0, "v", "b"), (4.0, "u", "a"), (5.0, "v", "b")] * 5,
                               ["sepal.length", "a.b", "the.class"])
    out = preprocess.preprocess(df, {"encoding_method": "onehot", "encoding_columns": ["a.b"], "scaler": "robust",
                                     "outlier_method": "clip", "skewness_method": "yeojohnson"})
    assert {"sepal.length", "a.b_u", "a.b_v"} <= set(out.columns) and out.count() == 20
    assert features.kbest_select(df, "the.class").columns == ["sepal.length", "the.class"]
    model, used, _ = train.fit_pipeline(df, "the.class", "decision_tree")
    assert used == ["sepal.length", "a.b"] and train.accuracy_of(model.transform(df), "the.class") == 1.0


def test_anova_of_perfect_and_single_classes(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0, "a"), (1.0, 2.0, 2.0, "a"), (3.0, 1.5, 2.0, "b"), (3.0, 2.5, 2.0, "b")],
                               "p double, q double, c double, y string")
    got = {r["column_name"]: r for r in features.anova_report(df, "y", k=1).collect()}
    assert got["p"]["f_score"] == float("inf") and got["p"]["selected"] and got["c"]["f_score"] is None
    one = features.anova_report(df.filter("y = 'a'"), "y", k=1).collect()
    assert all(r["f_score"] is None for r in one)


def test_auc_of_an_absent_class_leaves_the_other_metrics(spark):
    df = three_classes(spark)
    model, _, labels = train.fit_pipeline(df, "cls", "logistic_regression", ["x", "y"])
    part = model.transform(df.filter("cls < 2"))
    got = {r["metric"]: r["value"] for r in evaluate.evaluate(part, "cls", labels=labels).collect()}
    assert got["roc_auc"] is None and got["accuracy"] > 0.9
    without = {r["metric"]: r["value"] for r in evaluate.evaluate(part.drop(train.PROBABILITY), "cls", labels=labels).collect()}
    assert without["roc_auc"] is None and without["f1"] > 0.9


def test_auc_counts_shared_scores(spark):
    rng = np.random.default_rng(1)
    score, label = rng.integers(0, 4, 2000) / 4, rng.integers(0, 2, 2000)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "s double, y int")
    ranks = pd.Series(score).rank().to_numpy()
    n1, n0 = label.sum(), (1 - label).sum()
    want = (ranks[label == 1].sum() - n1 * (n1 + 1) / 2) / n1 / n0
    assert evaluate.binary_auc(df, F.col("y") == 1, F.col("s")).first()[0] == pytest.approx(want, abs=1e-12)


def test_onehot_text_nan_and_missing_share_a_column(spark):
    df = spark.createDataFrame([("nan",), (None,), ("x",)], "c string")
    out = encode.onehot(df)
    assert out.columns == ["c_nan", "c_x"] and [tuple(r) for r in out.collect()] == [(1.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    with pytest.raises(ValueError):
        encode.onehot(spark.range(20).select(F.col("id").cast("string").alias("c")), max_categories=10)
    wide = encode.onehot(spark.range(1200).select(F.col("id").cast("string").alias("c")))
    assert len(wide.columns) == 1200
    long = encode.onehot_long(df.withColumn("id", F.monotonically_increasing_id()), ["id"])
    assert sorted(r["feature"] for r in long.collect()) == ["c_nan", "c_nan", "c_x"]


def test_csv_as_pandas_reads_it(spark, tmp_path):
    path = os.path.join(tmp_path, "made.csv")
    with open(path, "w", newline="") as out:
        rows = csv.writer(out)
        rows.writerow(["", "square", "ratio", "note", "flag", "empty", "mixed"])
        for i in range(50):
            rows.writerow([i, "NA" if i % 7 == 3 else i * i, "" if i % 11 == 5 else i * i / 7,
                           f'he said "{i}", ok' if i % 3 else "two\nlines", "True" if i % 2 else "False", "n/a",
                           "null" if i % 5 == 0 else (i if i % 2 else f"t{i}")])
    want = pd.read_csv(path)
    got = files.read_path(spark, path)
    assert got.columns == ["_c0", *want.columns[1:]]
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "double", "string", "boolean", "double", "string"]
    for row, (_, expected) in zip(got.orderBy("_c0").collect(), want.iterrows(), strict=True):
        for a, b in zip(row, expected, strict=True):
            assert (a is None and pd.isna(b)) or a == b or str(a) == b or math.isclose(a, b, rel_tol=1e-14)
    back = os.path.join(tmp_path, "written.csv")
    files.write_path(got.drop("_c0"), back, "csv")
    parts = [pd.read_csv(os.path.join(back, f)) for f in sorted(os.listdir(back)) if f.startswith("part-")]
    again = pd.concat(parts).reset_index(drop=True)
    assert again["note"].tolist() == want["note"].tolist()
    assert np.allclose(again["ratio"], want["ratio"], equal_nan=True)
    assert files.read_path(spark, back, "csv").exceptAll(got.drop("_c0")).isEmpty()


@pytest.mark.parametrize("keys", ["unique", "repeated", "one"])
def test_split_and_undersampling_are_exact_by_counting(spark, keys):
    rows = [(i if keys == "unique" else i // 40 if keys == "repeated" else 7, "abc"[(i % 10 > 6) + (i % 10 > 8)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, y string")
    sizes = {r["split"]: r["count"] for r in train.split_column(df, 0.17, 1, ["k"]).groupBy("split").count().collect()}
    assert sizes == {"test": 170, "train": 830}
    from tessera.operators import balance

    out = balance.undersample(df, "y", ["k"])
    assert out.columns == ["k", "y"]
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"a": 100, "b": 100, "c": 100}
    assert out.exceptAll(df).isEmpty()
    plan = train.split_column(df, 0.17, 1, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert keys != "unique" or "Sort" not in plan
