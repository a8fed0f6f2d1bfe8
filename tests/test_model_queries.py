"""Every training query runs, and models agree with independent derivations."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera import workloads
from tessera.operators import features, neighbors

SF = "/root/testdata/sf0.001"
ALGORITHMS = ["logistic_regression", "random_forest", "decision_tree", "neural_network", "xgboost", "svm", "knn"]


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_training_queries_beat_chance(spark, algorithm):
    rows = {r["metric"]: r["value"] for r in workloads.QUERIES[f"train_{algorithm}_documents"](spark, SF).collect()}
    assert 0.55 < rows["accuracy"] <= 1.0
    assert len(rows) == (6 if algorithm == "logistic_regression" else 1)


def test_embedding_classes_are_learned(spark):
    rows = {r["metric"]: r["value"] for r in workloads.QUERIES["train_evaluate_embeddings"](spark, SF).collect()}
    assert set(rows) == {"accuracy", "precision", "recall", "f1", "roc_auc"}
    assert rows["recall"] == pytest.approx(rows["accuracy"])


def test_knn_votes_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"), F.col("label").cast("double").alias("y"))
    fitted = neighbors.KNNClassifier(5).setFeaturesCol("x").setLabelCol("y").setPredictionCol("p") \
        .setProbabilityCol("q").setRawPredictionCol("r").fit(rows.filter("vec_id % 5 <> 0"))
    got = {r["vec_id"]: (r["p"], r["q"].toArray()) for r in fitted.transform(rows.filter("vec_id % 5 = 0")).collect()}
    all_rows = rows.collect()
    train = [r for r in all_rows if r["vec_id"] % 5]
    x, y = np.array([r["x"].toArray() for r in train]), np.array([int(r["y"]) for r in train])
    for r in all_rows:
        if r["vec_id"] % 5 == 0:
            near = np.argsort(((x - r["x"].toArray()) ** 2).sum(axis=1), kind="stable")[:5]
            votes = np.bincount(y[near], minlength=int(y.max()) + 1)
            assert got[r["vec_id"]][0] == votes.argmax()
            assert np.allclose(got[r["vec_id"]][1], votes / 5)


def test_rfe_keeps_what_tells_the_classes_apart(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    label = (x[:, 1] - 2 * x[:, 4] + 0.1 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(y)) for r, y in zip(x, label)], [*"abcdef", "y"])
    assert sorted(features.rfe_select(df, "y", list("abcdef"), 2)) == ["b", "e"]


def test_rfe_loses_no_row_to_a_mostly_missing_column(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    label = (x[:, 1] - 2 * x[:, 2] > 0).astype(int)
    rows = [(*map(float, r), None if i > 1 else 1.0, float("nan") if i % 2 else 1.0, int(y)) for i, (r, y) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, y int")
    assert sorted(features.rfe_select(df, "y", list("abcdef"), 2)) == ["b", "c"]


def test_lda_direction_equals_a_direct_solution(spark):
    rng = np.random.default_rng(6)
    means = np.array([[0, 0, 0], [2, 1, 0], [0, 2, 1]])
    label = np.arange(240) % 3
    x = rng.normal(size=(240, 3)) @ np.diag([1, 2, 0.5]) + means[label]
    df = spark.createDataFrame([(*map(float, r), f"c{y}") for r, y in zip(x, label)], ["u", "v", "w", "y"])
    model = features.fit_lda(df, "y", ["u", "v", "w"], 1)
    got = np.array([r["LD1"] for r in model.transform(df, []).collect()])
    within = sum(np.cov(x[label == k].T, bias=True) for k in range(3)) / 3
    between = np.cov(np.array([x[label == k].mean(axis=0) for k in range(3)]).T, bias=True)
    values, vectors = np.linalg.eig(np.linalg.solve(within, between))
    want = x @ np.real(vectors[:, np.real(values).argmax()])
    assert abs(np.corrcoef(got, want)[0, 1]) > 1 - 1e-9
