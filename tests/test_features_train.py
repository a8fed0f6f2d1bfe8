import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, features, predict, train
from tessera.sources import models


def test_polynomial_names_and_values(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id long, a double, b double")
    out = features.polynomial(df, ["a", "b"], keep=["id"])
    assert out.columns == ["id", "a", "b", "a^2", "a b", "b^2"]
    assert tuple(out.first())[1:] == (2.0, 3.0, 4.0, 6.0, 9.0)
    inter = features.polynomial(df, ["a", "b"], interaction_only=True)
    assert inter.columns == ["a", "b", "a b"]


def test_variance_and_anova(spark):
    rng = np.random.default_rng(1)
    n = 90
    y = np.repeat(["p", "q", "r"], 30)
    pdf = pd.DataFrame({"good": rng.normal(size=n) + (y == "q") * 3, "noise": rng.normal(size=n),
                        "const": np.full(n, 1.0), "y": y})
    df = spark.createDataFrame(pdf)
    var = {r["column_name"]: r["selected"] for r in features.variance_report(df, ["good", "const"]).collect()}
    assert var == {"good": True, "const": False}
    rep = {r["column_name"]: r for r in features.anova_report(df, "y", ["good", "noise"], k=1).collect()}
    g = [pdf.good[pdf.y == c] for c in "pqr"]
    grand = pdf.good.mean()
    ssb = sum(len(x) * (x.mean() - grand) ** 2 for x in g)
    ssw = sum(((x - x.mean()) ** 2).sum() for x in g)
    assert rep["good"]["f_score"] == pytest.approx((ssb / 2) / (ssw / (n - 3)), rel=1e-9)
    assert rep["good"]["selected"] and not rep["noise"]["selected"]


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4))
    pdf = pd.DataFrame(x, columns=list("abcd"))
    df = spark.createDataFrame(pdf)
    got = features.pca(df, None, list("abcd"), 2).toPandas().to_numpy()
    xc = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(xc, full_matrices=False)
    for k in range(2):
        v = vt[k] * np.sign(vt[k][np.argmax(np.abs(vt[k]))])
        np.testing.assert_allclose(got[:, k], xc @ v, atol=1e-8)


def test_lda_separates_classes(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(60, 3))
    b = rng.normal(size=(60, 3)) + np.array([3.0, 0.0, 1.0])
    pdf = pd.DataFrame(np.vstack([a, b]), columns=["x", "y", "z"])
    pdf["t"] = ["a"] * 60 + ["b"] * 60
    out = features.lda(spark.createDataFrame(pdf), "t").toPandas()
    m = out.groupby("t").LD1.mean()
    within = out.groupby("t").LD1.var(ddof=1).mean()
    assert abs(m["a"] - m["b"]) > 3 * math.sqrt(within)


def test_split_exact_and_repeatable(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    marked = train.split_column(df, 0.2, 42, ["k"])
    test_keys = sorted(r["k"] for r in marked.where("split = 'test'").collect())
    assert len(test_keys) == math.ceil(103 * 0.2)
    again = sorted(r["k"] for r in train.split_column(df, 0.2, 42, ["k"]).where("split = 'test'").collect())
    assert again == test_keys


def _sklearn_stratified_folds(y, k):
    """Brute-force restatement of unshuffled StratifiedKFold."""
    first = {}
    for i, v in enumerate(y):
        first.setdefault(v, i)
    order = sorted(first, key=first.get)
    enc = np.array([order.index(v) for v in y])
    y_sorted = np.sort(enc)
    alloc = np.asarray([np.bincount(y_sorted[i::k], minlength=len(order)) for i in range(k)])
    folds = np.empty(len(y), dtype=int)
    for c in range(len(order)):
        folds[enc == c] = np.arange(k).repeat(alloc[:, c])
    return folds


def test_stratified_folds_match_brute_force(spark):
    rng = np.random.default_rng(9)
    y = rng.choice(["x", "y", "z"], size=97, p=[0.6, 0.3, 0.1])
    pdf = pd.DataFrame({"k": np.arange(97) * 3, "y": y})
    got = train.stratified_folds(spark.createDataFrame(pdf), "y", 5, ["k"]).toPandas()
    got = got.sort_values("k").fold.to_numpy()
    np.testing.assert_array_equal(got, _sklearn_stratified_folds(list(y), 5))


@pytest.fixture
def separable(spark):
    rng = np.random.default_rng(12)
    n = 200
    x1 = rng.normal(size=n)
    x2 = rng.normal(size=n)
    seg = rng.choice(["u", "v"], size=n)
    label = np.where(x1 + 0.5 * x2 + (seg == "u") > 0.3, "yes", "no")
    pdf = pd.DataFrame({"id": np.arange(n), "x1": x1, "x2": x2, "seg": seg, "label": label})
    return spark.createDataFrame(pdf)


def test_train_evaluate_predict_and_store(spark, separable, tmp_root):
    res = train.train_model(separable, "label", "logistic_regression", 0.25, 3, key=["id"],
                            features=["x1", "x2", "seg"])
    assert res.accuracy > 0.85
    assert isinstance(res.cv_scores, list) and len(res.cv_scores) == 3
    preds = res.model.transform(separable)
    rep = {r["metric"]: r["value"] for r in evaluate.evaluate(preds, "label", labels=res.labels).collect()}
    assert rep["recall"] == pytest.approx(rep["accuracy"])  # weighted recall = accuracy
    assert rep["roc_auc"] > 0.9
    types = {f.name: f.dataType.simpleString() for f in separable.schema.fields}
    mid = models.save_model(spark, tmp_root, res.model, "label", res.algorithm, res.feature_names,
                            types, res.labels)
    stored = models.load_model(spark, tmp_root, mid)
    assert stored.features == ["x1", "x2", "seg"]
    assert [r["model_id"] for r in models.list_models(spark, tmp_root).collect()] == [mid]
    partial = separable.select("id", "x1", "x2")  # 'seg' missing -> typed null
    out = predict.predict(stored.model, partial, stored.features, stored.feature_types, ["id"])
    assert out.count() == 200 and set(out.columns) == {"id", "prediction"}


def test_tree_models_train(spark, separable):
    for algo in ("decision_tree", "random_forest"):
        res = train.train_model(separable, "label", algo, 0.25, None, key=["id"])
        assert res.accuracy > 0.7


def test_unknown_target_and_algorithm(spark, separable):
    with pytest.raises(ValueError):
        train.train_model(separable, "nope")
    with pytest.raises(ValueError):
        train.train_model(separable, "label", "quantum")


def _brute_auc(y, s):
    pos = [v for t, v in zip(y, s) if t]
    neg = [v for t, v in zip(y, s) if not t]
    wins = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    return wins / (len(pos) * len(neg))


def _brute_report(actual, pred):
    classes = sorted(set(actual) | set(pred))
    n = len(actual)
    out = {"accuracy": sum(a == p for a, p in zip(actual, pred)) / n, "precision": 0.0,
           "recall": 0.0, "f1": 0.0}
    for c in classes:
        tp = sum(a == c and p == c for a, p in zip(actual, pred))
        sup = sum(a == c for a in actual)
        npred = sum(p == c for p in pred)
        prec = tp / npred if npred else 0.0
        rec = tp / sup if sup else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        out["precision"] += sup * prec / n
        out["recall"] += sup * rec / n
        out["f1"] += sup * f1 / n
    return out


def test_metrics_and_auc_match_brute_force(spark):
    rng = np.random.default_rng(8)
    actual = [str(v) for v in rng.choice(["a", "b", "c"], size=150)]
    pred = [str(v) for v in rng.choice(["a", "b", "d"], size=150)]  # 'c' never predicted
    score = [float(v) for v in np.round(rng.normal(size=150), 1)]  # many ties
    df = spark.createDataFrame(list(zip(actual, pred, score)), "actual string, pred string, s double")
    rep = evaluate.classification_report(df, "actual", "pred").first().asDict()
    for k, v in _brute_report(actual, pred).items():
        assert rep[k] == pytest.approx(v, abs=1e-12)
    auc = evaluate.binary_auc(df, F.col("actual") == "a", F.col("s")).first()[0]
    assert auc == pytest.approx(_brute_auc([a == "a" for a in actual], score), abs=1e-12)
    cm = {(r["actual"], r["predicted"]): r["count"] for r in
          evaluate.confusion_matrix(df, "actual", "pred").collect()}
    assert sum(cm.values()) == 150
    with pytest.raises(ValueError):
        evaluate.require_target(df, "missing")


def test_kernel_svm_learns_nonlinear_boundary(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(300, 2))
    label = np.where((x ** 2).sum(axis=1) < 1.0, "in", "out")  # not linearly separable
    pdf = pd.DataFrame({"id": np.arange(300), "a": x[:, 0], "b": x[:, 1], "label": label})
    res = train.train_model(spark.createDataFrame(pdf), "label", "svm", 0.25, None, key=["id"])
    assert res.accuracy > 0.85
    preds = res.model.transform(spark.createDataFrame(pdf))
    rep = {r["metric"]: r["value"] for r in evaluate.evaluate(preds, "label", labels=res.labels).collect()}
    assert rep["roc_auc"] > 0.9


def test_knn_matches_brute_force_and_smote_balances(spark, separable):
    from tessera.operators import balance, neighbors

    rng = np.random.default_rng(3)
    ref = rng.normal(size=(60, 3))
    qry = rng.normal(size=(25, 3))
    got = neighbors._nearest(qry, ref, 5)
    d = ((qry[:, None, :] - ref[None, :, :]) ** 2).sum(axis=2)
    np.testing.assert_array_equal(got, np.argsort(d, axis=1, kind="stable")[:, :5])

    res = train.train_model(separable, "label", "knn", 0.25, None, key=["id"],
                            features=["x1", "x2", "seg"])
    assert res.accuracy > 0.8

    pdf = separable.toPandas()
    out = balance.balance(separable.drop("seg"), "smote", "label", key=["id"], features=["x1", "x2"]).toPandas()
    counts = out.label.value_counts()
    assert counts.nunique() == 1 and counts.iloc[0] == pdf.label.value_counts().max()
    for cls, grp in out.groupby("label"):
        src = pdf[pdf.label == cls]
        assert grp.x1.between(src.x1.min() - 1e-9, src.x1.max() + 1e-9).all()
        assert grp.x2.between(src.x2.min() - 1e-9, src.x2.max() + 1e-9).all()


def test_smote_neighbours_recall_and_shape(spark):
    from tessera.operators import balance, neighbors

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 3))
    rows = [("a" if i % 3 else "b", i, [float(v) for v in x[i]]) for i in range(1200)]
    got = neighbors.neighbours_in_class(spark.createDataFrame(rows, "cls string, idx long, x array<double>"), 5, cell_rows=64)
    hits = 0
    for r in got.collect():
        own = [i for i in range(1200) if bool(i % 3) == bool(r["idx"] % 3) and i != r["idx"]]
        want = sorted(own, key=lambda i: ((x[i] - x[r["idx"]]) ** 2).sum())[:5]
        hits += len({n["other"] for n in r["near"]} & set(want))
        assert len(r["near"]) == 5 and all(bool(n["other"] % 3) == bool(r["idx"] % 3) for n in r["near"])
    assert got.count() == 1200 and hits / 6000 > 0.9

    df = spark.createDataFrame([(i, float(x[i][0]), float(x[i][1]), "p" if i < 900 else "q") for i in range(1000)],
                               "id long, u double, v double, y string")
    out = balance.balance(df, "smote", "y", key=["id"], features=["u", "v"]).toPandas()
    made = out[900 + 100:]
    assert len(made) == 800 and set(made.y) == {"q"}
    source = x[900:1000, :2]
    for u, v in made[["u", "v"]].to_numpy()[:200]:  # each lies between two rows of the class
        line = [abs((b - a)[0] * (v - a[1]) - (b - a)[1] * (u - a[0])) < 1e-9 and min(a[0], b[0]) - 1e-9 <= u <= max(a[0], b[0]) + 1e-9
                for a in source for b in source if a is not b]
        assert any(line)
    with pytest.raises(ValueError, match="no value for the columns"):
        balance.balance(df.withColumn("s", F.lit("x")), "smote", "y", key=["id"], features=["u", "v"])
    with pytest.raises(ValueError, match="class label"):
        balance.class_counts(spark.range(10_001), "id")


def test_streaming_scoring_replays_fitted_steps(spark, separable, tmp_root):
    from tessera.operators import scale
    from tessera.streaming.scoring import score_stream, write_scores

    scaler = scale.fit_scaler(separable, ["x1", "x2"], "standard")
    train_df = scaler.transform(separable)
    res = train.train_model(train_df, "label", "logistic_regression", 0.25, None, key=["id"],
                            features=["x1", "x2", "seg"])
    src = os.path.join(tmp_root, "incoming")
    separable.drop("label").write.parquet(src)
    stream = spark.readStream.schema(separable.drop("label").schema).parquet(src)
    types = {f.name: f.dataType.simpleString() for f in separable.schema.fields}
    scored = score_stream(stream, res.model, res.feature_names, types, ["id"], [scaler])
    out = os.path.join(tmp_root, "scores")
    query = write_scores(scored, out, os.path.join(tmp_root, "scores_ckpt"))
    query.awaitTermination(120)
    got = spark.read.parquet(out)
    batch = res.model.transform(train_df).select("id", F.col("predicted_label").alias("b"))
    assert got.count() == 200
    assert got.join(batch, "id").where("prediction <> b").count() == 0


def test_knn_and_svm_models_round_trip_the_store(spark, separable, tmp_root):
    types = {f.name: f.dataType.simpleString() for f in separable.schema.fields}
    for algo in ("knn", "svm"):
        res = train.train_model(separable, "label", algo, 0.25, None, key=["id"],
                                features=["x1", "x2", "seg"])
        mid = models.save_model(spark, tmp_root, res.model, "label", algo, res.feature_names,
                                types, res.labels)
        stored = models.load_model(spark, tmp_root, mid)
        before = res.model.transform(separable).select("id", F.col("predicted_label").alias("a"))
        after = stored.model.transform(separable).select("id", F.col("predicted_label").alias("b"))
        assert before.join(after, "id").where("a <> b").count() == 0
