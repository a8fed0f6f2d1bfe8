"""Boosting, hashed features and the nearest-neighbour join."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import boosting, hashing, knn_join, neighbors, svm, train


@pytest.fixture(scope="module")
def three(spark):
    """Three classes from numbers with a tenth missing."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    x[:, 3] = rng.integers(0, 4, len(x))
    y = (x[:, 0] + x[:, 3] > 1).astype(int) + (x[:, 1] > 0)
    x[rng.random(x.shape) < 0.1] = np.nan
    return x, y, spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(x, y, strict=True)], "x array<double>, label int")


def same(a, b):
    return all(np.array_equal(getattr(s, f), getattr(t, f)) for first, second in zip(a, b, strict=True) for s, t in zip(first, second, strict=True)
               for f in ("feature", "bin", "cut", "missing_left", "weight"))


def test_trees_are_the_same_in_one_task_and_by_levels(three):
    _, _, df = three
    rows = df.select(*boosting.sparse_array(), "label")
    rule = boosting.Rule(3, 1.0, 1.0, 0.3)
    _, one = boosting.boost(rows, 4, 3, 3, rule)
    _, levels = boosting.boost(rows.repartition(7), 4, 3, 3, rule, local_bytes=0)
    assert same(one, levels)


def test_many_rounds_by_levels_write_their_margins(spark):
    rows = spark.range(60).select(F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double")).alias("x"), (F.col("id") % 2).cast("int").alias("label"))
    rows = rows.select(*boosting.sparse_array(), "label")
    rule = boosting.Rule(1, 1.0, 1.0, 0.3)
    rounds = boosting.FLUSH + 2
    assert same(boosting.boost(rows, 2, 2, rounds, rule)[1], boosting.boost(rows, 2, 2, rounds, rule, local_bytes=0)[1])


def test_log_loss_on_three_classes(three):
    x, y, df = three
    _, trees = boosting.boost(df.filter(F.col("label") >= 0).select(*boosting.sparse_array(), "label"), 4, 3, 30)
    margin = boosting.margins(trees, x)
    p = np.exp(margin - margin.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert -np.log(p[np.arange(len(y)), y]).mean() < 0.2 and (p.argmax(axis=1) == y).mean() > 0.93


def test_missing_values_go_where_they_gain(spark):
    """Missing is informative: class 1 when missing or above 5."""
    rows = [([None if i % 3 == 0 else float(i % 10)], int(i % 3 == 0 or i % 10 > 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "x array<double>, label int").select(*boosting.sparse_array(), "label")
    split = boosting.first_split(df, 1).first()
    assert (split["cut"], split["missing_left"]) == (6.0, False) and split["left_weight"] < 0 < split["right_weight"]


def test_boosted_pipeline_takes_nulls_and_round_trips(spark, three, tmp_root):
    x, y, _ = three
    rows = [(None if np.isnan(r[0]) else float(r[0]), float(r[1]), float(r[3]), f"c{c}") for r, c in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, d double, cls string")
    model, _, labels = train.fit_pipeline(df, "cls", "xgboost", options={"maxIter": 20})
    assert labels == ["c0", "c1", "c2"] and "OneVsRest" not in str(model.stages)
    model.write().overwrite().save(f"{tmp_root}/m")
    again = PipelineModel.load(f"{tmp_root}/m")
    first, second = (m.transform(df).select(train.PROBABILITY, train.PREDICTED_LABEL).collect() for m in (model, again))
    assert first == second and all(abs(r[0].toArray().sum() - 1) < 1e-9 for r in first)
    assert train.accuracy_of(again.transform(df), "cls") > 0.85
    with pytest.raises(ValueError):
        boosting.boost(df.select(F.array("b").alias("x"), F.lit(0).alias("label")).select(*boosting.sparse_array(), "label"), 1, 2, 1, max_bins=255)


# Hashing -----------------------------------------------------------------------

def test_hashed_vectors_are_signed_sparse_and_add_up(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, None), ("b", "x")], "p string, `q.r` string")
    got = [r["v"] for r in hashing.SignedHasher(["p", "q.r"], "v", 64).transform(df).collect()]
    assert [v.size for v in got] == [64] * 4 and got[2].numNonzeros() == 0
    assert np.array_equal(got[0].toArray() - got[1].toArray(), got[3].toArray() - (got[3].toArray() - (got[0].toArray() - got[1].toArray())))
    assert set(np.abs(got[1].values)) == {1.0}


def test_hashed_inner_products_are_unbiased(spark):
    """Over many values signs balance, and places are met as often as the bound says."""
    df = spark.range(20000).select(F.concat(F.lit("value "), F.col("id")).alias("s"))
    place, sign = hashing.slot(F.col("s"), 0, 4096)
    slots = df.select(place.alias("p"), sign.alias("g"))
    assert abs(slots.agg(F.sum("g")).first()[0]) < 5 * 20000 ** 0.5
    alone = slots.groupBy("p").count().filter("count = 1").count()
    assert abs((1 - alone / 20000) - hashing.collision_bound(20000, 4096)) < 0.02


def test_a_column_of_distinct_texts_trains(spark, tmp_root):
    rows = [(f"user {i}", "even" if i % 2 else "odd", float(i % 2) + 0.1 * (i % 5), int(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, kind string, x double, y int")
    stages, used = train.feature_stages(df, "y", max_categories=50, hash_features=256)
    assert used == ["x", "name", "kind"] and sum(isinstance(s, hashing.SignedHasher) for s in stages) == 1
    model = train.Pipeline(stages=stages).fit(df)
    vector = model.transform(df).first()[train.FEATURES]
    assert vector.size == 1 + 2 + 256 and vector.numNonzeros() == 3
    model.write().overwrite().save(f"{tmp_root}/features")
    again = PipelineModel.load(f"{tmp_root}/features")
    unseen = spark.createDataFrame([("nobody", "third", None)], "name string, kind string, x double")
    assert again.transform(unseen).first()[train.FEATURES].size == vector.size
    old, train.MAX_CATEGORIES = train.MAX_CATEGORIES, 50
    try:
        for algorithm in ("logistic_regression", "xgboost"):
            fitted, _, _ = train.fit_pipeline(df, "y", algorithm, options={"maxIter": 5})
            assert train.accuracy_of(fitted.transform(df), "y") > 0.95
    finally:
        train.MAX_CATEGORIES = old


# Nearest neighbours ------------------------------------------------------------

@pytest.mark.parametrize("n, dims, clusters", [(900, 3, 30), (300, 20, 4)])
def test_join_equals_brute_force_with_a_hot_point(spark, n, dims, clusters):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(clusters, dims))[rng.integers(0, clusters, n)] * 5 + rng.normal(size=(n, dims)), 1)
    x[50:50 + n // 3] = x[5]
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "i long, v array<double>, y int").repartition(5)
    points = knn_join.written(knn_join.points(df, "i", "v", "y"), "test")
    got = {}
    for r in knn_join.knn_join(points, points, 4, portion_bytes=400 * dims).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], r["y"], r["distance"])
    for i in range(n):
        d2 = np.square(x - x[i]).sum(axis=1)
        near = np.lexsort((np.arange(n), d2))[:4]
        assert [got[i][k][0] for k in range(1, 5)] == near.tolist()
        assert [got[i][k][1] for k in range(1, 5)] == (near % 3).tolist()
        assert np.allclose([got[i][k][2] for k in range(1, 5)], np.sqrt(d2[near]))


def test_join_odd_rows(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, None]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [-0.0, 1.0]), (7, [])]
    points = knn_join.points(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v")
    got = knn_join.knn_join(points, points, 3).collect()
    assert sorted((r["query"], r["rank"], r["id"], r["distance"]) for r in got) == [(1, 1, 1, 0.0), (1, 2, 6, 0.0), (6, 1, 1, 0.0), (6, 2, 6, 0.0)]
    assert knn_join.knn_join(points, points.limit(0), 3).count() == 0


def test_join_sends_a_query_once_to_a_bin_of_many_cells(spark, monkeypatch):
    """Points without clusters, so that nearly all cells are looked at: about
    ``BINS`` copies of a query and of a row, not one for each of 64 cells."""
    rng = np.random.default_rng(11)
    n, sent = 4096, []
    x = rng.normal(size=(n, 24)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(4)
    points = knn_join.written(knn_join.points(df, "i", "v"), "spread")
    plain = knn_join._compared
    monkeypatch.setattr(knn_join, "_compared", lambda dealt, *more: (sent.append(dealt.count()), plain(dealt, *more))[1])
    got = {(r["query"], r["rank"]): r["id"] for r in knn_join.knn_join(points, points, 3).collect()}
    for i in range(n):
        near = np.lexsort((np.arange(n), np.square(x - x[i]).sum(axis=1)))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == near.tolist()
    assert sum(sent) <= 12 * n


def test_knn_votes_by_join_equal_those_by_broadcast(spark, tmp_root):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(600, 3)), 1)
    x[:200] = x[0]  # a third are one point, with both labels
    df = spark.createDataFrame([(i, v.tolist(), float(i % 2 if i < 200 else v[0] > 0)) for i, v in enumerate(x)], "i int, v array<double>, y double") \
        .withColumn("f", array_to_vector("v"))
    fits = [neighbors.KNNClassifier(5, max_broadcast_bytes=b).setFeaturesCol("f").setLabelCol("y").setProbabilityCol("p").setPredictionCol("c")
            .setRawPredictionCol("r").fit(df.repartition(n)) for b, n in ((1 << 20, 3), (0, 7))]
    fits[1].write().overwrite().save(f"{tmp_root}/knn")
    fits.append(neighbors.KNNModel.read().load(f"{tmp_root}/knn"))
    votes = [{r["i"]: (r["p"].toArray().tolist(), r["c"]) for r in m.transform(df).select("i", "p", "c").collect()} for m in fits]
    assert len(votes[0]) == 600 and votes[0] == votes[1] == votes[2]


def test_iterative_learners_get_partitions_by_bytes(spark):
    rows = spark.range(0, 3000, 1, 12).select(array_to_vector(F.array(F.rand(1), F.rand(2))).alias(train.FEATURES), F.lit(0.0).alias(train.LABEL))
    held, n, width = train._held(rows, True)
    assert (held.rdd.getNumPartitions(), n, width) == (1, 3000, 2)
    held.unpersist()
    plain, _, _ = train._held(rows, False)
    assert plain.rdd.getNumPartitions() == 12
    plain.unpersist()


# Curves and normality ----------------------------------------------------------

def test_curve_area_equals_auc_and_thinning_keeps_its_bound(spark):
    from tessera.operators import evaluate

    rng = np.random.default_rng(4)
    y = rng.random(3000) < 0.3
    s = np.round(rng.normal(size=3000) + y, 2)
    df = spark.createDataFrame([(bool(a), float(b)) for a, b in zip(y, s, strict=True)] + [(None, 1.0), (True, None)], "y boolean, s double").repartition(4)
    auc = evaluate.binary_auc(df.dropna(), F.col("y"), F.col("s")).first()[0]
    whole = evaluate.curve_points(df, F.col("y"), F.col("s"), 10 ** 6)
    assert whole.count() == len(set(s)) + 1 and evaluate.curve_area(whole) == pytest.approx(auc, abs=1e-12)
    thin = evaluate.curve_points(df, F.col("y"), F.col("s"), 20)
    assert thin.count() <= 42 and abs(evaluate.curve_area(thin) - auc) <= 1 / 40
    ends = sorted((r["fpr"], r["tpr"]) for r in thin.collect())
    assert ends[0] == (0.0, 0.0) and ends[-1] == (1.0, 1.0)
    assert evaluate.curve_area(evaluate.curve_points(df.filter("y"), F.col("y"), F.col("s"))) is None
    assert evaluate.curve_points(df.limit(0), F.col("y"), F.col("s")).count() == 1


def test_shapiro_francia(spark):
    """W' equals numpy's correlation; normal samples pass, others fail."""
    from statistics import NormalDist

    from tessera.operators import normality

    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(1e6, 1, 800), "skewed": rng.exponential(size=800), "ties": rng.integers(0, 5, 800).astype(float), "constant": np.ones(800)}
    rows = [tuple(float(x[c][i]) for c in x) for i in range(800)] + [(None, float("nan"), None, None)]
    df = spark.createDataFrame(rows, list(x)).repartition(5)
    got = {r["column_name"]: r for r in normality.normality(df).collect()}
    for c in ("normal", "skewed", "ties"):
        rank = np.array([((x[c] < v).sum() + 1 + (x[c] <= v).sum()) / 2 for v in x[c]])
        m = np.array([NormalDist().inv_cdf((r - 0.375) / 800.25) for r in rank])
        assert got[c]["n"] == 800 and got[c]["w"] == pytest.approx(np.corrcoef(x[c], m)[0, 1] ** 2, abs=1e-7)
    assert got["normal"]["p"] > 0.05 and got["skewed"]["p"] < 1e-9 and got["ties"]["p"] < 0.01
    assert got["constant"]["w"] is None and got["constant"]["p"] is None
    few = normality.normality(df.limit(0), ["normal"]).first()
    assert (few["n"], few["w"], few["p"]) == (0, None, None)
    z = spark.sql(f"SELECT {normality.upper_tail_sql('1.5')} AS a, {normality.upper_tail_sql('-0.3')} AS b, {normality.normal_quantile_sql('0.001')} AS c").first()
    assert z["a"] == pytest.approx(1 - NormalDist().cdf(1.5), rel=1e-6) and z["b"] == pytest.approx(NormalDist().cdf(0.3), rel=1e-6)
    assert z["c"] == pytest.approx(NormalDist().inv_cdf(0.001), rel=1e-8)


def test_rows_that_grow_in_the_fit_lie_in_partitions_of_what_is_held(spark):
    """The kernel SVM holds 200 doubles a row: partitions are cut by these, and
    more are made where too few came in."""
    rows = spark.range(60_000, numPartitions=1).select(F.array(F.col("id").cast("double")).alias("x"), F.lit(1.0).alias("y"))
    rows = rows.select(array_to_vector("x").alias("x"), "y")
    made = svm.kernel_row_bytes()
    assert made >= 8 * svm.DEFAULT_COMPONENTS
    held, n, width = train._held(rows, True, made)
    assert (n, width) == (60_000, 1)
    sizes = [r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) * made <= 1.1 * train.FIT_BYTES and sum(sizes) == n
    held.unpersist()


def test_forest_rows_keep_their_nodes_and_its_trees_stay(spark):
    rows = spark.range(0, 600, 1, 3).select(
        array_to_vector(F.array((F.col("id") % 37).cast("double"), (F.col("id") % 11).cast("double"))).alias(train.FEATURES),
        (F.col("id") * 7919 % 101 % 2).cast("double").alias(train.LABEL))
    kept = train.classifier("random_forest", 600, 2, 2)
    assert kept.getCacheNodeIds() and kept.getNumTrees() == train.TREES
    plain = train.classifier("random_forest", 600, 2, 2, options={"cacheNodeIds": False})
    assert kept.fit(rows).toDebugString.split("\n")[1:] == plain.fit(rows).toDebugString.split("\n")[1:]
    many = spark.range(200_000, numPartitions=1).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("x"), F.lit(1.0).alias("y"))
    held, n, _ = train._held(many, False, 32 + 4 * train.TREES)
    assert n == 200_000 and held.rdd.getNumPartitions() == 3
    held.unpersist()
