"""Property tests (hypothesis, few examples: each one runs Spark jobs)."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import evaluate, outliers, scale, train

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(sizes=st.lists(st.integers(min_value=1, max_value=40), min_size=2, max_size=4),
       k=st.sampled_from([2, 3, 5]))
def test_fold_sizes_differ_by_at_most_one_per_class(spark, sizes, k):
    rows = [(i, f"c{j}") for j, n in enumerate(sizes) for i in range(sum(sizes[:j]), sum(sizes[:j]) + n)]
    df = spark.createDataFrame(rows, "id long, y string")
    folds = train.stratified_folds(df, "y", k, ["id"])
    counts = {}
    for r in folds.groupBy("y", "fold").count().collect():
        counts.setdefault(r["y"], {})[r["fold"]] = r["count"]
    for cls, per in counts.items():
        full = [per.get(f, 0) for f in range(k)]
        assert max(full) - min(full) <= 1
        assert sum(full) == sizes[int(cls[1:])]


@SETTINGS
@given(n=st.integers(min_value=2, max_value=300), t=st.sampled_from([0.15, 0.2, 0.25, 0.3]))
def test_split_has_exact_test_size(spark, n, t):
    df = spark.range(n).withColumnRenamed("id", "k")
    marked = train.split_column(df, t, 42, ["k"])
    assert marked.where("split = 'test'").count() == math.ceil(n * t)
    assert marked.count() == n


@SETTINGS
@given(values=st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=4,
                       max_size=60))
def test_clip_is_bounded_and_idempotent(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")
    once = outliers.clip_outliers(df, ["x"], "iqr")
    twice = outliers.clip_outliers(once, ["x"], "iqr")
    a = sorted(r["x"] for r in once.collect())
    assert min(values) <= a[0] and a[-1] <= max(values)
    b = sorted(r["x"] for r in twice.collect())
    # Clipping never widens the range.
    assert b[0] >= a[0] - 1e-9 * max(1.0, abs(a[0])) and b[-1] <= a[-1] + 1e-9 * max(1.0, abs(a[-1]))


@SETTINGS
@given(values=st.lists(st.floats(min_value=-1e4, max_value=1e4, allow_nan=False), min_size=3,
                       max_size=60, unique=True))
def test_standard_scaling_centres_and_scales(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    out = scale.scale(df, "standard", ["x"])
    row = out.agg(F.avg("x"), F.stddev_pop("x")).first()
    assert row[0] == pytest.approx(0.0, abs=1e-9)
    assert row[1] == pytest.approx(1.0, rel=1e-9)


@SETTINGS
@given(pairs=st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abcd")), min_size=1,
                      max_size=80))
def test_weighted_recall_equals_accuracy(spark, pairs):
    df = spark.createDataFrame(pairs, "actual string, predicted string")
    rep = evaluate.classification_report(df, "actual", "predicted").first()
    assert rep["recall"] == pytest.approx(rep["accuracy"], abs=1e-12)
    assert 0.0 <= rep["precision"] <= 1.0 and 0.0 <= rep["f1"] <= 1.0
