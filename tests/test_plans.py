"""Plan-shape guards for scale: no single-partition exchange or global
window on the data path, map-side partial aggregation for per-key picks,
broadcast only for size-checked tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import balance, clean, encode, profile, train
from tessera.plans import ordering


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i, i % 3, "hot" if i % 3 else f"k{i % 11}", float(i % 17)) for i in range(600)]
    return spark.createDataFrame(rows, "id long, grp long, key string, v double")


def test_positions_have_no_single_partition_exchange(spark, events):
    positioned = ordering.with_position(events, ["v", "id"], "pos")
    plan = _plan(positioned)
    assert "SinglePartition" not in plan
    assert "BroadcastHashJoin" in plan  # one row per partition
    assert sorted(r["pos"] for r in positioned.collect()) == list(range(600))


def test_group_index_spreads_a_hot_group(spark, events):
    idx = ordering.with_group_index(events, ["key"], ["id"], "i", num_partitions=8)
    assert "SinglePartition" not in _plan(idx)
    hot = sorted(r["i"] for r in idx.where("key = 'hot'").collect())
    assert hot == list(range(400))


def test_keep_last_and_value_counts_aggregate_map_side(spark, events):
    last = clean.deduplicate(events, "keep_last", ["key"], ["id"])
    plan = _plan(last)
    assert "partial_max" in plan and "Window" not in plan
    counts = profile.value_counts(events, ["key"])
    assert "partial_count" in _plan(counts)


def test_encoding_join_is_broadcast_when_small(spark, events):
    out = encode.target_encode(events, ["key"], "v")
    assert "BroadcastHashJoin" in _plan(out)


def test_balancing_and_folds_avoid_global_windows(spark, events):
    under = balance.undersample(events, "grp", ["id"])
    folds = train.stratified_folds(events, "grp", 5, ["id"])
    for df in (under, folds):
        plan = _plan(df)
        assert "SinglePartition" not in plan
    assert under.groupBy("grp").count().agg(F.min("count"), F.max("count")).first()[0] == 200


def test_interpolation_windows_are_per_partition(spark, events):
    gaps = events.withColumn("v", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("v")))
    out = clean.interpolate(gaps.where("id > 0"), ["v"], ["id"], num_partitions=6)
    assert "SinglePartition" not in _plan(out)
    assert out.where("v IS NULL").count() == 0
