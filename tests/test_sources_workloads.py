import os
import posixpath

import duckdb
import pytest

import __spark_entry__ as entry_module
from tessera import workloads
from tessera.sources import catalog, files

SF_SMALL = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_zone_fallback_formats_and_catalog(spark, tmp_root):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    files.write_path(df, posixpath.join(tmp_root, files.RAW_ZONE, "raw.parquet"), "parquet")
    files.write_path(df, posixpath.join(tmp_root, files.PROCESSED_ZONE, "processed_x.json"), "json")
    assert files.load_dataset(spark, tmp_root, "raw.parquet").count() == 2
    assert files.load_dataset(spark, tmp_root, "processed_x.json").count() == 2
    with pytest.raises(FileNotFoundError):
        files.load_dataset(spark, tmp_root, "nothing.csv")
    with pytest.raises(ValueError):
        files.load_dataset(spark, tmp_root, "table.xml")
    array_json = posixpath.join(tmp_root, files.RAW_ZONE, "records.json")
    os.makedirs(os.path.dirname(array_json), exist_ok=True)
    with open(array_json, "w") as fh:
        fh.write('[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]')
    assert sorted(r["a"] for r in files.load_dataset(spark, tmp_root, "records.json").collect()) == [1, 2]
    listed = {(r["zone"], r["name"]) for r in catalog.list_datasets(spark, tmp_root).collect()}
    assert listed == {("uploaded_data", "raw.parquet"), ("uploaded_data", "records.json"),
                      ("processed_data", "processed_x.json")}
    counts = {r["item"]: r["count"] for r in catalog.catalog_counts(spark, tmp_root).collect()}
    assert counts == {"datasets": 2, "processed": 1, "models": 0}
    assert files.processed_name("a.csv") == "processed_a.csv"
    assert files.processed_name("a.csv", "suffix") == "a_processed.csv"


def test_entry_smoke(spark):
    out = entry_module.entry(spark)
    assert out.count() == 4
    assert out.columns[:2] == ["column_name", "count"]


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(None if r[i] is None else (round(r[i], 9) if isinstance(r[i], float) else str(r[i]))
                        for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(workloads.ORACLES))
def test_query_matches_oracle_small(spark, duck, name):
    sdf = workloads.QUERIES[name](spark, SF_SMALL)
    res = duck.sql(workloads.ORACLES[name])
    assert sorted(sdf.columns) == sorted(res.columns)
    assert _digest(sdf.columns, [tuple(r) for r in sdf.collect()]) == _digest(res.columns, res.fetchall())


FAST_ROWS_ONLY = ["transform_boxcox_customer", "skew_yeojohnson_customer", "pca_embeddings",
                  "lda_embeddings", "predict_documents"]


@pytest.mark.parametrize("name", FAST_ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    assert workloads.QUERIES[name](spark, SF_SMALL).count() > 0


def test_every_query_has_oracle_or_is_listed():
    rows_only = set(workloads.QUERIES) - set(workloads.ORACLES)
    assert rows_only <= set(FAST_ROWS_ONLY) | {
        "skew_boxcox_part", "rfe_lineitem", "train_evaluate_embeddings",
        *[q for q in workloads.QUERIES if q.startswith("train_")]}


def test_preprocess_and_engineer_requests_write_zones(spark, tmp_root):
    from tessera.plans.engineering import engineer_dataset
    from tessera.plans.preprocess import preprocess_dataset

    rows = [(i, float(i % 7), "n/a" if i % 5 == 0 else ("x" if i % 2 else "y"), "a" if i % 3 else "b")
            for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v double, s string, target string")
    raw = posixpath.join(tmp_root, files.RAW_ZONE, "sample.csv")
    files.write_path(df.coalesce(1), raw, "csv")
    name = preprocess_dataset(spark, tmp_root, "sample.csv", {
        "target_column": "target", "missing_strategy": "most_frequent", "missing_indicator": True,
        "encoding_method": "onehot", "encoding_columns": ["s"], "scaler": "minmax",
        "imbalance_method": "undersample", "key": ["id"], "duplicate_handling": "drop"})
    assert name == "processed_sample.csv"
    out = files.load_dataset(spark, tmp_root, name)
    assert {"s_x", "s_y"} <= set(out.columns)  # 'n/a' became missing, then the mode
    assert "s_missing" in out.columns and "v_missing" not in out.columns  # only for columns with nulls
    counts = {r["target"]: r["count"] for r in out.groupBy("target").count().collect()}
    assert counts["a"] == counts["b"] == 20
    result = engineer_dataset(spark, tmp_root, "sample.csv", "polynomial", "variance", "none", "target")
    assert result["processed_dataset"] == "sample_processed.csv"
    assert result["shape"][0] == 60 and len(result["preview"]) == 5


def test_request_functions_train_evaluate_predict(spark, tmp_root):
    from tessera.plans import requests

    rows = [(i, float(i % 10), "u" if i % 3 else "v", "yes" if (i % 10) + (i % 3 == 0) * 3 > 5 else "no")
            for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, seg string, target string")
    files.write_path(df, posixpath.join(tmp_root, files.RAW_ZONE, "t.parquet"), "parquet")
    for kind in requests.ANALYSES:
        out = requests.eda(files.load_dataset(spark, tmp_root, "t.parquet"), kind, "target", ["id"])
        frames = out.values() if isinstance(out, dict) else [out]
        assert all(f.count() >= 1 for f in frames)
    with pytest.raises(ValueError):
        requests.eda(df, "nonsense")
    model_id, metrics = requests.train_dataset(spark, tmp_root, "t.parquet", "target",
                                               "decision_tree", 0.25, "stratified", key=["id"])
    assert metrics["accuracy"] > 0.8 and len(metrics["cross_validation_scores"]) == 5
    rep = {r["metric"]: r["value"] for r in
           requests.evaluate_dataset(spark, tmp_root, model_id, "t.parquet", "target").collect()}
    assert set(rep) == {"accuracy", "precision", "recall", "f1", "roc_auc"}
    cm = requests.confusion_dataset(spark, tmp_root, model_id, "t.parquet", "target")
    assert sum(r["count"] for r in cm.collect()) == 120
    pred = requests.predict_dataset(spark, tmp_root, model_id, df.select("id", "x"), ["id"])
    assert pred.count() == 120
