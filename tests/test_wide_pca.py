import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import features, wide_pca
from tests.conftest import SF_SMALL


def _vectors(spark, matrix, parts=5):
    rows = [(i, Vectors.sparse(len(x), {int(j): float(x[j]) for j in np.flatnonzero(x)})) for i, x in enumerate(matrix)]
    return spark.createDataFrame(rows, ["id", "v"]).repartition(parts)


def _close(a, b, tolerance=1e-7):
    assert a.shape == b.shape
    np.testing.assert_allclose(np.abs(a), np.abs(b), atol=tolerance)


def test_agrees_with_the_covariance_on_embeddings(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    wide, cols = features.array_columns(emb, "embedding", "e")
    dense = features.fit_pca(wide, cols, 2)
    vectors = emb.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    found = wide_pca.fit_wide_pca(vectors, "v", 2, oversample=20, tolerance=1e-8)
    assert 0 < found.rounds
    _close(found.components, np.array(dense.weights), 1e-6)
    got = {r["vec_id"]: (r["PC1"], r["PC2"]) for r in found.transform(vectors, "v").collect()}
    want = {r["vec_id"]: (r["PC1"], r["PC2"]) for r in dense.transform(wide, ["vec_id"]).collect()}
    for key, row in want.items():
        np.testing.assert_allclose(got[key], row, atol=1e-5)


def test_fifty_thousand_sparse_columns(spark):
    """Two planted directions over 50,000 columns; a covariance would take 20 GB."""
    rng = np.random.default_rng(2)
    d, n = 50_000, 400
    rows = []
    for i in range(n):
        a, b = rng.normal() * 9, rng.normal() * 5
        noise = rng.choice(np.arange(100, d), 12, replace=False)
        own = {3: a, 70: a, 90: b, 95: -b, **{int(j): float(v) for j, v in zip(noise, rng.normal(size=12) * 0.3)}}
        rows.append((i, Vectors.sparse(d, own)))
    df = spark.createDataFrame(rows, ["id", "v"]).repartition(6)
    found = wide_pca.fit_wide_pca(df, "v", 2, tolerance=1e-6, task_bytes=4096)
    alone = wide_pca.fit_wide_pca(df, "v", 2, tolerance=1e-6)
    assert alone.rounds == found.rounds > 0
    np.testing.assert_allclose(alone.components, found.components, atol=1e-9)
    with pytest.raises(ValueError):
        wide_pca.fit_wide_pca(df, "v", 2, tolerance=0.0, max_rounds=2)
    assert found.components.shape == (2, d)
    strongest = [set(np.argsort(-np.abs(c))[:2]) for c in found.components]
    assert strongest == [{3, 70}, {90, 95}]
    matrix = np.zeros((n, d), dtype=np.float32)
    for i, v in rows:
        matrix[i, v.indices] = v.values
    centred = matrix.astype(float) - matrix.mean(axis=0, dtype=float)
    gram = np.linalg.eigvalsh(centred @ centred.T)[::-1][:2] / (n - 1)
    np.testing.assert_allclose(found.variances, gram, rtol=1e-6)


def test_few_columns_are_exact_and_repeatable_over_partitions(spark):
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(60, 7)) * [5, 3, 2, 1, 1, 0, 1] + 100.0
    matrix[:, 5] = 0
    want = np.linalg.svd(matrix - matrix.mean(axis=0))
    one, many = (wide_pca.fit_wide_pca(_vectors(spark, matrix, p), "v", 3, task_bytes=p * 500) for p in (13, 1))
    for found in (one, many):
        assert found.rounds == 0
        _close(found.components, want[2][:3], 1e-9)
        np.testing.assert_allclose(found.variances, want[1][:3] ** 2 / 59, rtol=1e-9)
    np.testing.assert_allclose(one.components, many.components, atol=1e-9)


def test_missing_rows_constant_columns_and_clashing_names(spark):
    rows = [(1, Vectors.dense(1.0, 2.0)), (2, None), (3, Vectors.dense(float("nan"), 1.0)), (4, Vectors.dense(3.0, 2.0)),
            (5, Vectors.sparse(2, {1: 2.0}))]
    df = spark.createDataFrame(rows, ["id", "v"])
    found = wide_pca.fit_wide_pca(df, "v", 5)
    _close(found.components, np.eye(2), 1e-12)
    np.testing.assert_allclose(found.variances, [7 / 3, 0.0], atol=1e-12)
    got = {r["id"]: r["PC1"] for r in found.transform(df, "v").collect()}
    assert got[2] is None and got[3] is None
    assert got[4] == pytest.approx(3 - 4 / 3)
    with pytest.raises(ValueError):
        found.transform(df.withColumn("PC1", F.lit(0)), "v")
    with pytest.raises(ValueError):
        wide_pca.fit_wide_pca(df.limit(0), "v")
    with pytest.raises(ValueError):
        wide_pca.fit_wide_pca(df.unionByName(spark.createDataFrame([(9, Vectors.dense(1.0))], ["id", "v"])), "v")


@pytest.mark.parametrize("task_bytes", [4096, wide_pca.FIT_BYTES])
def test_variances_that_hardly_differ(spark, task_bytes):
    """64 variances from 1.01 down to 0.95: no gap behind the directions, and
    two axes that are all but equal.  100 rounds didn't settle them."""
    rng = np.random.default_rng(7)
    turned = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    half = np.sqrt(np.linspace(1.01, 0.95, 64) * 127 / 2)[:, None] * turned
    matrix = np.vstack([half, -half]) + 3.0
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(matrix)]
    df = spark.createDataFrame(rows, "id long, x array<double>").select("id", array_to_vector("x").alias("v")).repartition(4)
    found = wide_pca.fit_wide_pca(df, "v", 2, oversample=40, tolerance=1e-10, task_bytes=task_bytes)
    assert 0 < found.rounds <= 3
    _close(found.components, turned[:2], 1e-8)
    np.testing.assert_allclose(found.variances, np.linspace(1.01, 0.95, 64)[:2], rtol=1e-10)


def test_equal_variances_settle_by_their_residual(spark):
    half = np.eye(40) * np.sqrt(79 / 2)
    df = _vectors(spark, np.vstack([half, -half]), 3)
    found = wide_pca.fit_wide_pca(df, "v", 2, oversample=6, tolerance=1e-10)
    np.testing.assert_allclose(found.variances, [1.0, 1.0], rtol=1e-10)
    np.testing.assert_allclose(found.components @ found.components.T, np.eye(2), atol=1e-10)


def test_query_leaves_out_vectors_that_are_null_or_hold_nulls(spark, tmp_root):
    from tessera import workloads

    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 6)) * [5, 3, 1, 1, 1, 1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_root}/odd_vectors/embeddings.parquet")
    got = {(r["component"], r["place"]): r for r in workloads.QUERIES["wide_pca_embeddings"](spark, f"{tmp_root}/odd_vectors").collect()}
    want = np.linalg.eigvalsh(np.cov(x.astype(np.float32).astype(float).T))[::-1]
    assert len(got) == 12
    assert [got[k, 1]["variance"] for k in (1, 2)] == pytest.approx(want[:2].tolist(), rel=1e-4)
