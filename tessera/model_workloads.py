"""Queries with SQL of their own for boosting, hashing, the nearest-neighbour
join, curves and normality.  Imported by ``tessera.workloads``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import boosting, evaluate, features, hashing, knn_join, normality, wide_pca
from tessera.workloads import embedding_frame, num, register, sql_num, table

_SPLIT_FEATURES = ("l_quantity", "l_discount", "l_tax")

_SPLIT_SQL = f"""
WITH r AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN -0.5 ELSE 0.5 END AS g, l_quantity AS q, round(l_discount * 100) AS d,
    CASE WHEN l_linenumber > 1 THEN round(l_tax * 100) END AS t FROM lineitem
), e AS (
  SELECT 0 AS i, q AS v, g FROM r UNION ALL SELECT 1, d, g FROM r UNION ALL SELECT 2, t, g FROM r
), total AS (SELECT sum(g) AS g, 0.25 * count(*) AS h FROM r),
missing AS (SELECT i, coalesce(sum(g) FILTER (v IS NULL), 0) AS g, 0.25 * count(*) FILTER (v IS NULL) AS h FROM e GROUP BY i),
steps AS (SELECT i, v, sum(g) AS g, 0.25 * count(*) AS h FROM e WHERE v IS NOT NULL GROUP BY i, v),
sides AS (
  SELECT i, lead(v) OVER w AS cut, sum(g) OVER w AS lg, sum(h) OVER w AS lh FROM steps WINDOW w AS (PARTITION BY i ORDER BY v)
), cuts AS (
  SELECT s.i, cut, side = 1 AS missing_left, lg + side * m.g AS lg, lh + side * m.h AS lh, t.g - lg - side * m.g AS rg, t.h - lh - side * m.h AS rh, t.g, t.h
  FROM sides s JOIN missing m ON s.i = m.i, total t, (VALUES (0), (1)) AS x(side) WHERE cut IS NOT NULL
)
SELECT ['l_quantity', 'l_discount', 'l_tax'][i + 1] AS feature, cut, missing_left,
  {sql_num("-0.3 * lg / (lh + 1)")} AS left_weight, {sql_num("-0.3 * rg / (rh + 1)")} AS right_weight
FROM cuts WHERE lh >= 1 AND rh >= 1
ORDER BY lg * lg / (lh + 1) + rg * rg / (rh + 1) - g * g / (h + 1) DESC, i, cut, missing_left LIMIT 1
"""


@register("boost_first_split_lineitem", _SPLIT_SQL)
def boost_first_split_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the first cut that boosting makes for returned lines, with a learned
    side for the missing tax of first lines."""
    t = table(spark, sf_dir, "lineitem")
    x = F.array(F.col("l_quantity"), F.round(F.col("l_discount") * 100), F.when(F.col("l_linenumber") > 1, F.round(F.col("l_tax") * 100)))
    rows = (t.select(x.alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
            .select(*boosting.sparse_array(), "label"))
    names = F.array(*map(F.lit, _SPLIT_FEATURES))
    return boosting.first_split(rows, len(_SPLIT_FEATURES)).select(
        F.get(names, F.col("feature")).alias("feature"), "cut", "missing_left",
        num("left_weight").alias("left_weight"), num("right_weight").alias("right_weight"))


_HASH_PLACES = 1024


def _sql_slot(column: str, number: int) -> str:
    digest = f"md5('{number}=' || {column})"
    return (f"CAST(('0x' || substr({digest}, 1, 12)) AS BIGINT) % {_HASH_PLACES} AS place_{number}, "
            f"CASE WHEN substr({digest}, 13, 1) BETWEEN '0' AND '7' THEN 1.0 ELSE -1.0 END AS sign_{number}")


@register("hash_features_customer", f"""
WITH s AS (SELECT c_custkey, {_sql_slot('c_name', 0)}, {_sql_slot('c_mktsegment', 1)} FROM customer)
SELECT c_custkey, CAST(place_0 AS INTEGER) AS place_0, CAST(place_1 AS INTEGER) AS place_1,
  CAST(CASE WHEN place_0 = place_1 THEN sign_0 + sign_1 ELSE sign_0 END AS DOUBLE) AS value_0,
  CAST(CASE WHEN place_0 = place_1 THEN sign_0 + sign_1 ELSE sign_1 END AS DOUBLE) AS value_1 FROM s""")
def hash_features_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: a column of distinct names and one of segments in one signed hashed
    vector; each row's places and what stands there."""
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    made = hashing.SignedHasher(["c_name", "c_mktsegment"], "v", _HASH_PLACES).transform(t)
    places = [hashing.slot(F.col(c), i, _HASH_PLACES)[0] for i, c in enumerate(("c_name", "c_mktsegment"))]
    whole = vector_to_array("v")
    return made.select("c_custkey", *(p.alias(f"place_{i}") for i, p in enumerate(places)),
                       *(F.get(whole, p).alias(f"value_{i}") for i, p in enumerate(places)))


@register("knn_join_embeddings", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
near AS (
  SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.x, b.x) AS far,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, {sql_num("far")} AS distance FROM near WHERE rank <= 5""")
def knn_join_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the five nearest other vectors of every vector, by the pivot join."""
    rows = knn_join.written(knn_join.points(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "embeddings")
    near = knn_join.knn_join(rows, rows, 6).filter(F.col("query") != F.col("id"))
    again = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    return (near.withColumn("place", again).filter(F.col("place") <= 5)
            .select(F.col("query").alias("vec_id"), F.col("place").cast("int").alias("rank"), F.col("id").alias("neighbour"), num("distance").alias("distance")))


_STEPS = 50


@register("curve_points_documents", f"""
WITH r AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS s FROM documents JOIN labels USING (doc_id)),
t AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS q FROM r GROUP BY s),
c AS (SELECT s, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS ps, sum(q) OVER () AS qs FROM t
      WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, tp * {_STEPS} // ps + fp * {_STEPS} // qs AS cell FROM c),
l AS (SELECT s AS threshold, tp, fp, ps, qs FROM k QUALIFY row_number() OVER (PARTITION BY cell ORDER BY tp + fp DESC) = 1
      UNION ALL SELECT NULL, 0, 0, max(ps), max(qs) FROM c)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {sql_num("tp / CAST(ps AS DOUBLE)")} AS tpr,
  {sql_num("fp / CAST(qs AS DOUBLE)")} AS fpr, CASE WHEN tp + fp > 0 THEN {sql_num("tp / CAST(tp + fp AS DOUBLE)")} END AS precision FROM l""")
def curve_points_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of V3: ROC and precision-recall points of n_chars as a score."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    points = evaluate.curve_points(docs, F.col("quality") == 1, F.col("n_chars"), _STEPS)
    return points.select("threshold", "tp", "fp", *(num(c).alias(c) for c in ("tpr", "fpr", "precision")))


def _sql_normality(source: str, column: str) -> str:
    p = "((before + (k + 1) / 2e0 - 0.375e0) / (n + 0.25e0))"
    return f"""SELECT '{column}' AS column_name, CAST(n AS BIGINT) AS n, w, {normality.p_value_sql('w', 'n')} AS p FROM (
  SELECT n, pow(mx - m * x / n, 2) / ((mm - m * m / n) * (xx - x * x / n)) AS w FROM (
    SELECT max(n) AS n, sum(k * z) AS m, sum(k * v) AS x, sum(k * z * z) AS mm, sum(k * v * v) AS xx, sum(k * z * v) AS mx FROM (
      SELECT v, k, n, {normality.normal_quantile_sql(p)} AS z FROM (
        SELECT v, k, sum(k) OVER (ORDER BY v) - k AS before, sum(k) OVER () AS n FROM (
          SELECT {column} - (SELECT avg({column}) FROM {source}) AS v, count(*) AS k FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)))))"""


@register("normality_events_customer", f"""SELECT column_name, n, {sql_num('w')} AS w, {sql_num('p')} AS p FROM (
  {_sql_normality('events', 'value')} UNION ALL {_sql_normality('customer', 'c_acctbal')})""")
def normality_events_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: Shapiro-Francia W' and its p-value of event values and balances."""
    both = (normality.normality(table(spark, sf_dir, "events"), ["value"])
            .unionByName(normality.normality(table(spark, sf_dir, "customer"), ["c_acctbal"])))
    return both.select("column_name", "n", num("w").alias("w"), num("p").alias("p"))


def _sql_axes(k: int) -> str:
    """Axes a0 .. of embeddings (v: loadings, l: variance) with their means
    (centre): the covariance squared 30 times is the leading axis times
    itself; its share is taken off for the next one."""
    steps = ["""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e),
means AS (SELECT i, avg(v) AS m FROM u GROUP BY i), centre AS (SELECT list(m ORDER BY i) AS mu FROM means),
c AS (SELECT vec_id, i, v - m AS v FROM u JOIN means USING (i)),
cov AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) / (SELECT count(*) - 1 FROM e) AS s FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2),
m0 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM cov GROUP BY i))"""]
    for t in range(k):
        steps.append(f"""p{t} AS (SELECT 0 AS step, m AS a FROM m{t} UNION ALL
  SELECT step + 1, [[list_inner_product(r, q) / t for q in a] for r in a]
  FROM (SELECT step, a, list_sum([list_inner_product(w, w) for w in a]) AS t FROM p{t} WHERE step < 30)),
r{t} AS (SELECT r, j FROM (SELECT unnest(a) AS r, generate_subscripts(a, 1) AS j FROM p{t} WHERE step = 30) ORDER BY r[j] DESC, j LIMIT 1),
v{t} AS (SELECT [y / sqrt(list_inner_product(r, r)) for y in r] AS v FROM r{t}),
a{t} AS (SELECT v, list_inner_product(v, [list_inner_product(q, v) for q in m]) AS l FROM v{t}, m{t}),
m{t + 1} AS (SELECT list([y - l * v[i] * v[j] for y, j in r] ORDER BY i) AS m
  FROM (SELECT unnest(m) AS r, generate_subscripts(m, 1) AS i FROM m{t}), a{t})""")
    return "WITH RECURSIVE " + ",\n".join(steps)


def _sixth(c) -> Column:
    """Six decimals; minus zero is zero."""
    return F.round(c, 6) + F.lit(0.0)


@register("pca_scores_embeddings", f"""{_sql_axes(3)}
SELECT vec_id, {', '.join(f"round(list_inner_product(d, a{t}.v), 6) + 0.0 AS PC{t + 1}" for t in range(3))}
FROM (SELECT vec_id, list(v ORDER BY i) AS d FROM c GROUP BY vec_id), a0, a1, a2""")
def pca_scores_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first three principal components, six decimals."""
    wide, cols = embedding_frame(spark, sf_dir)
    scores = features.fit_pca(wide, cols, 3).transform(wide, ["vec_id"])
    return scores.select("vec_id", *(_sixth(f"PC{i}").alias(f"PC{i}") for i in (1, 2, 3)))


@register("wide_pca_embeddings", _sql_axes(2) + "\nUNION ALL\n".join(f"""
SELECT {t + 1} AS component, {sql_num("l")} AS variance, CAST(i AS INTEGER) AS place, round(v[i], 4) + 0.0 AS loading
FROM a{t}, generate_series(1, (SELECT count(*) FROM means)) AS n(i)""" for t in range(2)))
def wide_pca_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 for wide rows: two axes of embeddings by the range finder, four
    decimals, and their variances."""
    # array_to_vector doesn't take nulls; such rows have no part in the fit.
    whole = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull()))
    vectors = whole.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    found = wide_pca.fit_wide_pca(vectors, "v", 2, oversample=40, tolerance=1e-10)
    rows = [(t + 1, float(found.variances[t]), i + 1, float(x)) for t, axis in enumerate(found.components) for i, x in enumerate(axis)]
    made = spark.createDataFrame(rows, "component int, variance double, place int, loading double")
    return made.select("component", num("variance").alias("variance"), "place", (F.round("loading", 4) + F.lit(0.0)).alias("loading"))
