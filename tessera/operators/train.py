"""Splitting, folds, feature pipeline and classifiers.

Models are Spark ML pipelines: the feature step standardises numeric
columns and one-hot encodes string columns (unknown -> all zeros), the label
is indexed in sorted order and predictions are mapped back to label values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import (Imputer, IndexToString, OneHotEncoder, SQLTransformer,
                                StandardScaler, StringIndexer, VectorAssembler)
from pyspark.ml.linalg import DenseVector
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import col, quoted
from tessera.functions.schema import is_categorical, is_numeric
from tessera.operators.balance import MAX_CLASSES
from tessera.operators.boosting import BoostedClassifier
from tessera.operators.hashing import SignedHasher
from tessera.operators.svm import kernel_row_bytes
from tessera.plans.ordering import attach_small, hash_thresholds, with_group_index, with_position

ALGORITHMS = ("logistic_regression", "random_forest", "xgboost", "decision_tree",
              "neural_network", "svm", "knn")
DEFAULT_SEED = 42
DEFAULT_TEST_SIZE = 0.2
# Internal column names are namespaced so a user column (for example a
# target called "label") never collides with them.
FEATURES = "_ts_features"
LABEL = "_ts_label"
PREDICTION = "_ts_prediction"
PROBABILITY = "_ts_probability"
RAW_PREDICTION = "_ts_raw"
PREDICTED_LABEL = "predicted_label"
# Bytes of a partition of the rows that a learner passes over again and again.
FIT_BYTES = 32 << 20
# The reference's trees grow without limit; Spark's own maximum.
MAX_DEPTH = 30
TREES = 100


# ------------------------------------------------------------------- splits

def split_column(df: DataFrame, test_size: float = DEFAULT_TEST_SIZE,
                 seed: int = DEFAULT_SEED, key: Sequence[str] | None = None,
                 name: str = "split") -> DataFrame:
    """M1: exactly ``ceil(n * test_size)`` rows marked 'test', the rest
    'train'.  The test rows are those with the smallest seeded hashes of the
    key (a random subset that repeats), below an exact threshold found by
    counting; nothing is sorted unless rows of equal keys straddle it."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    key = list(key) if key else list(df.columns)
    h = F.xxhash64(F.lit(seed), *[col(k) for k in key])
    hashed = df.withColumn("_ts_h", h)
    n_test = math.ceil(df.count() * test_size)
    if not n_test:
        return df.withColumn(name, F.lit("train"))
    rows = hashed.select(F.lit(0).alias("g"), F.col("_ts_h").alias("h"))
    limit, need, equal = hash_thresholds(rows, {0: n_test})[0]

    def marked(frame: DataFrame, test: Column) -> DataFrame:
        return frame.withColumn(name, F.when(test, F.lit("test")).otherwise(F.lit("train")))

    if need == equal:
        return marked(hashed, F.col("_ts_h") <= limit).drop("_ts_h")
    tied = with_position(hashed.where(F.col("_ts_h") == limit), [quoted(k) for k in key], "_ts_rank")
    return (marked(hashed.where(F.col("_ts_h") != limit), F.col("_ts_h") < limit)
            .unionByName(marked(tied, F.col("_ts_rank") < need).drop("_ts_rank")).drop("_ts_h"))


def train_test_split(df: DataFrame, test_size: float = DEFAULT_TEST_SIZE,
                     seed: int = DEFAULT_SEED, key: Sequence[str] | None = None):
    marked = split_column(df, test_size, seed, key, "_ts_split")
    return (marked.where(F.col("_ts_split") == "train").drop("_ts_split"),
            marked.where(F.col("_ts_split") == "test").drop("_ts_split"))


def stratified_folds(df: DataFrame, target: str, n_splits: int = 5,
                     order_by: Sequence[str] | None = None, name: str = "fold") -> DataFrame:
    """M10 folds, as scikit-learn's unshuffled ``StratifiedKFold``.

    Classes are numbered by first appearance in ``order_by``; in the sorted
    class sequence, position p goes to allocation slot p mod k, and each
    class hands out its folds in contiguous blocks of its allocation, in row
    order.  The in-class row index comes from a distributed sort; only the
    class table (classes x folds) is computed on the driver.
    """
    order_by = list(order_by) if order_by else list(df.columns)
    data = df.where(col(target).isNotNull())
    first = F.min(F.struct(*[col(c) for c in order_by]))
    classes = data.groupBy(col(target)).agg(first.alias("_first"), F.count(F.lit(1)).alias("_n"))
    rows = classes.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"column {target!r} has more than {MAX_CLASSES} values and can't be a class label")
    rows.sort(key=lambda r: tuple(r["_first"]))
    start, ends = 0, []
    for r in rows:
        n_k = r["_n"]
        alloc = [_count_congruent(start, start + n_k, i, n_splits) for i in range(n_splits)]
        cum, bounds = 0, []
        for a in alloc[:-1]:
            cum += a
            bounds.append(cum)
        ends.append((r[target], bounds))
        start += n_k
    table = df.sparkSession.createDataFrame(
        ends, f"`{target}` {df.schema[target].dataType.simpleString()}, _bounds array<long>")
    indexed = with_group_index(data, [target], order_by, "_ts_idx")
    joined = attach_small(indexed, table, [target], "inner")
    fold = F.size(F.filter(F.col("_bounds"), lambda b: b <= F.col("_ts_idx")))
    return joined.withColumn(name, fold.cast("int")).drop("_bounds", "_ts_idx")


def _count_congruent(lo: int, hi: int, r: int, k: int) -> int:
    """#{p in [lo, hi) : p mod k == r}."""
    def upto(x: int) -> int:  # count in [0, x)
        return (x - r + k - 1) // k if x > r else 0
    return upto(hi) - upto(lo)


# ----------------------------------------------------------------- pipeline

# Values up to which a string feature is one-hot encoded (they pass through the
# driver); a feature of more is hashed, into so many places.
MAX_CATEGORIES, HASH_FEATURES = 10_000, 1 << 16
# Stands for a missing category, so that it is a category of its own.
MISSING_CATEGORY = "tessera:missing"


def feature_stages(df: DataFrame, target: str, features: Sequence[str] | None = None,
                   max_categories: int = MAX_CATEGORIES, hash_features: int = HASH_FEATURES,
                   keep_missing: bool = False):
    """M2: standardise numerics, one-hot strings; columns of other types are
    dropped, as in the reference.

    A category unknown in training gives all zeros; a missing one is a
    category of its own if training had it, else zeros too.  A missing number
    gets the training mean, so that prediction accepts it; with
    ``keep_missing`` (for learners that treat it themselves) it stays NaN and
    numbers stay as they are.

    String columns of more than ``max_categories`` values are hashed together
    into ``hash_features`` signed places of a sparse vector (see
    ``tessera.operators.hashing`` for what collisions cost); nothing of theirs
    passes through the driver, and unknown values have their place too.
    """
    cols = list(features) if features else [c for c in df.columns if c != target]
    num = [c for c in cols if is_numeric(df.schema[c].dataType)]
    cat = [c for c in cols if is_categorical(df.schema[c].dataType)]
    if not num and not cat:
        raise ValueError("no numeric or string feature columns")

    def more_than(c: str, most: int) -> bool:
        return df.select(col(c)).distinct().limit(most + 1).count() > most

    if target in df.columns and more_than(target, MAX_CLASSES):
        raise ValueError(f"column {target!r} has more than {MAX_CLASSES} values and can't be a class label")
    wide = [c for c in cat if more_than(c, max_categories)]
    few = [c for c in cat if c not in wide]
    made = [f"nanvl(CAST({quoted(c)} AS DOUBLE), NULL) AS _ts_d_{i}" for i, c in enumerate(num)]
    made += [f"coalesce(CAST({quoted(c)} AS STRING), '{MISSING_CATEGORY}') AS _ts_m_{i}" for i, c in enumerate(few)]
    made += [f"coalesce(CAST({quoted(c)} AS STRING), '{MISSING_CATEGORY}') AS _ts_w_{i}" for i, c in enumerate(wide)]
    stages, parts = [SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")], []
    if num and keep_missing:
        stages.append(VectorAssembler(inputCols=[f"_ts_d_{i}" for i in range(len(num))], outputCol="_ts_num", handleInvalid="keep"))
        parts.append("_ts_num")
    elif num:
        raw, full = ([f"_ts_{k}_{i}" for i in range(len(num))] for k in "df")
        stages += [Imputer(inputCols=raw, outputCols=full, strategy="mean"),
                   VectorAssembler(inputCols=full, outputCol="_ts_num"),
                   StandardScaler(inputCol="_ts_num", outputCol="_ts_num_s",
                                  withMean=True, withStd=True)]
        parts.append("_ts_num_s")
    if few:
        text, idx, vec = ([f"_ts_{k}_{i}" for i in range(len(few))] for k in "mio")
        # "keep" numbers unknown values last, and the last number is dropped.
        stages += [StringIndexer(inputCols=text, outputCols=idx, handleInvalid="keep",
                                 stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=idx, outputCols=vec, dropLast=True, handleInvalid="error")]
        parts += vec
    if wide:
        stages.append(SignedHasher(inputCols=[f"_ts_w_{i}" for i in range(len(wide))], outputCol="_ts_hashed", numFeatures=hash_features))
        parts.append("_ts_hashed")
    stages.append(VectorAssembler(inputCols=parts, outputCol=FEATURES))
    return stages, num + cat


def classifier(algorithm: str, n_rows: int, n_features: int, n_classes: int,
               seed: int = DEFAULT_SEED, options: dict | None = None):
    """Spark ML estimator for each algorithm name of the reference;
    ``options`` are parameters of that estimator (``maxDepth``, ``maxIter``,
    ``blockSize``, ...) in place of the defaults here."""
    est = _estimator(algorithm, n_rows, n_features, n_classes, seed)
    if options:
        est._set(**options)
    est.setFeaturesCol(FEATURES).setLabelCol(LABEL).setPredictionCol(PREDICTION)
    if hasattr(est, "setProbabilityCol"):
        est.setProbabilityCol(PROBABILITY)
    if hasattr(est, "setRawPredictionCol"):
        est.setRawPredictionCol(RAW_PREDICTION)
    return est


def _estimator(algorithm: str, n_rows: int, n_features: int, n_classes: int, seed: int):
    if algorithm == "logistic_regression":
        # C = 1 in scikit-learn is regParam = 1/n here; data is standardised.
        return LogisticRegression(maxIter=1000, regParam=1.0 / max(n_rows, 1), tol=1e-4,
                                  standardization=False)
    if algorithm == "random_forest":
        # Each row keeps its node in each tree, or every pass would lead it
        # down all trees again; the trees are the same.
        return RandomForestClassifier(numTrees=TREES, maxDepth=MAX_DEPTH,
                                      featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True)
    if algorithm == "xgboost":
        return BoostedClassifier()
    if algorithm == "decision_tree":
        return DecisionTreeClassifier(maxDepth=MAX_DEPTH, seed=seed)
    if algorithm == "neural_network":
        return MultilayerPerceptronClassifier(layers=[n_features, 100, max(n_classes, 2)],
                                              maxIter=1000, tol=1e-4, seed=seed)
    if algorithm in ("svm", "knn"):
        from tessera.operators.neighbors import estimator_for
        return estimator_for(algorithm, seed=seed)
    raise ValueError(f"no such algorithm: {algorithm}")


@dataclass
class TrainResult:
    """The fitted pipeline and its scores."""

    model: PipelineModel
    target: str
    algorithm: str
    feature_names: list[str]
    accuracy: float | None
    cv_scores: list[float] | str | None = None
    labels: list[str] = field(default_factory=list)


def _held(prepared: DataFrame, iterative: bool, made_bytes: int = 0) -> tuple[DataFrame, int, int]:
    """The (features, label) pairs persisted, for an ``iterative`` learner in
    partitions of about ``FIT_BYTES``, their number and the width of their
    vectors.  Such a learner runs a task for each partition in every iteration, so that few
    rows must not lie in many partitions, nor many in few; of another learner's
    only the latter are dealt out.  ``made_bytes``: what the learner itself
    holds for each row, if it is more than the row."""
    plain = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    n_rows, first = plain.count(), plain.first()
    width = first[0].size if first else 0
    # A dense entry takes 8 bytes, a sparse one 12; one row stands for all.
    row_bytes = 32 + (8 * width if first is None or isinstance(first[0], DenseVector) else 12 * len(first[0].indices))
    wanted = max(1, math.ceil(n_rows * max(row_bytes, made_bytes) / FIT_BYTES))
    parts = plain.rdd.getNumPartitions()
    if wanted == parts or wanted < parts and not iterative:
        return plain, n_rows, width
    held = (plain.coalesce(wanted) if wanted < parts else plain.repartition(wanted)).persist(StorageLevel.MEMORY_AND_DISK)
    held.count()
    plain.unpersist()
    return held, n_rows, width


def fit_pipeline(train: DataFrame, target: str, algorithm: str = "random_forest",
                 features: Sequence[str] | None = None, seed: int = DEFAULT_SEED,
                 options: dict | None = None):
    """Fit feature stages, label indexer and classifier as one PipelineModel.

    Iterative estimators pass over their input once per iteration, so the
    prepared (features, label) pair is persisted for the fit; a lost cache
    block is recomputed from the (deterministic) lineage.
    """
    stages, used = feature_stages(train, target, features, keep_missing=algorithm == "xgboost")
    feature_model = Pipeline(stages=stages).fit(train)
    label_model = StringIndexer(inputCol=quoted(target) if "." in target else target, outputCol=LABEL,
                                stringOrderType="alphabetAsc").fit(train)
    labels = list(label_model.labels)
    prepared = label_model.transform(feature_model.transform(train)).select(FEATURES, LABEL)
    # Trees take few jobs of much work, which all cores share.
    made_bytes = {"svm": kernel_row_bytes(), "random_forest": 32 + 4 * TREES}.get(algorithm, 0)
    prepared, n_rows, width = _held(prepared, algorithm not in ("random_forest", "decision_tree"), made_bytes)
    try:
        est = classifier(algorithm, n_rows, width, len(labels), seed, options)
        fitted = [est.fit(prepared)]
    finally:
        prepared.unpersist()
    back = IndexToString(inputCol=PREDICTION, outputCol=PREDICTED_LABEL, labels=labels)
    return PipelineModel(stages=[feature_model, label_model, *fitted, back]), used, labels


def cross_validate(df: DataFrame, target: str, algorithm: str, n_splits: int = 5,
                   order_by: Sequence[str] | None = None, features: Sequence[str] | None = None,
                   seed: int = DEFAULT_SEED) -> list[float]:
    """Per-fold accuracy over all rows (stratified, unshuffled folds)."""
    # Fold ids come from checkpointed positions, so re-reading them per fold
    # is deterministic and cheap (a broadcast join on a checkpoint).
    folded = stratified_folds(df, target, n_splits, order_by, "_ts_fold")
    if features:  # only what the fits read is held
        folded = folded.select(*[col(c) for c in dict.fromkeys([*features, target])], "_ts_fold")
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    scores = []
    try:
        for k in range(n_splits):
            train = folded.where(F.col("_ts_fold") != k).drop("_ts_fold")
            test = folded.where(F.col("_ts_fold") == k).drop("_ts_fold")
            model, _, _ = fit_pipeline(train, target, algorithm, features, seed)
            scores.append(accuracy_of(model.transform(test), target))
    finally:
        folded.unpersist()
    return scores


def accuracy_of(pred: DataFrame, target: str) -> float:
    row = pred.agg(F.avg((F.col(PREDICTED_LABEL) == col(target).cast("string"))
                         .cast("double"))).first()
    return row[0]


def train_model(df: DataFrame, target: str, algorithm: str = "random_forest",
                test_size: float = DEFAULT_TEST_SIZE, cross_validation: str | int | None = None,
                key: Sequence[str] | None = None, seed: int = DEFAULT_SEED,
                features: Sequence[str] | None = None) -> TrainResult:
    """The reference's training request: split, optional CV on all rows,
    fit on the training part, accuracy on the held-out part."""
    if not target or target not in df.columns:
        raise ValueError(f"the data has no target column {target!r}")
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no such algorithm: {algorithm} (known: {', '.join(ALGORITHMS)})")
    cv_scores = None
    if cross_validation and cross_validation != "none":
        try:
            k = 5 if cross_validation == "stratified" else int(cross_validation)
            cv_scores = cross_validate(df, target, algorithm, k, key, features, seed)
        except Exception as exc:  # noqa: BLE001 - reported as text, as in the reference
            cv_scores = f"no fold scores: {exc}"
    marked = split_column(df, test_size, seed, key, "_ts_split")
    train = marked.where(F.col("_ts_split") == "train").drop("_ts_split")
    test = marked.where(F.col("_ts_split") == "test").drop("_ts_split")
    model, used, labels = fit_pipeline(train, target, algorithm, features, seed)
    acc = accuracy_of(model.transform(test), target)
    return TrainResult(model, target, algorithm, used, acc, cv_scores, labels)

