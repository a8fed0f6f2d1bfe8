"""RBF-kernel support vector classifier (M6) on Spark.

An exact kernel SVM needs the n x n kernel matrix.  Instead the RBF kernel
is approximated by random Fourier features (Rahimi and Recht, 2007):
z(x) = sqrt(2/D) cos(W x + b) with W ~ N(0, 2 gamma), b ~ U(0, 2 pi), so
that z(x).z(y) ~ exp(-gamma |x - y|^2).  A linear SVM (hinge loss, C = 1)
is trained on z(x), one-vs-rest for more than two classes, and its margins
are calibrated into probabilities by a logistic regression (Platt scaling,
generalised to several classes).  gamma follows scikit-learn's 'scale':
1 / (n_features * variance of all feature values).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol,
                                     HasPredictionCol, HasProbabilityCol, HasRawPredictionCol,
                                     HasSeed)
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_COMPONENTS = 200


def kernel_row_bytes(components: int = DEFAULT_COMPONENTS) -> int:
    """Bytes of a row of Fourier features, as it is held for the fit."""
    return 32 + 8 * components


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol,
                            DefaultParamsReadable, DefaultParamsWritable):
    """Fitted random Fourier map; the matrix product runs in an Arrow-batched
    pandas UDF (numpy over whole batches, never per row)."""

    weights = Param(Params._dummy(), "weights", "d x D projection, row-major",
                    typeConverter=TypeConverters.toListFloat)
    offsets = Param(Params._dummy(), "offsets", "D phase offsets",
                    typeConverter=TypeConverters.toListFloat)
    inputSize = Param(Params._dummy(), "inputSize", "d", typeConverter=TypeConverters.toInt)

    def __init__(self, inputCol: str = "features", outputCol: str = "rff",
                 weights=None, offsets=None, inputSize: int = 0):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, inputSize=inputSize,
                  weights=list(weights or []), offsets=list(offsets or []))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        d = self.getOrDefault(self.inputSize)
        w = np.asarray(self.getOrDefault(self.weights), dtype=float).reshape(d, -1)
        b = np.asarray(self.getOrDefault(self.offsets), dtype=float)
        scale = np.sqrt(2.0 / len(b))

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(rows: pd.Series) -> pd.Series:
            x = np.vstack(rows.to_numpy()) if len(rows) else np.zeros((0, d))
            z = scale * np.cos(x @ w + b)
            return pd.Series(list(z))

        arr = vector_to_array(F.col(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(project(arr)))


class KernelSVM(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol,
                HasRawPredictionCol, HasSeed):
    """Estimator producing a PipelineModel: features -> RFF -> linear SVM
    (OvR) -> calibrated probabilities."""

    def __init__(self, components: int = DEFAULT_COMPONENTS, seed: int = 42,
                 max_iter: int = 1000):
        super().__init__()
        self._set(seed=seed)
        self.components = components
        self.max_iter = max_iter

    def setFeaturesCol(self, value: str) -> "KernelSVM":
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str) -> "KernelSVM":
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str) -> "KernelSVM":
        return self._set(predictionCol=value)

    def setProbabilityCol(self, value: str) -> "KernelSVM":
        return self._set(probabilityCol=value)

    def setRawPredictionCol(self, value: str) -> "KernelSVM":
        return self._set(rawPredictionCol=value)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        feats, label = self.getFeaturesCol(), self.getLabelCol()
        stats = dataset.select(Summarizer.metrics("mean", "variance", "count")
                               .summary(F.col(feats)).alias("s")).first()["s"]
        mean, var, n = stats["mean"].toArray(), stats["variance"].toArray(), int(stats["count"])
        d = len(mean)
        pop_var = var * (n - 1) / n if n > 1 else var
        total_var = float(np.mean(pop_var + mean ** 2) - np.mean(mean) ** 2)
        gamma = 1.0 / (d * total_var) if total_var > 0 else 1.0
        rng = np.random.default_rng(self.getSeed())
        w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(d, self.components))
        b = rng.uniform(0.0, 2.0 * np.pi, size=self.components)
        rff = RandomFourierFeatures(feats, "_ts_rff", w.ravel().tolist(), b.tolist(), d)
        # The optimiser passes over the mapped rows once per iteration: keep
        # them (MEMORY_AND_DISK; a lost block is recomputed from lineage).
        mapped = rff.transform(dataset).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit_mapped(mapped, rff, label, n)
        finally:
            mapped.unpersist()

    def _fit_mapped(self, mapped: DataFrame, rff: RandomFourierFeatures, label: str,
                    n: int) -> PipelineModel:

        n_classes = int(mapped.agg(F.max(label)).first()[0] or 0) + 1
        svc = LinearSVC(featuresCol="_ts_rff", labelCol=label, maxIter=self.max_iter,
                        regParam=1.0 / max(n, 1), tol=1e-3, standardization=False,
                        rawPredictionCol=self.getRawPredictionCol())
        if n_classes > 2:
            svc = OneVsRest(classifier=svc, featuresCol="_ts_rff", labelCol=label)
        svc.setPredictionCol(self.getPredictionCol()).setRawPredictionCol(self.getRawPredictionCol())
        svc_model = svc.fit(mapped)
        margins = svc_model.transform(mapped)
        platt = LogisticRegression(featuresCol=self.getRawPredictionCol(), labelCol=label,
                                   predictionCol="_ts_platt_prediction",
                                   rawPredictionCol="_ts_platt_raw",
                                   probabilityCol=self.getProbabilityCol(), maxIter=200)
        platt_model = platt.fit(margins)
        return PipelineModel(stages=[rff, svc_model, platt_model])
