"""Signed feature hashing (M2 for string columns of any number of values).

A value's place among ``numFeatures`` and its sign come from the MD5 digest of
its column's number and text.  Of ``m`` distinct values, the expected share that
meets another one in its place is ``1 - (1 - 1/D)^(m - 1)``, at most m / D; as
signs are independent, inner products of hashed rows are unbiased, with a
variance of at most ``2/D`` times the product of their squared lengths
(Weinberger et al., 2009).  Vectors are sparse: a row holds one entry for each
column, however large D is, and nothing is fitted or collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import col


def collision_bound(values: int, places: int) -> float:
    """Expected share of ``values`` that share their place with another."""
    return 1.0 - (1.0 - 1.0 / places) ** max(values - 1, 0)


def slot(text: Column, number: int, places: int) -> tuple[Column, Column]:
    """Place (int) and sign (1.0 or -1.0) of a value of the column with that
    number; null stays null."""
    digest = F.md5(F.concat(F.lit(f"{number}="), text.cast("string")).cast("binary"))
    place = F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(places)).cast("int")
    sign = F.when(F.substring(digest, 13, 1).between("0", "7"), 1.0).when(digest.isNotNull(), -1.0)
    return place, sign


class SignedHasher(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Hash string columns into one sparse vector; null values have no entry
    and values of several columns that share a place are added up."""

    numFeatures = Param(Params._dummy(), "numFeatures", "places of the vector", TypeConverters.toInt)

    def __init__(self, inputCols: list[str] | None = None, outputCol: str | None = None, numFeatures: int = 1 << 16):
        super().__init__()
        self._set(numFeatures=numFeatures, **({"inputCols": inputCols} if inputCols else {}), **({"outputCol": outputCol} if outputCol else {}))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        places = self.getOrDefault(self.numFeatures)
        slots = [slot(col(c), i, places) for i, c in enumerate(self.getInputCols())]
        vector = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

        @F.arrow_udf(VectorUDT())
        def build(place: pa.Array, sign: pa.Array) -> pa.Array:
            rows = []
            for own, signs in zip(place.to_pylist(), sign.to_pylist(), strict=True):
                known = [(p, s) for p, s in zip(own, signs, strict=True) if p is not None]
                at, back = np.unique(np.array([p for p, _ in known], dtype=np.int32), return_inverse=True)
                total = np.bincount(back, [s for _, s in known], len(at)) if known else np.zeros(0)
                rows.append({"type": 0, "size": places, "indices": at.tolist(), "values": total.tolist()})
            return pa.array(rows, type=vector)

        return dataset.withColumn(self.getOutputCol(), build(F.array(*[p for p, _ in slots]), F.array(*[s for _, s in slots])))
