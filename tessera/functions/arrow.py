"""Functions of this package over Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def schema_of(schema: str | StructType) -> StructType:
    return _parse_datatype_string(schema) if isinstance(schema, str) else schema


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(schema_of(schema))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``; workers look for this package where the driver
    found it too, besides their own path."""
    environment = df.sparkSession.sparkContext.environment
    paths = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if PACKAGE_ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_ROOT])
    return df.mapInArrow(run, schema_of(schema))


def rows_of(column: pa.Array, kind: str) -> list:
    """NumPy views of a column of bytes."""
    import numpy as np

    return [np.frombuffer(x, dtype=kind) for x in column.to_pylist()]
