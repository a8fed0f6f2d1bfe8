"""Column classes by Spark type.

The reference picks columns by pandas dtype; here the same classes are read
from ``df.schema``.  Booleans count as categorical everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
CATEGORICAL_TYPES = (T.StringType, T.BooleanType, T.VarcharType, T.CharType)
TEMPORAL_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
FLOATING_TYPES = (T.FloatType, T.DoubleType)


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_categorical(dtype: T.DataType) -> bool:
    return isinstance(dtype, CATEGORICAL_TYPES)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL_TYPES)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [n for n, t in _types(df).items() if is_numeric(t) and n not in skip]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [n for n, t in _types(df).items() if is_categorical(t) and n not in skip]


def temporal_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [n for n, t in _types(df).items() if is_temporal(t) and n not in skip]


def select_columns(df: DataFrame, requested: Sequence[str] | None, kind: str,
                   exclude: Iterable[str] = ()) -> list[str]:
    """Columns of ``kind`` ('numeric', 'categorical', 'temporal').

    An empty or missing request means every column of that kind; otherwise
    the requested names that exist and have that kind, in request order.
    Unknown names are ignored, as in the reference.
    """
    pick = {"numeric": numeric_columns, "categorical": categorical_columns,
            "temporal": temporal_columns}[kind]
    available = pick(df, exclude)
    if not requested:
        return available
    allowed = set(available)
    return [c for c in requested if c in allowed]


def existing(df: DataFrame, requested: Sequence[str] | None,
             exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    names = set(df.columns)
    return [c for c in (requested or []) if c in names and c not in skip]
