"""Dataset loading and saving in zones.

A dataset root holds ``uploaded_data`` (raw), ``processed_data`` and
``saved_models``.  Any Hadoop path works as root (local, HDFS, s3a://...),
since only Spark readers and writers touch it.
"""

from __future__ import annotations

import posixpath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expressions import col, quoted

RAW_ZONE = "uploaded_data"
PROCESSED_ZONE = "processed_data"
MODEL_ZONE = "saved_models"
READABLE = {"csv": "csv", "json": "json", "parquet": "parquet"}


def extension(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


# The texts that the reference's CSV reader takes for missing.
CSV_MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
               "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_path(spark: SparkSession, path: str, fmt: str | None = None,
              schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header (types inferred unless a schema is given),
    JSON (array of records or one record per line), or Parquet.

    ``multi_line=False`` lets Spark split a large CSV file whose quoted
    fields hold no line break.
    """
    fmt = fmt or READABLE.get(extension(path))
    if fmt is None:
        raise ValueError(f"Unsupported file format: {path}")
    reader = spark.read
    if fmt == "csv":
        return _read_csv(reader, path, schema, multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "json":
        return reader.option("multiLine", _is_json_array(spark, path)).json(path)
    return reader.parquet(path)


def _read_csv(reader, path: str, schema, multi_line: bool) -> DataFrame:
    """All columns as text first, so that missing tokens are taken out before
    the types are decided; a doubled quote stands for a quote."""
    text = (reader.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).csv(path))
    cleaned = text.select(*[F.when(~col(c).isin(*CSV_MISSING), col(c)).alias(c) for c in text.columns])
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return cleaned.select(*[_as_type(c, f.dataType).alias(f.name) for c, f in zip(cleaned.columns, wanted, strict=True)])
    types = _inferred(cleaned)
    return cleaned.select(*[_as_type(c, t).alias(c) for c, t in types.items()])


_CANDIDATES = (T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType())
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(inf|Infinity)\s*$"


def _as_type(c: str, kind: T.DataType):
    name = kind.simpleString()
    if name == "string":
        return col(c)
    return F.expr(f"try_cast(trim({quoted(c)}) AS {name})")


def _inferred(cleaned: DataFrame) -> dict[str, T.DataType]:
    """The first of integer, number, boolean and time that all values of a
    column are, by one aggregate over all columns; else text.  A column
    without values is a number, as in the reference."""
    checks = []
    for i, c in enumerate(cleaned.columns):
        valid = {0: col(c).rlike(r"^\s*[+-]?\d+\s*$"), 1: col(c).rlike(_NUMBER),
                 2: F.lower(F.trim(col(c))).isin("true", "false"), 3: col(c).rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}")}
        for k, kind in enumerate(_CANDIDATES):
            fits = valid[k] & _as_type(c, kind).isNotNull()
            checks.append(F.count_if(col(c).isNotNull() & ~fits).alias(f"n{i}_{k}"))
        checks.append(F.count(col(c)).alias(f"n{i}"))
    found = cleaned.agg(*checks).first()
    return {c: T.DoubleType() if not found[f"n{i}"] else
            next((kind for k, kind in enumerate(_CANDIDATES) if not found[f"n{i}_{k}"]), T.StringType())
            for i, c in enumerate(cleaned.columns)}


def _is_json_array(spark: SparkSession, path: str) -> bool:
    """A JSON file that starts with '[' is an array of records (pandas'
    ``read_json`` default); otherwise it is read as JSON lines."""
    head = spark.read.text(path).limit(1).collect()
    return bool(head) and head[0][0].lstrip().startswith("[")


def load_dataset(spark: SparkSession, root: str, name: str,
                 schema: T.StructType | str | None = None) -> DataFrame:
    """S3: the raw zone first, then the processed zone; a missing dataset is
    ``FileNotFoundError``, an unknown extension ``ValueError``."""
    fmt = READABLE.get(extension(name))
    if fmt is None:
        raise ValueError(f"Unsupported file format: {name}")
    for zone in (RAW_ZONE, PROCESSED_ZONE):
        path = posixpath.join(root, zone, name)
        try:
            return read_path(spark, path, fmt, schema)
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc) and "Path does not exist" not in str(exc):
                raise
    raise FileNotFoundError(f"Dataset '{name}' not found in {RAW_ZONE} or {PROCESSED_ZONE}")


def processed_name(name: str, style: str = "prefix") -> str:
    """``processed_{name}`` (preprocessing) or ``{stem}_processed.{ext}``
    (feature engineering)."""
    if style == "prefix":
        return f"processed_{name}"
    ext = extension(name)
    stem = name[: -(len(ext) + 1)] if ext else name
    return f"{stem}_processed.{ext}" if ext else f"{stem}_processed"


def write_path(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """CSV with a header, JSON records, or Parquet (the default)."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"Unsupported format for saving: {fmt}")
    return path


def save_dataset(df: DataFrame, root: str, name: str, style: str = "prefix",
                 fmt: str | None = None) -> str:
    """Write into the processed zone, in the input's format unless given."""
    out_name = processed_name(name, style)
    fmt = fmt or READABLE.get(extension(name), "parquet")
    write_path(df, posixpath.join(root, PROCESSED_ZONE, out_name), fmt)
    return out_name


def dataset_columns(df: DataFrame) -> DataFrame:
    """Column names and types as a DataFrame (schema only, no scan)."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string")
