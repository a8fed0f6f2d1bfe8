"""Dataset and model catalog (S8, S9) from file listings.

Listing uses the ``binaryFile`` source with only path, size and time
selected, so file contents are never read.  A dataset written by Spark is
a folder of part files; it is reported once, under its folder name.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import MODEL_ZONE, PROCESSED_ZONE, RAW_ZONE

RAW_EXTENSIONS = ("csv", "xls", "xlsx", "json", "parquet")
PROCESSED_EXTENSIONS = ("csv", "json", "parquet")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of every file below ``folder``."""
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .load(folder))
    except Exception as exc:  # noqa: BLE001 - a missing folder is an empty listing
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return spark.createDataFrame([], "path string, length long, modificationTime timestamp")
        raise
    return files.select("path", "length", "modificationTime")


def _entries(files: DataFrame, folder: str) -> DataFrame:
    """Group files by their first path component below ``folder``."""
    prefix = folder.rstrip("/") + "/"
    rel = F.substring_index(F.regexp_replace(F.col("path"), r"^file:", ""), prefix, -1)
    name = F.split(rel, "/")[0]
    return (files.select(name.alias("name"), F.col("length"))
                 .where(~F.col("name").startswith("_") & ~F.col("name").startswith("."))
                 .groupBy("name").agg(F.count(F.lit(1)).alias("files"),
                                      F.sum("length").alias("bytes")))


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """(zone, name, files, bytes) for the raw and processed zones."""
    out = None
    for zone, exts in ((RAW_ZONE, RAW_EXTENSIONS), (PROCESSED_ZONE, PROCESSED_EXTENSIONS)):
        folder = posixpath.join(root, zone)
        entries = _entries(list_files(spark, folder), folder)
        ext = F.lower(F.substring_index(F.col("name"), ".", -1))
        entries = entries.where(F.col("name").contains(".") & ext.isin(*exts))
        entries = entries.select(F.lit(zone).alias("zone"), "name", "files", "bytes")
        out = entries if out is None else out.unionByName(entries)
    return out


def list_tables(spark: SparkSession, folder: str, extensions=("parquet",)) -> DataFrame:
    """(name, files, bytes) of the datasets directly inside ``folder``."""
    entries = _entries(list_files(spark, folder), folder)
    ext = F.lower(F.substring_index(F.col("name"), ".", -1))
    return entries.where(ext.isin(*extensions))


def catalog_counts(spark: SparkSession, root: str) -> DataFrame:
    """(item, count) for raw datasets, processed datasets and models.
    (The reference's prediction counter is never incremented; left out.)"""
    datasets = list_datasets(spark, root)
    model_folder = posixpath.join(root, MODEL_ZONE)
    models = _entries(list_files(spark, model_folder), model_folder)
    raw = datasets.where(F.col("zone") == RAW_ZONE).agg(
        F.lit("datasets").alias("item"), F.count(F.lit(1)).alias("count"))
    processed = datasets.where((F.col("zone") == PROCESSED_ZONE)
                               & F.col("name").startswith("processed_")).agg(
        F.lit("processed").alias("item"), F.count(F.lit(1)).alias("count"))
    stored = models.agg(F.lit("models").alias("item"), F.count(F.lit(1)).alias("count"))
    return raw.unionByName(processed).unionByName(stored)
