"""Snapshot files: whole documents with metadata, bounds, encoding and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.config import LIMITS

# <root>/<machine>/<import>.json
PATH_PATTERN = r"([^/]+)/([^/]+)\.json$"


def read_snapshot_files(spark: SparkSession, path: str, pattern: str = PATH_PATTERN) -> DataFrame:
    """One row per file; machine and import come from the path. Spark's reader passes over files of length 0."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    )
    return files.select(
        F.col("path").alias("file_id"), F.regexp_extract("path", pattern, 1).alias("machine_id"),
        F.regexp_extract("path", pattern, 2).alias("import_id"), F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("created_at"), "content")


def fingerprint_files(files: DataFrame) -> DataFrame:
    return files.withColumn("raw_sha256", F.sha2("content", 256))


def split_readable(files: DataFrame, max_bytes: int = LIMITS.max_snapshot_bytes) -> tuple[DataFrame, DataFrame]:
    """(files with a text payload, quarantine with reasons). Bad bytes are refused, never replaced."""
    text = F.col("content").cast("string")
    reason = (
        F.when(F.col("file_size_bytes") < 1, "empty file")
        .when(F.col("file_size_bytes") > max_bytes, "file too large")
        .when(~F.is_valid_utf8(text), "not valid UTF-8"))
    checked = files.withColumn("reason", reason)
    readable = checked.filter(F.col("reason").isNull()).withColumn("payload", text).drop("content", "reason")
    return readable, checked.filter(F.col("reason").isNotNull()).drop("content")
