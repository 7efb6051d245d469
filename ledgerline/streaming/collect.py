"""File collection as a stream: sizes are checked before contents are read, and every file is looked at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.config import LIMITS
from ledgerline.operators.imports import insert_ignore
from ledgerline.sources import snapshots
from ledgerline.sources.versioned import Change, Version, VersionedStore
from ledgerline.streaming.current import committed

#: The fixed columns of Spark's binaryFile source.
FILE = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, folder: str, max_bytes: int, files_per_trigger: int, glob: str = "*.json") -> DataFrame:
    """New files with their metadata and, up to `max_bytes`, their content. Of larger files only the metadata is read."""
    def side() -> DataFrame:
        return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option(
            "maxFilesPerTrigger", files_per_trigger).load(folder)

    columns = [F.col("path").alias("file_id"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("created_at")]
    small = side().filter(F.col("length") <= max_bytes).select(*columns, "content")
    large = side().filter(F.col("length") > max_bytes).select(*columns, F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def collect_files(spark: SparkSession, folder: str, store: VersionedStore, checkpoint: str, max_bytes: int = LIMITS.max_snapshot_bytes, files_per_trigger: int = 1000,
                  pattern: str = snapshots.PATH_PATTERN, glob: str = "*.json") -> StreamingQuery:
    """Take in every new file below a folder, then stop; the next call goes on where this one ended.

    `files` gets a row per machine and content: the earliest file of a batch, unless an earlier batch had that content. `refused`
    gets files that are too large or not valid UTF-8, with the reason. Both are committed together, once per batch.
    Spark's source passes over files of length 0; files_per_trigger bounds what a batch holds.
    """
    def make(batch: DataFrame, base: Version) -> list[Change]:
        held = VersionedStore(batch.sparkSession, store.path)
        named = batch.withColumns({"machine_id": F.regexp_extract("file_id", pattern, 1), "import_id": F.regexp_extract("file_id", pattern, 2)})
        readable, refused = snapshots.split_readable(snapshots.fingerprint_files(named), max_bytes)
        files = held.append("files", readable, ["machine_id"], lambda stored, new: insert_ignore(new, stored, ["machine_id", "raw_sha256"], ["created_at", "file_id"]), base)
        return [files, held.append("refused", refused, ["machine_id"], lambda stored, new: insert_ignore(new, stored, ["file_id"], ["created_at"]), base)]

    return committed(file_stream(spark, folder, max_bytes, files_per_trigger, glob), store, checkpoint, make)
