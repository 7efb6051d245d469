"""Append-only fact tables and the link table, as Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerline.functions.dates import month_key
from ledgerline.operators.imports import first_per_key, insert_ignore
from ledgerline.sources.versioned import Version, VersionedStore, changes_win

PRIVATE_COLUMNS = ("project_path", "payload", "content")


def without_private_columns(rows: DataFrame) -> DataFrame:
    return rows.drop(*PRIVATE_COLUMNS)


def _stored(rows: DataFrame, path: str) -> DataFrame | None:
    """The table at `path`, or None while it does not exist."""
    try:
        return rows.sparkSession.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_facts(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None,
               date_column: str = "usage_date") -> DataFrame:
    """Stored facts of a range of days. The range also names the months, so other months are not listed or read."""
    rows = spark.read.parquet(path)
    if first_day is not None:
        rows = rows.filter((F.col("usage_month") >= first_day[:7]) & (F.col(date_column) >= F.lit(first_day).cast("date")))
    if last_day is not None:
        rows = rows.filter((F.col("usage_month") <= last_day[:7]) & (F.col(date_column) <= F.lit(last_day).cast("date")))
    return rows


def append_facts(rows: DataFrame, path: str, keys: list[str], date_column: str = "usage_date") -> None:
    """Append rows whose natural key is not stored, partitioned by month.

    Only the months the batch touches are read for the key check. The rebalance
    hint gathers a month's rows into few files and splits a month that holds most of them.
    """
    rows = without_private_columns(rows).withColumn("usage_month", month_key(F.col(date_column)))
    stored = _stored(rows, path)
    if stored is None:
        fresh = first_per_key(rows, keys)
    else:
        months = rows.select(F.col("usage_month").alias("_month")).distinct()
        touched = stored.join(months, F.col("usage_month").eqNullSafe(F.col("_month")), "left_semi")
        fresh = insert_ignore(rows, touched, keys)
    fresh.hint("rebalance", "usage_month").write.mode("append").partitionBy(
        "usage_month").parquet(path)


def upserted(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with changed ones replaced and new ones added; of several changes of a key every run keeps the same one.

    The result is a whole table. `upsert` rewrites only the partitions that change.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.xxhash64(*changes.columns))
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return both.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "_new")


def upsert(store: VersionedStore, table: str, changes: DataFrame, keys: list[str], by: list[str], order: list[str] | None = None) -> Version:
    """Replace changed rows and add new ones, as one commit that rewrites the touched partitions. `by` must be among the keys or follow from them."""
    changes = without_private_columns(changes)
    win = changes_win(keys, [*[F.col(c) for c in order or []], F.xxhash64(*changes.columns)])
    return store.update(lambda base: [store.merge(table, changes, by, win, base)])
