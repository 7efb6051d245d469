"""Ledger tables kept up to date by streams: each batch rewrites the partitions it touches and is committed once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.functions.dates import month_key
from ledgerline.operators.revisions import DAILY_KEYS
from ledgerline.sources.versioned import Change, Version, VersionedStore, newest_per_key, sums_per_key

MONTH = "usage_month"


def newest_first() -> list[Column]:
    """The order of revisions: the latest processed, then the latest created, then the greatest id."""
    return [F.col("processed_at").desc_nulls_last(), F.col("created_at").desc(), F.col("id").desc()]


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The identity of a stream's checkpoint: the same after a restart, another one for a new checkpoint folder."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def committed(stream: DataFrame, store: VersionedStore, checkpoint: str, make: Callable[[DataFrame, Version], list[Change]]) -> StreamingQuery:
    """Drain the stream; each batch is one commit, and one that is delivered again after a failure adds nothing."""
    def write(batch: DataFrame, number: int) -> None:
        held = VersionedStore(batch.sparkSession, store.path)
        held.update(lambda base: make(batch, base), (run_of(batch.sparkSession, checkpoint), number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_current(revisions: DataFrame, store: VersionedStore, checkpoint: str, keys: list[str] = DAILY_KEYS, table: str = "current",
                     date_column: str = "usage_date") -> StreamingQuery:
    """Keep the latest revision of each key from a stream of processed revisions (with processed_at), then stop.

    A batch reads and rewrites only the (machine, month) partitions it touches, however old they are.
    Tombstones stay in the table, as they hide revisions that come later but are older; `current_rows` leaves them out.
    """
    by = ["machine_id", MONTH]

    def make(batch: DataFrame, base: Version) -> list[Change]:
        rows = batch.withColumn(MONTH, month_key(F.col(date_column)))
        return [VersionedStore(batch.sparkSession, store.path).merge(table, rows, by, newest_per_key(keys, newest_first()), base)]

    return committed(revisions, store, checkpoint, make)


def current_rows(store: VersionedStore, table: str = "current") -> DataFrame:
    """The current truth: the newest revision of each key, unless it is a tombstone."""
    return store.read(table).filter(~F.col("is_tombstone")).drop(MONTH, "processed_at")


def maintain_sums(events: DataFrame, store: VersionedStore, checkpoint: str, keys: list[str], sums: dict[str, str], time: str = "ts", table: str = "daily") -> StreamingQuery:
    """Keep day sums per key from a stream of events, then stop. No event is too late, and open days show.

    `sums` maps output names to SQL expressions over the event. A batch adds its sums to the months it touches, so the
    table has one row per day and key after any number of batches. A run owns its sums: after the loss of a checkpoint
    the next run reads all events again, and its sums don't add to those of the run before (`day_sums` shows the last run).
    """
    day = F.col(time).cast("timestamp").cast("date").alias("usage_date")

    def make(batch: DataFrame, base: Version) -> list[Change]:
        spark = batch.sparkSession
        added = batch.groupBy(day, *keys).agg(*[F.sum(F.expr(e)).alias(name) for name, e in sums.items()])
        added = added.withColumns({MONTH: month_key(F.col("usage_date")), "run": F.lit(run_of(spark, checkpoint))})
        held = VersionedStore(spark, store.path)
        # Sums of an earlier run go with the first batch of the next one.
        stale = [] if table not in base.tables else [k for k in base.tables[table].parts if not k.startswith("." + run_of(spark, checkpoint))]
        change = held.merge(table, added, ["run", MONTH], sums_per_key([MONTH, "run", "usage_date", *keys], list(sums)), base)
        return [Change(change.table, change.schema, change.parts, change.replaced | frozenset(stale))]

    return committed(events, store, checkpoint, make)


def day_sums(store: VersionedStore, table: str = "daily") -> DataFrame:
    return store.read(table).drop(MONTH, "run")
