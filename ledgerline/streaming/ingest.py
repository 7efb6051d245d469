"""Incremental collection: exact re-deliveries are dropped, revisions are appended, nothing is rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.imports import insert_ignore
from ledgerline.sources.sinks import append_facts
from ledgerline.sources.versioned import Change, Version, VersionedStore
from ledgerline.streaming.current import committed


def collect_new_contents(files: DataFrame, store: VersionedStore, checkpoint: str, table: str = "contents", signs: int = 2) -> StreamingQuery:
    """Keep every file whose content its machine never delivered before, however late it comes, then stop.

    Each batch is compared with what is stored, so the rule has no expiry and a backlog file is as welcome as a new one. A repeated
    batch adds nothing. The committed table (machine_id, raw_sha256, created_at, ...) lies in partitions by the first `signs` of the content's hash, so a batch meets the stored keys
    of its own prefixes only. Of equal files in one batch the earliest stays.
    """
    def make(batch: DataFrame, base: Version) -> list[Change]:
        held = VersionedStore(batch.sparkSession, store.path)
        rows = batch.withColumn("prefix", F.substring("raw_sha256", 1, signs))
        return [held.append(table, rows, ["prefix"], lambda stored, new: insert_ignore(new, stored, ["machine_id", "raw_sha256"], ["created_at"]), base)]

    return committed(files, store, checkpoint, make)


def append_revisions(rows: DataFrame, path: str, checkpoint: str, keys: list[str], date_column: str = "usage_date") -> StreamingQuery:
    """Append every new revision once, then stop: the scheduled collection job.

    Late rows are newer revisions of their key; readers take the latest one.
    A batch that is delivered again after a failure adds nothing.
    """
    def write(batch: DataFrame, _: int) -> None:
        append_facts(batch, path, keys, date_column)

    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
