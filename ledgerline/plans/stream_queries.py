"""Streams over the given tables. Each runs until its input is read and leaves a table in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.plans import views as v
from ledgerline.plans.reading_queries import _COOLDOWN, _fold_sql
from ledgerline.plans.registry import query
from ledgerline.session import ensure_checkpoint_dir, prepare
from ledgerline.sources.versioned import VersionedStore
from ledgerline.streaming import current, ingest, readings as live, rollups


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files. The brackets make the path a pattern: Spark takes a plain one for a folder."""
    schema = v.table(spark, sf_dir, name).schema
    return prepare(spark).readStream.schema(schema).parquet(f"{sf_dir}/{name}.[p]arquet")


def _daily_table(spark, d):
    folder = f"{ensure_checkpoint_dir(spark)}/daily-{uuid.uuid4().hex}"
    store = VersionedStore(spark, f"{folder}/store")
    current.maintain_sums(read_table_stream(spark, d, "events"), store, f"{folder}/state", ["event_type"],
                          {"events": "cast(1 as bigint)", "tokens": "cast(floor(value) as bigint)"}).awaitTermination()
    return current.day_sums(store)


@query("j01_j05_daily_stream", sql="""
  SELECT ts::DATE::VARCHAR AS usage_date, event_type, count(*) AS events, sum(floor(value)::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1, 2""")
def daily_stream(spark, d):
    """All days, open ones too."""
    return _daily_table(spark, d)


@query("j05_weekly_stream", sql="""
  SELECT date_trunc('week', ts)::DATE::VARCHAR AS week, event_type, count(*) AS events, sum(floor(value)::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1, 2""")
def weekly_stream(spark, d):
    return rollups.weekly_from_daily(_daily_table(spark, d), ["event_type"], ["events", "tokens"])


@query("j05_monthly_stream", sql="""
  SELECT date_trunc('month', ts)::DATE::VARCHAR AS month, event_type, count(*) AS events, sum(floor(value)::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1, 2""")
def monthly_stream(spark, d):
    return rollups.monthly_from_daily(_daily_table(spark, d), ["event_type"], ["events", "tokens"])


@query("j03_redelivery_stream", ("raw_files",), """
  SELECT machine_id, raw_sha256, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS created_at FROM raw_files GROUP BY 1, 2""")
def redelivery_stream(spark, d):
    """Files by machine and content, with their own times of delivery; all of them are delivered twice, the second time to a new checkpoint."""
    files = read_table_stream(spark, d, "documents").select(
        F.col("source").alias("machine_id"), F.sha2("text", 256).alias("raw_sha256"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"))
    folder = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    store = VersionedStore(spark, f"{folder}/store")
    for delivery in ("first", "again"):
        ingest.collect_new_contents(files, store, f"{folder}/{delivery}", signs=1).awaitTermination()
    return store.read("contents").select("machine_id", "raw_sha256", "created_at")


@query("j04_reading_stream", ("readings",), _fold_sql("readings", _COOLDOWN))
def reading_stream(spark, d):
    folder = f"{ensure_checkpoint_dir(spark)}/readings-{uuid.uuid4().hex}"
    store = VersionedStore(spark, f"{folder}/store")
    live.store_readings(v.as_readings(read_table_stream(spark, d, "events")), store, f"{folder}/state").awaitTermination()
    return live.stored(store).select("account", "reading_id")
