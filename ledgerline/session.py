"""Session helpers: defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "ledgerline", master: str | None = None) -> SparkSession:
    """A session for tests and the bench. On a cluster, the submitted conf wins."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        cores = master.split("[")[-1].rstrip("]")
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "8g"))
            .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        )
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings every plan of this library relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, so that they share local folders."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a new local one only where one process is the whole cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.getCheckpointDir() and not is_local(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not configured:
        configured = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="ledgerline-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def materialized(rows: DataFrame, name: str = "step") -> DataFrame:
    """Write rows once as a new table in the shared checkpoint folder and read them back.

    For results that later steps read several times: each of them would otherwise
    work the whole plan out again. The table survives the loss of executors, and
    readers prune its columns and push filters into it.
    """
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
