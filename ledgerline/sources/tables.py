"""Readers of ledger tables in the order their users expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def active_machines(machines: DataFrame) -> DataFrame:
    return machines.filter("is_active").orderBy("name")


def by_date(rows: DataFrame) -> DataFrame:
    """Current rows in date order."""
    return rows.orderBy("usage_date")


def recovered_header(sets: DataFrame, set_id: str | None = None) -> DataFrame:
    """Set headers without the raw text they were recovered from."""
    kept = sets.drop("raw_text", "raw_sha256")
    return kept if set_id is None else kept.filter(F.col("set_id") == set_id)


def recovered_rows(rows: DataFrame, set_id: str) -> DataFrame:
    return rows.filter(F.col("set_id") == set_id).orderBy("month", "agent")


def newest_recovered_set(sets: DataFrame, time: str = "created_at") -> DataFrame:
    return recovered_header(sets).orderBy(F.col(time).desc(), F.col("set_id").desc()).limit(1)
