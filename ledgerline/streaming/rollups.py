"""Day sums of event streams (see current.maintain_sums) to weeks and months."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.dates import month_start, week_start


def weekly_from_daily(daily: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return daily.groupBy(week_start(F.col("usage_date")).alias("week"), *keys).agg(*[F.sum(c).alias(c) for c in sums])


def monthly_from_daily(daily: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return daily.groupBy(month_start(F.col("usage_date")).alias("month"), *keys).agg(*[F.sum(c).alias(c) for c in sums])
