"""Gapless numbers inside groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BUCKET = 4000


def numbered(rows: DataFrame, by: str, order: list[str], name: str, n_rows: int) -> DataFrame:
    """Number the rows of each `by` from 0 without gaps, as column `name`.

    A group is dealt over buckets by the hash of its order columns; a row's number is the
    count of the buckets before its own plus its place inside. `rows` is read twice, so
    it should be a written table; `n_rows` sets the number of buckets.
    """
    buckets = max(16, n_rows // ROWS_PER_BUCKET)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(by).alias("_by"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1
    placed = dealt.withColumn("_inside", inside).join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_at")), "left")
    return placed.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_bucket", "_inside", "_by", "_at", "_before")


def text_key(text: Column) -> Column:
    """Equal for equal texts only; null has a key of its own."""
    return F.coalesce(F.sha2(text, 256), F.lit("null"))
