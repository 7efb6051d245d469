"""Append-only revisions to the current truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

DAILY_KEYS = ["machine_id", "agent", "usage_date"]
MODEL_KEYS = ["machine_id", "agent", "model", "usage_date"]


def accepted_revisions(observations: DataFrame, imports: DataFrame | None) -> DataFrame:
    """Revisions of processed imports with their processing time.

    Promotion stores the time on each row (see imports.promote). Such facts hold
    processed rows only and need no join, which saves a shuffle of the whole table.
    """
    if imports is None:
        return observations
    accepted = imports.filter(F.col("status") == "processed").select("import_id", "processed_at")
    return observations.join(accepted, "import_id")


def latest_revision(observations: DataFrame, imports: DataFrame | None, keys: list[str] = DAILY_KEYS) -> DataFrame:
    """Latest processed revision per key, tombstones hidden.

    Ranking by rank = 1 lets Spark keep one row per key in every task before the
    shuffle, so a key with very many revisions moves only its candidates.
    """
    newest_first = Window.partitionBy(*keys).orderBy(
        F.col("processed_at").desc_nulls_last(), F.col("created_at").desc(), F.col("id").desc())
    return (
        accepted_revisions(observations, imports)
        .withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") == 1)
        .filter(~F.col("is_tombstone"))
        .drop("_rank", "processed_at")
    )


def current_daily(observations: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    return latest_revision(observations, imports, DAILY_KEYS)


def current_models(observations: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    return latest_revision(observations, imports, MODEL_KEYS)


def with_mirror_flag(current: DataFrame, links: DataFrame) -> DataFrame:
    """Mark rows hidden as mirrors. A link counts only while its canonical row is current.

    Which linked canonical rows are still current is settled on the (small) link
    table first, so the current rows are joined once.
    """
    canonical = current.select(
        F.col("id").alias("canonical_observation_id"), F.col("machine_id").alias("live_machine_id"))
    live = (
        links.select("observation_id", "canonical_observation_id")
        .join(canonical, "canonical_observation_id")
        .select(F.col("observation_id").alias("id"), "live_machine_id")
    )
    return current.join(live, "id", "left").withColumns({
        "global_duplicate": F.col("live_machine_id").isNotNull(),
        "canonical_machine_id": F.col("live_machine_id"),
    }).drop("live_machine_id")


def models_with_mirror_flag(models: DataFrame, flagged_daily: DataFrame) -> DataFrame:
    """Model rows take the flag of their day; a model row without a day is not a mirror."""
    flags = flagged_daily.select(*DAILY_KEYS, "global_duplicate", "canonical_machine_id")
    return models.join(flags, DAILY_KEYS, "left").withColumn(
        "global_duplicate", F.coalesce("global_duplicate", F.lit(False)))
