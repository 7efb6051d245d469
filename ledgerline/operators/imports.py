"""Import audit: duplicates, provenance, states, watermarks and promotion."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.config import LIMITS
from ledgerline.operators.skew import hot_lookup

ACTIVE = ("processing", "processed")


def next_since(last_date: Column) -> Column:
    """First day of the next export: the last accepted day is looked at again with the days before it."""
    return F.date_sub(last_date, LIMITS.lookback_days - 1)


def collection_watermark(machines: DataFrame, imports: DataFrame) -> DataFrame:
    """Last accepted day per active machine; null where nothing was accepted yet."""
    last = imports.groupBy("machine_id").agg(
        F.max(F.when(F.col("status") == "processed", F.col("scope_end"))).alias("last_scope_end"))
    return machines.filter("is_active").select("machine_id").join(last, "machine_id", "left")


def session_evidence_state(machines: DataFrame, sessions: DataFrame, imports: DataFrame,
                           approximate: bool = False) -> DataFrame:
    """Distinct identities and mirrors per machine.

    A machine whose only sessions belong to unprocessed imports is absent; a
    machine without any session counts zero. Inactive machines are included.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    accepted = imports.filter(F.col("status") == "processed").select("import_id", F.lit(True).alias("_accepted"))
    seen = F.col("_accepted")
    state = sessions.join(accepted, "import_id", "left").groupBy("machine_id").agg(
        distinct(F.when(seen, F.col("identity_hash"))).alias("session_count"),
        distinct(F.when(seen, F.col("mirror_hash"))).alias("mirror_fingerprint_count"),
        F.max(F.when(seen, F.col("created_at"))).alias("last_session_evidence_at"),
        F.count(seen).alias("_accepted_rows"),
    )
    return (
        machines.select("machine_id").join(state, "machine_id", "left")
        .filter(F.col("_accepted_rows").isNull() | (F.col("_accepted_rows") > 0))
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("session_count", "mirror_fingerprint_count")})
        .drop("_accepted_rows")
    )


def collection_hints(machines: DataFrame, watermark: DataFrame, evidence: DataFrame) -> DataFrame:
    """Active machines by name with their watermark, the next export start and evidence counts."""
    counts = ("session_count", "mirror_fingerprint_count")
    return (
        machines.filter("is_active").join(watermark, "machine_id", "left").join(evidence, "machine_id", "left")
        .withColumn("next_since", next_since(F.col("last_scope_end")))
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
        .orderBy("name")
    )


def mark_exact_duplicates(files: DataFrame, keys: list[str]) -> DataFrame:
    """The first file per key stays; later equal files become exact duplicates of it.

    `files(import_id, created_at, keys...)`. Where a status is given, only files
    in processing or processed take part: a failed import may be delivered again.
    Groups with one file are never looked up, and a group holding most files is
    spread over many tasks.
    """
    counts = F.col("status").isin(*ACTIVE) if "status" in files.columns else F.lit(True)
    groups = files.filter(counts).groupBy(*keys).agg(
        F.min(F.struct("created_at", "import_id"))["import_id"].alias("_first"),
        F.count(F.lit(1)).alias("_copies"),
    ).filter("_copies > 1")
    looked_up = hot_lookup(files, groups, keys, "_copies", ["import_id"])
    is_copy = counts & F.col("_first").isNotNull() & (F.col("_first") != F.col("import_id"))
    return looked_up.withColumns({
        "is_exact_duplicate": is_copy,
        "duplicate_of_import_id": F.when(is_copy, F.col("_first")),
    }).drop("_first", "_copies")


def same_content_elsewhere(incoming: DataFrame, imports: DataFrame) -> DataFrame:
    """Earliest processed import of another machine with the same content.

    Two candidates per content are enough: the earliest import, and the earliest
    one of any other machine for files of the first one's machine.
    """
    first_per_machine = imports.filter(F.col("status") == "processed").groupBy("raw_sha256", "machine_id").agg(
        F.min(F.struct("created_at", "import_id")).alias("_at"), F.count(F.lit(1)).alias("_copies"))
    by_time = Window.partitionBy("raw_sha256").orderBy("_at", "machine_id")
    candidates = (
        first_per_machine.withColumn("_rank", F.row_number().over(by_time)).filter("_rank <= 2")
        .groupBy("raw_sha256").agg(
            F.max(F.when(F.col("_rank") == 1, F.struct("machine_id", F.col("_at.import_id").alias("import_id")))).alias("_first"),
            F.max(F.when(F.col("_rank") == 2, F.struct("machine_id", F.col("_at.import_id").alias("import_id")))).alias("_second"),
            F.sum("_copies").alias("_copies"),
        )
    )
    looked_up = hot_lookup(incoming, candidates, ["raw_sha256"], "_copies", ["import_id"])
    other = F.when(F.col("_first.machine_id") != F.col("machine_id"), F.col("_first")).otherwise(F.col("_second"))
    return looked_up.withColumn("_other", other).withColumns({
        "other_machine_id": F.col("_other.machine_id"),
        "other_import_id": F.col("_other.import_id"),
    }).drop("_first", "_second", "_copies", "_other")


def recover_stale(imports: DataFrame, now: Column, minutes: int = LIMITS.stale_import_minutes) -> DataFrame:
    """Imports left in processing for too long become failed."""
    stale = (F.col("status") == "processing") & (F.unix_micros("created_at") < F.unix_micros(now) - minutes * 60_000_000)
    return imports.withColumns({
        "processed_at": F.when(stale, now).otherwise(F.col("processed_at")),
        "status": F.when(stale, F.lit("failed")).otherwise(F.col("status")),
    })


def concurrent_processing(imports: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (a machine, a cycle) with more than one import in processing."""
    return (
        imports.filter(F.col("status") == "processing").groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("processing_imports")).filter("processing_imports > 1")
    )


def recent_imports(imports: DataFrame, limit: int = 20) -> DataFrame:
    return imports.orderBy(F.col("created_at").desc(), F.col("import_id").desc()).limit(limit)


def visible_imports(recent: DataFrame, machine_id: str | None, limit: int = 3) -> DataFrame:
    chosen = recent if machine_id is None else recent.filter(F.col("machine_id") == machine_id)
    return chosen.orderBy(F.col("created_at").desc(), F.col("import_id").desc()).limit(limit)


def latest_processed(imports: DataFrame) -> DataFrame:
    """The newest processed import and when it was processed."""
    newest = F.max(F.struct("created_at", "import_id", "processed_at"))
    return imports.filter(F.col("status") == "processed").agg(newest.alias("_n")).select(
        F.col("_n.import_id").alias("import_id"), F.col("_n.processed_at").alias("processed_at"))


def import_summary(changes: DataFrame, model_changes: DataFrame, parsed: DataFrame, links: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """One summary record per import: change counts, totals before and after with their difference, facets, suppression and risk.

    `changes` and `model_changes` are classified rows with import_id, change_type and, for `changes`, tokens before and
    after; `parsed` is the parser's summary; `links` carry import_id and tokens; `risk` has import_id and partial_mirror_risk.
    """
    def counts(rows: DataFrame, prefix: str, *more: Column) -> DataFrame:
        kinds = ("new", "revised", "removed", "unchanged")
        return rows.groupBy("import_id").agg(
            *[F.count(F.when(F.col("change_type") == k, 1)).alias(f"{prefix}{k}") for k in kinds], *more)

    sums = [F.sum(f"{c}_tokens").alias(f"{c}_total") for c in ("before", "after")]
    suppressed = links.groupBy("import_id").agg(
        F.count(F.lit(1)).alias("rows_suppressed"), F.sum("reported_total_tokens").alias("duplicate_tokens_prevented"))
    joined = (
        parsed.join(counts(changes, "", *sums), "import_id", "left")
        .join(counts(model_changes, "model_"), "import_id", "left")
        .join(suppressed, "import_id", "left")
    )
    if risk is not None:
        joined = joined.join(risk.select("import_id", "partial_mirror_risk"), "import_id", "left").withColumn(
            "partial_mirror_risk", F.coalesce("partial_mirror_risk", F.lit(False)))
    numbers = [c for c in joined.columns if c.startswith("model_") or c in (
        "new", "revised", "removed", "unchanged", "before_total", "after_total", "rows_suppressed", "duplicate_tokens_prevented")]
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers}).withColumns({
        "net_change": F.col("after_total") - F.col("before_total"), "cross_machine_match": F.col("rows_suppressed") > 0})


def first_per_key(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the first by `order`, then by a hash of the whole row, so that every run keeps the same one."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or []), F.xxhash64(*rows.columns)))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def insert_ignore(incoming: DataFrame, stored: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows whose natural key is not stored yet, one per key (see first_per_key)."""
    known = stored.select(*[F.col(k).alias("_stored_" + k) for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col("_stored_" + k)) for k in keys])
    return first_per_key(incoming, keys, order).join(known, same, "left_anti")


@dataclass(frozen=True)
class Promotion:
    """What one batch of imports adds: rows to append, rewritten imports and counts per import."""

    daily: DataFrame
    models: DataFrame | None
    sessions: DataFrame | None
    imports: DataFrame
    counts: DataFrame


def promote(imports: DataFrame, now: Column, rows: DataFrame, stored_rows: DataFrame,
            model_rows: DataFrame | None = None, stored_models: DataFrame | None = None,
            session_rows: DataFrame | None = None, stored_sessions: DataFrame | None = None) -> Promotion:
    """Promote every import in processing at once.

    Rows of imports in another state are ignored; a row already stored for its
    import is not stored again. Stored rows carry the processing time, so that
    current_daily reads them without joining the imports.
    """
    pending = imports.filter(F.col("status") == "processing").select("import_id")

    def fresh(incoming, stored, keys):
        if incoming is None:
            return None
        rows = insert_ignore(incoming.join(pending, "import_id", "left_semi"), stored, keys)
        return rows.withColumn("processed_at", now)

    daily = fresh(rows, stored_rows, ["import_id", "agent", "usage_date"])
    models = fresh(model_rows, stored_models, ["import_id", "agent", "model", "usage_date"])
    sessions = fresh(session_rows, stored_sessions, ["import_id", "local_key_hash"])
    parts = {"inserted_rows": daily, "inserted_model_rows": models, "inserted_session_rows": sessions}
    counts = pending
    for name, part in parts.items():
        if part is not None:
            added = part.groupBy("import_id").agg(F.count(F.lit(1)).alias(name))
            counts = counts.join(added, "import_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    is_pending = F.col("status") == "processing"
    done = imports.withColumns({
        "processed_at": F.when(is_pending, now).otherwise(F.col("processed_at")),
        "status": F.when(is_pending, F.lit("processed")).otherwise(F.col("status")),
    })
    return Promotion(daily, models, sessions, done, counts)


def backfill(imports: DataFrame, incoming: DataFrame, stored: DataFrame, keys: list[str],
             machine_id: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows to add to imports that are already processed; running it again adds nothing.

    Backfilled rows are present rows, never tombstones.
    """
    accepted = imports.filter(F.col("status") == "processed")
    if machine_id is not None:
        accepted = accepted.filter(F.col("machine_id") == machine_id)
    rows = insert_ignore(incoming.join(accepted.select("import_id"), "import_id", "left_semi"), stored, keys, order)
    return rows.withColumn("is_tombstone", F.lit(False)) if "is_tombstone" in rows.columns else rows
