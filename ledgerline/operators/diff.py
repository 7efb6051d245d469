"""Change classification of an incoming snapshot against the current rows.

Absence is not deletion: a key missing from the incoming rows keeps its
current value unless the caller opts in with evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions import fingerprints
from ledgerline.functions.fingerprints import FIVE_COUNTERS
from ledgerline.operators.revisions import DAILY_KEYS
from ledgerline.operators.skew import spread_join

NEW, REVISED, UNCHANGED, REMOVED, PRESERVED = "new", "revised", "unchanged", "removed", "preserved"
_VALUES = [*FIVE_COUNTERS, "accounting_delta_tokens", "reported_cost_usd", "is_tombstone", "usage_hash"]


def coverage(incoming: DataFrame) -> DataFrame:
    """Observed first and last day per machine."""
    return incoming.groupBy("machine_id").agg(
        F.min("usage_date").alias("scope_start"), F.max("usage_date").alias("scope_end"))


def widened_start(scope_start: Column, expected_start: Column) -> Column:
    """A snapshot is expected to reach back to the overlap start even when its rows begin later."""
    return F.least(scope_start, expected_start)


def classify_changes(incoming: DataFrame, current: DataFrame, keys: list[str] = DAILY_KEYS,
                     scopes: DataFrame | None = None, allow_removal: bool = False) -> DataFrame:
    """One row per key on either side with change_type and the totals before and after.

    `scopes(machine_id, scope_start, scope_end)` bounds removals; missing ends
    fall back to the observed days. Without `allow_removal` no row is removed.
    """
    new_side = F.struct(*[c for c in _VALUES if c in incoming.columns])
    old_side = F.struct("usage_hash", "reported_total_tokens")
    joined = incoming.select(*keys, new_side.alias("_in")).join(
        current.select(*keys, old_side.alias("_cur")), keys, "full_outer")
    absent = F.col("_in").isNull()
    removable = F.lit(False)
    if allow_removal:
        observed = coverage(incoming)
        if scopes is not None:
            given = scopes.select("machine_id", F.col("scope_start").alias("_start"), F.col("scope_end").alias("_end"))
            observed = observed.join(given, "machine_id", "full_outer").select(
                "machine_id", F.coalesce("_start", "scope_start").alias("scope_start"),
                F.coalesce("_end", "scope_end").alias("scope_end"))
        joined = spread_join(joined, observed, ["machine_id"], keys)
        removable = F.coalesce(F.col("usage_date").between(F.col("scope_start"), F.col("scope_end")), F.lit(False))
    change = (
        F.when(absent & removable, REMOVED).when(absent, PRESERVED)
        .when(F.col("_cur").isNull(), NEW)
        .when(F.col("_in.usage_hash") != F.col("_cur.usage_hash"), REVISED)
        .otherwise(UNCHANGED)
    )
    before = F.coalesce(F.col("_cur.reported_total_tokens"), F.lit(0))
    after = F.when(F.col("change_type") == REMOVED, F.lit(0)).when(
        F.col("change_type").isin(NEW, REVISED), F.col("_in.reported_total_tokens")).otherwise(before)
    return joined.withColumn("change_type", change).select(
        *keys, "change_type", before.alias("before_tokens"), after.alias("after_tokens"),
        F.col("_in").alias("incoming"))


def tombstones(changes: DataFrame, keys: list[str] = DAILY_KEYS) -> DataFrame:
    """All-zero rows for removed keys, fingerprinted as tombstones."""
    zero = {c: F.lit(0).cast("bigint") for c in FIVE_COUNTERS}
    row = {
        **{k: F.col(k) for k in keys}, **zero, "accounting_delta_tokens": F.lit(0).cast("bigint"),
        "reported_cost_usd": F.lit(None).cast("decimal(38,12)"), "is_tombstone": F.lit(True),
    }
    make = fingerprints.model_hash if "model" in keys else fingerprints.daily_hash
    row["usage_hash"] = make(row.__getitem__)
    return changes.filter(F.col("change_type") == REMOVED).select(*[v.alias(k) for k, v in row.items()])


def rows_to_write(changes: DataFrame, keys: list[str] = DAILY_KEYS) -> DataFrame:
    """New and revised rows as they came, removed keys as tombstones."""
    written = changes.filter(F.col("change_type").isin(NEW, REVISED)).select(*keys, "incoming.*")
    return written.unionByName(tombstones(changes, keys).select(written.columns))


def change_summary(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per change and the totals before and after; `by` gives one row per group."""
    kinds = (NEW, REVISED, UNCHANGED, REMOVED)
    return changes.groupBy(*(by or [])).agg(
        *[F.count(F.when(F.col("change_type") == k, 1)).alias(f"{k}_rows") for k in kinds],
        F.coalesce(F.sum("before_tokens"), F.lit(0)).alias("before_total"),
        F.coalesce(F.sum("after_tokens"), F.lit(0)).alias("after_total"),
        F.coalesce(F.sum(F.col("after_tokens") - F.col("before_tokens")), F.lit(0)).alias("net_change"),
    )
