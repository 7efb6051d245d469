"""Content fingerprints of daily, model and session rows.

The version tag is the first part of every fingerprint. Ledgers that already
hold fingerprints made under another tag pass that tag instead.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerline.functions.numbers import plain_decimal
from ledgerline.functions.text import trimmed

DAILY_TAG = "daily-agent-v2"
MODEL_TAG = "daily-agent-model-v1"
SESSION_LOCAL_TAG = "session-local-v1"
SESSION_IDENTITY_TAG = "session-identity-v1"
SESSION_MIRROR_TAG = "session-mirror-v1"
SESSION_TAG = "session-observation-v1"

COUNTERS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
FIVE_COUNTERS = COUNTERS + ("reported_total_tokens",)


def fingerprint(*parts: Column | str, missing: str = "") -> Column:
    """sha256 over '|'-joined parts. Nulls are spelled out: concat_ws would drop them."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit(missing)) for p in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def _cost_part(cost: Column) -> Column:
    return F.coalesce(plain_decimal(cost), F.lit("null"))


def _state_part(is_tombstone: Column) -> Column:
    return F.when(is_tombstone, "tombstone").otherwise("present")


def daily_hash(row, tag: str = DAILY_TAG) -> Column:
    """`row(name)` returns the column of that name: F.col for flat rows, a getter inside arrays."""
    return fingerprint(
        tag, row("agent"), row("usage_date"), *[row(c) for c in FIVE_COUNTERS],
        _cost_part(row("reported_cost_usd")), _state_part(row("is_tombstone")),
    )


def model_hash(row, tag: str = MODEL_TAG) -> Column:
    return fingerprint(
        tag, row("agent"), row("model"), row("usage_date"), *[row(c) for c in FIVE_COUNTERS],
        _cost_part(row("reported_cost_usd")), _state_part(row("is_tombstone")),
    )


def iso_instant(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def session_hashes(row) -> dict[str, Column]:
    """Local key (with path), identity, mirror (no price, no path) and observation hashes."""
    local = fingerprint(
        SESSION_LOCAL_TAG, row("agent"), row("session_id"), trimmed(row("project_path"))
    )
    mirror = fingerprint(
        SESSION_MIRROR_TAG, row("agent"), row("session_id"),
        iso_instant(row("first_activity")), iso_instant(row("last_activity")),
        *[row(c) for c in FIVE_COUNTERS], F.array_join(F.array_sort(row("models")), ","),
    )
    return {
        "local_key_hash": local,
        "identity_hash": fingerprint(SESSION_IDENTITY_TAG, row("agent"), row("session_id")),
        "mirror_hash": mirror,
        "session_hash": fingerprint(SESSION_TAG, local, mirror, _cost_part(row("reported_cost_usd"))),
    }
