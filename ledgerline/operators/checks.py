"""Business checks on imports and data-quality rules on stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ledgerline.config import ACCOUNTING_MODES, IMPORT_STATUSES, LIMITS, LINK_REASONS
from ledgerline.functions.dates import local_date
from ledgerline.functions.fingerprints import COUNTERS, FIVE_COUNTERS
from ledgerline.functions.text import CONTROL_CHARACTERS, is_sha256, trimmed
from ledgerline.operators.skew import spread_join
from ledgerline.session import ensure_checkpoint_dir

# What the registry and the commands accept.
MACHINE_ID = r"^[a-z0-9][a-z0-9-]{1,63}$"
MAX_NAME_CHARS = 100
MAX_COMMAND_CHARS = 2048
COMMAND_CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
MAX_STATUS_CHARS = 64
MAX_FETCH_MILLIS = 600_000


def future_dated(imports: DataFrame, now: Column, zone: str) -> DataFrame:
    """Imports that reach past today in the business time zone."""
    return imports.filter(F.col("scope_end") > local_date(now, zone))


def scope_regressions(incoming: DataFrame, imports: DataFrame) -> DataFrame:
    """Incoming snapshots that end before their machine's last accepted day."""
    last = imports.filter(F.col("status") == "processed").groupBy("machine_id").agg(F.max("scope_end").alias("last_scope_end"))
    return spread_join(incoming, last, ["machine_id"], ["import_id"], "inner").filter(F.col("scope_end") < F.col("last_scope_end"))


def registry_rejects(commands: DataFrame, machines: DataFrame) -> DataFrame:
    """Commands whose machine id is malformed, or not an active registered machine."""
    active = machines.filter("is_active").select("machine_id", F.lit(True).alias("_known"))
    spread = [c for c in commands.columns if c != "machine_id"][:1] or ["machine_id"]
    checked = spread_join(commands, active, ["machine_id"], spread)
    reason = F.when(~F.col("machine_id").rlike(MACHINE_ID), "malformed machine id").when(
        F.col("_known").isNull(), "unknown or inactive machine")
    return checked.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_known")


def command_violation(command: Column) -> Column:
    """Collection commands may hold tabs and line ends, but no other control characters."""
    clean = trimmed(command)
    return F.when(F.length(clean) > MAX_COMMAND_CHARS, "command too long").when(
        clean.rlike(COMMAND_CONTROL_CHARACTERS), "control characters in command")


def name_violation(name: Column, max_chars: int = MAX_NAME_CHARS) -> Column:
    clean = trimmed(name)
    return F.when(clean == "", "empty name").when(F.length(clean) > max_chars, "name too long").when(
        clean.rlike(CONTROL_CHARACTERS), "control characters in name")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break. An unknown outcome is no violation."""
    named = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.withColumn("violations", named).filter(F.size("violations") > 0)


def verdict_rules(verdict: Column, names: tuple[str, ...]) -> dict[str, Column]:
    """The outcomes of a verdict column (null where nothing is wrong) as one rule each."""
    return {name: F.coalesce(verdict != name, F.lit(True)) for name in names}


def audited(rows: DataFrame, rules: dict[str, Column], name: str = "audited") -> dict[str, int]:
    """Violations of each rule, counted in the pass that writes the rows; the rules are one projection. An unknown outcome is none."""
    watch = Observation(name)
    counts = [F.count(F.when(~rule, 1)).alias(f"r{k}") for k, rule in enumerate(rules.values())]
    rows.observe(watch, *counts).write.parquet(f"{ensure_checkpoint_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}")
    return {rule: watch.get[f"r{k}"] for k, rule in enumerate(rules)}


def _col(name: str) -> Column:
    return F.col(name)


def _non_negative(*names: str) -> Column:
    rule = _col(names[0]) >= 0
    for n in names[1:]:
        rule = rule & (_col(n) >= 0)
    return rule


def _nonempty(name: str, longest: int) -> Column:
    return F.length(F.trim(_col(name))).between(1, longest)


def _cost_ok() -> Column:
    return _col("reported_cost_usd").isNull() | (_col("reported_cost_usd") >= 0)


def _tombstone_is_zero() -> Column:
    zero = _col("reported_cost_usd").isNull()
    for n in (*FIVE_COUNTERS, "accounting_delta_tokens"):
        zero = zero & (_col(n) == 0)
    return ~_col("is_tombstone") | zero


def machine_rules() -> dict[str, Column]:
    return {"machine id": _col("machine_id").rlike(MACHINE_ID), "machine name": name_violation(_col("name")).isNull()}


def import_rules() -> dict[str, Column]:
    return {
        "import status": _col("status").isin(*IMPORT_STATUSES),
        "import file size": _col("file_size_bytes").isNull() | _col("file_size_bytes").between(0, LIMITS.max_snapshot_bytes),
        "import hash": is_sha256(_col("raw_sha256")),
        "import scope order": _col("scope_start").isNull() | _col("scope_end").isNull() | (_col("scope_start") <= _col("scope_end")),
    }


def daily_rules() -> dict[str, Column]:
    return {
        "agent length": _nonempty("agent", LIMITS.max_agent_chars),
        "counters not negative": _non_negative(*FIVE_COUNTERS),
        "cost not negative": _cost_ok(),
        "hash format": is_sha256(_col("usage_hash")),
        "tombstone is zero": _tombstone_is_zero(),
    }


def model_rules() -> dict[str, Column]:
    return {**daily_rules(), "model length": _nonempty("model", LIMITS.max_model_chars)}


def session_rules() -> dict[str, Column]:
    return {
        "agent length": _nonempty("agent", LIMITS.max_agent_chars),
        "session id length": _nonempty("session_id", LIMITS.max_session_chars),
        "counters not negative": _non_negative(*FIVE_COUNTERS),
        "cost not negative": _cost_ok(),
        "activity order": _col("first_activity").isNull() | _col("last_activity").isNull() | (_col("first_activity") <= _col("last_activity")),
        "hash format": is_sha256(_col("local_key_hash")) & is_sha256(_col("identity_hash")) & is_sha256(_col("mirror_hash")) & is_sha256(_col("session_hash")),
    }


def link_rules() -> dict[str, Column]:
    return {
        "link reason": _col("reason").isin(*LINK_REASONS),
        "match count not negative": _col("matched_session_count") >= 0,
        "overlap ratio": _col("session_overlap_ratio").between(0, 1),
        "link not to itself": _col("observation_id") != _col("canonical_observation_id"),
    }


def recovered_rules() -> dict[str, Column]:
    return {
        "month normalised": _col("month") == F.trunc(_col("month"), "month"),
        "agent length": _nonempty("agent", LIMITS.max_agent_chars),
        "counters not negative": _non_negative(*COUNTERS, "total_tokens"),
        "total is the sum": _col("total_tokens") == _col("input_tokens") + _col("output_tokens") + _col("cache_read_tokens") + _col("cache_creation_tokens"),
        "cost not negative": _cost_ok(),
        "model names": ~F.exists("models", lambda m: m.isNull() | (m == "")),
    }


def recovered_set_rules() -> dict[str, Column]:
    return {
        "accounting mode": _col("accounting_mode").isin(*ACCOUNTING_MODES),
        "total is the sum": _col("total_tokens") == _col("total_input_tokens") + _col("total_output_tokens") + _col("total_cache_read_tokens") + _col("total_cache_creation_tokens"),
        "cost not negative": _cost_ok(),
    }


def recovered_origin_rules() -> dict[str, Column]:
    return {
        "source machine count": _col("source_machine_count") > 0,
        "confidence": _col("confidence") == "exact_monthly_aggregate",
        "granularity": _col("granularity") == "monthly_agent",
    }


def contract_rules() -> dict[str, Column]:
    plan = [_col(n) for n in ("baseline", "hard_limit", "safety_reserve", "planned_ceiling")]
    known = plan[0].isNotNull() & plan[1].isNotNull() & plan[2].isNotNull() & plan[3].isNotNull()
    absent = plan[0].isNull() & plan[1].isNull() & plan[2].isNull() & plan[3].isNull()
    return {
        "contract status": _col("status").isin(*IMPORT_STATUSES),
        "plan relations": absent | (known & F.coalesce(
            (_col("hard_limit") > 0) & (_col("safety_reserve") >= 0) & (_col("safety_reserve") < _col("hard_limit"))
            & (F.abs(_col("planned_ceiling") - (_col("hard_limit") - _col("safety_reserve"))) < 1e-9)
            & (_col("baseline") >= 0) & (_col("baseline") <= _col("planned_ceiling")), F.lit(False))),
        "reset after start": _col("tracking_start").isNull() | _col("reset_at").isNull() | (_col("reset_at") > _col("tracking_start")),
        "processed is complete": (_col("status") != "processed") | (
            known & _col("tracking_start").isNotNull() & _col("reset_at").isNotNull() & _col("check_time").isNotNull()),
    }


def reading_rules() -> dict[str, Column]:
    return {
        "fraction in range": _col("fraction").between(0, 1),
        "status length": F.length("status").between(1, MAX_STATUS_CHARS),
        "fetch duration": _col("fetch_duration_ms").between(0, MAX_FETCH_MILLIS),
    }


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys stored more than once, for tables whose key must be unique per import."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
