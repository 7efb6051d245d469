"""Live quota readings against contracts: validation, as-of ceilings, rollover, comparison.

A contract's checkpoint array travels with its row, so the checkpoint in force
at a reading is found inside the row; no range join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.config import LIMITS
from ledgerline.functions.dates import dated_instant
from ledgerline.functions.text import trimmed
from ledgerline.operators.pacing import exploded
from ledgerline.operators.skew import wide_join, with_previous
from ledgerline.schemas import READING_PAYLOAD

# The texts of the statuses.
LABELS = {"ON_TRACK": "On track", "NEAR_PLAN": "Near plan", "OVER_PACE": "Over pace", "LIMIT_EXCEEDED": "Limit exceeded",
          "SYNC_STALE": "Stale", "RESET_REQUIRED": "Reset required"}
NO_OBSERVATION = "—"
UPCOMING = "Upcoming"


def canonical_reset(value: Column) -> Column:
    return F.date_trunc("second", value)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000


def same_reset_window(a: Column, b: Column, tolerance: int = LIMITS.reset_tolerance_seconds) -> Column:
    return F.abs(seconds_between(canonical_reset(a), canonical_reset(b))) <= tolerance


def is_rate_limited(status: Column) -> Column:
    text = F.translate(F.lower(trimmed(status)), "_", "-")
    return text.isin("rate-limited", "exhausted", "limited", "exceeded") | text.contains("rate-limited")


def freshness(age_seconds: Column) -> Column:
    return (
        F.when(age_seconds.isNull(), "STALE").when(age_seconds < LIMITS.live_seconds, "LIVE")
        .when(age_seconds < LIMITS.recent_seconds, "RECENT").otherwise("STALE"))


def parse_payloads(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reading payloads to (valid readings, quarantine with a reason).

    Reads raw(account, reading_id, fetched_at, fetch_duration_ms, payload). The
    state was read when the request started: observed = fetched - duration.
    """
    monthly = F.col("_p.usage.monthly")
    percent, status, resets = monthly["percent"], monthly["status"], monthly["resetsAt"]
    reset_at = dated_instant(resets)
    # A number quoted as text, and a status given as a number, are malformed; the document keeps its types.
    doc = F.try_parse_json("payload")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    quoted = F.coalesce(kind("$.usage.monthly.percent") == "STRING", F.lit(False))
    reset_text = F.coalesce(kind("$.usage.monthly.resetsAt") == "STRING", F.lit(False))
    status_text = F.coalesce(kind("$.usage.monthly.status") == "STRING", F.lit(False))
    reason = (
        F.when(doc.isNull(), "malformed document")
        .when(monthly.isNull(), "missing usage.monthly")
        .when(percent.isNull() | quoted | F.isnan(percent) | (percent < 0) | (percent == float("inf")), "malformed percent")
        .when(percent > 100, "percent out of range")
        .when(status.isNull() | (trimmed(status) == "") | ~status_text, "malformed status")
        .when(reset_at.isNull() | ~reset_text, "malformed reset"))
    checked = raw.withColumn("_p", F.from_json("payload", READING_PAYLOAD)).withColumn("reason", reason)
    valid = checked.filter(F.col("reason").isNull()).select(
        "account", "reading_id",
        F.timestamp_micros(F.unix_micros("fetched_at") - F.col("fetch_duration_ms") * 1000).alias("observed_at"),
        "fetched_at", "fetch_duration_ms", (percent / 100).alias("fraction"), status.alias("status"),
        canonical_reset(reset_at).alias("provider_resets_at"))
    return valid, checked.filter(F.col("reason").isNotNull()).drop("_p")


def state_at(now: Column) -> dict[str, Column]:
    """Checkpoint and ceiling in force at `now`, and the next ones; the baseline holds before the first."""
    active = F.array_max(F.filter("checkpoints", lambda c: c["ts"] <= now))
    following = F.array_min(F.filter("checkpoints", lambda c: c["ts"] > now))
    return {"active": active, "next": following}


def with_active_state(contracts: DataFrame, now: Column) -> DataFrame:
    return contracts.withColumns(state_at(now)).withColumns({
        "active_ceiling": F.coalesce("active.ceiling", "baseline"),
        "pre_first_checkpoint": F.col("active").isNull(),
        "next_ceiling": F.col("next.ceiling"),
        "seconds_until_next": F.greatest(F.lit(0.0), seconds_between(F.col("next.ts"), now)),
    })


def in_contract(readings: DataFrame, contracts: DataFrame, *columns: str) -> DataFrame:
    """Readings observed inside their account's contract: start <= observed < reset.

    An account that holds many readings is spread over several tasks. Contracts with their checkpoints are
    wide and as many as the accounts, so they are neither broadcast nor repeated for the other accounts.
    """
    wanted = contracts.select("account", "contract_id", "tracking_start", "reset_at", *columns)
    return wide_join(readings, wanted, ["account"], ["reading_id"]).filter(
        (F.col("observed_at") >= F.col("tracking_start")) & (F.col("observed_at") < F.col("reset_at")))


def readings_with_ceiling(readings: DataFrame, contracts: DataFrame) -> DataFrame:
    """Every in-contract reading with the ceiling in force when it was observed."""
    joined = in_contract(readings, contracts, "baseline", "checkpoints")
    return with_active_state(joined, F.col("observed_at")).withColumn(
        "headroom", F.col("active_ceiling") - F.col("fraction").cast("double")).drop("checkpoints")


def is_rollover(previous_reset: Column, reset: Column, observed: Column) -> Column:
    """The reset moved on by more than the tolerance and the old window is over, or it moved by a day or more."""
    advance = seconds_between(reset, previous_reset)
    ended = seconds_between(previous_reset, observed) <= LIMITS.reset_tolerance_seconds
    moved = (advance > LIMITS.reset_tolerance_seconds) & (ended | (advance >= LIMITS.rollover_min_advance_seconds))
    return F.coalesce(moved, F.lit(False))


def rollovers(readings: DataFrame) -> DataFrame:
    """Each reading with `is_rollover` against the reading before it; usage plays no part."""
    paired = with_previous(readings, ["account"], "observed_at", ["observed_at", "reading_id"], ["provider_resets_at"], name="_before")
    return paired.withColumn("is_rollover", is_rollover(
        canonical_reset(F.col("_before.provider_resets_at")), canonical_reset(F.col("provider_resets_at")),
        F.col("observed_at"))).drop("_before")


def _newest_first(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(F.col("observed_at").desc(), F.col("reading_id").desc())


def newest(readings: DataFrame, n: int = 60, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """The newest n readings per key, numbered from 1."""
    return readings.withColumn("position", F.row_number().over(_newest_first(*keys))).filter(F.col("position") <= n)


def latest_two_in_contract(readings: DataFrame, contracts: DataFrame) -> DataFrame:
    """Newest and second newest in-window reading per contract as structs `latest` and `previous`."""
    fields = ["observed_at", "fraction", "status", "provider_resets_at"]
    two = newest(in_contract(readings, contracts), 2, ("contract_id",))
    packed = F.struct(*fields)
    return two.groupBy("contract_id").agg(
        F.max(F.when(F.col("position") == 1, packed)).alias("latest"),
        F.max(F.when(F.col("position") == 2, packed)).alias("previous"))


def compare(contracts: DataFrame, readings: DataFrame, now: Column) -> DataFrame:
    """Status of every contract at `now` from its newest in-window readings, by precedence."""
    pair = latest_two_in_contract(readings, contracts)
    joined = with_active_state(contracts.join(pair, "contract_id", "left"), now)
    fraction = F.col("latest.fraction").cast("double")
    usable = F.coalesce((fraction >= 0) & ~F.isnan(fraction) & (fraction < float("inf")), F.lit(False))
    age = F.greatest(F.lit(0.0), seconds_between(now, F.col("latest.observed_at")))
    headroom = F.col("active_ceiling") - fraction
    rolled = usable & is_rollover(canonical_reset(F.col("previous.provider_resets_at")),
                                  canonical_reset(F.col("latest.provider_resets_at")), F.col("latest.observed_at"))
    status = (
        F.when(now >= F.col("reset_at"), "RESET_REQUIRED")
        .when(~usable, "SYNC_STALE")
        .when(rolled, "RESET_REQUIRED")
        .when((fraction >= 1) | is_rate_limited(F.col("latest.status")), "LIMIT_EXCEEDED")
        .when(age > LIMITS.sync_stale_seconds, "SYNC_STALE")
        .when(fraction > F.col("active_ceiling"), "OVER_PACE")
        .when((headroom >= LIMITS.headroom_lower_eps)
              & (headroom <= LIMITS.near_plan_headroom + LIMITS.headroom_upper_eps), "NEAR_PLAN")
        .otherwise("ON_TRACK"))
    return joined.withColumns({
        "comparison_status": status, "is_rollover": rolled,
        "freshness": freshness(F.when(F.col("latest").isNotNull(), age)),
        "freshness_age_seconds": F.when(F.col("latest").isNotNull(), age),
        "safe_headroom": F.when(usable, headroom),
        "provider_remaining": F.when(usable, F.greatest(F.lit(0.0), 1 - fraction)),
        "provider_monthly": F.when(usable, fraction),
        "provider_status": F.col("latest.status"),
    })


def first_in_window(readings: DataFrame, contracts: DataFrame) -> DataFrame:
    """First reading of each checkpoint's window [checkpoint, next checkpoint or reset).

    The window a reading falls into is that of its active checkpoint, so this is
    one aggregation after the join.
    """
    placed = in_contract(readings, contracts, "checkpoints").withColumn(
        "_active", F.array_max(F.filter("checkpoints", lambda c: c["ts"] <= F.col("observed_at"))))
    first = F.min(F.struct("observed_at", "reading_id", "fraction"))
    return placed.filter(F.col("_active").isNotNull()).groupBy("contract_id", F.col("_active.day").alias("day")).agg(
        first.alias("_first")).select("contract_id", "day", F.col("_first.observed_at").alias("observed_at"),
                                      F.col("_first.fraction").alias("fraction"))


def history_label(headroom: Column, fraction: Column) -> Column:
    return (
        F.when(fraction >= 1, "Limit exceeded").when(fraction < 0, NO_OBSERVATION)
        .when(headroom < LIMITS.headroom_lower_eps, "Over pace")
        .when(headroom <= LIMITS.near_plan_headroom + LIMITS.headroom_upper_eps, "Near plan")
        .otherwise("On track"))


def status_label(status: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, status), status)


def checkpoint_rows(contracts: DataFrame, readings: DataFrame, now: Column) -> DataFrame:
    """One row per checkpoint: upcoming, current with live values, or history.
    The current row shows live values only while the account's newest reading of
    all lies inside the contract.
    """
    compared = compare(contracts, readings, now)
    seen = first_in_window(readings, contracts).groupBy("contract_id").agg(
        F.map_from_entries(F.collect_list(F.struct("day", F.col("fraction").cast("double")))).alias("_seen"))
    # The newest reading of an account is one value: a partial max, never a window over all readings.
    last = readings.groupBy("account").agg(F.max("observed_at").alias("_last"))
    # Maps are wider than Spark takes them for, so they are not broadcast.
    joined = compared.join(seen.hint("merge"), "contract_id", "left").join(last, "account", "left")
    live = (F.col("_last") >= F.col("tracking_start")) & (F.col("_last") < F.col("reset_at"))
    opened = exploded(
        joined.withColumn("_live", F.coalesce(live, F.lit(False))),
        "contract_id", "comparison_status", "provider_monthly", "safe_headroom", "_live", "_seen",
        F.col("active.date").alias("_active_date"))
    future = F.col("_c.ts") > now
    current = ~future & F.coalesce(F.col("_c.date") == F.col("_active_date"), F.lit(False))
    found = F.try_element_at(F.col("_seen"), F.col("_c.day"))
    gap = F.col("_c.ceiling") - found
    return opened.select(
        "contract_id", "_c.day", "_c.date", "_c.ts", "_c.ceiling",
        F.when(future, F.lit(None)).when(current, F.when(F.col("_live"), F.col("provider_monthly"))).otherwise(found).alias("observation"),
        F.when(future, F.lit(None)).when(current, F.when(F.col("_live"), F.col("safe_headroom"))).otherwise(gap).alias("headroom"),
        F.when(future, UPCOMING).when(current, status_label(F.col("comparison_status")))
        .when(found.isNull(), NO_OBSERVATION).otherwise(history_label(gap, found)).alias("status"),
        current.alias("is_current"), future.alias("is_future"))


def chart_points(contracts: DataFrame, rows: DataFrame) -> DataFrame:
    """The checkpoint series with whatever row exists for its date. Both sides are exploded, which Spark's estimate leaves out, so neither is broadcast."""
    series = exploded(contracts, "contract_id").select(
        "contract_id", F.col("_c.date").alias("date"), F.col("_c.ts").alias("ts"), F.col("_c.ceiling").alias("ceiling"))
    return series.join(rows.select("contract_id", "date", "observation", "status", "headroom").hint("merge"), ["contract_id", "date"], "left").orderBy("contract_id", "ts")


def default_rows(rows: DataFrame, before: int = 3, after: int = 5, without_current: int = 8) -> DataFrame:
    """Three rows before the current checkpoint, itself and five after; the first eight when there is none."""
    position = F.min(F.when(F.col("is_current"), F.col("day"))).over(Window.partitionBy("contract_id"))
    near = F.col("day").between(F.col("_current") - before, F.col("_current") + after)
    return rows.withColumn("_current", position).filter(
        F.when(F.col("_current").isNull(), F.col("day") <= without_current).otherwise(near)).drop("_current")


def room_to_next(next_ceiling: Column, fraction: Column) -> Column:
    return next_ceiling - fraction


def refresh_policy(latest: DataFrame, now: Column) -> DataFrame:
    """Which accounts are due, cooling down, and for how long.

    `latest(account, observed_at, tracking_start, reset_at)`; the cooldown holds
    only while the latest reading belongs to a valid contract window, or there is no window.
    """
    age = seconds_between(now, F.col("observed_at"))
    has_window = F.coalesce(F.col("reset_at") > F.col("tracking_start"), F.lit(False))
    outside = has_window & ((F.col("observed_at") < F.col("tracking_start")) | (F.col("observed_at") >= F.col("reset_at")))
    cooling = F.coalesce((age < LIMITS.cooldown_seconds) & ~outside, F.lit(False))
    return latest.withColumns({
        "due": F.coalesce(age >= LIMITS.auto_refresh_seconds, F.lit(True)),
        "cooling_down": cooling,
        "cooldown_seconds_left": F.when(cooling, F.greatest(F.lit(0.0), LIMITS.cooldown_seconds - age)).otherwise(F.lit(0.0)),
    })
