"""Quota contracts: generated checkpoints, linear ceilings, recorded actuals, status.

A contract covers one quota cycle, so its checkpoints are a short array inside
its row. Schedules, ceilings and checks are expressions on that array and need
no shuffle; checkpoints are exploded only for output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.config import LIMITS
from ledgerline.functions.dates import day_sequence, local_date, wall_to_instant
from ledgerline.functions.text import trimmed
from ledgerline.operators import workbook
from ledgerline.operators.skew import with_previous

CYCLE = ["account", "tracking_start", "reset_at"]


def planned_ceiling(hard_limit: Column, safety_reserve: Column) -> Column:
    return hard_limit - safety_reserve


def plan_violation(baseline: Column, hard_limit: Column, safety_reserve: Column) -> Column:
    """Name of the first broken plan rule, null for a valid plan."""
    def finite(value):
        return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))
    return (
        F.when(~finite(baseline), "baseline is not a finite number")
        .when(~finite(hard_limit), "hard limit is not a finite number")
        .when(~finite(safety_reserve), "safety reserve is not a finite number")
        .when(baseline < 0, "baseline is negative")
        .when(hard_limit <= 0, "hard limit is not positive")
        .when(safety_reserve < 0, "safety reserve is negative")
        .when(safety_reserve >= hard_limit, "safety reserve reaches the hard limit")
        .when(baseline > planned_ceiling(hard_limit, safety_reserve), "baseline exceeds the planned ceiling")
    )


def with_plan(contracts: DataFrame) -> DataFrame:
    """Planned ceiling, starting budget and the plan's violation, if any."""
    plan = planned_ceiling(F.col("hard_limit"), F.col("safety_reserve"))
    broken = plan_violation(F.col("baseline"), F.col("hard_limit"), F.col("safety_reserve"))
    return contracts.withColumns({
        "planned_ceiling": plan,
        "starting_budget": F.when(broken.isNull(), plan - F.col("baseline")),
        "plan_violation": broken,
    })


def ceiling_at(instant: Column, start: Column, reset: Column, baseline: Column, plan: Column) -> Column:
    """Linear from the baseline at the start to the plan at the reset, clamped to both."""
    progress = (F.unix_micros(instant) - F.unix_micros(start)) / (F.unix_micros(reset) - F.unix_micros(start))
    return F.greatest(baseline, F.least(plan, baseline + (plan - baseline) * progress))


def with_schedule(contracts: DataFrame, zone: str) -> DataFrame:
    """Add `checkpoints`: one per local day, strictly between start and reset, numbered from 1."""
    start, reset = F.col("tracking_start"), F.col("reset_at")
    days = day_sequence(local_date(start, zone), local_date(reset, zone))
    plan = planned_ceiling(F.col("hard_limit"), F.col("safety_reserve"))
    candidates = F.transform(days, lambda d: F.struct(
        d.alias("date"), wall_to_instant(d, F.col("check_time"), zone).alias("ts")))
    inside = F.filter(candidates, lambda c: (c["ts"] > start) & (c["ts"] < reset))
    schedule = F.transform(inside, lambda c, i: F.struct(
        c["ts"].alias("ts"), (i + 1).alias("day"), c["date"].alias("date"), F.col("check_time").alias("check_time"),
        ceiling_at(c["ts"], start, reset, F.col("baseline"), plan).alias("ceiling")))
    # Exploding a one-element array pins the schedule here: a condition on it that
    # Spark derives further up would otherwise be worked out again for every source row.
    return contracts.select("*", F.explode(F.array(schedule)).alias("checkpoints"))


def exploded(contracts: DataFrame, *columns) -> DataFrame:
    """One row per checkpoint as `_c`. An outer explode adds no condition on the array to the source."""
    return contracts.select(*columns, F.explode_outer("checkpoints").alias("_c")).filter(F.col("_c").isNotNull())


def checkpoints(contracts: DataFrame, *extra: str) -> DataFrame:
    return exploded(contracts, "contract_id", *extra).select("contract_id", *extra, "_c.*")


def with_actuals(contracts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Attach recorded actuals(contract_id, date, actual) to the checkpoints; missing days stay blank, of several values of a day the highest counts."""
    recorded = actuals.filter(F.col("actual").isNotNull()).groupBy("contract_id", "date").agg(F.max("actual").alias("actual")).groupBy("contract_id").agg(
        F.map_from_entries(F.collect_list(F.struct("date", "actual"))).alias("_actuals"))
    return contracts.join(recorded, "contract_id", "left").withColumn("checkpoints", F.transform(
        "checkpoints", lambda c: c.withField("actual", F.try_element_at(F.col("_actuals"), c["date"])))).drop("_actuals")


def _latest(array: Column) -> Column:
    """The element with the greatest time; elements start with `ts`."""
    return F.array_max(array)


def latest_actual(contracts: DataFrame) -> DataFrame:
    """Latest recorded actual by time, else the baseline, as `latest`; negative or infinite ones are flagged."""
    recorded = F.filter("checkpoints", lambda c: c["actual"].isNotNull())
    newest = _latest(recorded)
    return contracts.withColumns({
        "_newest": newest,
        "actual_invalid": F.exists("checkpoints", lambda c: F.coalesce(
            (c["actual"] < 0) | F.isnan(c["actual"]) | (c["actual"] == float("inf")), F.lit(False))),
    }).withColumn("latest", F.struct(
        F.coalesce("_newest.actual", "baseline").alias("value"),
        F.when(F.col("_newest").isNull(), "baseline").otherwise("checkpoint").alias("source"),
        F.col("_newest.date").alias("date"), F.col("_newest.ts").alias("ts"))).drop("_newest")


def required_checkpoint(now: Column) -> Column:
    """Latest checkpoint at or before now."""
    return _latest(F.filter("checkpoints", lambda c: c["ts"] <= now))


def tracker_status(contracts: DataFrame, now: Column) -> DataFrame:
    """Status by precedence, with the required checkpoint, headroom and what is left of the budget."""
    seen = latest_actual(contracts).withColumn("required", required_checkpoint(now))
    actual, ceiling = F.col("required.actual"), F.col("required.ceiling")
    headroom = ceiling - actual
    plan = planned_ceiling(F.col("hard_limit"), F.col("safety_reserve"))
    status = (
        F.when(now >= F.col("reset_at"), "RESET_REQUIRED")
        .when(F.col("latest.value") >= F.col("hard_limit"), "LIMIT_EXCEEDED")
        .when(F.col("required").isNull(), "ON_TRACK")
        .when(actual.isNull(), "UPDATE_DUE")
        .when(actual > ceiling, "OVER_PACE")
        .when((headroom >= 0) & (headroom <= LIMITS.near_limit_headroom), "NEAR_LIMIT")
        .otherwise("ON_TRACK"))
    early = F.col("status").isin("RESET_REQUIRED", "LIMIT_EXCEEDED", "UPDATE_DUE")
    return seen.withColumn("status", status).withColumns({
        "headroom": F.when(~early, headroom),
        "remaining_budget": F.greatest(F.lit(0.0), plan - F.col("latest.value")),
        "pre_first_checkpoint": F.col("required").isNull() & ~F.col("status").isin("RESET_REQUIRED", "LIMIT_EXCEEDED"),
    })


def reconcile_formulas(contracts: DataFrame, tolerance: float = LIMITS.formula_tolerance,
                       keep: int = LIMITS.max_formula_details) -> DataFrame:
    """Compare the sheet's own ceilings with the computed ones.

    Reads `sheet_planned_ceiling` and `sheet_ceilings` array<struct<day, value>>.
    All mismatches are counted; the listed details are the first `keep`, planned ceiling first.
    """
    plan = planned_ceiling(F.col("hard_limit"), F.col("safety_reserve"))
    own = F.map_from_entries(F.transform("checkpoints", lambda c: F.struct(c["day"], c["ceiling"])))
    header = F.filter(F.array(F.struct(
        F.lit("plannedCeiling").alias("field"), F.lit(None).cast("int").alias("day"),
        F.col("sheet_planned_ceiling").alias("sheet_value"), plan.alias("computed_value"))),
        lambda v: v["sheet_value"].isNotNull())
    lines = F.transform(F.filter("sheet_ceilings", lambda s: s["value"].isNotNull()), lambda s: F.struct(
        F.lit("checkpointCeiling").alias("field"), s["day"].alias("day"), s["value"].alias("sheet_value"),
        F.try_element_at(F.col("_own"), s["day"]).alias("computed_value")))
    return (
        contracts.withColumn("_own", own)
        .withColumn("_values", F.concat(header, F.array_sort(lines)))
        .withColumn("_off", F.filter("_values", lambda v: F.abs(v["sheet_value"] - v["computed_value"]) > tolerance))
        .withColumns({
            "formula_values_available": F.size("_values") > 0,
            "formula_mismatch_count": F.size("_off"),
            "formula_warnings": F.slice("_off", 1, keep),
        }).drop("_own", "_values", "_off")
    )


def schedule_violation(supplied: Column, expected: Column, check_time: Column) -> Column:
    """First broken rule of a supplied checkpoint array(day, date, ts, check_time), null when it fits.

    Arrays are compared by position.
    """
    n = F.size(supplied)
    pairs = F.arrays_zip(F.slice(supplied, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(supplied, 2, F.greatest(n, F.lit(1))).alias("b"))
    stamps = F.transform(supplied, lambda c: c["ts"])
    return (
        F.when(n == 0, "checkpoint table has no rows")
        .when(F.exists(F.transform(supplied, lambda c, i: c["day"] != i + 1), lambda b: F.coalesce(b, F.lit(True))),
              "day numbers are not contiguous")
        .when(F.size(F.array_distinct(stamps)) < n, "duplicate checkpoint")
        .when(F.exists(pairs, lambda p: p["a"]["ts"] >= p["b"]["ts"]), "checkpoints do not increase")
        .when(F.exists(supplied, lambda c: c["check_time"] != check_time), "inconsistent check time")
        .when(n != F.size(expected), "unexpected number of checkpoints")
        .when(F.exists(F.arrays_zip(supplied.alias("s"), expected.alias("e")), lambda p: (p["s"]["ts"] != p["e"]["ts"]) | (p["s"]["date"] != p["e"]["date"])),
              "checkpoint does not match the schedule")
    )


def first_decrease(points: Column) -> Column:
    """Date of the first actual below an earlier one, blanks ignored. `points` are ordered structs(date, actual)."""
    known = F.filter(points, lambda p: p["actual"].isNotNull())
    n = F.size(known)
    pairs = F.arrays_zip(
        F.slice(known, 1, F.greatest(n - 1, F.lit(0))).alias("before"), F.slice(known, 2, F.greatest(n, F.lit(1))).alias("after"))
    falling = F.filter(pairs, lambda p: p["after"]["actual"] < p["before"]["actual"])
    return F.get(falling, 0)["after"]["date"]


def _points(array: Column) -> Column:
    return F.transform(array, lambda c: F.struct(c["date"].alias("date"), c["actual"].alias("actual")))


def correction_violation(previous: Column, following: Column) -> Column:
    """plan_drift, null_regression or monotonic for a new actual sequence of the same cycle; null when allowed.

    Both are ordered arrays with date and actual. The first break in date order decides.
    """
    zipped = F.arrays_zip(previous.alias("p"), following.alias("n"))
    codes = F.transform(zipped, lambda z: F.when(z["p"]["date"] != z["n"]["date"], "plan_drift").when(
        z["p"]["actual"].isNotNull() & z["n"]["actual"].isNull(), "null_regression"))
    return F.when(F.size(previous) != F.size(following), "plan_drift").otherwise(F.coalesce(
        F.get(F.array_compact(codes), 0),
        F.when(first_decrease(_points(following)).isNotNull(), F.lit("monotonic"))))


def check_same_cycle(imports: DataFrame) -> DataFrame:
    """Each accepted import against the one before it in its cycle, with the code of the broken rule.

    The plan of a cycle is frozen after its first accepted import: five scalars
    and the schedule must stay equal. `imports` carry the plan and `checkpoints`
    with actuals.
    """
    plan = ["baseline", "hard_limit", "safety_reserve", "planned_ceiling", "check_time"]
    accepted = imports.filter(F.col("status") == "processed")
    paired = with_previous(accepted, CYCLE, "created_at", ["created_at", "contract_id"], [*plan, "checkpoints"],
                           name="_before", bucket_seconds=30 * 86400)
    drift = F.lit(False)
    for name in plan:
        drift = drift | ~F.col(name).eqNullSafe(F.col(f"_before.{name}"))
    dates = lambda array: F.transform(array, lambda c: c["date"])
    drift = drift | ~dates(F.col("checkpoints")).eqNullSafe(dates(F.col("_before.checkpoints")))
    code = F.when(F.col("_before").isNull(), F.lit(None)).when(drift, "plan_drift").otherwise(
        correction_violation(F.col("_before.checkpoints"), F.col("checkpoints")))
    return paired.withColumns({"is_first_of_cycle": F.col("_before").isNull(), "violation": code}).drop("_before")


def active_contracts(imports: DataFrame) -> DataFrame:
    """Per account: processed, newest cycle first, then newest import."""
    newest = Window.partitionBy("account").orderBy(
        F.col("tracking_start").desc(), F.col("created_at").desc(), F.col("contract_id").desc())
    return imports.filter(F.col("status") == "processed").withColumn("_rank", F.row_number().over(newest)).filter(
        "_rank = 1").drop("_rank")


def latest_accepted_per_cycle(imports: DataFrame) -> DataFrame:
    newest = Window.partitionBy(*CYCLE).orderBy(F.col("created_at").desc(), F.col("contract_id").desc())
    return imports.filter(F.col("status") == "processed").withColumn("_rank", F.row_number().over(newest)).filter(
        "_rank = 1").drop("_rank")


def import_history(imports: DataFrame, limit: int = 50) -> DataFrame:
    return imports.orderBy(F.col("created_at").desc(), F.col("contract_id").desc()).limit(limit)


def stored_documents(contracts: DataFrame, zone: str) -> DataFrame:
    """The stored form of a contract: plan, checkpoint array, latest actual and formula diagnostics."""
    full = contracts if "formula_mismatch_count" in contracts.columns else contracts.withColumns({
        "formula_values_available": F.lit(False), "formula_mismatch_count": F.lit(0),
        "formula_warnings": F.lit(None)})
    return latest_actual(full).select("contract_id", F.struct(
        F.lit(zone).alias("timezone"), F.col("tracking_start"), F.col("reset_at"), F.col("check_time"),
        F.col("baseline"), F.col("hard_limit"), F.col("safety_reserve"),
        planned_ceiling(F.col("hard_limit"), F.col("safety_reserve")).alias("planned_ceiling"),
        F.col("checkpoints"), F.col("latest"),
        F.struct("formula_values_available", "formula_mismatch_count", "formula_warnings").alias("diagnostics"),
    ).alias("document"))


def tracker_view(documents: DataFrame, now: Column) -> DataFrame:
    """The one-row-per-contract view computed from stored documents."""
    opened = documents.select("contract_id", "document.*").drop("latest")
    return tracker_status(opened, now).select(
        "contract_id", "tracking_start", "reset_at", "planned_ceiling", "status",
        F.col("required.date").alias("required_date"), F.col("required.ceiling").alias("required_ceiling"),
        "headroom", "latest", "remaining_budget", "pre_first_checkpoint",
        F.size("checkpoints").alias("checkpoint_count"), F.col("diagnostics.formula_mismatch_count").alias("formula_mismatch_count"))


#: The code of each broken rule of schedule_violation.
_SCHEDULE_CODES = {"duplicate checkpoint": "duplicate", "checkpoints do not increase": "non_increasing"}


def workbook_verdicts(cells: DataFrame, title: str, zone: str) -> DataFrame:
    """One row per workbook: the code of the first check it fails, in the order of the sheet, or null if it is accepted.

    `cells` is read many times, so it should be a written table.
    """
    values = workbook.label_values(cells, workbook.SOURCE_LABELS + workbook.DERIVED_LABELS)
    plans = workbook.read_plans(values, zone)
    headers = workbook.header_columns(cells)
    rows = workbook.read_checkpoints(workbook.table_rows(cells, headers), plans, zone)
    full = with_schedule(workbook.assemble(plans, rows), zone)
    supplied = F.coalesce("supplied", F.array().cast(full.schema["supplied"].dataType))
    number = lambda name: F.col(name).isNull()
    broken = schedule_violation(supplied, F.coalesce("checkpoints", F.array().cast(full.schema["checkpoints"].dataType)), F.col("check_time"))
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _SCHEDULE_CODES.items() for x in pair]), broken), F.when(broken.isNotNull(), F.lit("schedule")))
    judged = full.select("workbook_id", F.when(number("baseline"), "invalid_plan").when(number("check_time") | number("tracking_start") | number("reset_at"), "invalid_datetime").when(
        number("hard_limit") | number("safety_reserve"), "invalid_plan").when(F.col("reset_at") <= F.col("tracking_start"), "invalid_datetime").when(
        plan_violation(F.col("baseline"), F.col("hard_limit"), F.col("safety_reserve")).isNotNull(), "invalid_plan").alias("_plan"),
        F.when(F.exists(supplied, lambda c: c["date"].isNull()), "invalid_datetime").when(F.exists(supplied, lambda c: c["actual_malformed"]), "invalid_actual").alias("_rows"),
        F.coalesce(code, F.when(first_decrease(_points(supplied)).isNotNull(), "monotonic")).alias("_table"))
    titled = cells.filter(trimmed(F.col("value")) == title).select("workbook_id").distinct().withColumn("_titled", F.lit(True))
    unlabelled = workbook.missing_labels(cells, values).select("workbook_id").withColumn("_unlabelled", F.lit(True))
    named = headers.select("workbook_id").withColumn("_headed", F.lit(True))
    joined = cells.select("workbook_id").distinct()
    for part in (titled, unlabelled, named, judged):
        joined = joined.join(part, "workbook_id", "left")
    return joined.select("workbook_id", F.coalesce(
        F.when(F.col("_titled").isNull(), "title"), F.when(F.col("_unlabelled"), "missing_label"), F.col("_plan"), F.when(F.col("_headed").isNull(), "missing_headers"),
        F.col("_rows"), F.col("_table")).alias("verdict"))
