"""Recovered monthly evidence: verification, row selection and projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline.config import LIMITS, RECOVERED_MACHINE

ALL_AGENT = "All"
PARTS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens")


def additive_sets(sets: DataFrame) -> DataFrame:
    """Only sets accounted as additive take part in totals."""
    return sets.filter(F.col("accounting_mode") == "additive_recovered")


def _strict_cost(condition):
    """A cost sum that is unknown as soon as one cost is."""
    cost = F.col("reported_cost_usd")
    unknown = F.count(F.when(condition & cost.isNull(), 1)) > 0
    return F.when(~unknown, F.coalesce(F.sum(F.when(condition, cost)), F.lit(0)).cast("decimal(38,12)"))


def _costs_agree(left, right):
    both_unknown = left.isNull() & right.isNull()
    near = F.abs(left - F.round(right, 2)) < F.lit(LIMITS.recovered_cost_tolerance).cast("decimal(38,12)")
    return both_unknown | F.coalesce(near, F.lit(False))


def monthly_checks(rows: DataFrame) -> DataFrame:
    """Per set and month: number of All rows, agent rows, and whether the agents add up to All."""
    is_all = F.col("agent") == ALL_AGENT
    sums = {}
    for part in PARTS:
        sums[f"all_{part}"] = F.sum(F.when(is_all, F.col(part)))
        sums[f"agents_{part}"] = F.coalesce(F.sum(F.when(~is_all, F.col(part))), F.lit(0))
    checked = rows.groupBy("set_id", "month").agg(
        F.count(F.when(is_all, 1)).alias("all_rows"), F.count(F.when(~is_all, 1)).alias("agent_rows"),
        *[v.alias(k) for k, v in sums.items()],
        _strict_cost(is_all).alias("all_cost"), _strict_cost(~is_all).alias("agents_cost"))
    same = _costs_agree(F.col("all_cost"), F.col("agents_cost"))
    for part in PARTS:
        same = same & (F.col(f"all_{part}") == F.col(f"agents_{part}"))
    return checked.withColumn("agents_match", (F.col("agent_rows") > 0) & F.coalesce(same, F.lit(False)))


def set_checks(sets: DataFrame, checks: DataFrame) -> DataFrame:
    """Per set: do the monthly All rows add up to the header, and has each month one All row?"""
    totals = checks.groupBy("set_id").agg(
        F.count(F.when(F.col("all_rows") != 1, 1)).alias("months_without_one_all"),
        *[F.sum(f"all_{p}").alias(p) for p in PARTS],
        F.when(F.count(F.when(F.col("all_cost").isNull(), 1)) == 0, F.sum("all_cost")).alias("rows_cost"))
    header = {p: F.col("total_tokens" if p == "total_tokens" else f"total_{p}") for p in PARTS}
    joined = sets.select("set_id", *[v.alias(f"_{k}") for k, v in header.items()],
                         F.col("reported_cost_usd").alias("header_cost")).join(totals, "set_id", "left")
    same = _costs_agree(F.col("header_cost"), F.col("rows_cost").cast("decimal(38,12)"))
    for p in PARTS:
        same = same & (F.col(p) == F.col(f"_{p}"))
    return joined.select(
        "set_id", F.coalesce("months_without_one_all", F.lit(0)).alias("months_without_one_all"),
        F.coalesce(same, F.lit(False)).alias("header_matches"))


def select_rows(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """Agent rows of months where they add up to All, else the All row."""
    verdict = checks.select("set_id", "month", "agents_match")
    return rows.join(verdict, ["set_id", "month"]).filter(
        F.col("agents_match") == (F.col("agent") != ALL_AGENT)).drop("agents_match")


def project(sets: DataFrame, rows: DataFrame, strict: bool = True) -> DataFrame:
    """Unified monthly rows of the additive sets.

    With `strict` a set that does not reconcile stops the job when it is read;
    otherwise such sets are left out and set_checks reports them.
    """
    chosen = additive_sets(sets)
    own = rows.join(chosen.select("set_id"), "set_id", "left_semi")
    checks = monthly_checks(own)
    verdicts = set_checks(chosen, checks)
    good = F.col("header_matches") & (F.col("months_without_one_all") == 0)
    if strict:
        stop = F.assert_true(good, F.concat(F.lit("recovered set does not reconcile: "), F.col("set_id")))
        verdicts = verdicts.filter(stop.isNull())
    else:
        verdicts = verdicts.filter(good)
    header = chosen.select("set_id", F.col("pricing_complete").alias("_priced")).join(verdicts.select("set_id"), "set_id")
    parts = [F.col(p) for p in PARTS[:-1]]
    residual = F.col("total_tokens") - parts[0] - parts[1] - parts[2] - parts[3]
    return select_rows(own, checks).join(header, "set_id").select(
        "month", F.lit(RECOVERED_MACHINE).alias("machine_id"), F.lit("recovered").alias("source_kind"), "agent",
        *PARTS, residual.alias("accounting_delta_tokens"), "reported_cost_usd",
        (F.col("_priced") & F.col("reported_cost_usd").isNotNull()).alias("pricing_complete"),
        "models", F.lit(False).alias("model_attribution_available"))


def seed_mismatches(seed: DataFrame, stored: DataFrame) -> DataFrame:
    """Seed rows that are absent from the stored table or differ in any field, null-safe."""
    keys = ["set_id", "month", "agent"]
    fields = [*PARTS, "reported_cost_usd", "models"]
    joined = seed.select(*keys, F.struct(*fields).alias("_seed")).join(
        stored.select(*keys, F.struct(*fields).alias("_stored")), keys, "left")
    return joined.filter(~F.col("_seed").eqNullSafe(F.col("_stored"))).select(
        *keys, F.col("_stored").isNull().alias("absent"))


def correct_header(sets: DataFrame, set_id: str, machine_count: int = 1) -> DataFrame:
    """The guarded correction: one named set becomes additive; all others stay as they are."""
    this = F.col("set_id") == set_id
    out = sets.withColumn("accounting_mode", F.when(this, F.lit("additive_recovered")).otherwise(F.col("accounting_mode")))
    if "source_machine_count" in sets.columns:
        out = out.withColumn("source_machine_count", F.when(this, F.lit(machine_count)).otherwise(F.col("source_machine_count")))
    if "suspected_mirror" in sets.columns:
        out = out.withColumn("suspected_mirror", F.when(this, F.lit(False)).otherwise(F.col("suspected_mirror")))
    return out
