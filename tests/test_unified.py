"""Recovered evidence and unified totals with the golden values."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.config import RECOVERED_MACHINE
from ledgerline.operators import recovery, rollups
from ledgerline.operators.rollups import Filters

D = dt.date
# Month, agent, input, output, cache read, total, cost. Cache creation is 0.
ROWS = [
    (5, "All", 9172233, 760817, 104578084, 114511134, "120.94"), (5, "Alpha", 9162254, 760220, 104572672, 114495146, "120.90"),
    (5, "Beta", 9979, 597, 5412, 15988, "0.04"),
    (6, "All", 66366953, 6913485, 1324959636, 1398240074, "515.05"), (6, "Alpha", 53210093, 5142031, 837061376, 895413500, "496.05"),
    (6, "Gamma", 13156860, 1771454, 487898260, 502826574, "19.00"),
    (7, "All", 104026745, 9579406, 2360740627, 2474346778, "329.02"), (7, "Alpha", 49931343, 3776798, 1069986560, 1123694701, "281.84"),
    (7, "Gamma", 54093230, 5802563, 1290754067, 1350649860, "47.18"), (7, "delta", 2172, 45, 0, 2217, "0.00"),
    (8, "All", 123631901, 14944563, 5540616452, 5679192916, "421.18"), (8, "Alpha", 96385495, 10984851, 3978407168, 4085777514, "410.64"),
    (8, "Gamma", 27246406, 3959712, 1562209284, 1593415402, "10.54"),
]
HEADER = ("s", "additive_recovered", False, 303197832, 32198271, 0, 9330894799, 9666290902, Decimal("1386.19"))


def recovered(spark, rows=ROWS):
    return spark.createDataFrame([("s", D(2026, m, 1), a, i, o, 0, r, t, c and Decimal(c), ["m"]) for m, a, i, o, r, t, c in rows], schemas.RECOVERED)


def header(spark, *changes):
    row = list(HEADER)
    for position, value in changes:
        row[position] = value
    return spark.createDataFrame([tuple(row)], schemas.RECOVERED_SETS)


def daily(spark, rows):
    """rows: (machine, agent, date, input, output, creation, read, cost, duplicate)."""
    out = []
    for m, a, d, i, o, c, r, cost, dup in rows:
        out.append((m, a, d, i, o, r, c, i + o + r + c, 0, None if cost is None else Decimal(str(cost)), False, dup))
    return spark.createDataFrame(out, "machine_id string, agent string, usage_date date, input_tokens bigint, output_tokens bigint, "
                                      "cache_read_tokens bigint, cache_creation_tokens bigint, reported_total_tokens bigint, accounting_delta_tokens bigint, "
                                      "reported_cost_usd decimal(38,12), is_tombstone boolean, global_duplicate boolean")


CANON = [("vm", "Alpha", D(2026, 5, 1), 100, 200, 300, 8204456586, 20, False), ("vm2", "Alpha", D(2026, 5, 1), 100, 200, 300, 8204456586, 20, True)]


def with_model(frame, model):
    return frame.withColumn("model", F.lit(model))


@pytest.fixture(scope="module")
def projection(spark):
    rows = daily(spark, CANON)
    return rollups.build_projection(rows, with_model(rows, "m1"), recovery.project(header(spark), recovered(spark)))


def test_agents_add_up_and_the_set_reconciles(spark):
    checks = recovery.monthly_checks(recovered(spark))
    assert [r.agents_match for r in checks.collect()] == [True] * 4
    verdict = recovery.set_checks(header(spark), checks).collect()[0]
    assert verdict.header_matches and verdict.months_without_one_all == 0


def test_unified_golden_totals(projection):
    row = rollups.select_usage(projection, Filters()).totals.collect()[0]
    assert row.total_tokens == 17870748088 and row.reported_cost_usd == Decimal("1406.19")
    assert row.row_count == 10 and row.pricing_complete is False
    by_month = rollups.by_period(projection.monthly, "month").collect()
    assert [r.total_tokens for r in by_month] == [8318968320, 1398240074, 2474346778, 5679192916]


def test_recovered_rows_get_no_model(projection):
    kinds = {r.kind: r.n for r in projection.models.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"canonical-attributed": 1, "recovered-unattributed": 9}
    assert [r.model for r in rollups.available_models(rollups.canonical_models(projection.models.sparkSession.createDataFrame(
        [], "machine_id string, agent string, model string, usage_date date, input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, "
            "cache_read_tokens bigint, reported_total_tokens bigint, accounting_delta_tokens bigint, reported_cost_usd decimal(38,12), is_tombstone boolean"))).collect()] == []


@pytest.mark.parametrize("filters, status, reason", [
    (Filters(grain="day"), "unsupported", "recovered-month-only"), (Filters(range="7d"), "unsupported", "recovered-all-time-only"),
    (Filters(), "ready", None), (Filters("vm", grain="week", range="30d"), "ready", None), (Filters(model="m1", grain="day"), "ready", None)])
def test_capability_guard(projection, filters, status, reason):
    chosen = rollups.select_usage(projection, filters)
    row = chosen.status.collect()[0]
    assert (row.status, row.reason) == (status, reason)
    assert row.model_attribution_excluded is (filters.model != "all")
    if status == "unsupported":
        assert chosen.daily.count() == chosen.monthly.count() == chosen.models.count() == 0
        assert chosen.totals.collect()[0].row_count == 0


def test_incomplete_agents_fall_back_to_all(spark):
    rows = [r for r in ROWS if r[:2] != (6, "Gamma")]
    got = recovery.project(header(spark), recovered(spark, rows))
    assert {r.agent for r in got.filter("month = date'2026-06-01'").collect()} == {"All"}
    assert got.agg(F.sum("total_tokens")).collect()[0][0] == HEADER[7]


def test_unknown_cost_poisons_the_month(spark):
    rows = [(*r[:6], None) if r[:2] == (6, "Gamma") else r for r in ROWS]
    checks = {r.month: r.agents_match for r in recovery.monthly_checks(recovered(spark, rows)).collect()}
    assert checks[D(2026, 6, 1)] is False and checks[D(2026, 7, 1)] is True


def test_set_that_does_not_reconcile_stops(spark):
    wrong = header(spark, (7, HEADER[7] + 1))
    with pytest.raises(Exception, match="does not reconcile"):
        recovery.project(wrong, recovered(spark)).collect()
    assert recovery.project(wrong, recovered(spark), strict=False).count() == 0
    evidence_only = header(spark, (1, "evidence_only_non_additive"))
    assert recovery.project(evidence_only, recovered(spark)).count() == 0


def test_residual_sixty_and_unknown_cost(spark):
    rows = daily(spark, [("m", "a", D(2026, 8, 1), 100, 0, 0, 0, 1.5, False), ("m", "a", D(2026, 8, 2), 10, 0, 0, 0, 1, False),
                         ("m", "b", D(2026, 8, 1), 5, 0, 0, 0, 2, False)])
    models = with_model(daily(spark, [("m", "a", D(2026, 8, 1), 40, 0, 0, 0, 1.25, False), ("m", "b", D(2026, 8, 1), 7, 0, 0, 0, None, False),
                                      ("m", "a", D(2026, 8, 2), 10, 0, 0, 0, 1, False)]), "x")
    got = {(r.agent, r.usage_date.day): r for r in rollups.unattributed(rollups.canonical_daily(rows), rollups.canonical_models(models)).collect()}
    assert set(got) == {("a", 1), ("b", 1)}
    assert got["a", 1].total_tokens == 60 and got["a", 1].reported_cost_usd == Decimal("0.25")
    assert got["b", 1].total_tokens == -2 and got["b", 1].reported_cost_usd is None and not got["b", 1].pricing_complete


def test_models_plus_residual_is_daily(spark):
    rows = daily(spark, [("m", "a", D(2026, 8, d), 10 * d, d, 0, 3, d, False) for d in range(1, 20)])
    models = with_model(daily(spark, [("m", "a", D(2026, 8, d), 4 * d, d, 0, 1, d, False) for d in range(1, 20, 2)]), "x")
    p = rollups.build_projection(rows, models)
    assert p.models.agg(F.sum("total_tokens")).collect() == p.daily.agg(F.sum("total_tokens")).collect()


def test_range_is_anchored_at_the_newest_day_in_scope(spark):
    rows = daily(spark, [("m", "a", D(2026, 8, d), d, 0, 0, 0, 1, False) for d in range(1, 21)] + [("n", "a", D(2026, 8, 30), 1, 0, 0, 0, 1, False)])
    p = rollups.build_projection(rows, with_model(rows, "x"))
    got = rollups.select_usage(p, Filters("m", range="7d", grain="day")).daily.agg(F.min("usage_date"), F.count("*")).collect()[0]
    assert tuple(got) == (D(2026, 8, 14), 7)


def test_filter_reaches_the_rows_below_the_rollup(spark, tmp_path):
    rows = daily(spark, [("m", "a", D(2026, 8, d), d, 0, 0, 0, 1, False) for d in range(1, 21)])
    rows.write.parquet(str(tmp_path / "daily"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    stored = spark.read.parquet(str(tmp_path / "daily"))
    p = rollups.build_projection(stored, with_model(stored, "x"))
    plan = rollups.select_usage(p, Filters("m", grain="day")).daily._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(machine_id,m)" in plan


def test_weeks_begin_on_monday_and_peak_takes_the_earliest(spark):
    rows = rollups.canonical_daily(daily(spark, [("m", "a", D(2026, 8, d), 5, 0, 0, 0, 1, False) for d in (30, 31)] + [("m", "a", D(2026, 9, 1), 0, 0, 0, 0, 1, False)]))
    assert {r.week: r.total_tokens for r in rollups.weeks(rows).collect()} == {D(2026, 8, 24): 5, D(2026, 8, 31): 5}
    row = rollups.day_statistics(rows).collect()[0]
    assert (row.detailed_days, row.average_detailed_day, row.peak_date) == (2, 5.0, D(2026, 8, 30))


def test_machine_names(spark):
    machines = spark.createDataFrame([("m", "Desk")], "machine_id string, name string")
    rows = spark.createDataFrame([("m",), (RECOVERED_MACHINE,), ("x",)], "machine_id string")
    assert {r.machine_id: r.machine_name for r in rollups.with_machine_name(rows, machines).collect()} == {
        "m": "Desk", RECOVERED_MACHINE: "Recovered machine", "x": "x"}


def test_model_summary_keeps_known_models(spark):
    """Recovered rows of one month add up and list every model they name once; other kinds list none."""
    values = ", ".join(f"{c} long" for c in rollups.TOKENS[:5])
    rows = spark.createDataFrame(
        [(rollups.RECOVERED, None, "m1", "all", dt.date(2026, 1, 1), None, *[1] * 5, None, ["b", "a"]),
         (rollups.RECOVERED, None, "m2", "all", dt.date(2026, 1, 1), None, *[2] * 5, None, ["a", "c"]),
         (rollups.ATTRIBUTED, "a", "m1", "x", None, dt.date(2026, 1, 2), *[3] * 5, None, None)],
        f"kind string, model string, machine_id string, agent string, month date, usage_date date, {values}, reported_cost_usd decimal(20,12), known_models array<string>")
    found = {r.key: (r.total_tokens, r.known_models) for r in rollups.model_summary(rows).collect()}
    assert found == {"recovered:all:2026-01": (3, ["a", "b", "c"]), "canonical:a": (3, [])}
    bare = rollups.model_summary(rows.drop("known_models")).collect()
    assert all(r.known_models == [] for r in bare)
