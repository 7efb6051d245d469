"""Schedules, ceilings, statuses, corrections and workbook grids."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.functions import dates, numbers
from ledgerline.operators import pacing, workbook

ZONE = "Africa/Casablanca"
T, D = dt.datetime, dt.date
CONTRACT = "contract_id string, account string, created_at timestamp, status string, tracking_start timestamp, reset_at timestamp, check_time string, baseline double, hard_limit double, safety_reserve double"
# 30 Aug 22:29 to 29 Sep 11:29 wall time, at +01:00
START, RESET = T(2026, 8, 30, 21, 29), T(2026, 9, 29, 10, 29)
NOW = T(2026, 9, 5, 13, 29)


def contract(spark, start=START, reset=RESET, check="12:00", baseline=0.048, limit=1.0, reserve=0.0):
    return spark.createDataFrame([("c", "u", T(2026, 8, 31), "processed", start, reset, check, baseline, limit, reserve)], CONTRACT)


def scheduled(spark, **kw):
    return pacing.with_schedule(contract(spark, **kw), ZONE)


def at(value):
    return F.lit(value).cast("timestamp")


def points(frame):
    return pacing.checkpoints(frame).orderBy("day").collect()


def test_monthly_cycle_has_29_checkpoints(spark):
    rows = points(scheduled(spark))
    assert [r.day for r in rows] == list(range(1, 30))
    assert (rows[0].date, rows[-1].date) == (D(2026, 8, 31), D(2026, 9, 28))
    assert rows[0].ts == T(2026, 8, 31, 11, 0)


def test_partial_days_are_strict(spark):
    assert points(scheduled(spark, start=T(2026, 8, 30, 11, 0)))[0].date == D(2026, 8, 31)
    assert points(scheduled(spark, start=T(2026, 8, 30, 10, 59)))[0].date == D(2026, 8, 30)
    assert points(scheduled(spark, reset=T(2026, 9, 29, 11, 0)))[-1].date == D(2026, 9, 28)
    assert points(scheduled(spark, reset=T(2026, 9, 29, 11, 1)))[-1].date == D(2026, 9, 29)


def test_ceiling_goldens(spark):
    fifth = [r for r in points(scheduled(spark)) if r.date == D(2026, 9, 5)][0]
    assert fifth.ceiling == pytest.approx(0.2272776681, abs=1e-10)
    later = [r for r in points(scheduled(spark, reset=T(2026, 9, 29, 11, 29))) if r.date == D(2026, 9, 5)][0]
    assert later.ceiling == pytest.approx(0.2270251643, abs=1e-10)


def test_ceiling_is_clamped(spark):
    row = spark.range(1).select(
        pacing.ceiling_at(at("2026-01-01"), at("2026-02-01"), at("2026-03-01"), F.lit(0.1), F.lit(0.9)),
        pacing.ceiling_at(at("2026-04-01"), at("2026-02-01"), at("2026-03-01"), F.lit(0.1), F.lit(0.9))).collect()[0]
    assert tuple(row) == (0.1, 0.9)


def status(spark, actuals, now=NOW):
    recorded = spark.createDataFrame([("c", D(2026, 9, d), a) for d, a in actuals], "contract_id string, date date, actual double")
    return pacing.tracker_status(pacing.with_actuals(scheduled(spark), recorded), F.lit(now)).collect()[0]


@pytest.mark.parametrize("actuals, expected, headroom", [
    ([], "UPDATE_DUE", None), ([(3, 0.15), (4, 0.18)], "UPDATE_DUE", None), ([(5, 0.182)], "ON_TRACK", 0.0453),
    ([(5, 0.217)], "NEAR_LIMIT", 0.0103), ([(5, 0.274)], "OVER_PACE", -0.0467), ([(4, 1.0)], "LIMIT_EXCEEDED", None),
    ([(5, 0.0)], "ON_TRACK", 0.2273)])
def test_status_table(spark, actuals, expected, headroom):
    row = status(spark, actuals)
    assert row.status == expected
    assert row.headroom == (None if headroom is None else pytest.approx(headroom, abs=1e-4))
    assert row.latest.value == (actuals[-1][1] if actuals else 0.048)
    assert row.latest.source == ("checkpoint" if actuals else "baseline")


def test_status_at_the_ends(spark):
    assert status(spark, [], RESET).status == "RESET_REQUIRED"
    row = status(spark, [], T(2026, 8, 31, 7, 0))
    assert (row.status, row.pre_first_checkpoint, row.headroom) == ("ON_TRACK", True, None)


@pytest.mark.parametrize("plan, message", [((-0.1, 1.0, 0.0), "baseline is negative"), ((0.0, 0.0, 0.0), "hard limit is not positive"),
                                           ((0.0, 1.0, 1.0), "safety reserve reaches the hard limit"), ((0.95, 1.0, 0.1), "baseline exceeds the planned ceiling"),
                                           ((float("nan"), 1.0, 0.0), "baseline is not a finite number"), ((0.1, 1.0, 0.1), None)])
def test_plan_violations(spark, plan, message):
    assert spark.range(1).select(pacing.plan_violation(*[F.lit(x) for x in plan])).collect()[0][0] == message


ACTUALS = "array<struct<date: string, actual: double>>"


@pytest.mark.parametrize("before, after, code", [
    ([("a", 0.1), ("b", None)], [("a", 0.1), ("b", 0.2)], None), ([("a", 0.1), ("b", 0.3)], [("a", 0.1), ("b", 0.2)], None),
    ([("a", 0.1), ("b", None)], [("a", None), ("b", 0.2)], "null_regression"), ([("a", 0.1), ("b", None)], [("a", 0.3), ("b", 0.2)], "monotonic"),
    ([("a", 0.1)], [("a", 0.1), ("b", 0.2)], "plan_drift"), ([("a", 0.1)], [("b", 0.1)], "plan_drift"),
    ([("a", 0.1), ("b", None), ("c", None)], [("a", 0.2), ("b", None), ("c", 0.1)], "monotonic")])
def test_corrections(spark, before, after, code):
    frame = spark.createDataFrame([(before, after)], f"p {ACTUALS}, n {ACTUALS}")
    assert frame.select(pacing.correction_violation(F.col("p"), F.col("n"))).collect()[0][0] == code


def test_active_contract_is_the_newest_cycle_even_when_an_old_one_is_uploaded_late(spark):
    rows = [("old", "u", T(2026, 9, 9), "processed", T(2026, 7, 30)), ("new", "u", T(2026, 9, 1), "processed", T(2026, 8, 30)),
            ("newer", "u", T(2026, 9, 2), "processed", T(2026, 8, 30)), ("bad", "u", T(2026, 9, 8), "failed", T(2026, 9, 30))]
    frame = spark.createDataFrame(rows, "contract_id string, account string, created_at timestamp, status string, tracking_start timestamp")
    assert [r.contract_id for r in pacing.active_contracts(frame).collect()] == ["newer"]


def test_formula_details_are_bounded_and_counted(spark):
    frame = scheduled(spark, reset=T(2026, 12, 29, 10, 29)).withColumns({
        "sheet_planned_ceiling": F.lit(0.5), "sheet_ceilings": F.transform("checkpoints", lambda c: F.struct(c["day"].alias("day"), (c["ceiling"] + 1).alias("value")))})
    row = pacing.reconcile_formulas(frame).collect()[0]
    assert row.formula_mismatch_count == len(row.checkpoints) + 1 > 51
    assert len(row.formula_warnings) == 50 and row.formula_warnings[0].field == "plannedCeiling" and row.formula_warnings[1].day == 1


def test_clock_gap_is_refused(spark):
    row = spark.range(1).select(
        dates.wall_to_instant(F.lit("2026-03-08").cast("date"), F.lit("02:30"), "America/New_York"),
        dates.wall_to_instant(F.lit("2026-03-08").cast("date"), F.lit("03:30"), "America/New_York")).collect()[0]
    assert tuple(row) == (None, T(2026, 3, 8, 7, 30))


@pytest.mark.parametrize("cell, expected", [("46264.9368055556", T(2026, 8, 30, 21, 29)), ("2026-08-30 22:29", T(2026, 8, 30, 21, 29)),
                                            ("2026-08-30T22:29:00", T(2026, 8, 30, 21, 29)), ("2026-08-30", T(2026, 8, 30, 11, 0)),
                                            ("2019-12-31", None), ("2020-01-01", T(2020, 1, 1, 11, 0)), ("2035-01-01", T(2035, 1, 1, 11, 0)), ("2035-01-02", None), ("soon", None)])
def test_date_cells(spark, cell, expected):
    assert spark.range(1).select(dates.date_cell(F.lit(cell), F.lit("12:00"), ZONE)).collect()[0][0] == expected


def test_value_cells(spark):
    row = spark.range(1).select(numbers.fraction_cell(F.lit(" 4.8 % ")), numbers.fraction_cell(F.lit("x")), numbers.actual_cell(F.lit("0")),
                                numbers.actual_cell(F.lit(" ")), numbers.actual_cell(F.lit("-1")), dates.clock_cell(F.lit("9:05")),
                                dates.clock_cell(F.lit("0.4375")), dates.clock_cell(F.lit("24:00"))).collect()[0]
    assert row[0] == pytest.approx(0.048) and row[1] is None
    assert (row[2].value, row[2].valid, row[3].value, row[3].valid, row[4].valid) == (0.0, True, None, True, False)
    assert tuple(row[5:]) == ("09:05", "10:30", None)


def test_grid_lookup(spark):
    cells = [("w", 0, 0, "Title"), ("w", 1, 1, " Tracking starts "), ("w", 1, 4, "2026-08-30 22:29"), ("w", 1, 5, "later"), ("w", 9, 1, "Tracking starts"), ("w", 9, 2, "no"),
             ("w", 2, 1, "Safety reserve"), *[("w", 12, i, h) for i, h in enumerate(workbook.HEADERS)], ("w", 13, 0, "1"), ("w", 13, 1, "2026-08-31"),
             ("w", 14, 0, " "), ("w", 14, 1, "x"), ("w", 15, 0, "2")]
    frame = spark.createDataFrame(cells, schemas.CELLS)
    values = {r.label: r.value for r in workbook.label_values(frame, workbook.SOURCE_LABELS).collect()}
    assert values == {"Tracking starts": "2026-08-30 22:29", "Safety reserve": None}
    table = workbook.table_rows(frame, workbook.header_columns(frame)).collect()
    assert [(r.day_cell, r.date_cell, r.actual_cell) for r in table] == [("1", "2026-08-31", None)]
