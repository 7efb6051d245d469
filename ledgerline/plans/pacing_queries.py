"""Queries of quota contracts: schedules, ceilings, statuses, workbook grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import dates, numbers
from ledgerline.operators import imports, pacing, workbook
from ledgerline.plans import views as v
from ledgerline.plans.registry import day, moment, query
from ledgerline.session import materialized

ZONE = v.ZONE


def _now():
    return F.lit(v.NOW).cast("timestamp")


@v.once_per_session
def _scheduled(spark, d):
    return pacing.with_schedule(pacing.with_plan(v.contracts(spark, d)), ZONE)


@v.once_per_session
def _filled(spark, d):
    return pacing.with_actuals(_scheduled(spark, d), v.actuals(spark, d))


@query("w01_plan", ("contracts",), """
  SELECT contract_id, round(hard_limit - safety_reserve, 6) AS planned_ceiling, round(hard_limit - safety_reserve - baseline, 6) AS starting_budget,
    NULL AS plan_violation FROM contracts""")
def plan(spark, d):
    return pacing.with_plan(v.contracts(spark, d)).select("contract_id", "planned_ceiling", "starting_budget", "plan_violation")


@query("w01_plan_violations", ("contracts",), """
  SELECT contract_id, CASE WHEN baseline - 0.05 < 0 THEN 'baseline is negative' WHEN safety_reserve >= 0.1 THEN 'safety reserve reaches the hard limit'
    WHEN baseline - 0.05 > 0.1 - safety_reserve THEN 'baseline exceeds the planned ceiling' END AS plan_violation FROM contracts""")
def plan_violations(spark, d):
    return v.contracts(spark, d).select("contract_id", pacing.plan_violation(
        F.col("baseline") - 0.05, F.lit(0.1), F.col("safety_reserve")).alias("plan_violation"))


@query("w02_day_list", ("contracts",), """
  SELECT contract_id, unnest(generate_series(tracking_start::DATE, reset_at::DATE, INTERVAL 1 DAY))::DATE::VARCHAR AS date FROM contracts""")
def day_list(spark, d):
    return v.contracts(spark, d).select("contract_id", F.explode(dates.day_sequence(
        F.col("tracking_start").cast("date"), F.col("reset_at").cast("date"))).alias("date"))


_WALL_SQL = """SELECT event_id, wall, wall >= TIMESTAMP '2023-11-05 01:00:00' AND wall < TIMESTAMP '2023-11-05 02:00:00' AS twice FROM (
    SELECT event_id, (ts::DATE - 90)::TIMESTAMP + to_minutes(event_id % 1440) AS wall FROM events)"""


@query("w03_wall_clock", sql=f"""
  SELECT event_id, strftime(CASE WHEN twice THEN wall + INTERVAL 4 HOUR ELSE timezone('UTC', timezone('America/New_York', wall)) END, '%Y-%m-%d %H:%M:%S') AS instant,
    strftime(CASE WHEN twice THEN wall + INTERVAL 5 HOUR ELSE timezone('UTC', timezone('America/New_York', wall)) END, '%Y-%m-%d %H:%M:%S') AS later FROM ({_WALL_SQL})""")
def wall_clock(spark, d):
    """Wall times around a clock change, with both instants of the repeated hour."""
    minute = F.col("event_id") % 1440
    e = v.table(spark, d, "events").select(
        "event_id", F.date_sub(F.col("ts").cast("date"), 90).alias("day"),
        dates.hours_minutes(F.floor(minute / 60).cast("int"), (minute % 60).cast("int")).alias("time"))
    instant = lambda later: dates.wall_to_instant(F.col("day"), F.col("time"), "America/New_York", later)
    return e.select("event_id", instant(False).alias("instant"), instant(True).alias("later"))


@query("w04_w05_checkpoints", ("checkpoints",), f"SELECT contract_id, day, {day('date')}, {moment('ts')}, round(ceiling, 6) AS ceiling FROM checkpoints")
def checkpoints(spark, d):
    return pacing.checkpoints(_scheduled(spark, d)).select("contract_id", "day", "date", "ts", "ceiling")


@query("w06_latest_actual", ("tracker",), """
  SELECT contract_id, round(latest, 6) AS value, source, CASE WHEN source = 'checkpoint' THEN latest_date::VARCHAR END AS date FROM tracker""")
def latest_actual(spark, d):
    return pacing.latest_actual(_filled(spark, d)).select("contract_id", "latest.value", "latest.source", "latest.date")


_STATUS = """CASE WHEN latest >= hard_limit THEN 'LIMIT_EXCEEDED' WHEN required_ts IS NULL THEN 'ON_TRACK' WHEN required_actual < 0 THEN 'UPDATE_DUE'
      WHEN required_actual > required_ceiling THEN 'OVER_PACE' WHEN required_ceiling - required_actual BETWEEN 0 AND 0.02 THEN 'NEAR_LIMIT' ELSE 'ON_TRACK' END"""


@query("w07_w09_tracker_status", ("tracker",), f"""
  SELECT contract_id, status, required_date::VARCHAR AS required_date,
    CASE WHEN status NOT IN ('LIMIT_EXCEEDED', 'UPDATE_DUE') THEN round(required_ceiling - required_actual, 6) END AS headroom,
    round(greatest(0, planned_ceiling - latest), 6) AS remaining_budget FROM (SELECT *, {_STATUS} AS status FROM tracker)""")
def tracker_status(spark, d):
    return pacing.tracker_status(_filled(spark, d), _now()).select(
        "contract_id", "status", F.col("required.date").alias("required_date"), "headroom", "remaining_budget")


@query("w10_formula_reconciliation", ("checkpoints",), """
  SELECT contract_id, (count(*) FILTER (day % 4 = 0) + max((user_id % 2)))::BIGINT AS formula_mismatch_count,
    least(50, count(*) FILTER (day % 4 = 0) + max(user_id % 2))::BIGINT AS details FROM checkpoints GROUP BY 1""")
def formula_reconciliation(spark, d):
    """Sheet ceilings equal to the computed ones, but for every fourth day and every second plan."""
    base = _scheduled(spark, d).withColumns({
        "sheet_planned_ceiling": F.col("planned_ceiling") + F.when(F.substring("account", 2, 20).cast("bigint") % 2 == 1, 0.01).otherwise(0.0),
        "sheet_ceilings": F.transform("checkpoints", lambda c: F.struct(
            c["day"].alias("day"), (c["ceiling"] + F.when(c["day"] % 4 == 0, 0.001).otherwise(0.0000001)).alias("value")))})
    return pacing.reconcile_formulas(base).select("contract_id", "formula_mismatch_count", F.size("formula_warnings").alias("details"))


@query("w11_schedule_violations", ("contracts", "checkpoints"), """
  SELECT c.contract_id, CASE c.user_id % 6 WHEN 1 THEN 'day numbers are not contiguous' WHEN 2 THEN 'checkpoints do not increase'
    WHEN 3 THEN 'inconsistent check time' WHEN 4 THEN 'unexpected number of checkpoints' WHEN 5 THEN 'checkpoint does not match the schedule' END AS violation
  FROM contracts c""")
def schedule_violations(spark, d):
    """Supplied schedules damaged in one of five ways, by account."""
    base = _scheduled(spark, d).withColumn("_k", F.substring("account", 2, 20).cast("bigint") % 6)
    k = F.col("_k")
    def supplied(c, i):
        shift = F.when((k == 2) & (i == 3), -3 * 86400).when((k == 5) & (i == 3), 60).otherwise(0)
        return F.struct(
            F.when((k == 1) & (i == 3), 99).otherwise(c["day"]).alias("day"), c["date"].alias("date"),
            F.timestamp_seconds(F.unix_seconds(c["ts"]) + shift - F.when((k == 2) & (i == 3), 60).otherwise(0)).alias("ts"),
            F.when((k == 3) & (i == 3), "12:30").otherwise(c["check_time"]).alias("check_time"))
    rows = base.withColumn("supplied", F.transform("checkpoints", supplied)).withColumn(
        "supplied", F.when(k == 4, F.slice("supplied", 1, 20)).otherwise(F.col("supplied")))
    return rows.select("contract_id", pacing.schedule_violation(F.col("supplied"), F.col("checkpoints"), F.col("check_time")).alias("violation"))


@query("w12_first_decrease", ("filled",), """
  SELECT contract_id, min(date) FILTER (actual < before)::VARCHAR AS first_decrease FROM (
    SELECT contract_id, date, actual, last_value(actual IGNORE NULLS) OVER (PARTITION BY contract_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM filled) GROUP BY 1""")
def first_decrease(spark, d):
    points = F.transform("checkpoints", lambda c: F.struct(c["date"].alias("date"), c["actual"].alias("actual")))
    return _filled(spark, d).select("contract_id", pacing.first_decrease(points).alias("first_decrease"))


@v.once_per_session
def _sequence(spark, d):
    """Import n of a contract carries actuals 0.01 * day up to day 10 + 5n; some imports blank or lower one."""
    base = pacing.with_schedule(pacing.with_plan(v.contract_imports(spark, d)), ZONE)
    n, user = F.col("import_no"), F.col("user_id")
    def actual(c):
        value = F.when(c["day"] <= 10 + n * 5, c["day"] * 0.01)
        value = F.when((n == 3) & (user % 7 == 0) & (c["day"] == 4), F.lit(None)).otherwise(value)
        return F.when((n == 1) & (user % 3 == 0) & (c["day"] == 5), 0.001).otherwise(value)
    return base.withColumn("checkpoints", F.transform("checkpoints", lambda c: c.withField("actual", actual(c))))


@query("w13_w14_same_cycle", ("contract_imports",), """
  SELECT contract_id, import_no <= 1 AS is_first_of_cycle,
    CASE WHEN import_no <= 1 THEN NULL
      WHEN user_id % 5 = 0 THEN 'plan_drift'
      WHEN import_no = 3 AND user_id % 7 = 0 THEN 'null_regression' END AS violation
  FROM contract_imports WHERE status = 'processed'""")
def same_cycle(spark, d):
    """The first import of a cycle has nothing before it, so its own decrease is another check's matter."""
    return pacing.check_same_cycle(_sequence(spark, d)).select("contract_id", "is_first_of_cycle", "violation")


@query("w15_active_contracts", ("contract_imports",), """
  SELECT account, contract_id FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY tracking_start DESC, created_at DESC) AS rn
    FROM contract_imports WHERE status = 'processed') WHERE rn = 1""")
def active_contracts(spark, d):
    return pacing.active_contracts(v.contract_imports(spark, d)).select("account", "contract_id")


@query("w16_latest_per_cycle", ("contract_imports",), f"""
  SELECT account, {moment('tracking_start')}, contract_id FROM (
    SELECT *, row_number() OVER (PARTITION BY account, tracking_start, reset_at ORDER BY created_at DESC) AS rn FROM contract_imports WHERE status = 'processed') WHERE rn = 1""")
def latest_per_cycle(spark, d):
    return pacing.latest_accepted_per_cycle(v.contract_imports(spark, d)).select("account", "tracking_start", "contract_id")


@query("w16_import_history", ("contract_imports",), f"""
  SELECT contract_id, status, {moment('created_at')} FROM (SELECT * FROM contract_imports ORDER BY created_at DESC, contract_id DESC LIMIT 50)""")
def import_history(spark, d):
    return pacing.import_history(v.contract_imports(spark, d)).select("contract_id", "status", "created_at")


@query("w17_cells", sql="""
  SELECT event_id, value / 100 AS fraction, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 0.0 END AS actual, event_id % 3 <> 2 AS actual_valid,
    lpad(((event_id % 24))::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') AS clock,
    lpad(((event_id % 1440) // 60)::VARCHAR, 2, '0') || ':' || lpad(((event_id % 1440) % 60)::VARCHAR, 2, '0') AS clock_of_fraction FROM events""")
def cells(spark, d):
    e, n = v.table(spark, d, "events"), F.col("event_id")
    actual = numbers.actual_cell(F.when(n % 3 == 0, F.lit(" ")).when(n % 3 == 1, F.lit("0")).otherwise(F.lit("-4%")))
    return e.select(
        "event_id", numbers.fraction_cell(F.concat(F.col("value").cast("string"), F.lit(" %"))).alias("fraction"),
        actual["value"].alias("actual"), actual["valid"].alias("actual_valid"),
        dates.clock_cell(F.concat((n % 24).cast("string"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(":59"))).alias("clock"),
        dates.clock_cell(((n % 1440) / 1440).cast("string")).alias("clock_of_fraction"))


@query("w18_serial_dates", sql="""
  SELECT event_id, strftime(timezone('UTC', timezone('Africa/Casablanca', DATE '2024-01-01' + to_minutes(event_id % 40000))), '%Y-%m-%d %H:%M:%S') AS instant,
    NULL::VARCHAR AS too_late FROM events""")
def serial_dates(spark, d):
    """Spreadsheet serial numbers of January 2024; day 45292 is the first."""
    serial = F.lit(45292.0) + (F.col("event_id") % 40000) / 1440
    return v.table(spark, d, "events").select(
        "event_id", dates.date_cell(serial.cast("string"), F.lit("12:00"), ZONE).alias("instant"),
        dates.date_cell((serial + 10000).cast("string"), F.lit("12:00"), ZONE).alias("too_late"))


def _grid(spark, d):
    """The grid is looked up for labels, headers and rows, so it is built once and written."""
    cells = materialized(v.cells(spark, d), "cells")
    values = workbook.label_values(cells, workbook.SOURCE_LABELS + workbook.DERIVED_LABELS)
    return cells, values, workbook.read_plans(values, ZONE)


@query("w19_label_values", ("contracts",), f"""
  SELECT contract_id AS workbook_id, '12:00' AS check_time, round(baseline, 6) AS baseline, {moment('tracking_start')}, {moment('reset_at')},
    round(hard_limit, 6) AS hard_limit, round(safety_reserve, 6) AS safety_reserve FROM contracts""")
def label_values(spark, d):
    return _grid(spark, d)[2].drop("sheet_planned_ceiling")


@query("w19_missing_labels", ("contracts",), "SELECT contract_id AS workbook_id, 'Safety reserve' AS missing_labels, 'Tracking starts' AS labels_without_value FROM contracts")
def missing_labels(spark, d):
    cells = materialized(v.cells(spark, d), "cells").filter("not (row = 8 and col = 1) and not (row = 3 and col = 3)")
    return workbook.missing_labels(cells, workbook.label_values(cells, workbook.SOURCE_LABELS + workbook.DERIVED_LABELS))


@query("w19_table_rows", ("filled",), f"""
  SELECT contract_id AS workbook_id, day, {day('date')}, check_time, {moment('ts')}, round(ceiling, 6) AS sheet_ceiling, round(actual, 6) AS actual FROM filled""")
def table_rows(spark, d):
    cells, _, plans = _grid(spark, d)
    table = workbook.table_rows(cells, workbook.header_columns(cells))
    return workbook.read_checkpoints(table, plans, ZONE).drop("row", "actual_malformed")


@query("w11_w19_assembled_workbooks", ("contracts", "checkpoints"), """
  SELECT c.contract_id AS workbook_id, count(k.day) AS checkpoints, NULL AS violation FROM contracts c JOIN checkpoints k USING (contract_id) GROUP BY 1""")
def assembled_workbooks(spark, d):
    """Grid to plan, table and schedule check in one pass."""
    cells, _, plans = _grid(spark, d)
    rows = workbook.read_checkpoints(workbook.table_rows(cells, workbook.header_columns(cells)), plans, ZONE)
    full = pacing.with_schedule(workbook.assemble(plans, rows), ZONE)
    return full.select("workbook_id", F.size("supplied").alias("checkpoints"), pacing.schedule_violation(
        F.col("supplied"), F.col("checkpoints"), F.col("check_time")).alias("violation"))


_TITLE = "Monthly Usage Tracker"
_VERDICTS = ("title", "missing_label", "invalid_plan", "invalid_datetime", "missing_headers", "schedule", "duplicate", "non_increasing", "invalid_actual", "monotonic", "schedule")


def _damaged_cells(spark, d):
    """The workbooks' cells with a title; the account's number modulo 12 says what each workbook lacks or has wrong."""
    k = F.regexp_replace("workbook_id", "c", "").cast("bigint") % 12
    cells = v.cells(spark, d)
    titles = cells.select("workbook_id").distinct().select("workbook_id", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(f" {_TITLE} ").alias("value"))
    at = lambda kind, row, col: (F.col("k") == kind) & (F.col("row") == row) & (F.col("col") == col)
    all_ = cells.unionByName(titles).withColumn("k", k).filter(
        ~(at(1, 0, 0) | at(2, 8, 1) | at(5, 20, 6) | ((F.col("k") == 6) & (F.col("row") > 20)) | (F.col("k").isin(9, 10) & F.col("row").isin(21, 22) & (F.col("col") == 4))
          # Recorded days fall now and then: only a sheet with one of them is accepted.
          | ((F.col("k") == 0) & (F.col("row") > 21) & (F.col("col") == 4))))
    first = all_.filter("row = 21 AND col = 1").select(F.col("workbook_id").alias("_w"), F.col("value").alias("_first"))
    second = all_.filter("row = 22 AND col = 1").select(F.col("workbook_id").alias("_v"), F.col("value").alias("_second"))
    paired = all_.join(first, F.col("workbook_id") == F.col("_w"), "left").join(second, F.col("workbook_id") == F.col("_v"), "left")
    value = F.when(at(3, 2, 3), "abc").when(at(4, 6, 3), "2020-02-01 00:00").when(at(7, 22, 1) | at(8, 22, 1), F.col("_first")).when(at(8, 21, 1), F.col("_second")).when(
        at(11, 21, 0), "7").otherwise(F.col("value"))
    extra = lambda kind, row, value: cells.select("workbook_id").distinct().filter(k == kind).select("workbook_id", F.lit(row).alias("row"), F.lit(4).alias("col"), F.lit(value).alias("value"))
    out = paired.select("workbook_id", "row", "col", value.alias("value"))
    for part in (extra(9, 22, "often"), extra(10, 21, "0.95"), extra(10, 22, "0.01")):
        out = out.unionByName(part)
    return out


@query("w19_workbook_verdicts", ("contracts",), f"""
  SELECT contract_id AS workbook_id, CASE WHEN user_id % 12 > 0 THEN (['{"', '".join(_VERDICTS)}'])[user_id % 12] END AS verdict FROM contracts""")
def workbook_verdicts(spark, d):
    return pacing.workbook_verdicts(materialized(_damaged_cells(spark, d), "cells"), _TITLE, ZONE)


@query("w20_tracker_view", ("tracker", "checkpoints"), f"""
  SELECT contract_id, status, required_date::VARCHAR AS required_date, round(required_ceiling, 6) AS required_ceiling,
    round(latest, 6) AS latest_value, source AS latest_source, checkpoint_count FROM (SELECT *, {_STATUS} AS status FROM tracker)
  JOIN (SELECT contract_id, count(*) AS checkpoint_count FROM checkpoints GROUP BY 1) USING (contract_id)""")
def tracker_view(spark, d):
    view = pacing.tracker_view(pacing.stored_documents(_filled(spark, d), ZONE), _now())
    return view.select("contract_id", "status", "required_date", "required_ceiling", F.col("latest.value").alias("latest_value"),
                       F.col("latest.source").alias("latest_source"), "checkpoint_count")


@query("w21_workbook_duplicates", ("raw_files",), """
  SELECT import_id, rn > 1 AS is_exact_duplicate, CASE WHEN rn > 1 THEN first_id END AS duplicate_of_import_id FROM (
    SELECT import_id, row_number() OVER w AS rn, first_value(import_id) OVER w AS first_id FROM raw_files
    WINDOW w AS (PARTITION BY raw_sha256 ORDER BY created_at, import_id))""")
def workbook_duplicates(spark, d):
    return imports.mark_exact_duplicates(v.raw_files(spark, d), ["raw_sha256"]).select(
        "import_id", "is_exact_duplicate", "duplicate_of_import_id")
