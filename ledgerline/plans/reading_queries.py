"""Queries of live readings: validation, as-of ceilings, rollover, append rule, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import append, pacing, readings as r
from ledgerline.plans import views as v
from ledgerline.plans.registry import day, moment, query

NOW_SQL = f"TIMESTAMP '{v.NOW}'"


def _now():
    return F.lit(v.NOW).cast("timestamp")


@v.once_per_session
def _contracts(spark, d):
    return pacing.with_schedule(v.contracts(spark, d), v.ZONE)


_KIND = """CASE reading_id % 13 WHEN 1 THEN 'malformed percent' WHEN 2 THEN 'malformed percent' WHEN 3 THEN 'malformed percent'
    WHEN 7 THEN 'missing usage.monthly' WHEN 8 THEN 'malformed document'
    ELSE CASE WHEN percent > 100 THEN 'percent out of range' ELSE CASE reading_id % 13 WHEN 4 THEN 'malformed status' WHEN 5 THEN 'malformed status'
      WHEN 6 THEN 'malformed reset' END END END"""


@query("i01_i02_i18_valid_payloads", ("all_readings",), f"""
  SELECT account, reading_id, strftime(fetched_at - to_milliseconds(reading_id % 2000), '%Y-%m-%d %H:%M:%S') AS observed_at, round(percent::DOUBLE / 100, 6) AS fraction,
    status, {moment('provider_resets_at')} FROM all_readings WHERE {_KIND} IS NULL""")
def valid_payloads(spark, d):
    return r.parse_payloads(v.payloads(spark, d))[0].select("account", "reading_id", "observed_at", "fraction", "status", "provider_resets_at")


@query("a10_i01_quarantined_payloads", ("all_readings",), f"SELECT reading_id, {_KIND} AS reason FROM all_readings WHERE {_KIND} IS NOT NULL")
def quarantined_payloads(spark, d):
    return r.parse_payloads(v.payloads(spark, d))[1].select("reading_id", "reason")


@query("i02_same_window", ("readings",), f"""
  SELECT reading_id, abs(epoch(provider_resets_at) - epoch(date_trunc('month', observed_at + INTERVAL 1 MONTH))) <= 60 AS same_window FROM readings""")
def same_window(spark, d):
    start = F.date_trunc("month", F.expr("observed_at + interval 1 month"))
    return v.readings(spark, d).select("reading_id", r.same_reset_window(F.col("provider_resets_at"), start).alias("same_window"))


@query("i03_rate_limited", sql="SELECT event_id, event_type IN ('error', 'click') AS limited FROM events")
def rate_limited(spark, d):
    name = F.when(F.col("event_type") == "error", " Monthly_Rate_Limited ").when(F.col("event_type") == "click", "EXHAUSTED").otherwise("ok")
    return v.table(spark, d, "events").select("event_id", r.is_rate_limited(name).alias("limited"))


@query("i04_freshness", ("readings",), f"""
  SELECT reading_id, CASE WHEN age < 300 THEN 'LIVE' WHEN age < 1800 THEN 'RECENT' ELSE 'STALE' END AS freshness
  FROM (SELECT reading_id, (epoch_us({NOW_SQL}) - epoch_us(observed_at)) / 1000000.0 AS age FROM readings)""")
def freshness(spark, d):
    return v.readings(spark, d).select("reading_id", r.freshness(r.seconds_between(_now(), F.col("observed_at"))).alias("freshness"))


@query("i05_active_state", ("compared",), f"""
  SELECT contract_id, {day('active_date')}, round(active_ceiling, 6) AS active_ceiling, round(next_ceiling, 6) AS next_ceiling,
    round((epoch_us(next_ts) - epoch_us({NOW_SQL})) / 1000000.0, 6) AS seconds_until_next FROM compared""")
def active_state(spark, d):
    return r.with_active_state(_contracts(spark, d), _now()).select(
        "contract_id", F.col("active.date").alias("active_date"), "active_ceiling", "next_ceiling", "seconds_until_next")


@query("i05_i08_readings_with_ceiling", ("placed",), """
  SELECT reading_id, contract_id, day, round(active_ceiling, 6) AS active_ceiling, round(active_ceiling - fraction, 6) AS headroom FROM placed""")
def readings_with_ceiling(spark, d):
    return r.readings_with_ceiling(v.readings(spark, d), _contracts(spark, d)).select(
        "reading_id", "contract_id", F.col("active.day").alias("day"), "active_ceiling", "headroom")


@query("i06_rollovers", ("readings",), """
  SELECT reading_id, coalesce(epoch(provider_resets_at) - epoch(p) > 60
    AND (epoch_us(p) - epoch_us(observed_at) <= 60000000 OR epoch(provider_resets_at) - epoch(p) >= 86400), FALSE) AS is_rollover
  FROM (SELECT *, lag(provider_resets_at) OVER (PARTITION BY account ORDER BY observed_at, reading_id) AS p FROM readings)""")
def rollovers(spark, d):
    return r.rollovers(v.readings(spark, d)).select("reading_id", "is_rollover")


@v.once_per_session
def _compared(spark, d):
    return r.compare(_contracts(spark, d), v.readings(spark, d), _now())


@query("i07_comparison", ("compared",), """
  SELECT contract_id, comparison_status, rolled AS is_rollover, round(active_ceiling, 6) AS active_ceiling, round(fraction, 6) AS provider_monthly,
    round(active_ceiling - fraction, 6) AS safe_headroom, round(greatest(0, 1 - fraction), 6) AS provider_remaining,
    CASE WHEN fraction IS NULL THEN 'STALE' WHEN age < 300 THEN 'LIVE' WHEN age < 1800 THEN 'RECENT' ELSE 'STALE' END AS freshness FROM compared""")
def comparison(spark, d):
    return _compared(spark, d).select("contract_id", "comparison_status", "is_rollover", "active_ceiling", "provider_monthly",
                                      "safe_headroom", "provider_remaining", "freshness")


@query("i08_latest_two", ("placed",), f"""
  SELECT contract_id, strftime(max(observed_at) FILTER (rn = 1), '%Y-%m-%d %H:%M:%S') AS latest_at, strftime(max(observed_at) FILTER (rn = 2), '%Y-%m-%d %H:%M:%S') AS previous_at
  FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY observed_at DESC, reading_id DESC) AS rn FROM placed) WHERE rn <= 2 GROUP BY 1""")
def latest_two(spark, d):
    return r.latest_two_in_contract(v.readings(spark, d), _contracts(spark, d)).select(
        "contract_id", F.col("latest.observed_at").alias("latest_at"), F.col("previous.observed_at").alias("previous_at"))


@query("i09_newest_readings", ("readings",), f"""
  SELECT account, reading_id, position FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY observed_at DESC, reading_id DESC) AS position FROM readings)
  WHERE position <= 3""")
def newest_readings(spark, d):
    return r.newest(v.readings(spark, d), 3).select("account", "reading_id", "position")


def _fold_sql(source: str, cooldown: str) -> str:
    return f"""
  WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY observed_at, reading_id) AS rn FROM {source}),
  walk AS (
    SELECT account, rn, reading_id, TRUE AS stored, observed_at AS so, provider_resets_at AS sr, fraction AS sf, status AS ss FROM ranked WHERE rn = 1
    UNION ALL
    SELECT account, rn, reading_id, keep, CASE WHEN keep THEN observed_at ELSE so END, CASE WHEN keep THEN provider_resets_at ELSE sr END,
      CASE WHEN keep THEN fraction ELSE sf END, CASE WHEN keep THEN status ELSE ss END
    FROM (SELECT r.*, w.so, w.sr, w.sf, w.ss, (r.fraction <> w.sf OR r.status <> w.ss OR abs(epoch(r.provider_resets_at) - epoch(w.sr)) > 60
        OR ({cooldown} epoch_us(r.fetched_at) - epoch_us(w.so) > 3600000000)) AS keep
      FROM walk w JOIN ranked r ON r.account = w.account AND r.rn = w.rn + 1))
  SELECT account, reading_id FROM walk WHERE stored"""


_COOLDOWN = "epoch_us(r.fetched_at) - epoch_us(w.so) >= 45000000 AND"


@query("i10_append_plain", ("readings",), _fold_sql("readings", ""))
def append_plain(spark, d):
    return append.stored_readings(v.readings(spark, d), append.PLAIN).select("account", "reading_id")


@query("i11_append_atomic", ("readings",), _fold_sql("readings", _COOLDOWN))
def append_atomic(spark, d):
    return append.stored_readings(v.readings(spark, d), append.ATOMIC).select("account", "reading_id")


@query("i11_append_dense_polls", ("polled",), _fold_sql("polled", _COOLDOWN))
def append_dense_polls(spark, d):
    """A few accounts polled all the time with hardly a change: most decisions depend on what was stored before."""
    return append.stored_readings(v.polled_readings(spark, d), append.ATOMIC).select("account", "reading_id")


@query("i12_refresh_policy", ("placed", "contracts"), f"""
  SELECT c.contract_id, coalesce(age >= 120, TRUE) AS due, coalesce(age < 45, FALSE) AS cooling_down, round(CASE WHEN age < 45 THEN greatest(0, 45 - age) ELSE 0 END, 6) AS cooldown_seconds_left
  FROM contracts c LEFT JOIN (SELECT contract_id, (epoch_us(TIMESTAMP '2024-01-29 11:00:00') - epoch_us(max(observed_at))) / 1000000.0 AS age FROM placed GROUP BY 1) USING (contract_id)""")
def refresh_policy(spark, d):
    contracts = _contracts(spark, d)
    latest = contracts.select("contract_id", "tracking_start", "reset_at").join(
        r.latest_two_in_contract(v.readings(spark, d), contracts).select("contract_id", "latest.observed_at"), "contract_id", "left")
    return r.refresh_policy(latest, F.lit("2024-01-29 11:00:00").cast("timestamp")).select(
        "contract_id", "due", "cooling_down", "cooldown_seconds_left")


@query("i13_first_in_window", ("placed",), f"""
  SELECT contract_id, day, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at, round(fraction, 6)::DECIMAL(20,2)::VARCHAR AS fraction FROM (
    SELECT *, row_number() OVER (PARTITION BY contract_id, day ORDER BY observed_at, reading_id) AS rn FROM placed WHERE day IS NOT NULL) WHERE rn = 1""")
def first_in_window(spark, d):
    return r.first_in_window(v.readings(spark, d), _contracts(spark, d))


_ROWS = f"""
  WITH first AS (SELECT contract_id, day, fraction FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, day ORDER BY observed_at, reading_id) AS rn
      FROM placed WHERE day IS NOT NULL) WHERE rn = 1),
  newest AS (SELECT account, max(observed_at) AS last FROM readings GROUP BY 1),
  checkpoint_rows AS (SELECT k.contract_id, k.day, k.date, k.ts, k.ceiling, k.ts > {NOW_SQL} AS is_future, k.ts <= {NOW_SQL} AND coalesce(k.date = c.active_date, FALSE) AS is_current,
      CASE WHEN k.ts > {NOW_SQL} THEN NULL WHEN k.date = c.active_date THEN CASE WHEN n.last >= c.tracking_start AND n.last < c.reset_at THEN c.fraction END ELSE f.fraction END AS observation,
      CASE WHEN k.ts > {NOW_SQL} THEN 'Upcoming' WHEN k.date = c.active_date THEN CASE c.comparison_status WHEN 'ON_TRACK' THEN 'On track' WHEN 'NEAR_PLAN' THEN 'Near plan'
          WHEN 'OVER_PACE' THEN 'Over pace' WHEN 'LIMIT_EXCEEDED' THEN 'Limit exceeded' WHEN 'SYNC_STALE' THEN 'Stale' ELSE 'Reset required' END
        WHEN f.fraction IS NULL THEN '—' WHEN f.fraction >= 1 THEN 'Limit exceeded' WHEN k.ceiling - f.fraction < -1e-12 THEN 'Over pace'
        WHEN k.ceiling - f.fraction <= 0.02 + 1e-9 THEN 'Near plan' ELSE 'On track' END AS status
    FROM checkpoints k JOIN compared c USING (contract_id) LEFT JOIN first f ON f.contract_id = k.contract_id AND f.day = k.day
    LEFT JOIN newest n ON n.account = c.account)"""
_ROW_VIEWS = ("placed", "compared", "checkpoints", "readings")


@v.once_per_session
def _rows(spark, d):
    return r.checkpoint_rows(_contracts(spark, d), v.readings(spark, d), _now())


@query("i14_checkpoint_rows", _ROW_VIEWS, _ROWS + f"""
  SELECT contract_id, day, {day('date')}, round(ceiling, 6) AS ceiling, round(observation, 6) AS observation, status, is_current, is_future FROM checkpoint_rows""")
def checkpoint_rows(spark, d):
    return _rows(spark, d).select("contract_id", "day", "date", "ceiling", "observation", "status", "is_current", "is_future")


@query("i15_chart_points", _ROW_VIEWS, _ROWS + f"""
  SELECT contract_id, {day('date')}, {moment('ts')}, round(observation, 6) AS observation, status FROM checkpoint_rows""")
def chart_points(spark, d):
    return r.chart_points(_contracts(spark, d), _rows(spark, d)).select("contract_id", "date", "ts", "observation", "status")


@query("i16_default_rows", _ROW_VIEWS, _ROWS + """
  SELECT k.contract_id, k.day, k.status FROM checkpoint_rows k LEFT JOIN (SELECT contract_id, day AS cur FROM checkpoint_rows WHERE is_current) c USING (contract_id)
  WHERE CASE WHEN cur IS NULL THEN k.day <= 8 ELSE k.day BETWEEN cur - 3 AND cur + 5 END""")
def default_rows(spark, d):
    return r.default_rows(_rows(spark, d)).select("contract_id", "day", "status")


@query("i17_room_to_next", ("compared",), "SELECT contract_id, round(next_ceiling - fraction, 6) AS room_to_next FROM compared")
def room_to_next(spark, d):
    return _compared(spark, d).select("contract_id", r.room_to_next(F.col("next_ceiling"), F.col("provider_monthly")).alias("room_to_next"))
