"""Queries of the unified analytics: residuals, roll-ups, filters, ranges, shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import recovery, rollups
from ledgerline.operators.revisions import current_daily
from ledgerline.operators.rollups import Filters
from ledgerline.plans import views as v
from ledgerline.plans.registry import day, money, query
from ledgerline.session import materialized

TOKENS = ", ".join(rollups.TOKENS)
ROW = [*rollups.TOKENS, "reported_cost_usd", "pricing_complete"]
ROW_SQL = f"{TOKENS}, {money('reported_cost_usd')}, pricing_complete"
SUMS = ", ".join(f"sum({t})::BIGINT AS {t}" for t in rollups.TOKENS)


@query("flagship_current_by_month_and_agent", ("current_daily",), """
  SELECT date_trunc('month', usage_date)::DATE::VARCHAR AS month, agent, sum(reported_total_tokens)::BIGINT AS total_tokens,
    round(sum(reported_total_tokens)::DOUBLE / (SELECT sum(reported_total_tokens) FROM current_daily), 6) AS share
  FROM current_daily GROUP BY 1, 2""")
def flagship(spark, d):
    """Current truth per machine, agent and day, rolled up to months with each agent's share of the whole."""
    current = rollups.canonical_daily(current_daily(v.promoted(spark, d)))
    monthly = current.withColumn("month", F.trunc("usage_date", "month")).groupBy("month", "agent").agg(F.sum("total_tokens").alias("total_tokens"))
    # The exchange below both sums is one: Spark works it out once and reuses it.
    whole = monthly.agg(F.sum("total_tokens").alias("t")).scalar()
    return monthly.withColumn("share", F.col("total_tokens").cast("double") / whole)


@v.once_per_session
def _daily(spark, d):
    return rollups.canonical_daily(v.daily(spark, d))


@v.once_per_session
def _models(spark, d):
    return rollups.canonical_models(v.model_daily(spark, d))


def _evidence(spark, d):
    """Recovered sets and rows. The orders are summed once per query, not once per check."""
    rows = materialized(v.recovered(spark, d), "recovered")
    return v.recovered_sets(rows), rows


def _recovered(spark, d):
    return recovery.project(*_evidence(spark, d))


def _with_recovered(spark, d):
    return rollups.build_projection(v.daily(spark, d), v.model_daily(spark, d), _recovered(spark, d))


@v.once_per_session
def _canonical_only(spark, d):
    return rollups.build_projection(v.daily(spark, d), v.model_daily(spark, d))


def _projection(spark, d, recovered=True):
    return _with_recovered(spark, d) if recovered else _canonical_only(spark, d)


@query("a09_seed_mismatches", ("recovered", "recovered_agents"), f"""
  SELECT set_id, {day('month')}, agent, FALSE AS absent FROM recovered WHERE agent = 'All' AND month(month) % 5 = 0
  UNION ALL SELECT set_id, month::VARCHAR, agent, TRUE FROM recovered WHERE agent = '1-URGENT' AND month(month) = 7""")
def seed_mismatches(spark, d):
    """Stored rows lack one agent's Julys and hold All rows without the extra token."""
    rows = v.recovered(spark, d)
    extra = F.when((F.col("agent") == "All") & (F.month("month") % 5 == 0), 1).otherwise(0)
    stored = rows.filter("not (agent = '1-URGENT' and month(month) = 7)").withColumn("input_tokens", F.col("input_tokens") - extra)
    return recovery.seed_mismatches(rows, stored)


@query("a09_corrected_header", ("recovered_sets",), """
  SELECT set_id, CASE WHEN set_id = 'set-1996' THEN 'additive_recovered' ELSE accounting_mode END AS accounting_mode FROM recovered_sets""")
def corrected_header(spark, d):
    return recovery.correct_header(v.recovered_sets(v.recovered(spark, d)), "set-1996").select("set_id", "accounting_mode")


@query("u01_canonical_daily", ("flagged_daily",), f"""
  SELECT {day('usage_date')}, machine_id, agent, reported_total_tokens AS total_tokens, {money('reported_cost_usd')}, reported_cost_usd IS NOT NULL AS pricing_complete
  FROM flagged_daily WHERE NOT global_duplicate""")
def canonical_daily(spark, d):
    from ledgerline.operators.revisions import with_mirror_flag
    current = materialized(current_daily(v.observations(spark, d).drop("model"), v.imports(spark, d)), "current")
    flagged = with_mirror_flag(current, v.current_links(spark, d, current))
    return rollups.canonical_daily(flagged).select("usage_date", "machine_id", "agent", "total_tokens", "reported_cost_usd", "pricing_complete")


@query("u02_u03_months", ("u_months", "u_models"), f"""
  SELECT {day('month')}, machine_id, agent, {ROW_SQL}, coalesce(n.models, '') AS models, n.models IS NOT NULL AS model_attribution_available
  FROM u_months LEFT JOIN (SELECT date_trunc('month', usage_date)::DATE AS month, machine_id, agent, string_agg(DISTINCT model, ',' ORDER BY model) AS models
    FROM u_models GROUP BY 1, 2, 3) n USING (month, machine_id, agent)""")
def months(spark, d):
    return rollups.months(_daily(spark, d), _models(spark, d)).select(
        "month", "machine_id", "agent", *ROW, "models", "model_attribution_available")


@query("u04_unattributed", ("u_open",), f"SELECT {day('usage_date')}, machine_id, agent, {ROW_SQL} FROM u_open")
def unattributed(spark, d):
    return rollups.unattributed(_daily(spark, d), _models(spark, d)).select("usage_date", "machine_id", "agent", *ROW)


@query("u05_monthly_checks", ("recovered",), f"""
  SELECT set_id, {day('month')}, count(*) FILTER (agent = 'All') AS all_rows, count(*) FILTER (agent <> 'All') AS agent_rows,
    sum(total_tokens) FILTER (agent = 'All') = sum(total_tokens) FILTER (agent <> 'All') AS agents_match FROM recovered GROUP BY set_id, recovered.month""")
def monthly_checks(spark, d):
    return recovery.monthly_checks(v.recovered(spark, d)).select("set_id", "month", "all_rows", "agent_rows", "agents_match")


@query("u06_set_checks", ("recovered_sets",), """
  SELECT set_id, 0::BIGINT AS months_without_one_all, set_id <> 'set-1998' AS header_matches FROM recovered_sets""")
def set_checks(spark, d):
    off = F.when(F.col("set_id") == "set-1998", 1).otherwise(0)
    sets, rows = _evidence(spark, d)
    return recovery.set_checks(sets.withColumn("total_tokens", F.col("total_tokens") + off), recovery.monthly_checks(rows))


@query("u05_u08_recovered_projection", ("recovered_rows",), f"SELECT {day('month')}, machine_id, agent, {ROW_SQL} FROM recovered_rows")
def recovered_projection(spark, d):
    return _recovered(spark, d).select("month", "machine_id", "agent", *ROW)


@query("u09_unified_monthly", ("u_monthly",), f"SELECT {day('month')}, machine_id, source_kind, agent, {ROW_SQL} FROM u_monthly")
def unified_monthly(spark, d):
    return rollups.sorted_months(_projection(spark, d).monthly).select("month", "machine_id", "source_kind", "agent", *ROW)


@query("u10_tagged_models", ("u_tagged",), f"""
  SELECT kind, {day('usage_date')}, {day('month')}, machine_id, agent, model, {ROW_SQL} FROM u_tagged""")
def tagged_models(spark, d):
    return _projection(spark, d).models.select("kind", "usage_date", "month", "machine_id", "agent", "model", *ROW)


@query("u11_available_models", ("u_models",), "SELECT DISTINCT model FROM u_models")
def available_models(spark, d):
    return rollups.available_models(_models(spark, d))


_WHOLE = """FROM {source} WHERE {where}"""
_TOTALS = f"""SELECT {', '.join(f'coalesce(sum({t}), 0)::BIGINT AS {t}' for t in rollups.TOKENS)},
    coalesce(sum(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens), 0)::BIGINT AS component_total_tokens,
    coalesce(sum(reported_cost_usd), 0)::DECIMAL(20,2)::VARCHAR AS reported_cost_usd, count(reported_cost_usd) AS cost_rows, count(*) AS row_count,
    coalesce(bool_and(pricing_complete), TRUE) AS pricing_complete """


@query("u12_dimension_filters", ("u_daily",), f"SELECT {day('usage_date')}, machine_id, agent, total_tokens FROM u_daily WHERE machine_id = 'm3' AND agent = 'click'")
def dimension_filters(spark, d):
    chosen = rollups.select_usage(_projection(spark, d, False), Filters("m3", "click", grain="day"))
    return chosen.daily.select("usage_date", "machine_id", "agent", "total_tokens")


@query("u13_rolling_range", ("u_daily",), f"""
  SELECT {day('usage_date')}, machine_id, agent, total_tokens FROM u_daily
  WHERE machine_id = 'm5' AND usage_date >= (SELECT max(usage_date) FROM u_daily WHERE machine_id = 'm5') - 6""")
def rolling_range(spark, d):
    chosen = rollups.select_usage(_projection(spark, d, False), Filters("m5", range="7d", grain="day"))
    return chosen.daily.select("usage_date", "machine_id", "agent", "total_tokens")


@query("u14_model_filtered_daily", ("u_models",), f"""
  SELECT {day('usage_date')}, machine_id, agent, {ROW_SQL} FROM u_models WHERE model = 'model-2'
    AND usage_date >= (SELECT max(usage_date) FROM u_models WHERE model = 'model-2') - 29""")
def model_filtered_daily(spark, d):
    chosen = rollups.select_usage(_projection(spark, d, False), Filters(model="model-2", range="30d", grain="day"))
    return chosen.daily.select("usage_date", "machine_id", "agent", *ROW)


@query("u15_regrouped_months", ("u_models",), f"""
  SELECT date_trunc('month', usage_date)::DATE::VARCHAR AS month, machine_id, agent, {SUMS}, sum(reported_cost_usd)::DECIMAL(20,2)::VARCHAR AS reported_cost_usd,
    bool_and(pricing_complete) AS pricing_complete, '' AS models, TRUE AS model_attribution_available
  FROM u_models WHERE model = 'model-1' GROUP BY 1, 2, 3""")
def regrouped_months(spark, d):
    chosen = rollups.select_usage(_projection(spark, d), Filters(model="model-1"))
    return chosen.monthly.select("month", "machine_id", "agent", *ROW, "models", "model_attribution_available")


@query("u16_totals", ("u_monthly",), _TOTALS + "FROM u_monthly")
def totals(spark, d):
    return rollups.select_usage(_projection(spark, d), Filters()).totals


@query("u16_totals_of_nothing", ("u_monthly",), _TOTALS + "FROM u_monthly WHERE machine_id = 'nobody'")
def totals_of_nothing(spark, d):
    return rollups.select_usage(_projection(spark, d), Filters("nobody")).totals


@query("u17_capability_guard", ("recovered_rows",), """
  WITH f AS (SELECT count(*) > 0 AS found FROM recovered_rows)
  SELECT 'week' AS asked, 'unsupported' AS status, 'recovered-month-only' AS reason, TRUE AS recovered_in_scope, FALSE AS model_attribution_excluded, FALSE AS supports_day_week FROM f WHERE found
  UNION ALL SELECT 'range', 'unsupported', 'recovered-all-time-only', TRUE, FALSE, FALSE FROM f WHERE found
  UNION ALL SELECT 'model', 'ready', NULL, FALSE, TRUE, TRUE FROM f WHERE found
  UNION ALL SELECT 'machine', 'ready', NULL, FALSE, FALSE, TRUE FROM f""")
def capability_guard(spark, d):
    asked = {"week": Filters(grain="week"), "range": Filters(range="30d"), "model": Filters(model="model-1", grain="day"),
             "machine": Filters("m1", grain="week")}
    projection = _projection(spark, d)
    out = None
    for name, filters in asked.items():
        row = rollups.select_usage(projection, filters).status.select(
            F.lit(name).alias("asked"), "status", "reason", "recovered_in_scope", "model_attribution_excluded", "supports_day_week")
        out = row if out is None else out.unionByName(row)
    return out


@query("u17_unsupported_is_empty", ("recovered_rows", "u_daily"), """
  SELECT count(*) AS rows FROM u_daily WHERE NOT (SELECT count(*) > 0 FROM recovered_rows)""")
def unsupported_is_empty(spark, d):
    return rollups.select_usage(_projection(spark, d), Filters(grain="day")).daily.agg(F.count(F.lit(1)).alias("rows"))


@query("u18_weeks", ("u_daily",), f"""
  SELECT date_trunc('week', usage_date)::DATE::VARCHAR AS week, machine_id, agent, {SUMS}, sum(reported_cost_usd)::DECIMAL(20,2)::VARCHAR AS reported_cost_usd,
    bool_and(pricing_complete) AS pricing_complete FROM u_daily GROUP BY 1, 2, 3""")
def weeks(spark, d):
    return rollups.weeks(_daily(spark, d)).select("week", "machine_id", "agent", *ROW)


@query("u19_by_day", ("u_daily",), "SELECT usage_date::VARCHAR AS usage_date, sum(total_tokens)::BIGINT AS total_tokens FROM u_daily GROUP BY 1")
def by_day(spark, d):
    return rollups.by_period(_daily(spark, d), "usage_date")


@query("u19_by_month", ("u_monthly",), "SELECT month::VARCHAR AS month, sum(total_tokens)::BIGINT AS total_tokens FROM u_monthly GROUP BY 1")
def by_month(spark, d):
    return rollups.by_period(_projection(spark, d).monthly, "month")


_SHARE = """SELECT {k}, sum(total_tokens)::BIGINT AS total_tokens,
    round(sum(total_tokens)::DOUBLE / (SELECT sum(total_tokens) FROM u_monthly)::DOUBLE, 6) AS share FROM u_monthly GROUP BY 1"""


@query("u20_by_agent", ("u_monthly",), _SHARE.format(k="agent"))
def by_agent(spark, d):
    return rollups.by_dimension(_projection(spark, d).monthly, "agent")


@query("u20_by_machine", ("u_monthly",), _SHARE.format(k="machine_id"))
def by_machine(spark, d):
    return rollups.by_dimension(_projection(spark, d).monthly, "machine_id")


@query("u19_u20_grouping_sets", ("u_daily",), """
  SELECT usage_date::VARCHAR AS usage_date, agent, machine_id, sum(total_tokens)::BIGINT AS total_tokens FROM u_daily
  GROUP BY GROUPING SETS ((usage_date), (agent), (machine_id))""")
def grouping_sets(spark, d):
    return rollups.grouped_totals(_daily(spark, d), "usage_date")


@query("u21_model_summary", ("u_tagged",), """
  SELECT key, kind, sum(total_tokens)::BIGINT AS total_tokens, coalesce(sum(reported_cost_usd), 0)::DECIMAL(20,2)::VARCHAR AS reported_cost_usd,
    count(reported_cost_usd) AS cost_rows, count(DISTINCT agent) AS agents, count(DISTINCT period) AS periods,
    round(sum(total_tokens)::DOUBLE / (SELECT sum(total_tokens) FROM u_tagged)::DOUBLE, 6) AS share,
    round(CASE WHEN sum(total_tokens) <> 0 THEN sum(cache_read_tokens)::DOUBLE / sum(total_tokens)::DOUBLE ELSE 0 END, 6) AS cache_share
  FROM (SELECT *, CASE kind WHEN 'canonical-attributed' THEN 'canonical:' || model WHEN 'canonical-unattributed' THEN kind || ':' || machine_id || ':' || agent
      ELSE 'recovered:' || agent || ':' || strftime(month, '%Y-%m') END AS key,
      CASE WHEN kind = 'recovered-unattributed' THEN strftime(month, '%Y-%m') ELSE usage_date::VARCHAR END AS period FROM u_tagged) GROUP BY key, kind""")
def model_summary(spark, d):
    return rollups.model_summary(_projection(spark, d).models).select(
        "key", "kind", "total_tokens", "reported_cost_usd", "cost_rows", "agents", "periods", "share", "cache_share")


@query("u22_model_coverage", ("u_models", "u_monthly"), """
  SELECT round((SELECT sum(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens) FROM u_models)::DOUBLE
    / (SELECT sum(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens) FROM u_monthly)::DOUBLE * 100, 6) AS model_coverage_percent""")
def model_coverage(spark, d):
    projection = _projection(spark, d)
    return rollups.model_coverage(projection.models, projection.monthly)


@query("u23_shares", ("u_monthly",), """
  SELECT round(sum(cache_read_tokens)::DOUBLE / sum(total_tokens)::DOUBLE * 100, 6) AS cache_share, round(sum(input_tokens)::DOUBLE / sum(total_tokens)::DOUBLE * 100, 6) AS input_share,
    round(sum(output_tokens)::DOUBLE / sum(total_tokens)::DOUBLE * 100, 6) AS output_share, round(count(reported_cost_usd)::DOUBLE / count(*) * 100, 6) AS cost_coverage
  FROM u_monthly""")
def shares(spark, d):
    return rollups.shares(rollups.totals(_projection(spark, d).monthly))


@query("u24_day_statistics", ("u_daily",), """
  WITH days AS (SELECT usage_date, sum(total_tokens)::BIGINT AS t FROM u_daily GROUP BY 1)
  SELECT count(*) FILTER (t > 0) AS detailed_days, round(sum(t)::DOUBLE / count(*) FILTER (t > 0), 6) AS average_detailed_day,
    (SELECT usage_date::VARCHAR FROM days ORDER BY t DESC, usage_date LIMIT 1) AS peak_date, max(t) AS peak_tokens FROM days""")
def day_statistics(spark, d):
    return rollups.day_statistics(_daily(spark, d))


@query("u25_agent_facet", ("u_monthly",), "SELECT DISTINCT agent FROM u_monthly WHERE agent <> 'All'")
def agent_facet(spark, d):
    return rollups.agent_facet(_projection(spark, d).monthly)


@query("u25_model_facet", ("u_models",), "SELECT DISTINCT model FROM u_models WHERE machine_id = 'm2' AND agent = 'view'")
def model_facet(spark, d):
    return rollups.model_facet(_projection(spark, d).models, Filters("m2", "view"))


@query("u26_machine_names", ("u_monthly", "machines"), """
  SELECT machine_id, CASE WHEN machine_id = 'recovered-machine' THEN 'Recovered machine' ELSE coalesce(m.name, machine_id) END AS machine_name,
    sum(total_tokens)::BIGINT AS total_tokens FROM u_monthly LEFT JOIN machines m USING (machine_id) GROUP BY 1, 2""")
def machine_names(spark, d):
    per_machine = _projection(spark, d).monthly.groupBy("machine_id").agg(F.sum("total_tokens").alias("total_tokens"))
    return rollups.with_machine_name(per_machine, v.machines(spark, d))
