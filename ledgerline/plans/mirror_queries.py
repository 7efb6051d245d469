"""Queries of cross-machine mirror detection, on the documents as sessions and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import imports, mirrors
from ledgerline.plans import views as v
from ledgerline.plans.registry import day, query

# The documents share few sessions per pair of sources, so the thresholds are lower than the defaults.
MATCHES, OVERLAP = 1, 0.02


@v.once_per_session
def _evidence(spark, d):
    rows = v.sessions(spark, d)
    return mirrors.session_evidence(rows, rows, MATCHES, OVERLAP)


def _strong(spark, d):
    rows = v.sessions(spark, d)
    return mirrors.strong_mirrors(rows, rows, MATCHES, OVERLAP)


@v.once_per_session
def _raw(spark, d):
    """All files that another machine delivered before."""
    files = v.raw_files(spark, d)
    found = imports.same_content_elsewhere(files.select("import_id", "machine_id", "raw_sha256"), files)
    return found.filter(F.col("other_machine_id").isNotNull())


def _links(spark, d):
    rows = v.document_daily(spark, d)
    return mirrors.choose_links(rows, rows, _strong(spark, d), _raw(spark, d))


@query("m01_exact_daily_holders", ("document_daily",), f"""
  SELECT agent, {day('usage_date')}, input_tokens, count(*) AS holders, min(machine_id) AS first_machine_id FROM document_daily
  GROUP BY agent, document_daily.usage_date, input_tokens HAVING count(*) > 1""")
def exact_daily_holders(spark, d):
    return mirrors.exact_daily_holders(v.document_daily(spark, d)).select("agent", "usage_date", "input_tokens", "holders", "first_machine_id")


@query("m02_m04_session_evidence", ("evidence",), f"""
  SELECT machine_id, other_machine_id, agent, n1 AS incoming_sessions, n2 AS existing_sessions, exact_matches, identity_matches,
    round(exact_overlap_ratio, 6) AS exact_overlap_ratio, {day('evidence_start')}, {day('evidence_end')}, {day('risk_start')}, {day('risk_end')}
  FROM evidence""")
def session_evidence(spark, d):
    return _evidence(spark, d).drop("strong")


@query("m02_agent_scope", ("evidence",), f"""
  SELECT machine_id, other_machine_id, agent, exact_matches, identity_matches, round(exact_overlap_ratio, 6) AS exact_overlap_ratio, {day('evidence_start')}, {day('evidence_end')}
  FROM evidence WHERE agent <> 'de'""")
def agent_scope(spark, d):
    """Daily rows without one of the agents: sessions of that agent are compared with nothing."""
    rows = v.sessions(spark, d)
    scoped = mirrors.in_agent_scope(rows, v.document_daily(spark, d).filter("agent <> 'de'"))
    return mirrors.session_evidence(scoped, rows, MATCHES, OVERLAP).select(
        "machine_id", "other_machine_id", "agent", "exact_matches", "identity_matches", "exact_overlap_ratio", "evidence_start", "evidence_end")


@query("m02_match_totals", ("evidence",), """
  SELECT machine_id, sum(exact_matches)::BIGINT AS exact_matches, sum(identity_matches)::BIGINT AS identity_matches
  FROM evidence GROUP BY 1""")
def match_totals(spark, d):
    rows = v.sessions(spark, d)
    return mirrors.match_totals(rows, rows)


@query("m05_strong_pairs_of_two", ("evidence",), """
  SELECT machine_id, other_machine_id, agent, exact_matches, round(exact_overlap_ratio, 6) AS exact_overlap_ratio FROM evidence
  WHERE exact_matches >= 2 AND exact_overlap_ratio >= 0.05 AND evidence_start IS NOT NULL""")
def strong_pairs_of_two(spark, d):
    rows = v.sessions(spark, d)
    return mirrors.strong_mirrors(rows, rows, 2, 0.05).select("machine_id", "other_machine_id", "agent", "exact_matches", "exact_overlap_ratio")


@query("m05_strong_pairs", ("evidence",), f"""
  SELECT machine_id, other_machine_id, agent FROM evidence WHERE exact_matches >= {MATCHES} AND exact_overlap_ratio >= {OVERLAP} AND evidence_start IS NOT NULL""")
def strong_pairs(spark, d):
    return _strong(spark, d).select("machine_id", "other_machine_id", "agent")


@query("m06_links", ("chosen_links",), f"""
  SELECT machine_id, agent, {day('usage_date')}, canonical_observation_id, canonical_machine_id, reason, matched_session_count,
    round(session_overlap_ratio, 6) AS session_overlap_ratio FROM chosen_links""")
def links(spark, d):
    return _links(spark, d).select("machine_id", "agent", "usage_date", "canonical_observation_id", "canonical_machine_id", "reason",
                                   "matched_session_count", "session_overlap_ratio")


@query("m07_partial_mirror_risk", ("chosen_links", "document_daily", "evidence"), """
  SELECT machine_id, bool_or(risky) AS partial_mirror_risk FROM (
    SELECT a.machine_id, EXISTS (SELECT 1 FROM evidence v WHERE v.machine_id = a.machine_id AND v.agent = a.agent
        AND a.usage_date BETWEEN v.risk_start AND v.risk_end)
      AND NOT EXISTS (SELECT 1 FROM chosen_links k WHERE k.machine_id = a.machine_id AND k.agent = a.agent AND k.usage_date = a.usage_date) AS risky
    FROM document_daily a) GROUP BY 1""")
def partial_mirror_risk(spark, d):
    rows = v.sessions(spark, d)
    return mirrors.partial_mirror_risk(v.document_daily(spark, d), _links(spark, d), rows, rows)


@query("m08_tokens_prevented", ("chosen_links",), """
  SELECT machine_id, count(*) AS rows_suppressed, sum(reported_total_tokens)::BIGINT AS duplicate_tokens_prevented
  FROM chosen_links WHERE NOT (machine_id IN ('src0', 'src1', 'src2') AND day(usage_date) % 2 = 0) GROUP BY 1""")
def tokens_prevented(spark, d):
    rows = v.document_daily(spark, d)
    before = rows.filter(F.col("machine_id").isin("src0", "src1", "src2"))
    return mirrors.tokens_prevented(_links(spark, d), rows, before, before.filter(F.dayofmonth("usage_date") % 2 == 1))


@query("m09_validated_links", ("chosen_links",), """
  SELECT machine_id || '/' || agent || '/' || usage_date::VARCHAR AS observation_id, canonical_observation_id, canonical_machine_id, reason
  FROM chosen_links""")
def validated_links(spark, d):
    rows = v.document_daily(spark, d)
    return mirrors.validate_links(_links(spark, d), rows, rows).select(
        "observation_id", "canonical_observation_id", "canonical_machine_id", "reason")


@query("m10_match_flags", ("evidence", "raw_elsewhere"), f"""
  SELECT machine_id, TRUE AS cross_machine_match, sum(strong)::BIGINT AS strong_mirrors FROM (
    SELECT machine_id, (exact_matches >= {MATCHES} AND exact_overlap_ratio >= {OVERLAP})::INTEGER AS strong FROM evidence
    UNION ALL SELECT machine_id, 0 FROM raw_elsewhere) GROUP BY 1""")
def match_flags(spark, d):
    files = v.raw_files(spark, d)
    raw = imports.same_content_elsewhere(files.select("import_id", "machine_id", "raw_sha256"), files)
    return mirrors.match_flags(match_totals(spark, d), _strong(spark, d), raw).select(
        "machine_id", "cross_machine_match", F.coalesce(F.size("strong_mirrors"), F.lit(0)).alias("strong_mirrors"))
