"""The domain views once more as SQL, for checking results outside Spark.

`with_views("daily", ...)` puts the named views, and those they read, in front of a query.
"""

from __future__ import annotations

_COUNTERS = "input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens"


def _hash(tag: str, *names: str) -> str:
    parts = ", ".join([f"'{tag}'", *names, _COUNTERS, "reported_total_tokens"])
    return (
        f"sha256(concat_ws('|', {parts}, coalesce(regexp_replace(reported_cost_usd::DECIMAL(38,12)::VARCHAR, '\\.?0+$', ''), 'null'), "
        "CASE WHEN is_tombstone THEN 'tombstone' ELSE 'present' END))"
    )


DAILY_HASH = _hash("daily-agent-v2", "agent", "usage_date::DATE::VARCHAR")
MODEL_HASH = _hash("daily-agent-model-v1", "agent", "model", "usage_date::DATE::VARCHAR")

_USAGE_SUMS = """sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens,
  sum(accounting_delta_tokens)::BIGINT AS accounting_delta_tokens,
  sum(input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens + accounting_delta_tokens)::BIGINT AS reported_total_tokens,
  sum(reported_cost_usd)::DECIMAL(38,12) AS reported_cost_usd, FALSE AS is_tombstone"""

_NEWEST = "ORDER BY i.processed_at DESC NULLS LAST, o.created_at DESC, o.id DESC"

# name: (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "imports": ((), """
      SELECT o_orderkey AS import_id, 'm' || (o_custkey % 4) AS machine_id,
        sha256(o_orderpriority || '|' || o_orderdate::DATE::VARCHAR) AS raw_sha256,
        o_orderdate::DATE - 6 AS scope_start, o_orderdate::DATE AS scope_end,
        CASE WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'processed' END AS status,
        o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS processed_at,
        floor(o_totalprice)::BIGINT AS file_size_bytes
      FROM orders"""),
    "machines": ((), """
      SELECT 'm' || n_nationkey AS machine_id, n_name AS name, n_regionkey <> 2 AS is_active FROM nation"""),
    "line_usage": ((), """
      SELECT lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_linenumber::VARCHAR, 3, '0') || lpad(l_partkey::VARCHAR, 10, '0') AS id,
        'm' || (o_custkey % 4) AS machine_id, l_orderkey AS import_id, l_returnflag AS agent, 'model-' || (l_linenumber % 3) AS model,
        l_shipdate::DATE AS usage_date, o_orderdate AS created_at, (l_linestatus = 'F' AND l_quantity > 45) AS is_tombstone,
        CASE WHEN (l_linestatus = 'F' AND l_quantity > 45) THEN 0 ELSE floor(l_quantity)::BIGINT END AS input_tokens,
        CASE WHEN (l_linestatus = 'F' AND l_quantity > 45) THEN 0 ELSE floor(l_extendedprice)::BIGINT END AS output_tokens,
        CASE WHEN (l_linestatus = 'F' AND l_quantity > 45) THEN 0 ELSE round(l_discount * 100)::BIGINT END AS cache_read_tokens,
        CASE WHEN (l_linestatus = 'F' AND l_quantity > 45) THEN 0 ELSE round(l_tax * 100)::BIGINT END AS cache_creation_tokens,
        CASE WHEN NOT (l_linestatus = 'F' AND l_quantity > 45) THEN l_extendedprice::DECIMAL(18,2)::DECIMAL(38,12) END AS reported_cost_usd
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "observations": (("line_usage",), f"""
      SELECT *, {DAILY_HASH} AS usage_hash, 0::BIGINT AS accounting_delta_tokens
      FROM (SELECT *, input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens AS reported_total_tokens FROM line_usage)"""),
    "model_observations": (("line_usage",), f"""
      SELECT *, {MODEL_HASH} AS usage_hash
      FROM (SELECT *, input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens AS reported_total_tokens FROM line_usage)"""),
    "current_daily": (("observations", "imports"), f"""
      SELECT * EXCLUDE (rn) FROM (SELECT o.*, row_number() OVER (PARTITION BY o.machine_id, o.agent, o.usage_date {_NEWEST}) AS rn
        FROM observations o JOIN imports i USING (import_id) WHERE i.status = 'processed') WHERE rn = 1 AND NOT is_tombstone"""),
    "current_models": (("model_observations", "imports"), f"""
      SELECT * EXCLUDE (rn) FROM (SELECT o.*, row_number() OVER (PARTITION BY o.machine_id, o.agent, o.model, o.usage_date {_NEWEST}) AS rn
        FROM model_observations o JOIN imports i USING (import_id) WHERE i.status = 'processed') WHERE rn = 1 AND NOT is_tombstone"""),
    "links": (("observations",), """
      SELECT o.id AS observation_id, t.canonical_observation_id, 'm0' AS canonical_machine_id FROM observations o
      JOIN (SELECT agent, usage_date, max(id) AS canonical_observation_id FROM observations WHERE machine_id = 'm0' GROUP BY ALL) t
        USING (agent, usage_date)
      WHERE o.machine_id <> 'm0' AND o.cache_read_tokens % 2 = 0"""),
    "flagged_daily": (("current_daily", "links"), """
      SELECT c.*, (k.observation_id IS NOT NULL AND n.id IS NOT NULL) AS global_duplicate, n.machine_id AS canonical_machine_id
      FROM current_daily c LEFT JOIN links k ON k.observation_id = c.id LEFT JOIN current_daily n ON n.id = k.canonical_observation_id"""),
    "event_usage": ((), """
      SELECT event_id, 'm' || (user_id % 8) AS machine_id, event_type AS agent,
        'model-' || (json_extract_string(props, '$.k')::BIGINT % 6) AS model, ts::DATE AS usage_date,
        round(value * 100)::BIGINT AS input_tokens, floor(value)::BIGINT AS output_tokens,
        json_extract_string(props, '$.k')::BIGINT AS cache_read_tokens, event_id % 7 AS cache_creation_tokens,
        event_id % 3 AS accounting_delta_tokens,
        CASE WHEN event_type <> 'error' THEN value::DECIMAL(18,2)::DECIMAL(38,12) END AS reported_cost_usd
      FROM events"""),
    "daily_sums": (("event_usage",), f"SELECT machine_id, agent, usage_date, {_USAGE_SUMS} FROM event_usage GROUP BY machine_id, agent, usage_date"),
    "daily": (("daily_sums",), f"SELECT *, {DAILY_HASH} AS usage_hash FROM daily_sums"),
    "model_sums": (("event_usage",), f"""
      SELECT machine_id, agent, model, usage_date, {_USAGE_SUMS} FROM event_usage WHERE model <> 'model-5'
      GROUP BY machine_id, agent, model, usage_date"""),
    "model_daily": (("model_sums",), f"SELECT *, {MODEL_HASH} AS usage_hash FROM model_sums"),
    "incoming_daily": (("daily_sums",), f"""
      SELECT *, {DAILY_HASH} AS usage_hash FROM (
        SELECT * REPLACE (input_tokens + b AS input_tokens, reported_total_tokens + b AS reported_total_tokens) FROM (
          SELECT *, CASE WHEN day(usage_date) % 4 = 0 THEN 7 ELSE 0 END AS b FROM (
            SELECT * REPLACE ((CASE WHEN day(usage_date) = 29 THEN usage_date + 10 ELSE usage_date END) AS usage_date)
            FROM daily_sums WHERE day(usage_date) % 5 <> 0)))"""),
    "incoming_models": (("model_sums",), f"""
      SELECT *, {MODEL_HASH} AS usage_hash FROM (
        SELECT * REPLACE (input_tokens + b AS input_tokens, reported_total_tokens + b AS reported_total_tokens) FROM (
          SELECT *, CASE WHEN day(usage_date) % 4 = 0 THEN 7 ELSE 0 END AS b FROM model_sums WHERE day(usage_date) % 5 <> 0))"""),
    "raw_files": ((), """
      SELECT doc_id AS import_id, source AS machine_id, sha256(text) AS raw_sha256, strlen(text)::BIGINT AS file_size_bytes,
        make_timestamp((1704067200 + doc_id * 60) * 1000000) AS created_at,
        CASE WHEN doc_id % 9 = 0 THEN 'processing' ELSE 'processed' END AS status
      FROM documents"""),
    "session_rows": ((), """
      SELECT doc_id AS import_id, source AS machine_id, lang AS agent,
        sha256(text) AS session_id, length(text)::BIGINT AS n,
        make_timestamp((1704067200 + (length(text) % 28) * 86400) * 1000000) AS first_activity,
        make_timestamp((1704067200 + (length(text) % 28) * 86400 + (length(text) % 3) * 86400) * 1000000) AS last_activity,
        make_timestamp((1704067200 + doc_id * 60) * 1000000) AS created_at
      FROM documents"""),
    "sessions": (("session_rows",), """
      SELECT *, sha256(concat_ws('|', 'session-local-v1', agent, session_id, machine_id)) AS local_key_hash,
        sha256(concat_ws('|', 'session-identity-v1', agent, session_id)) AS identity_hash,
        sha256(concat_ws('|', 'session-mirror-v1', agent, session_id, strftime(first_activity, '%Y-%m-%dT%H:%M:%S.000Z'),
          strftime(last_activity, '%Y-%m-%dT%H:%M:%S.000Z'), n, n % 97, n % 31, n % 5, n + n % 97 + n % 31 + n % 5, '')) AS mirror_hash
      FROM session_rows"""),
    "document_daily": ((), """
      SELECT source AS machine_id, lang AS agent, DATE '2024-01-01' + (length(text) % 28)::INTEGER AS usage_date, count(*)::BIGINT AS input_tokens,
        source || '/' || lang || '/' || (DATE '2024-01-01' + (length(text) % 28)::INTEGER)::VARCHAR AS id
      FROM documents GROUP BY ALL"""),
    "evidence": (("sessions",), """
      SELECT p.*, n1, n2, least(1.0::DOUBLE, CASE WHEN least(n1, n2) > 0 THEN exact_matches::DOUBLE / least(n1, n2) ELSE 0 END) AS exact_overlap_ratio
      FROM (
        SELECT machine_id, other_machine_id, agent, sum(is_exact)::BIGINT AS exact_matches, sum(1 - is_exact)::BIGINT AS identity_matches,
          min(s) FILTER (is_exact = 1) AS evidence_start, max(e) FILTER (is_exact = 1) AS evidence_end,
          coalesce(min(s) FILTER (is_exact = 0), min(s) FILTER (is_exact = 1)) AS risk_start,
          coalesce(max(e) FILTER (is_exact = 0), max(e) FILTER (is_exact = 1)) AS risk_end
        FROM (
          SELECT a.machine_id, b.machine_id AS other_machine_id, a.agent, 1 AS is_exact, a.s, a.e FROM
            (SELECT machine_id, agent, mirror_hash AS h, min(first_activity)::DATE AS s, max(last_activity)::DATE AS e FROM sessions GROUP BY ALL) a
            JOIN (SELECT DISTINCT machine_id, agent, mirror_hash AS h FROM sessions) b ON a.agent = b.agent AND a.h = b.h AND a.machine_id <> b.machine_id
          UNION ALL
          SELECT a.machine_id, b.machine_id, a.agent, 0, a.s, a.e FROM
            (SELECT machine_id, agent, identity_hash AS h, min(first_activity)::DATE AS s, max(last_activity)::DATE AS e FROM sessions GROUP BY ALL) a
            JOIN (SELECT DISTINCT machine_id, agent, identity_hash AS h FROM sessions) b ON a.agent = b.agent AND a.h = b.h AND a.machine_id <> b.machine_id)
        GROUP BY 1, 2, 3) p
      JOIN (SELECT machine_id, agent, count(DISTINCT identity_hash) AS n1 FROM sessions GROUP BY ALL) c1 USING (machine_id, agent)
      JOIN (SELECT machine_id AS other_machine_id, agent, count(DISTINCT identity_hash) AS n2 FROM sessions GROUP BY ALL) c2 USING (other_machine_id, agent)"""),
    "raw_elsewhere": (("raw_files",), """
      SELECT f.import_id, f.machine_id, o.machine_id AS other_machine_id, o.import_id AS other_import_id FROM raw_files f
      JOIN raw_files o ON f.raw_sha256 = o.raw_sha256 AND f.machine_id <> o.machine_id AND o.status = 'processed'
      QUALIFY row_number() OVER (PARTITION BY f.import_id ORDER BY o.created_at, o.import_id) = 1"""),
    "chosen_links": (("document_daily", "evidence", "raw_elsewhere"), """
      SELECT * EXCLUDE (rn) FROM (
        SELECT a.machine_id, a.agent, a.usage_date, b.id AS canonical_observation_id, b.machine_id AS canonical_machine_id,
          CASE WHEN r.machine_id IS NOT NULL THEN 'exact_raw_snapshot' ELSE 'exact_daily_with_session_evidence' END AS reason,
          CASE WHEN r.machine_id IS NOT NULL THEN 0 ELSE v.exact_matches END AS matched_session_count,
          CASE WHEN r.machine_id IS NOT NULL THEN 1.0 ELSE v.exact_overlap_ratio END AS session_overlap_ratio,
          a.input_tokens AS reported_total_tokens,
          row_number() OVER (PARTITION BY a.machine_id, a.agent, a.usage_date ORDER BY (r.machine_id IS NULL),
            CASE WHEN r.machine_id IS NOT NULL THEN 0 ELSE v.exact_matches END DESC,
            CASE WHEN r.machine_id IS NOT NULL THEN 1.0 ELSE v.exact_overlap_ratio END DESC, b.machine_id) AS rn
        FROM document_daily a JOIN document_daily b ON a.agent = b.agent AND a.usage_date = b.usage_date
          AND a.input_tokens = b.input_tokens AND a.machine_id <> b.machine_id
        LEFT JOIN (SELECT DISTINCT machine_id, other_machine_id FROM raw_elsewhere) r
          ON r.machine_id = a.machine_id AND r.other_machine_id = b.machine_id
        LEFT JOIN evidence v ON v.machine_id = a.machine_id AND v.other_machine_id = b.machine_id AND v.agent = a.agent
          AND v.exact_matches >= 1 AND v.exact_overlap_ratio >= 0.02 AND a.usage_date BETWEEN v.evidence_start AND v.evidence_end
        WHERE r.machine_id IS NOT NULL OR v.machine_id IS NOT NULL) WHERE rn = 1"""),
    "recovered_agents": ((), """
      SELECT 'set-' || year(o_orderdate) AS set_id, date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS agent,
        sum(floor(o_totalprice)::BIGINT)::BIGINT AS input_tokens, sum(o_custkey % 1000)::BIGINT AS output_tokens, 0::BIGINT AS cache_creation_tokens,
        sum(o_orderkey % 100)::BIGINT AS cache_read_tokens, sum(o_totalprice::DECIMAL(18,2)) AS reported_cost_usd
      FROM orders GROUP BY ALL"""),
    "recovered": (("recovered_agents",), """
      SELECT *, input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens AS total_tokens FROM (
        SELECT * FROM recovered_agents UNION ALL
        SELECT set_id, month, 'All', (sum(input_tokens) + CASE WHEN month(month) % 5 = 0 THEN 1 ELSE 0 END)::BIGINT, sum(output_tokens)::BIGINT, 0,
          sum(cache_read_tokens)::BIGINT, sum(reported_cost_usd) FROM recovered_agents GROUP BY set_id, month)"""),
    "recovered_sets": (("recovered",), """
      SELECT set_id, sum(input_tokens)::BIGINT AS total_input_tokens, sum(total_tokens)::BIGINT AS total_tokens, sum(reported_cost_usd) AS reported_cost_usd,
        CASE WHEN substr(set_id, 5, 4)::INTEGER % 2 = 0 THEN 'evidence_only_non_additive' ELSE 'additive_recovered' END AS accounting_mode,
        substr(set_id, 5, 4)::INTEGER % 3 <> 0 AS pricing_complete
      FROM recovered WHERE agent = 'All' GROUP BY set_id"""),
    "recovered_rows": (("recovered", "recovered_sets"), """
      SELECT r.month, 'recovered-machine' AS machine_id, 'recovered' AS source_kind, r.agent, r.input_tokens, r.output_tokens, r.cache_creation_tokens,
        r.cache_read_tokens, r.total_tokens, 0::BIGINT AS accounting_delta_tokens, r.reported_cost_usd::DECIMAL(38,12) AS reported_cost_usd,
        s.pricing_complete AS pricing_complete
      FROM recovered r JOIN recovered_sets s USING (set_id)
      WHERE s.accounting_mode = 'additive_recovered' AND (month(r.month) % 5 = 0) = (r.agent = 'All')"""),
    "u_daily": (("daily",), """
      SELECT usage_date, machine_id, 'canonical' AS source_kind, agent, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
        reported_total_tokens AS total_tokens, accounting_delta_tokens, reported_cost_usd, reported_cost_usd IS NOT NULL AS pricing_complete FROM daily"""),
    "u_models": (("model_daily",), """
      SELECT usage_date, machine_id, 'canonical' AS source_kind, agent, model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
        reported_total_tokens AS total_tokens, accounting_delta_tokens, reported_cost_usd, reported_cost_usd IS NOT NULL AS pricing_complete FROM model_daily"""),
    "u_open": (("u_daily", "u_models"), """
      SELECT * FROM (
        SELECT d.usage_date, d.machine_id, d.agent, d.source_kind,
          d.input_tokens - coalesce(m.i, 0) AS input_tokens, d.output_tokens - coalesce(m.o, 0) AS output_tokens,
          d.cache_creation_tokens - coalesce(m.c, 0) AS cache_creation_tokens, d.cache_read_tokens - coalesce(m.r, 0) AS cache_read_tokens,
          d.total_tokens - coalesce(m.t, 0) AS total_tokens, d.accounting_delta_tokens - coalesce(m.a, 0) AS accounting_delta_tokens,
          CASE WHEN m.agent IS NULL THEN d.reported_cost_usd WHEN m.p THEN d.reported_cost_usd - m.cost END AS reported_cost_usd,
          d.pricing_complete AND (CASE WHEN m.agent IS NULL THEN d.reported_cost_usd WHEN m.p THEN d.reported_cost_usd - m.cost END) IS NOT NULL AS pricing_complete
        FROM u_daily d LEFT JOIN (
          SELECT usage_date, machine_id, agent, sum(input_tokens)::BIGINT i, sum(output_tokens)::BIGINT o, sum(cache_creation_tokens)::BIGINT c,
            sum(cache_read_tokens)::BIGINT r, sum(total_tokens)::BIGINT t, sum(accounting_delta_tokens)::BIGINT a, sum(reported_cost_usd) cost,
            bool_and(pricing_complete) p FROM u_models GROUP BY 1, 2, 3) m USING (usage_date, machine_id, agent))
      WHERE input_tokens <> 0 OR output_tokens <> 0 OR cache_creation_tokens <> 0 OR cache_read_tokens <> 0 OR total_tokens <> 0 OR accounting_delta_tokens <> 0"""),
    "u_months": (("u_daily",), """
      SELECT date_trunc('month', usage_date)::DATE AS month, machine_id, 'canonical' AS source_kind, agent, sum(input_tokens)::BIGINT AS input_tokens,
        sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens,
        sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(total_tokens)::BIGINT AS total_tokens,
        sum(accounting_delta_tokens)::BIGINT AS accounting_delta_tokens, sum(reported_cost_usd)::DECIMAL(38,12) AS reported_cost_usd,
        bool_and(pricing_complete) AS pricing_complete
      FROM u_daily GROUP BY 1, 2, 4"""),
    "u_monthly": (("u_months", "recovered_rows"), "SELECT * FROM u_months UNION ALL BY NAME SELECT * FROM recovered_rows"),
    "u_tagged": (("u_models", "u_open", "recovered_rows"), """
      SELECT 'canonical-attributed' AS kind, * FROM u_models
      UNION ALL BY NAME SELECT 'canonical-unattributed' AS kind, * FROM u_open
      UNION ALL BY NAME SELECT 'recovered-unattributed' AS kind, * FROM recovered_rows"""),
    "contracts": ((), """
      SELECT 'c' || user_id AS contract_id, 'u' || user_id AS account, user_id,
        make_timestamp((1704067200 + (user_id % 48) * 3600) * 1000000) AS tracking_start, TIMESTAMP '2024-01-29 11:29:00' AS reset_at,
        '12:00' AS check_time, (user_id % 10)::DOUBLE / 100 AS baseline, 1.0::DOUBLE AS hard_limit, (user_id % 3) * 0.05::DOUBLE AS safety_reserve
      FROM (SELECT DISTINCT user_id FROM events)"""),
    "checkpoints": (("contracts",), """
      SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY ts)::INTEGER AS day,
        lead(ts, 1, reset_at) OVER (PARTITION BY contract_id ORDER BY ts) AS until,
        greatest(baseline, least(hard_limit - safety_reserve, baseline + ((hard_limit - safety_reserve) - baseline)
          * ((epoch_us(ts) - epoch_us(tracking_start))::DOUBLE / (epoch_us(reset_at) - epoch_us(tracking_start))::DOUBLE))) AS ceiling
      FROM (SELECT c.*, d.date::DATE AS date, (d.date + INTERVAL 12 HOUR - INTERVAL 1 HOUR) AS ts FROM contracts c,
          (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS date) d)
      WHERE ts > tracking_start AND ts < reset_at"""),
    "actuals": ((), """
      SELECT 'c' || user_id AS contract_id, ts::DATE AS date,
        CASE WHEN day(ts::DATE) % 6 <> 0 THEN floor(least(max(value), 120.0)) / 100 END AS actual
      FROM events GROUP BY user_id, ts::DATE"""),
    "filled": (("checkpoints", "actuals"), "SELECT c.*, a.actual FROM checkpoints c LEFT JOIN actuals a USING (contract_id, date)"),
    "tracker": (("filled",), """
      SELECT contract_id, reset_at, hard_limit, coalesce(max_by(actual, ts) FILTER (actual IS NOT NULL), any_value(baseline)) AS latest,
        CASE WHEN count(actual) > 0 THEN 'checkpoint' ELSE 'baseline' END AS source,
        (max(date) FILTER (actual IS NOT NULL)) AS latest_date, any_value(hard_limit - safety_reserve) AS planned_ceiling,
        max(ts) FILTER (ts <= TIMESTAMP '2024-01-16 12:10:00') AS required_ts,
        max_by(date, ts) FILTER (ts <= TIMESTAMP '2024-01-16 12:10:00') AS required_date,
        max_by(ceiling, ts) FILTER (ts <= TIMESTAMP '2024-01-16 12:10:00') AS required_ceiling,
        arg_max(coalesce(actual, -1), ts) FILTER (ts <= TIMESTAMP '2024-01-16 12:10:00') AS required_actual
      FROM filled GROUP BY contract_id, reset_at, hard_limit"""),
    "contract_imports": (("contracts",), """
      SELECT contract_id || '-' || n AS contract_id, account, user_id, n AS import_no, make_timestamp((1705276800 + n * 86400 + user_id) * 1000000) AS created_at,
        CASE WHEN n = 3 AND user_id % 4 = 0 THEN 'failed' ELSE 'processed' END AS status,
        CASE WHEN n = 0 THEN tracking_start - INTERVAL 30 DAY ELSE tracking_start END AS tracking_start,
        CASE WHEN n = 0 THEN TIMESTAMP '2023-12-30 11:29:00' ELSE reset_at END AS reset_at
      FROM contracts, (SELECT unnest([0, 1, 2, 3]) AS n)"""),
    "all_readings": ((), """
      SELECT 'u' || user_id AS account, event_id AS reading_id, ts AS observed_at, ts + to_seconds(event_id % 5) AS fetched_at,
        floor(value / 5)::BIGINT AS percent, CASE WHEN event_type = 'error' THEN 'rate-limited' ELSE 'ok' END AS status,
        date_trunc('month', ts + INTERVAL 1 MONTH) + to_seconds(event_id % 3 + CASE WHEN event_id % 11 = 0 THEN 90 ELSE 0 END) AS provider_resets_at
      FROM events"""),
    "readings": (("all_readings",), "SELECT *, percent::DOUBLE / 100 AS fraction FROM all_readings WHERE percent <= 100"),
    "polled": (("readings",), "SELECT * REPLACE ('a' || (reading_id % 7) AS account, floor(day(observed_at) / 6) AS fraction, 'ok' AS status) FROM readings"),
    "placed": (("readings", "checkpoints", "contracts"), """
      SELECT r.reading_id, r.account, r.observed_at, r.fraction, r.status AS reading_status, r.provider_resets_at, c.contract_id, c.tracking_start, c.reset_at,
        k.day, k.ts, coalesce(k.ceiling, c.baseline) AS active_ceiling
      FROM readings r JOIN contracts c ON c.account = r.account AND r.observed_at >= c.tracking_start AND r.observed_at < c.reset_at
      LEFT JOIN checkpoints k ON k.contract_id = c.contract_id AND r.observed_at >= k.ts AND r.observed_at < k.until"""),
    "compared": (("placed", "contracts", "checkpoints"), """
      SELECT *, CASE WHEN TIMESTAMP '2024-01-16 12:10:00' >= reset_at THEN 'RESET_REQUIRED' WHEN fraction IS NULL THEN 'SYNC_STALE'
          WHEN rolled THEN 'RESET_REQUIRED'
          WHEN fraction >= 1 OR reading_status = 'rate-limited' THEN 'LIMIT_EXCEEDED' WHEN age > 1800 THEN 'SYNC_STALE'
          WHEN fraction > active_ceiling THEN 'OVER_PACE'
          WHEN active_ceiling - fraction >= -1e-12 AND active_ceiling - fraction <= 0.02 + 1e-9 THEN 'NEAR_PLAN' ELSE 'ON_TRACK' END AS comparison_status
      FROM (
        SELECT c.contract_id, c.account, c.tracking_start, c.reset_at, a.date AS active_date, coalesce(a.ceiling, c.baseline) AS active_ceiling,
          n.ceiling AS next_ceiling, n.ts AS next_ts, l.fraction, l.reading_status, l.observed_at,
          greatest(0, (epoch_us(TIMESTAMP '2024-01-16 12:10:00') - epoch_us(l.observed_at)) / 1000000.0) AS age,
          coalesce(epoch(l.provider_resets_at) - epoch(p.provider_resets_at) > 60 AND
            (epoch_us(p.provider_resets_at) - epoch_us(l.observed_at) <= 60000000 OR epoch(l.provider_resets_at) - epoch(p.provider_resets_at) >= 86400), FALSE) AS rolled
        FROM contracts c
        LEFT JOIN (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY observed_at DESC, reading_id DESC) = 1) l USING (contract_id)
        LEFT JOIN (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY observed_at DESC, reading_id DESC) = 2) p USING (contract_id)
        LEFT JOIN (SELECT * FROM checkpoints WHERE ts <= TIMESTAMP '2024-01-16 12:10:00' QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY ts DESC) = 1) a USING (contract_id)
        LEFT JOIN (SELECT * FROM checkpoints WHERE ts > TIMESTAMP '2024-01-16 12:10:00' QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY ts) = 1) n USING (contract_id))"""),
    "export_files": (("event_usage",), """
      SELECT DISTINCT machine_id || '/' || date_trunc('week', usage_date)::DATE::VARCHAR AS file_id, machine_id, date_trunc('week', usage_date)::DATE AS week,
        CASE WHEN machine_id = 'm2' AND day(date_trunc('week', usage_date)::DATE) = 8 THEN 'rows do not reconcile with totals'
          WHEN machine_id = 'm3' AND day(date_trunc('week', usage_date)::DATE) = 15 THEN 'malformed document'
          WHEN machine_id = 'm4' AND day(date_trunc('week', usage_date)::DATE) = 22 THEN 'unsupported shape' END AS reason
      FROM event_usage"""),
}


def _needed(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needed(VIEWS[name][0], seen)
            seen.append(name)
    return seen


def with_views(*names: str, body: str) -> str:
    """`body` behind the named views; a body that starts with its own WITH list keeps it."""
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in _needed(names, [])]
    if not parts:
        return body
    own = body.lstrip()
    opening = next((o for o in ("WITH RECURSIVE ", "WITH ") if own.startswith(o)), None)
    if opening is None:
        return "WITH " + ",\n".join(parts) + "\n" + body
    return opening + ",\n".join(parts) + ",\n" + own[len(opening):]
