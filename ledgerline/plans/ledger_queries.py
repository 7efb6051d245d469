"""Queries of sources, normalisation, revisions, change classification and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.config import LIMITS
from ledgerline.functions import dates, numbers, text
from ledgerline.functions.fingerprints import FIVE_COUNTERS
from ledgerline.operators import checks, diff, imports, normalize, revisions
from ledgerline.plans import views as v
from ledgerline.plans.oracles import DAILY_HASH
from ledgerline.plans.registry import day, moment, money, query
from ledgerline.session import materialized
from ledgerline.sources import sinks, snapshots, tables

FIVE = ", ".join(FIVE_COUNTERS)


# Sources and sinks

@query("a02_a05_readable_files", sql="""
  SELECT source AS machine_id, (CASE WHEN strlen(text) > 3000 THEN 'file too large' ELSE 'readable' END) AS verdict, count(*) AS files
  FROM documents GROUP BY ALL""")
def readable_files(spark, d):
    files = v.table(spark, d, "documents").select(
        F.col("source").alias("machine_id"), F.col("text").cast("binary").alias("content"), F.octet_length("text").alias("file_size_bytes"))
    good, bad = snapshots.split_readable(files, max_bytes=3000)
    both = good.select("machine_id", F.lit("readable").alias("verdict")).unionByName(bad.select("machine_id", F.col("reason").alias("verdict")))
    return both.groupBy("machine_id", "verdict").agg(F.count(F.lit(1)).alias("files"))


@query("a03_raw_fingerprint", sql="SELECT doc_id AS import_id, sha256(text) AS raw_sha256 FROM documents")
def raw_fingerprint(spark, d):
    files = v.table(spark, d, "documents").select(F.col("doc_id").alias("import_id"), F.col("text").cast("binary").alias("content"))
    return snapshots.fingerprint_files(files).select("import_id", "raw_sha256")


@query("a06_active_machines", ("machines",), "SELECT machine_id, name FROM machines WHERE is_active")
def active_machines(spark, d):
    return tables.active_machines(v.machines(spark, d)).select("machine_id", "name")


@query("a07_current_by_date", ("current_daily",), f"SELECT {day('usage_date')}, machine_id, agent, reported_total_tokens FROM current_daily")
def current_by_date(spark, d):
    return tables.by_date(revisions.current_daily(v.daily_observations(spark, d), v.imports(spark, d))).select(
        "usage_date", "machine_id", "agent", "reported_total_tokens")


@query("a08_recovered_rows", ("recovered",), f"""
  SELECT set_id, {day('month')}, agent, total_tokens, {money('reported_cost_usd')} FROM recovered WHERE set_id = 'set-1997'""")
def recovered_rows(spark, d):
    return tables.recovered_rows(v.recovered(spark, d), "set-1997").select("set_id", "month", "agent", "total_tokens", "reported_cost_usd")


@query("a08_newest_set", ("recovered_sets",), f"""
  SELECT set_id, total_tokens, accounting_mode, FALSE AS text_shown FROM recovered_sets ORDER BY substr(set_id, 5, 4)::INTEGER % 5 DESC, set_id DESC LIMIT 1""")
def newest_set(spark, d):
    """The newest set's header, without the raw text it was recovered from."""
    sets = v.recovered_sets(v.recovered(spark, d)).withColumns({"created_at": F.substring("set_id", 5, 4).cast("int") % 5, "raw_text": F.lit("as it was found")})
    newest = tables.newest_recovered_set(sets)
    return newest.select("set_id", "total_tokens", "accounting_mode").withColumn("text_shown", F.lit("raw_text" in newest.columns))


@query("a05_workbook_sizes", sql=f"""
  SELECT doc_id, CASE WHEN strlen(text) * 512 > {LIMITS.max_workbook_bytes} THEN 'file too large' WHEN strlen(text) = 0 THEN 'empty file' ELSE 'readable' END AS verdict
  FROM documents WHERE text IS NOT NULL""")
def workbook_sizes(spark, d):
    """Documents as workbooks of 512 bytes a byte of text, under the workbooks' bound."""
    files = v.table(spark, d, "documents").filter("text IS NOT NULL").select(
        "doc_id", F.col("text").cast("binary").alias("content"), (F.octet_length("text") * F.lit(512).cast("bigint")).alias("file_size_bytes"))
    good, bad = snapshots.split_readable(files, max_bytes=LIMITS.max_workbook_bytes)
    return good.select("doc_id", F.lit("readable").alias("verdict")).unionByName(bad.select("doc_id", F.col("reason").alias("verdict")))


@query("a11_insert_ignore", ("daily", "incoming_daily"), f"""
  SELECT i.machine_id, i.agent, {day('i.usage_date')}, i.reported_total_tokens FROM incoming_daily i
  ANTI JOIN daily d USING (machine_id, agent, usage_date)""")
def insert_ignore(spark, d):
    return imports.insert_ignore(v.incoming_daily(spark, d), v.daily(spark, d), revisions.DAILY_KEYS).select(
        *revisions.DAILY_KEYS, "reported_total_tokens")


@query("a12_upserted", ("daily", "incoming_daily"), f"""
  SELECT machine_id, agent, {day('usage_date')}, coalesce(i.usage_hash, d.usage_hash) AS usage_hash
  FROM daily d FULL JOIN incoming_daily i USING (machine_id, agent, usage_date)""")
def upserted(spark, d):
    keep = [*revisions.DAILY_KEYS, "usage_hash"]
    return sinks.upserted(v.daily(spark, d).select(keep), v.incoming_daily(spark, d).select(keep), revisions.DAILY_KEYS)


# Snapshot normalisation, on exports built from the events

@v.once_per_session
def _parsed(spark, d):
    return normalize.parse_snapshots(v.exports(spark, d), ("file_id", "machine_id"))


@query("b01_b20_rejected_files", ("export_files",), "SELECT file_id, reason FROM export_files WHERE reason IS NOT NULL")
def rejected_files(spark, d):
    return _parsed(spark, d).rejects.select("file_id", F.explode("reasons").alias("reason"))


_ACCEPTED = "SELECT machine_id, week FROM export_files WHERE reason IS NULL"
_WEEK = "date_trunc('week', usage_date)::DATE"


@query("b02_b16_daily_rows", ("daily", "export_files"), f"""
  SELECT machine_id || '/' || {_WEEK}::VARCHAR AS file_id, agent, {day('usage_date')}, {FIVE}, accounting_delta_tokens,
    {money('reported_cost_usd')}, usage_hash
  FROM daily WHERE (machine_id, {_WEEK}) IN ({_ACCEPTED})""")
def daily_rows(spark, d):
    return _parsed(spark, d).daily.select("file_id", "agent", "usage_date", *FIVE_COUNTERS, "accounting_delta_tokens",
                                          "reported_cost_usd", "usage_hash")


@query("b03_model_rows", ("event_usage", "export_files"), f"""
  SELECT machine_id || '/' || {_WEEK}::VARCHAR AS file_id, agent, model, {day('usage_date')},
    sum(input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens + accounting_delta_tokens)::BIGINT AS reported_total_tokens,
    sum(reported_cost_usd)::DECIMAL(20,2)::VARCHAR AS reported_cost_usd
  FROM event_usage WHERE (machine_id, {_WEEK}) IN ({_ACCEPTED}) AND day(usage_date) % 10 <> 0 GROUP BY machine_id, agent, model, event_usage.usage_date""")
def model_rows(spark, d):
    return _parsed(spark, d).models.select("file_id", "agent", "model", "usage_date", "reported_total_tokens", "reported_cost_usd")


@query("b18_warnings", ("daily", "export_files"), f"""
  SELECT machine_id || '/' || {_WEEK}::VARCHAR AS file_id, 'no model breakdown for ' || agent || ' on ' || usage_date::VARCHAR AS warning
  FROM daily WHERE (machine_id, {_WEEK}) IN ({_ACCEPTED}) AND day(usage_date) % 10 = 0
  UNION ALL SELECT file_id, 'no session section' FROM export_files WHERE reason IS NULL""")
def warnings(spark, d):
    return _parsed(spark, d).summary.select("file_id", F.explode("warnings").alias("warning"))


@query("b19_parse_summary", ("daily", "export_files"), f"""
  SELECT machine_id || '/' || {_WEEK}::VARCHAR AS file_id, min(usage_date)::VARCHAR AS scope_start, max(usage_date)::VARCHAR AS scope_end,
    string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents, count(*) AS daily_rows, sum(reported_total_tokens)::BIGINT AS reported_total_tokens,
    'unified-daily' AS source_shape
  FROM daily WHERE (machine_id, {_WEEK}) IN ({_ACCEPTED}) GROUP BY machine_id, {_WEEK}""")
def parse_summary(spark, d):
    return _parsed(spark, d).summary.select("file_id", "scope_start", "scope_end", "agents", "daily_rows", "reported_total_tokens", "source_shape")


@query("b04_b11_sessions", sql="""
  SELECT conv_id::VARCHAR AS session_id, 'agent-' || (conv_id % 3) AS agent, count(*) AS input_tokens, sum(length(text))::BIGINT AS output_tokens,
    (count(*) + sum(length(text)))::BIGINT AS reported_total_tokens,
    strftime(make_timestamp((1704067200 + conv_id * 60) * 1000000), '%Y-%m-%d %H:%M:%S') AS first_activity,
    string_agg(DISTINCT role, ',' ORDER BY role) AS models FROM conversations GROUP BY conv_id""")
def session_rows(spark, d):
    """Conversations as the session sections of one export per conversation."""
    talk = v.table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"), F.collect_set("role").alias("roles"))
    counters = [F.lit(1).alias("inputTokens"), F.lit(0).alias("outputTokens"), F.lit(0).alias("cacheReadTokens"),
                F.lit(0).alias("cacheCreationTokens"), F.lit(1).alias("totalTokens")]
    session = F.struct(
        F.concat(F.lit(" "), F.col("conv_id").cast("string")).alias("session"),
        F.concat(F.lit("Agent-"), F.col("conv_id") % 3).alias("agent"), F.col("turns").alias("inputTokens"),
        F.col("chars").cast("string").alias("outputTokens"), F.lit(0).alias("cacheReadTokens"), F.lit("0").alias("cacheCreationTokens"),
        F.concat("roles", F.array(F.lit("USER"), F.lit(" "))).alias("models"),
        F.struct(F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("firstActivity")).alias("metadata"))
    day_row = F.struct(F.lit("2024-01-01").alias("date"), F.lit("agent-x").alias("agent"), *counters)
    doc = F.to_json(F.struct(F.lit("daily").alias("type"), F.array(day_row).alias("data"), F.struct(F.array(session).alias("sessions")).alias("sessionReport")))
    parsed = normalize.parse_snapshots(talk.select(F.col("conv_id").alias("file_id"), doc.alias("payload")))
    return parsed.sessions.select("session_id", "agent", "input_tokens", "output_tokens", "reported_total_tokens", "first_activity", "models")


@query("b05_b08_scalar_cleaning", sql="""
  SELECT event_id, floor(value * 0 + event_id)::BIGINT AS counter, NULL::BIGINT AS fractional,
    (CASE WHEN event_type = 'view' THEN NULL ELSE event_type END) AS agent, (value::DECIMAL(18,2))::DECIMAL(20,2)::VARCHAR AS cost FROM events""")
def scalar_cleaning(spark, d):
    e = v.table(spark, d, "events")
    name = F.when(F.col("event_type") == "view", "ALL").otherwise(F.concat(F.lit("\t "), F.upper("event_type"), F.lit(" ")))
    return e.select("event_id", numbers.counter(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".0"))).alias("counter"),
                    numbers.counter(F.concat(F.col("event_id").cast("string"), F.lit(".5"))).alias("fractional"),
                    text.agent_name(name).alias("agent"), numbers.cost(F.col("value").cast("string")).alias("cost"))


@query("b21_future_imports", ("imports",), """
  SELECT import_id FROM imports WHERE scope_end > timezone('Asia/Tokyo', timezone('UTC', TIMESTAMP '1997-12-31 23:30:00'))::DATE""")
def future_imports(spark, d):
    return checks.future_dated(v.imports(spark, d), F.lit("1997-12-31 23:30:00").cast("timestamp"), "Asia/Tokyo").select("import_id")


@query("b22_scope_regressions", ("imports",), f"""
  SELECT import_id, machine_id, {day('scope_end')} FROM imports i
  WHERE status = 'processing' AND scope_end < (SELECT max(scope_end) FROM imports p WHERE p.status = 'processed' AND p.machine_id = i.machine_id)""")
def scope_regressions(spark, d):
    rows = v.imports(spark, d)
    return checks.scope_regressions(rows.filter("status = 'processing'"), rows).select("import_id", "machine_id", "scope_end")


@query("b23_registry_rejects", ("imports", "machines"), """
  SELECT machine_id, 'unknown or inactive machine' AS reason, count(*) AS imports FROM imports
  WHERE machine_id NOT IN (SELECT machine_id FROM machines WHERE is_active) GROUP BY 1""")
def registry_rejects(spark, d):
    bad = checks.registry_rejects(v.imports(spark, d), v.machines(spark, d))
    return bad.groupBy("machine_id", "reason").agg(F.count(F.lit(1)).alias("imports"))


@query("b24_violations", ("imports",), """
  SELECT 'import file size' AS violation, count(*) AS rows FROM imports WHERE file_size_bytes > 300000 HAVING count(*) > 0""")
def violations(spark, d):
    rules = checks.import_rules()
    rules["import file size"] = F.col("file_size_bytes").isNull() | F.col("file_size_bytes").between(0, 300000)
    found = checks.violations(v.imports(spark, d), rules)
    return found.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("rows"))


@query("b24_daily_violations", ("daily",), """
  SELECT violation, count(*) AS rows FROM (
    SELECT 'counters not negative' AS violation FROM daily WHERE day(usage_date) % 7 = 0
    UNION ALL SELECT 'tombstone is zero' FROM daily WHERE agent = 'view'
    UNION ALL SELECT 'agent length' FROM daily WHERE agent = 'signup'
    UNION ALL SELECT 'hash format' FROM daily WHERE agent = 'click') GROUP BY 1""")
def daily_violations(spark, d):
    """The daily rows with some of them damaged, by day and agent."""
    agent = F.col("agent")
    damaged = v.daily(spark, d).withColumns({
        "input_tokens": F.when(F.dayofmonth("usage_date") % 7 == 0, -1).otherwise(F.col("input_tokens") + 1),
        "is_tombstone": agent == "view", "usage_hash": F.when(agent == "click", F.upper("usage_hash")).otherwise(F.col("usage_hash")),
        "agent": F.when(agent == "signup", "  ").otherwise(agent)})
    found = checks.violations(damaged, checks.daily_rules())
    return found.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("rows"))


@query("b24_contract_violations", ("contracts",), """
  SELECT contract_id, 'plan relations' AS violations FROM contracts WHERE baseline + 0.925 > hard_limit - safety_reserve""")
def contract_violations(spark, d):
    raised = v.contracts(spark, d).withColumns({
        "baseline": F.col("baseline") + 0.925, "planned_ceiling": F.col("hard_limit") - F.col("safety_reserve"), "status": F.lit("processed")})
    return checks.violations(raised, checks.contract_rules()).select("contract_id", "violations")


@query("b24_duplicate_keys", ("line_usage",), """
  SELECT machine_id, agent, usage_date::VARCHAR AS usage_date, count(*) AS rows FROM line_usage GROUP BY machine_id, agent, line_usage.usage_date HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    return checks.duplicate_keys(v.observations(spark, d), revisions.DAILY_KEYS)


# Revisions and audit

@query("c01_current_daily", ("current_daily",), f"""
  SELECT machine_id, agent, {day('usage_date')}, id, {FIVE}, {money('reported_cost_usd')}, usage_hash FROM current_daily""")
def current_daily(spark, d):
    # The stored rows would carry their fingerprint; here only the surviving revisions are fingerprinted.
    current = v.with_daily_hash(revisions.current_daily(v.promoted(spark, d)))
    return current.select(
        "machine_id", "agent", "usage_date", "id", *FIVE_COUNTERS, "reported_cost_usd", "usage_hash")


@query("c02_current_models", ("current_models",), f"""
  SELECT machine_id, agent, model, {day('usage_date')}, id, reported_total_tokens, usage_hash FROM current_models""")
def current_models(spark, d):
    return v.with_model_hash(revisions.current_models(v.observations(spark, d), v.imports(spark, d))).select(
        "machine_id", "agent", "model", "usage_date", "id", "reported_total_tokens", "usage_hash")


def _flagged(spark, d):
    """The current rows are read from both ends of a link, so they are ranked once and written."""
    current = materialized(revisions.current_daily(v.promoted(spark, d)).select("id", "machine_id", "agent", "usage_date"), "current")
    return revisions.with_mirror_flag(current, v.current_links(spark, d, current))


@query("c03_mirror_flag", ("flagged_daily",), f"""
  SELECT machine_id, agent, {day('usage_date')}, id, global_duplicate, canonical_machine_id FROM flagged_daily""")
def mirror_flag(spark, d):
    return _flagged(spark, d).select("machine_id", "agent", "usage_date", "id", "global_duplicate", "canonical_machine_id")


@query("c04_model_mirror_flag", ("current_models", "flagged_daily"), f"""
  SELECT m.machine_id, m.agent, m.model, {day('m.usage_date')}, coalesce(d.global_duplicate, FALSE) AS global_duplicate
  FROM current_models m LEFT JOIN flagged_daily d ON d.machine_id = m.machine_id AND d.agent = m.agent AND d.usage_date = m.usage_date""")
def model_mirror_flag(spark, d):
    models = revisions.current_models(v.model_observations(spark, d), v.imports(spark, d))
    return revisions.models_with_mirror_flag(models, _flagged(spark, d)).select("machine_id", "agent", "model", "usage_date", "global_duplicate")


@query("c05_collection_watermark", ("imports", "machines"), """
  SELECT m.machine_id, (max(i.scope_end) FILTER (i.status = 'processed'))::VARCHAR AS last_scope_end
  FROM machines m LEFT JOIN imports i USING (machine_id) WHERE m.is_active GROUP BY 1""")
def collection_watermark(spark, d):
    return imports.collection_watermark(v.machines(spark, d), v.imports(spark, d))


_EVIDENCE_STATE = """
  SELECT m.machine_id, count(DISTINCT s.identity_hash) AS session_count, count(DISTINCT s.mirror_hash) AS mirror_fingerprint_count,
    strftime(max(s.created_at), '%Y-%m-%d %H:%M:%S') AS last_session_evidence_at
  FROM (SELECT DISTINCT machine_id FROM raw_files UNION SELECT 'idle') m LEFT JOIN sessions s USING (machine_id)
  LEFT JOIN raw_files i ON i.import_id = s.import_id AND i.status = 'processed'
  WHERE s.import_id IS NULL OR i.import_id IS NOT NULL GROUP BY 1"""


@query("c06_session_evidence_state", ("raw_files", "sessions"), _EVIDENCE_STATE)
def session_evidence_state(spark, d):
    files = v.raw_files(spark, d)
    known = files.select("machine_id").union(spark.sql("SELECT 'idle'")).distinct()
    return imports.session_evidence_state(known, v.sessions(spark, d), files)


@v.once_per_session
def _promotion(spark, d):
    rows = v.daily_observations(spark, d)
    stored = rows.filter("machine_id = 'm1'")
    models = v.model_observations(spark, d)
    return imports.promote(v.imports(spark, d), F.lit("2001-11-01 00:00:00").cast("timestamp"), rows, stored, models, models.filter("machine_id = 'm1'"))


@query("c07_c09_promotion_counts", ("observations", "model_observations", "imports"), """
  SELECT i.import_id, coalesce(d.n, 0)::BIGINT AS inserted_rows, coalesce(m.n, 0)::BIGINT AS inserted_model_rows FROM imports i
  LEFT JOIN (SELECT import_id, count(DISTINCT (agent, usage_date)) AS n FROM observations WHERE machine_id <> 'm1' GROUP BY 1) d USING (import_id)
  LEFT JOIN (SELECT import_id, count(DISTINCT (agent, model, usage_date)) AS n FROM model_observations WHERE machine_id <> 'm1' GROUP BY 1) m USING (import_id)
  WHERE i.status = 'processing'""")
def promotion_counts(spark, d):
    return _promotion(spark, d).counts


@query("c07_promoted_imports", ("imports",), """
  SELECT status, (processed_at IS NULL) AS open, count(*) AS imports FROM (
    SELECT 'processed' AS status, coalesce(processed_at, TIMESTAMP '2001-11-01') AS processed_at FROM imports) GROUP BY ALL""")
def promoted_imports(spark, d):
    return _promotion(spark, d).imports.groupBy("status", F.col("processed_at").isNull().alias("open")).agg(F.count(F.lit(1)).alias("imports"))


@query("c10_backfill_models", ("model_observations", "imports"), f"""
  SELECT import_id, agent, model, {day('usage_date')}, min(id) AS id, FALSE AS is_tombstone FROM model_observations o
  WHERE import_id IN (SELECT import_id FROM imports WHERE status = 'processed') AND machine_id <> 'm1' GROUP BY import_id, agent, model, o.usage_date""")
def backfill_models(spark, d):
    """The rows to add, of which the least id of a key stays."""
    rows = v.model_observations(spark, d)
    added = imports.backfill(v.imports(spark, d), rows, rows.filter("machine_id = 'm1'"), ["import_id", "agent", "model", "usage_date"], order=["id"])
    return added.select("import_id", "agent", "model", "usage_date", "id", "is_tombstone")


@query("c11_backfill_sessions", ("sessions", "raw_files"), """
  SELECT import_id, local_key_hash, CASE WHEN import_id % 3 = 0 THEN 'stored' ELSE 'first run' END AS added FROM sessions JOIN raw_files f USING (import_id)
  WHERE import_id % 3 = 0 OR f.status = 'processed' AND f.machine_id = 'src3'""")
def backfill_sessions(spark, d):
    """A third of the sessions is stored; one machine's others are added, and a second run adds nothing."""
    rows = v.sessions(spark, d).select("import_id", "local_key_hash")
    stored = rows.filter("import_id % 3 = 0").withColumn("added", F.lit("stored"))
    for run in ("first run", "second run"):
        more = imports.backfill(v.raw_files(spark, d), rows, stored, ["import_id", "local_key_hash"], machine_id="src3")
        stored = materialized(stored.unionByName(more.withColumn("added", F.lit(run))), "sessions")
    return stored


@query("c12_exact_duplicates", ("raw_files",), """
  SELECT import_id, machine_id, rn > 1 AS is_exact_duplicate, CASE WHEN rn > 1 THEN first_id END AS duplicate_of_import_id FROM (
    SELECT import_id, machine_id, row_number() OVER w AS rn, first_value(import_id) OVER w AS first_id FROM raw_files
    WINDOW w AS (PARTITION BY machine_id, raw_sha256 ORDER BY created_at, import_id))""")
def exact_duplicates(spark, d):
    return imports.mark_exact_duplicates(v.raw_files(spark, d), ["machine_id", "raw_sha256"]).select(
        "import_id", "machine_id", "is_exact_duplicate", "duplicate_of_import_id")


@query("c13_same_content_elsewhere", ("raw_files", "raw_elsewhere"), """
  SELECT f.import_id, f.machine_id, r.other_machine_id, r.other_import_id FROM raw_files f LEFT JOIN raw_elsewhere r USING (import_id)""")
def same_content_elsewhere(spark, d):
    files = v.raw_files(spark, d)
    return imports.same_content_elsewhere(files.select("import_id", "machine_id", "raw_sha256"), files).select(
        "import_id", "machine_id", "other_machine_id", "other_import_id")


@query("c14_recover_stale", ("imports",), f"""
  SELECT import_id, CASE WHEN status = 'processing' AND created_at < TIMESTAMP '1998-06-01 00:10:00' - INTERVAL 15 MINUTE THEN 'failed' ELSE status END AS status,
    strftime(CASE WHEN status = 'processing' AND created_at < TIMESTAMP '1998-06-01 00:10:00' - INTERVAL 15 MINUTE THEN TIMESTAMP '1998-06-01 00:10:00'
      ELSE processed_at END, '%Y-%m-%d %H:%M:%S') AS processed_at FROM imports""")
def recover_stale(spark, d):
    return imports.recover_stale(v.imports(spark, d), F.lit("1998-06-01 00:10:00").cast("timestamp")).select("import_id", "status", "processed_at")


@query("c15_concurrent_processing", ("imports",), """
  SELECT machine_id, count(*) AS processing_imports FROM imports WHERE status = 'processing' GROUP BY 1 HAVING count(*) > 1""")
def concurrent_processing(spark, d):
    return imports.concurrent_processing(v.imports(spark, d), ["machine_id"])


@query("c16_recent_imports", ("imports",), f"""
  SELECT import_id, machine_id, status, {moment('created_at')} FROM (SELECT * FROM imports ORDER BY created_at DESC, import_id DESC LIMIT 20)""")
def recent_imports(spark, d):
    return imports.recent_imports(v.imports(spark, d), 20).select("import_id", "machine_id", "status", "created_at")


@query("c17_collection_hints", ("machines", "imports", "raw_files", "sessions"), f"""
  SELECT m.machine_id, m.name, w.last::VARCHAR AS last_scope_end, (w.last - 2)::VARCHAR AS next_since, coalesce(e.session_count, 0) AS session_count
  FROM machines m LEFT JOIN (SELECT machine_id, max(scope_end) FILTER (status = 'processed') AS last FROM imports GROUP BY 1) w USING (machine_id)
  LEFT JOIN ({_EVIDENCE_STATE}) e ON e.machine_id = replace(m.machine_id, 'm', 'src') WHERE m.is_active""")
def collection_hints(spark, d):
    machines = v.machines(spark, d)
    evidence = session_evidence_state(spark, d).withColumn("machine_id", F.regexp_replace("machine_id", "src", "m"))
    return imports.collection_hints(machines, imports.collection_watermark(machines, v.imports(spark, d)), evidence).select(
        "machine_id", "name", "last_scope_end", "next_since", "session_count")


@query("c18_import_summary", ("daily", "incoming_daily", "model_daily", "incoming_models"), """
  WITH ch AS (SELECT coalesce(i.machine_id, d.machine_id) AS machine_id, CASE WHEN i.usage_hash IS NULL THEN 'preserved' WHEN d.usage_hash IS NULL THEN 'new' WHEN d.usage_hash <> i.usage_hash THEN 'revised' ELSE 'unchanged' END AS t,
      coalesce(d.reported_total_tokens, 0) AS before, coalesce(i.reported_total_tokens, d.reported_total_tokens) AS after, i.reported_total_tokens AS incoming
      FROM incoming_daily i FULL JOIN daily d ON i.machine_id = d.machine_id AND i.agent = d.agent AND i.usage_date = d.usage_date),
    mc AS (SELECT i.machine_id, CASE WHEN d.usage_hash IS NULL THEN 'new' WHEN d.usage_hash <> i.usage_hash THEN 'revised' ELSE 'unchanged' END AS t
      FROM incoming_models i LEFT JOIN model_daily d USING (machine_id, agent, model, usage_date)),
    hidden AS (SELECT machine_id, count(*) AS n, sum(reported_total_tokens)::BIGINT AS tokens FROM incoming_daily WHERE agent = 'view' AND day(usage_date) % 3 = 0 GROUP BY 1)
  SELECT a.machine_id AS import_id, a.n AS "new", a.r AS revised, a.u AS unchanged, b.n AS model_new, b.r AS model_revised, a.total AS reported_total_tokens,
    coalesce(h.n, 0) AS rows_suppressed, coalesce(h.tokens, 0) AS duplicate_tokens_prevented, a.before AS before_total, a.after AS after_total, a.after - a.before AS net_change,
    h.n IS NOT NULL AS cross_machine_match, a.machine_id IN ('m1', 'm4') AS partial_mirror_risk
  FROM (SELECT machine_id, count(*) FILTER (t = 'new') n, count(*) FILTER (t = 'revised') r, count(*) FILTER (t = 'unchanged') u, sum(incoming)::BIGINT AS total,
      sum(before)::BIGINT AS before, sum(after)::BIGINT AS after FROM ch GROUP BY 1) a
  JOIN (SELECT machine_id, count(*) FILTER (t = 'new') n, count(*) FILTER (t = 'revised') r FROM mc GROUP BY 1) b USING (machine_id) LEFT JOIN hidden h USING (machine_id)""")
def import_summary(spark, d):
    """Each machine's later export as one import; some of its rows are hidden by links, some machines are at risk."""
    incoming = v.incoming_daily(spark, d)
    changes = diff.classify_changes(incoming, v.daily(spark, d)).withColumn("import_id", F.col("machine_id"))
    models = diff.classify_changes(v.incoming_models(spark, d), v.model_daily(spark, d), revisions.MODEL_KEYS).withColumn("import_id", F.col("machine_id"))
    parsed = incoming.groupBy(F.col("machine_id").alias("import_id")).agg(F.sum("reported_total_tokens").alias("reported_total_tokens"))
    links = incoming.filter("agent = 'view' AND dayofmonth(usage_date) % 3 = 0").select(F.col("machine_id").alias("import_id"), "reported_total_tokens")
    risk = parsed.select("import_id", F.col("import_id").isin("m1", "m4").alias("partial_mirror_risk"))
    return imports.import_summary(changes, models, parsed, links, risk).select(
        "import_id", "new", "revised", "unchanged", "model_new", "model_revised", "reported_total_tokens", "rows_suppressed", "duplicate_tokens_prevented",
        "before_total", "after_total", "net_change", "cross_machine_match", "partial_mirror_risk")


@query("c19_visible_imports", ("imports",), f"""
  SELECT import_id, machine_id, {moment('created_at')} FROM (SELECT * FROM imports WHERE machine_id = 'm2' ORDER BY created_at DESC, import_id DESC LIMIT 3)""")
def visible_imports(spark, d):
    return imports.visible_imports(v.imports(spark, d), "m2").select("import_id", "machine_id", "created_at")


@query("c19_latest_processed", ("imports",), f"""
  SELECT import_id, {moment('processed_at')} FROM (SELECT * FROM imports WHERE status = 'processed' ORDER BY created_at DESC, import_id DESC LIMIT 1)""")
def latest_processed(spark, d):
    return imports.latest_processed(v.imports(spark, d))


# Change classification

_CHANGE = """CASE WHEN i.usage_hash IS NULL THEN {absent} WHEN d.usage_hash IS NULL THEN 'new'
    WHEN d.usage_hash <> i.usage_hash THEN 'revised' ELSE 'unchanged' END"""


def _changes(spark, d, removal=False):
    return diff.classify_changes(v.incoming_daily(spark, d), v.daily(spark, d), allow_removal=removal)


@query("d01_classify_daily", ("daily", "incoming_daily"), f"""
  SELECT machine_id, agent, {day('usage_date')}, {_CHANGE.format(absent="'preserved'")} AS change_type, coalesce(d.reported_total_tokens, 0) AS before_tokens,
    coalesce(i.reported_total_tokens, d.reported_total_tokens) AS after_tokens
  FROM daily d FULL JOIN incoming_daily i USING (machine_id, agent, usage_date)""")
def classify_daily(spark, d):
    return _changes(spark, d).drop("incoming")


_REMOVED = """(SELECT machine_id, min(usage_date) AS s, max(usage_date) AS e FROM incoming_daily GROUP BY 1)"""


@query("d02_removal_opt_in", ("daily", "incoming_daily"), f"""
  SELECT machine_id, {_CHANGE.format(absent="CASE WHEN usage_date BETWEEN s AND e THEN 'removed' ELSE 'preserved' END")} AS change_type, count(*) AS rows
  FROM daily d FULL JOIN incoming_daily i USING (machine_id, agent, usage_date) JOIN {_REMOVED} c USING (machine_id) GROUP BY ALL""")
def removal_opt_in(spark, d):
    return _changes(spark, d, True).groupBy("machine_id", "change_type").agg(F.count(F.lit(1)).alias("rows"))


@query("d03_change_summary", ("daily", "incoming_daily"), """
  SELECT machine_id, count(*) FILTER (i.usage_hash IS NOT NULL AND d.usage_hash IS NULL) AS new_rows,
    count(*) FILTER (i.usage_hash <> d.usage_hash) AS revised_rows, coalesce(sum(d.reported_total_tokens), 0)::BIGINT AS before_total,
    sum(coalesce(i.reported_total_tokens, d.reported_total_tokens))::BIGINT AS after_total,
    (sum(coalesce(i.reported_total_tokens, d.reported_total_tokens)) - coalesce(sum(d.reported_total_tokens), 0))::BIGINT AS net_change
  FROM daily d FULL JOIN incoming_daily i USING (machine_id, agent, usage_date) GROUP BY 1""")
def change_summary(spark, d):
    return diff.change_summary(_changes(spark, d), ["machine_id"]).drop("unchanged_rows", "removed_rows")


@query("d04_classify_models", ("model_daily", "incoming_models"), f"""
  SELECT machine_id, agent, model, {day('usage_date')}, {_CHANGE.format(absent="'preserved'")} AS change_type
  FROM model_daily d FULL JOIN incoming_models i USING (machine_id, agent, model, usage_date)""")
def classify_models(spark, d):
    return diff.classify_changes(v.incoming_models(spark, d), v.model_daily(spark, d), revisions.MODEL_KEYS).drop(
        "incoming", "before_tokens", "after_tokens")


@query("d05_coverage", ("incoming_daily",), """
  SELECT machine_id, least(min(usage_date), DATE '2024-01-01')::VARCHAR AS scope_start, max(usage_date)::VARCHAR AS scope_end FROM incoming_daily GROUP BY 1""")
def coverage(spark, d):
    return diff.coverage(v.incoming_daily(spark, d)).withColumn(
        "scope_start", diff.widened_start(F.col("scope_start"), F.lit("2024-01-01").cast("date")))


@query("d06_rows_to_write", ("daily", "incoming_daily"), f"""
  SELECT machine_id, agent, {day('usage_date')}, is_tombstone, reported_total_tokens, usage_hash FROM (
    SELECT i.machine_id, i.agent, i.usage_date, FALSE AS is_tombstone, i.reported_total_tokens, i.usage_hash FROM incoming_daily i
      LEFT JOIN daily d USING (machine_id, agent, usage_date) WHERE d.usage_hash IS NULL OR d.usage_hash <> i.usage_hash
    UNION ALL
    SELECT machine_id, agent, usage_date, TRUE, 0, {DAILY_HASH} FROM (
      SELECT d.machine_id, d.agent, d.usage_date, 0 AS input_tokens, 0 AS output_tokens, 0 AS cache_read_tokens, 0 AS cache_creation_tokens,
        0 AS reported_total_tokens, NULL::DECIMAL(38,12) AS reported_cost_usd, TRUE AS is_tombstone
      FROM daily d ANTI JOIN incoming_daily i USING (machine_id, agent, usage_date) JOIN {_REMOVED} c ON c.machine_id = d.machine_id AND d.usage_date BETWEEN s AND e))""")
def rows_to_write(spark, d):
    return diff.rows_to_write(_changes(spark, d, True)).select("machine_id", "agent", "usage_date", "is_tombstone", "reported_total_tokens", "usage_hash")


# Fingerprints

@query("h01_daily_hash", ("daily",), f"SELECT machine_id, agent, {day('usage_date')}, usage_hash FROM daily")
def daily_hash(spark, d):
    return v.daily(spark, d).select("machine_id", "agent", "usage_date", "usage_hash")


@query("h02_model_hash", ("model_daily",), f"SELECT machine_id, agent, model, {day('usage_date')}, usage_hash FROM model_daily")
def model_hash(spark, d):
    return v.model_daily(spark, d).select("machine_id", "agent", "model", "usage_date", "usage_hash")


@query("h03_session_hashes", ("sessions",), """
  SELECT import_id, local_key_hash, identity_hash, mirror_hash,
    sha256(concat_ws('|', 'session-observation-v1', local_key_hash, mirror_hash, 'null')) AS session_hash FROM sessions""")
def session_hashes(spark, d):
    return v.sessions(spark, d).select("import_id", "local_key_hash", "identity_hash", "mirror_hash", "session_hash")


# Scalar functions

@query("k01_k04_scalars", sql="""
  SELECT event_id, value AS number, NULL::DOUBLE AS not_a_number, strftime(ts, '%Y-%m') AS month, date_trunc('month', ts)::DATE::VARCHAR AS month_start,
    date_trunc('week', ts)::DATE::VARCHAR AS week_start, strftime(ts, '%Y%m%d') AS compact, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def scalars(spark, d):
    date = F.col("ts").cast("date")
    return v.table(spark, d, "events").select(
        "event_id", numbers.safe_number(F.col("value").cast("string")).alias("number"), numbers.safe_number(F.lit("1x")).alias("not_a_number"),
        dates.month_key(date).alias("month"), dates.month_start(date).alias("month_start"), dates.week_start(date).alias("week_start"),
        dates.compact_date(date).alias("compact"), F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("k03_arrays", sql="""
  SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS models, FALSE AS has_empty FROM conversations GROUP BY 1""")
def arrays(spark, d):
    roles = F.concat(F.collect_list(F.upper("role")), F.array(F.lit(" ")))
    return v.table(spark, d, "conversations").groupBy("conv_id").agg(text.model_list(F.collect_set("role")).alias("models")).withColumn(
        "has_empty", F.array_contains("models", ""))
