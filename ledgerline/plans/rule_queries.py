"""Queries in which every rule and every reason to refuse occurs, on damaged rows of the views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.operators import checks, normalize
from ledgerline.plans import views as v
from ledgerline.plans.registry import day, query
from ledgerline.session import materialized


def _damaged(rows: DataFrame, number: Column, damage: dict[int, dict[str, Column]]) -> DataFrame:
    """Rows whose number modulo the count of damages is k take the k-th one."""
    for k, columns in damage.items():
        rows = rows.withColumns({c: F.when(number == k, value).otherwise(F.col(c)) for c, value in columns.items()})
    return rows


#: Table and number of rows by which damages are dealt, as SQL over the given tables; then the rule that each number breaks.
_DEALT = {
    "machines": ("SELECT n_nationkey % 7 AS k FROM nation", {0: "machine id", 1: "machine name"}),
    "imports": ("SELECT o_orderkey % 11 AS k FROM orders", {0: "import status", 1: "import file size", 2: "import hash", 3: "import scope order"}),
    "daily": ("SELECT day(usage_date) % 11 AS k FROM daily", {0: "agent length", 1: "counters not negative", 2: "cost not negative", 3: "hash format", 4: "tombstone is zero"}),
    "models": ("SELECT day(usage_date) % 11 AS k FROM model_daily", {0: "agent length", 1: "counters not negative", 2: "cost not negative", 3: "hash format", 4: "tombstone is zero", 5: "model length"}),
    "sessions": ("SELECT doc_id % 11 AS k FROM documents", {0: "agent length", 1: "session id length", 2: "counters not negative", 3: "cost not negative", 4: "activity order", 5: "hash format"}),
    "links": ("SELECT event_id % 11 AS k FROM events", {0: "link reason", 1: "match count not negative", 2: "overlap ratio", 3: "link not to itself"}),
    "recovered": ("SELECT CASE agent WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END AS k FROM recovered",
                  {0: "month normalised", 1: "agent length", 2: "counters not negative", 3: "total is the sum", 4: "cost not negative", 5: "model names"}),
    "recovered sets": ("SELECT substr(set_id, 5, 4)::BIGINT % 7 AS k FROM recovered_sets", {0: "accounting mode", 1: "total is the sum", 2: "cost not negative", 3: "source machine count", 4: "confidence", 5: "granularity"}),
    "contracts": ("SELECT user_id % 7 AS k FROM contracts", {0: "contract status", 1: "plan relations", 2: "reset after start", 3: "processed is complete"}),
    "readings": ("SELECT event_id % 11 AS k FROM events", {0: "fraction in range", 1: "status length", 2: "fetch duration"}),
    "names": ("SELECT c_custkey % 7 AS k FROM customer", {0: "empty name", 1: "name too long", 2: "control characters in name"}),
    "commands": ("SELECT c_custkey % 7 AS k FROM customer", {0: "command too long", 1: "control characters in command"}),
}
_RULES_SQL = " UNION ALL ".join(
    f"SELECT '{table}' AS checked, '{rule}' AS rule, count(*) FILTER (k = {k}) AS violations FROM ({rows})" for table, (rows, rules) in _DEALT.items() for k, rule in rules.items())


def _checked_tables(spark, d) -> dict[str, tuple[DataFrame, dict[str, Column]]]:
    """The ledger's tables with damaged rows, and the rules of each."""
    text, null = F.lit, lambda kind: F.lit(None).cast(kind)
    bad_hash = F.lit("not a hash")
    usage = {0: {"agent": text("  ")}, 1: {"input_tokens": F.lit(-1)}, 2: {"reported_cost_usd": F.lit(-1)}, 3: {"usage_hash": bad_hash}, 4: {"is_tombstone": F.lit(True)}}
    by_day = F.dayofmonth("usage_date") % 11
    orders = v.imports(spark, d)
    machines = v.machines(spark, d).withColumn("k", F.regexp_replace("machine_id", "m", "").cast("int") % 7).withColumn("machine_id", F.concat(F.lit("pc-"), "machine_id"))
    sessions = v.sessions(spark, d).withColumn("agent", F.coalesce("agent", F.lit("a")))
    events = v.table(spark, d, "events").select((F.col("event_id") % 11).alias("k"), F.lit("exact_raw_snapshot").alias("reason"), F.lit(1).alias("matched_session_count"),
                                                F.lit(0.5).alias("session_overlap_ratio"), F.lit("a").alias("observation_id"), F.lit("b").alias("canonical_observation_id"))
    recovered = v.recovered(spark, d)
    agents = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}
    of_agent = F.coalesce(reduce(lambda c, x: c.when(F.col("agent") == x[0], x[1]), list(agents.items())[1:], F.when(F.col("agent") == "1-URGENT", 0)), F.lit(5))
    sets = v.recovered_sets(recovered).withColumns({"k": F.substring("set_id", 5, 4).cast("int") % 7, "source_machine_count": F.lit(1),
                                                    "confidence": F.lit("exact_monthly_aggregate"), "granularity": F.lit("monthly_agent")})
    contracts = v.contracts(spark, d).withColumns({"k": F.substring("account", 2, 20).cast("bigint") % 7, "status": F.lit("processed"),
                                                   "planned_ceiling": F.col("hard_limit") - F.col("safety_reserve")})
    readings = v.table(spark, d, "events").select((F.col("event_id") % 11).alias("k"), F.lit(0.5).alias("fraction"), F.lit("ok").alias("status"), F.lit(9).alias("fetch_duration_ms"))
    names = v.table(spark, d, "customer").select((F.col("c_custkey") % 7).alias("k"), F.col("c_name").alias("name"), F.concat(F.lit("usage\t--since\n"), "c_name").alias("command"))
    k = F.col("k")
    less = F.col("input_tokens") + F.col("total_tokens") * 0
    return {
        "machines": (_damaged(machines, k, {0: {"machine_id": text("M 1")}, 1: {"name": text("  ")}}), checks.machine_rules()),
        "imports": (_damaged(orders.withColumn("k", F.col("import_id") % 11), k, {
            0: {"status": text("gone")}, 1: {"file_size_bytes": F.lit(-1)}, 2: {"raw_sha256": bad_hash}, 3: {"scope_start": F.date_add("scope_end", 1)}}), checks.import_rules()),
        "daily": (_damaged(v.daily(spark, d).withColumns({"k": by_day, "input_tokens": F.col("input_tokens") + 1}), k, usage), checks.daily_rules()),
        "models": (_damaged(v.model_daily(spark, d).withColumns({"k": by_day, "input_tokens": F.col("input_tokens") + 1}), k, usage | {5: {"model": text("")}}), checks.model_rules()),
        "sessions": (_damaged(sessions.withColumn("k", F.col("import_id") % 11), k, {
            0: {"agent": text("")}, 1: {"session_id": text(" ")}, 2: {"input_tokens": F.lit(-1)}, 3: {"reported_cost_usd": F.lit(-1)},
            4: {"first_activity": F.lit("2024-02-02").cast("timestamp"), "last_activity": F.lit("2024-02-01").cast("timestamp")}, 5: {"mirror_hash": bad_hash}}), checks.session_rules()),
        "links": (_damaged(events, k, {0: {"reason": text("looks alike")}, 1: {"matched_session_count": F.lit(-1)}, 2: {"session_overlap_ratio": F.lit(1.5)},
                                       3: {"canonical_observation_id": text("a")}}), checks.link_rules()),
        "recovered": (_damaged(recovered.withColumn("k", of_agent), k, {
            0: {"month": F.date_add("month", 3)}, 1: {"agent": text("")}, 2: {"total_tokens": F.col("total_tokens") - less - 1, "input_tokens": F.lit(-1)},
            3: {"total_tokens": F.col("total_tokens") + 1}, 4: {"reported_cost_usd": F.lit(-1)}, 5: {"models": F.array(F.lit("gamma"), null("string"))}}), checks.recovered_rules()),
        "recovered sets": (_damaged(sets, k, {
            0: {"accounting_mode": text("guess")}, 1: {"total_tokens": F.col("total_tokens") + 1}, 2: {"reported_cost_usd": F.lit(-1)}, 3: {"source_machine_count": F.lit(0)},
            4: {"confidence": text("estimate")}, 5: {"granularity": text("daily")}}), {**checks.recovered_set_rules(), **checks.recovered_origin_rules()}),
        "contracts": (_damaged(contracts, k, {0: {"status": text("open")}, 1: {"baseline": F.col("hard_limit") + 1}, 2: {"reset_at": F.col("tracking_start")},
                                              3: {"check_time": null("string")}}), checks.contract_rules()),
        "readings": (_damaged(readings, k, {0: {"fraction": F.lit(1.25)}, 1: {"status": text("")}, 2: {"fetch_duration_ms": F.lit(-1)}}), checks.reading_rules()),
        "names": (_damaged(names, k, {0: {"name": text(" \t")}, 1: {"name": F.rpad("name", 101, "n")}, 2: {"name": F.concat("name", F.lit("\x07x"))}}),
                  checks.verdict_rules(checks.name_violation(F.col("name")), ("empty name", "name too long", "control characters in name"))),
        "commands": (_damaged(names, k, {0: {"command": F.rpad("command", 2049, "c")}, 1: {"command": F.concat("command", F.lit("\x01x"))}}),
                     checks.verdict_rules(checks.command_violation(F.col("command")), ("command too long", "control characters in command"))),
    }


@query("b23_b24_all_rules", ("daily", "model_daily", "recovered", "recovered_sets", "contracts"), _RULES_SQL)
def all_rules(spark, d):
    """Every rule of every table with the number of its violations, counted in one pass per table while the rows are written."""
    found = [checks.audited(rows, rules, f"checked-{name.replace(' ', '-')}") for name, (rows, rules) in _checked_tables(spark, d).items()]
    return spark.createDataFrame([(name, rule, n) for name, counts in zip(_DEALT, found) for rule, n in counts.items()], "checked string, rule string, violations long")


# Reasons to refuse a document: one document per machine, agent and day, every sixteenth of each kind

_REASONS = ("", "malformed document", "unsupported shape", "empty report", "invalid date", "invalid agent", "invalid counter", "invalid cost", "invalid model", "conflicting daily rows",
            "conflicting model rows", "models do not reconcile with agent", "agents do not reconcile with day", "invalid session", "conflicting session rows", "rows do not reconcile with totals")
_FIELDS = ("inputTokens", "outputTokens", "cacheReadTokens", "cacheCreationTokens", "totalTokens")
_KIND = "(dayofmonth(usage_date) + length(agent)) % 16"


def _json_counters(*values) -> list[Column]:
    return [value.cast("string").alias(name) for name, value in zip(_FIELDS, values)]


@v.once_per_session
def _documents(spark, d) -> DataFrame:
    """file_id, kind and payload. Models come as an array on even days and as an object by name on odd ones."""
    n, zero, kind = F.col("input_tokens") + 1, F.lit(0), F.expr(_KIND)
    at = lambda k, good, bad: F.when(kind == k, bad).otherwise(good)
    counters = lambda value: _json_counters(value, zero, zero, zero, value)
    model = lambda value: F.struct(F.lit("Alpha").alias("modelName"), *counters(value), F.lit("1.5").alias("cost"))
    models = F.array(model(at(11, n, n + 1)).withField("modelName", at(8, F.lit("Alpha"), F.lit(" "))))
    models = F.when(kind == 10, F.array(model(n - 1), model(F.lit(1)))).otherwise(models)
    listed = F.dayofmonth("usage_date") % 2 == 0
    plain = F.struct(*[F.col("m")[c].alias(c) for c in (*_FIELDS, "cost")])
    rows = v.daily(spark, d).select("machine_id", "agent", "usage_date", n.alias("n"), kind.alias("kind"), models.alias("models")).withColumn("m", F.col("models")[0])
    agent = F.struct(
        F.when(F.col("kind") == 5, F.lit(" ")).otherwise(F.upper("agent")).alias("agent"), *_json_counters(F.when(F.col("kind") == 6, -1).otherwise(F.col("n")), zero, zero, zero, F.col("n")),
        F.when(F.col("kind") == 7, "1,5").otherwise("2.50").alias("totalCost"), F.when(listed | F.col("kind").isin(8, 10), F.col("models")).alias("modelBreakdowns"),
        F.when(~listed & ~F.col("kind").isin(8, 10), F.create_map(F.lit("Alpha"), plain)).alias("breakdown"))
    again = F.struct(F.upper("agent").alias("agent"), *counters(F.col("n") + 7))
    total = F.when(F.col("kind") == 9, 2 * F.col("n") + 7).otherwise(F.col("n"))
    agents = F.when(F.col("kind") == 9, F.array(F.to_json(agent), F.to_json(again))).otherwise(F.array(F.to_json(agent)))
    period = F.when(F.col("kind") == 4, "2024-02-30").otherwise(F.date_format("usage_date", "yyyy-MM-dd"))
    day_total = F.when(F.col("kind") == 12, total + 1).otherwise(total)
    numbers = lambda value: F.to_json(F.struct(*counters(value)))
    one_day = F.concat(F.lit('{"period":"'), period, F.lit('","agents":['), F.array_join(agents, ","), F.lit("],"), F.substring(numbers(day_total), 2, 1 << 20))
    session = lambda id_, value: F.to_json(F.struct(id_.alias("sessionId"), F.lit("a").alias("agent"), *counters(value)))
    sessions = F.when(F.col("kind") == 13, session(F.lit(" "), zero)).when(F.col("kind") == 14, F.concat(session(F.lit("s"), zero), F.lit(","), session(F.lit("s"), F.lit(1)))).otherwise(
        session(F.lit("s"), zero))
    totals = F.when(F.col("kind") == 15, F.concat(F.lit(',"totals":'), numbers(F.col("n") + 1))).when(F.col("kind") == 0, F.concat(F.lit(',"totals":'), numbers(F.col("n")))).otherwise(F.lit(""))
    text = F.concat(F.when(F.col("kind") == 2, '{"weekly":[').otherwise('{"daily":['), F.when(F.col("kind") == 3, "").otherwise(one_day), F.lit('],"session":['), sessions, F.lit("]"), totals,
                    F.when(F.col("kind") == 1, "}}").otherwise("}"))
    return rows.select(F.concat_ws("/", "machine_id", "agent", F.col("usage_date").cast("string")).alias("file_id"), "kind", text.alias("payload"))


_FILE_SQL = "machine_id || '/' || agent || '/' || usage_date::VARCHAR"
_KIND_SQL = "(day(usage_date) + length(agent)) % 16"


@query("b01_b20_all_reasons", ("daily",), f"""
  SELECT file_id, (['{"', '".join(_REASONS)}'])[k + 1] AS reason FROM (SELECT {_FILE_SQL} AS file_id, {_KIND_SQL} AS k FROM daily) WHERE k > 0""")
def all_reasons(spark, d):
    return normalize.parse_snapshots(_documents(spark, d)).rejects.select("file_id", F.explode("reasons").alias("reason"))


@query("b03_k02_model_forms", ("daily",), f"""
  SELECT {_FILE_SQL} AS file_id, {day('usage_date')}, agent, 'alpha' AS model, input_tokens + 1 AS reported_total_tokens, day(usage_date) % 2 = 0 AS listed FROM daily WHERE {_KIND_SQL} = 0""")
def model_forms(spark, d):
    """The accepted documents' model rows, from arrays and from objects."""
    rows = materialized(normalize.parse_snapshots(_documents(spark, d)).models, "models")
    return rows.select("file_id", "usage_date", "agent", "model", "reported_total_tokens", (F.dayofmonth("usage_date") % 2 == 0).alias("listed"))
