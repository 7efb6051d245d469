"""Ledger-shaped views derived from the given tables, so that every operator runs on their rows.

Each view states its definition once more as SQL in plans/oracles.py.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.functions import fingerprints
from ledgerline.functions.fingerprints import COUNTERS
from ledgerline.session import prepare

COST = "decimal(38,12)"
ZONE = "Africa/Casablanca"
MACHINES = 8
NOW = "2024-01-16 12:10:00"


def once_per_session(build):
    """Keep the plan a builder made for a session and folder; plans hold no data."""
    made: dict[tuple[int, str], tuple[SparkSession, DataFrame]] = {}

    @functools.wraps(build)
    def view(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        key = (id(spark), sf_dir)
        if key not in made or made[key][0] is not spark:
            made[key] = (spark, build(spark, sf_dir))
        return made[key][1]
    return view


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _long(value: Column) -> Column:
    return F.floor(value).cast("bigint")


def _cost(value: Column) -> Column:
    return value.cast("decimal(18,2)").cast(COST)


def with_daily_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("usage_hash", fingerprints.daily_hash(F.col))


def with_model_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("usage_hash", fingerprints.model_hash(F.col))


@once_per_session
def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    day = F.col("o_orderdate").cast("date")
    processing = F.col("o_orderstatus") == "P"
    return orders.select(
        F.col("o_orderkey").alias("import_id"),
        F.concat(F.lit("m"), F.col("o_custkey") % 4).alias("machine_id"),
        F.sha2(F.concat_ws("|", "o_orderpriority", day.cast("string")), 256).alias("raw_sha256"),
        F.date_sub(day, 6).alias("scope_start"), day.alias("scope_end"),
        F.when(processing, "processing").otherwise("processed").alias("status"),
        at.alias("created_at"), F.when(~processing, at).alias("processed_at"),
        _long(F.col("o_totalprice")).alias("file_size_bytes"))


@once_per_session
def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One machine per nation; m0..m3 own the imports."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(
        F.concat(F.lit("m"), "n_nationkey").alias("machine_id"), F.col("n_name").alias("name"),
        (F.col("n_regionkey") != 2).alias("is_active"))


@once_per_session
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of daily usage: one per line item, imported by its order."""
    return _revisions(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


@once_per_session
def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisions of processed imports as promotion stores them: with their processing time, so that reading them needs no join of the imports."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    return _revisions(table(spark, sf_dir, "lineitem"), done).withColumn("processed_at", F.col("created_at")).drop("model")


def _line_id() -> Column:
    return F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"),
                    F.lpad(F.col("l_partkey").cast("string"), 10, "0"))


def _revisions(lines: DataFrame, orders: DataFrame) -> DataFrame:
    owners = orders.select(
        F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("m"), F.col("o_custkey") % 4).alias("machine_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))
    tombstone = (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45)
    def live(value: Column) -> Column:
        return F.when(tombstone, F.lit(0)).otherwise(_long(value)).cast("bigint")
    parts = {
        "input_tokens": live(F.col("l_quantity")), "output_tokens": live(F.col("l_extendedprice")),
        "cache_read_tokens": live(F.round(F.col("l_discount") * 100)),
        "cache_creation_tokens": live(F.round(F.col("l_tax") * 100)),
    }
    rows = lines.join(owners, "l_orderkey").select(
        _line_id().alias("id"),
        "machine_id", F.col("l_orderkey").alias("import_id"), F.col("l_returnflag").alias("agent"),
        F.concat(F.lit("model-"), F.col("l_linenumber") % 3).alias("model"),
        F.col("l_shipdate").cast("date").alias("usage_date"), "created_at",
        *[v.alias(k) for k, v in parts.items()], tombstone.alias("is_tombstone"),
        F.when(~tombstone, _cost(F.col("l_extendedprice"))).alias("reported_cost_usd"))
    total = sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))
    return rows.withColumns({"reported_total_tokens": total, "accounting_delta_tokens": F.lit(0).cast("bigint")})


@once_per_session
def daily_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_daily_hash(observations(spark, sf_dir).drop("model"))


@once_per_session
def model_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_model_hash(observations(spark, sf_dir))


@once_per_session
def _event_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("m"), F.col("user_id") % MACHINES).alias("machine_id"),
        F.col("event_type").alias("agent"), F.concat(F.lit("model-"), k % 6).alias("model"),
        F.col("ts").cast("date").alias("usage_date"),
        _long(F.round(F.col("value") * 100)).alias("input_tokens"), _long(F.col("value")).alias("output_tokens"),
        k.alias("cache_read_tokens"), (F.col("event_id") % 7).alias("cache_creation_tokens"),
        (F.col("event_id") % 3).alias("accounting_delta_tokens"),
        F.when(F.col("event_type") != "error", _cost(F.col("value"))).alias("reported_cost_usd"))


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    names = (*COUNTERS, "accounting_delta_tokens")
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names], F.sum("reported_cost_usd").cast(COST).alias("reported_cost_usd"))
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return sums.withColumns({"reported_total_tokens": total, "is_tombstone": F.lit(False)})


@once_per_session
def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_daily_hash(_summed(_event_usage(spark, sf_dir), ["machine_id", "agent", "usage_date"]))


@once_per_session
def model_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model rows of the events; one model in six is not attributed, so residuals remain."""
    rows = _event_usage(spark, sf_dir).filter(F.col("model") != "model-5")
    return with_model_hash(_summed(rows, ["machine_id", "agent", "model", "usage_date"]))


@once_per_session
def incoming_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later export of the events: some keys missing, some revised, one more day."""
    day = F.dayofmonth("usage_date")
    rows = daily(spark, sf_dir).drop("usage_hash")
    kept = rows.filter((day % 5) != 0).withColumn(
        "usage_date", F.when(day == 29, F.date_add("usage_date", 10)).otherwise(F.col("usage_date")))
    bump = F.when(F.dayofmonth("usage_date") % 4 == 0, 7).otherwise(0).cast("bigint")
    return with_daily_hash(kept.withColumns({
        "input_tokens": F.col("input_tokens") + bump, "reported_total_tokens": F.col("reported_total_tokens") + bump}))


@once_per_session
def incoming_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("usage_date")
    rows = model_daily(spark, sf_dir).drop("usage_hash").filter((day % 5) != 0)
    bump = F.when(day % 4 == 0, 7).otherwise(0).cast("bigint")
    return with_model_hash(rows.withColumns({
        "input_tokens": F.col("input_tokens") + bump, "reported_total_tokens": F.col("reported_total_tokens") + bump}))


@once_per_session
def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded files: their machine is the source, their content the whole text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("import_id"), F.col("source").alias("machine_id"),
        F.sha2("text", 256).alias("raw_sha256"), F.octet_length("text").cast("bigint").alias("file_size_bytes"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"),
        F.when(F.col("doc_id") % 9 == 0, "processing").otherwise("processed").alias("status"))


@once_per_session
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sessions: id from the whole text, counters and days from the text."""
    docs = table(spark, sf_dir, "documents")
    length = F.length("text").cast("bigint")
    first = F.timestamp_seconds(F.lit(1704067200) + (length % 28) * 86400)
    rows = docs.select(
        F.col("doc_id").alias("import_id"), F.col("source").alias("machine_id"), F.col("lang").alias("agent"),
        F.sha2("text", 256).alias("session_id"), first.alias("first_activity"),
        F.timestamp_seconds(F.unix_seconds(first) + (length % 3) * 86400).alias("last_activity"),
        length.alias("input_tokens"), (length % 97).alias("output_tokens"), (length % 31).alias("cache_read_tokens"),
        (length % 5).alias("cache_creation_tokens"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"))
    total = sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))
    full = rows.withColumns({
        "reported_total_tokens": total, "accounting_delta_tokens": F.lit(0).cast("bigint"),
        "reported_cost_usd": F.lit(None).cast(COST), "models": F.array().cast("array<string>"),
        "project_path": F.col("machine_id")})
    return full.withColumns(fingerprints.session_hashes(F.col)).drop("project_path")


@once_per_session
def document_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily usage of the documents' machines: counts per source, language and day, so that equal rows occur."""
    length = F.length("text").cast("bigint")
    rows = table(spark, sf_dir, "documents").groupBy(
        F.col("source").alias("machine_id"), F.col("lang").alias("agent"),
        F.date_add(F.lit("2024-01-01").cast("date"), (length % 28).cast("int")).alias("usage_date")).agg(
        F.count(F.lit(1)).alias("input_tokens"))
    zero = F.lit(0).cast("bigint")
    return with_daily_hash(rows.withColumns({
        "output_tokens": zero, "cache_read_tokens": zero, "cache_creation_tokens": zero,
        "reported_total_tokens": F.col("input_tokens"), "accounting_delta_tokens": zero,
        "reported_cost_usd": F.lit(None).cast(COST), "is_tombstone": F.lit(False),
        "id": F.concat_ws("/", "machine_id", "agent", F.col("usage_date").cast("string"))}))


@once_per_session
def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.concat(F.lit("c"), "user_id").alias("contract_id"), F.concat(F.lit("u"), "user_id").alias("account"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("user_id") % 48) * 3600).alias("tracking_start"),
        F.lit("2024-01-29 11:29:00").cast("timestamp").alias("reset_at"), F.lit("12:00").alias("check_time"),
        ((F.col("user_id") % 10) / 100).alias("baseline"), F.lit(1.0).alias("hard_limit"),
        ((F.col("user_id") % 3) * 0.05).alias("safety_reserve"))


@once_per_session
def contract_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three workbook imports per account's cycle and one older cycle; some break a rule."""
    base = contracts(spark, sf_dir).withColumn("user_id", F.substring("account", 2, 20).cast("bigint"))
    n = F.col("import_no")
    older = n == 0
    return base.withColumn("import_no", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({
        "contract_id": F.concat_ws("-", "contract_id", n.cast("string")),
        "created_at": F.timestamp_seconds(F.lit(1705276800) + n * 86400 + F.col("user_id")),
        "status": F.when((n == 3) & (F.col("user_id") % 4 == 0), "failed").otherwise("processed"),
        "tracking_start": F.when(older, F.timestamp_seconds(F.unix_seconds("tracking_start") - 2592000)).otherwise(F.col("tracking_start")),
        "reset_at": F.when(older, F.lit("2023-12-30 11:29:00").cast("timestamp")).otherwise(F.col("reset_at")),
        "baseline": F.when((n == 2) & (F.col("user_id") % 5 == 0), F.col("baseline") + 0.001).otherwise(F.col("baseline")),
    })


@once_per_session
def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded usage per account and day: the running maximum of the readings' fractions, some days blank."""
    events = table(spark, sf_dir, "events")
    per_day = events.groupBy("user_id", F.col("ts").cast("date").alias("date")).agg(F.max("value").alias("v"))
    fraction = F.floor(F.least(F.col("v"), F.lit(120.0))) / 100
    return per_day.select(F.concat(F.lit("c"), "user_id").alias("contract_id"), "date",
                          F.when(F.dayofmonth("date") % 6 != 0, fraction).alias("actual"))


@once_per_session
def all_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polled readings, valid or not: percent may exceed 100."""
    return _polled(table(spark, sf_dir, "events"))


def _polled(e: DataFrame) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("account"), F.col("event_id").alias("reading_id"), at.alias("observed_at"),
        F.timestamp_micros(F.unix_micros(at) + (F.col("event_id") % 5) * 1000000).alias("fetched_at"),
        _long(F.col("value") / 5).alias("percent"),
        F.when(F.col("event_type") == "error", "rate-limited").otherwise("ok").alias("status"),
        F.timestamp_seconds(
            F.unix_seconds(F.date_trunc("month", F.expr("ts + interval 1 month").cast("timestamp"))) + F.col("event_id") % 3
            + F.when(F.col("event_id") % 11 == 0, 90).otherwise(0)
        ).alias("provider_resets_at"))


@once_per_session
def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(all_readings(spark, sf_dir))


def _valid(rows: DataFrame) -> DataFrame:
    return rows.filter("percent <= 100").withColumn(
        "fraction", (F.col("percent").cast("decimal(9,4)") / 100).cast("decimal(9,4)")).drop("percent")


def as_readings(events: DataFrame) -> DataFrame:
    """The readings view of any events frame, streams included."""
    return _valid(_polled(events))


@once_per_session
def polled_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings as one dense poll per machine: many equal readings close together."""
    return readings(spark, sf_dir).withColumns({
        "account": F.concat(F.lit("a"), F.col("reading_id") % 7),
        "fraction": F.floor(F.dayofmonth("observed_at") / 6).cast("decimal(9,4)"), "status": F.lit("ok")})


@once_per_session
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider payloads of the events; some are malformed in one of several ways."""
    e = all_readings(spark, sf_dir)
    reset = F.date_format("provider_resets_at", "yyyy-MM-dd'T'HH:mm:ss'.824Z'")
    kind = F.col("reading_id") % 13
    percent = F.when(kind == 1, F.lit('"19"')).when(kind == 2, F.lit("-1")).when(kind == 3, F.lit("null")).otherwise(
        F.col("percent").cast("string"))
    status = F.when(kind == 4, F.lit('" "')).when(kind == 5, F.lit("7")).otherwise(F.concat(F.lit('"'), "status", F.lit('"')))
    resets = F.when(kind == 6, F.lit("soon")).otherwise(reset)
    body = F.concat(F.lit('{"status":'), status, F.lit(',"percent":'), percent, F.lit(',"resetsAt":"'), resets, F.lit('"}'))
    usage = F.when(kind == 7, F.lit("{}")).otherwise(F.concat(F.lit('{"monthly":'), body, F.lit("}")))
    text = F.when(kind == 8, F.lit("{broken")).otherwise(F.concat(F.lit('{"usage":'), usage, F.lit("}")))
    return e.select("account", "reading_id", "fetched_at", (F.col("reading_id") % 2000).alias("fetch_duration_ms"),
                    text.alias("payload"))


_JSON_NAMES = {"input_tokens": "inputTokens", "output_tokens": "outputTokens", "cache_read_tokens": "cacheReadTokens",
               "cache_creation_tokens": "cacheCreationTokens", "reported_total_tokens": "totalTokens"}


@once_per_session
def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON export per machine and week, built from the events; some are damaged on purpose.

    A week of one machine has at most seven days of agents and models, so a
    file stays small however many events it sums up.
    """
    usage = _event_usage(spark, sf_dir).withColumn("agent", F.initcap("agent"))
    def counters(source):
        return [F.col(c).cast("string").alias(j) for c, j in _JSON_NAMES.items()] if source == "text" else [
            F.col(c).alias(j) for c, j in _JSON_NAMES.items()]
    models = _summed(usage, ["machine_id", "usage_date", "agent", "model"]).groupBy("machine_id", "usage_date", "agent").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("model").alias("modelName"), *counters("text"),
            F.col("reported_cost_usd").cast("string").alias("cost")))).alias("modelBreakdowns"))
    agents = _summed(usage, ["machine_id", "usage_date", "agent"]).join(models, ["machine_id", "usage_date", "agent"])
    day = agents.groupBy("machine_id", "usage_date").agg(
        F.array_sort(F.collect_list(F.struct(
            "agent", *counters("number"), F.col("reported_cost_usd").cast("string").alias("totalCost"),
            F.when(F.dayofmonth("usage_date") % 10 != 0, F.col("modelBreakdowns")).alias("modelBreakdowns")))).alias("agents"),
        *[F.sum(c).alias(c) for c in _JSON_NAMES])
    week = day.withColumn("week", F.date_trunc("week", "usage_date").cast("date")).groupBy("machine_id", "week").agg(
        F.array_sort(F.collect_list(F.struct(
            F.date_format("usage_date", "yyyy-MM-dd").alias("period"), *counters("number"), "agents"))).alias("daily"),
        *[F.sum(c).alias(c) for c in _JSON_NAMES])
    bad_total = (F.col("machine_id") == "m2") & (F.dayofmonth("week") == 8)
    damaged = week.withColumn("reported_total_tokens", F.col("reported_total_tokens") + F.when(bad_total, 1).otherwise(0))
    text = F.to_json(F.struct("daily", F.struct(*counters("number")).alias("totals")))
    broken = (F.col("machine_id") == "m3") & (F.dayofmonth("week") == 15)
    no_shape = (F.col("machine_id") == "m4") & (F.dayofmonth("week") == 22)
    payload = F.when(broken, F.concat(text, F.lit("}"))).when(no_shape, F.regexp_replace(text, '"daily"', '"weekly"')).otherwise(text)
    return damaged.select(F.concat_ws("/", "machine_id", F.col("week").cast("string")).alias("file_id"), "machine_id",
                          payload.alias("payload"))


@once_per_session
def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered months from the orders: a priority is an agent, and each month has its All row."""
    day = F.col("o_orderdate").cast("date")
    orders = table(spark, sf_dir, "orders").withColumns({
        "month": F.trunc(day, "month"), "set_id": F.concat(F.lit("set-"), F.year(day))})
    values = {
        "input_tokens": F.sum(_long(F.col("o_totalprice"))), "output_tokens": F.sum(F.col("o_custkey") % 1000),
        "cache_creation_tokens": F.sum(F.lit(0).cast("bigint")), "cache_read_tokens": F.sum(F.col("o_orderkey") % 100),
        "reported_cost_usd": F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast(COST),
    }
    agents = orders.groupBy("set_id", "month", F.col("o_orderpriority").alias("agent")).agg(*[v.alias(k) for k, v in values.items()])
    every = agents.groupBy("set_id", "month").agg(*[F.sum(k).alias(k) for k in values]).withColumn("agent", F.lit("All"))
    # In every fifth month the All row is one token higher than its agents.
    extra = F.when((F.col("agent") == "All") & (F.month("month") % 5 == 0), 1).otherwise(0).cast("bigint")
    rows = agents.unionByName(every).withColumn("input_tokens", F.col("input_tokens") + extra)
    total = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    return rows.withColumns({"total_tokens": total, "reported_cost_usd": F.col("reported_cost_usd").cast(COST),
                             "models": F.array(F.lit("gamma"))})


def recovered_sets(rows: DataFrame) -> DataFrame:
    """Headers of recovered rows, summed from their All rows; even years are evidence only."""
    every = rows.filter("agent = 'All'")
    names = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
    year = F.substring("set_id", 5, 4).cast("int")
    return every.groupBy("set_id").agg(
        *[F.sum(c).alias(f"total_{c}") for c in names], F.sum("total_tokens").alias("total_tokens"),
        F.sum("reported_cost_usd").cast(COST).alias("reported_cost_usd")).withColumns({
            "accounting_mode": F.when(year % 2 == 0, "evidence_only_non_additive").otherwise("additive_recovered"),
            "pricing_complete": year % 3 != 0})


@once_per_session
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of line items on m1..m3 to the greatest id of m0 with the same agent and day, current or not."""
    rows = observations(spark, sf_dir)
    return _links(rows, rows)


def current_links(spark: SparkSession, sf_dir: str, current: DataFrame) -> DataFrame:
    """The links of the rows in `current`, a written table: lines that aren't current are left out before they meet their orders.

    A key has one current row, so these are few beside all lines.
    """
    own = current.select(F.col("id").alias("_id"))
    lines = table(spark, sf_dir, "lineitem").join(own, _line_id() == F.col("_id"), "left_semi")
    return _links(_revisions(lines, table(spark, sf_dir, "orders")), observations(spark, sf_dir))


def _links(rows: DataFrame, every: DataFrame) -> DataFrame:
    target = every.filter("machine_id = 'm0'").groupBy("agent", "usage_date").agg(F.max("id").alias("canonical_observation_id"))
    return rows.filter("machine_id <> 'm0' and cache_read_tokens % 2 = 0").select("id", "agent", "usage_date").join(
        target, ["agent", "usage_date"]).select(F.col("id").alias("observation_id"), "canonical_observation_id",
                                                F.lit("m0").alias("canonical_machine_id"))


@once_per_session
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each contract as a workbook grid of text cells: labels with values, then a checkpoint table."""
    from ledgerline.operators.pacing import with_actuals, with_schedule

    filled = with_actuals(with_schedule(contracts(spark, sf_dir), ZONE), actuals(spark, sf_dir))
    start = F.date_format(F.from_utc_timestamp("tracking_start", ZONE), "yyyy-MM-dd HH:mm")
    reset = F.date_format(F.from_utc_timestamp("reset_at", ZONE), "yyyy-MM-dd'T'HH:mm:ss")
    def cell(row, col, value):
        return F.struct(F.lit(row).cast("int").alias("row"), F.lit(col).cast("int").alias("col"), value.cast("string").alias("value"))
    percent = F.concat(F.round(F.col("baseline") * 100).cast("int").cast("string"), F.lit(" %"))
    pairs = [
        ("Current monthly usage", percent), ("Tracking starts", start), ("Days until reset", F.lit(None)),
        ("Daily check time", F.lit("0.5")), ("Reset date/time", reset), ("Hard monthly limit", F.lit("100%")),
        ("Safety reserve", F.round(F.col("safety_reserve"), 2)), ("Planned ceiling at reset", F.lit(None)),
        ("Remaining usage budget", F.lit(None)), ("Avg additional usage/day", F.lit(None)), ("Daily checkpoint", F.lit(None))]
    labels = []
    for i, (label, value) in enumerate(pairs):
        labels += [cell(i + 2, 1, F.lit(f" {label} ")), cell(i + 2, 3, value)]
    names = ["Day #", "Date", "Check Time", "Max Monthly Usage", "Actual Usage", "Status", "Headroom"]
    header = [cell(20, i, F.lit(n)) for i, n in enumerate(names)]
    def line(c, i):
        row = (i + 21).cast("int")
        def at(col, value):
            return F.struct(row.alias("row"), F.lit(col).cast("int").alias("col"), value.cast("string").alias("value"))
        return F.array(at(0, c["day"]), at(1, c["date"]), at(3, F.round(c["ceiling"], 6)), at(4, c["actual"]))
    table_cells = F.flatten(F.transform("checkpoints", line))
    return filled.select(F.col("contract_id").alias("workbook_id"), F.explode(F.concat(F.array(*labels, *header), table_cells)).alias("_c")).select(
        "workbook_id", "_c.*").filter(F.col("value").isNotNull())
