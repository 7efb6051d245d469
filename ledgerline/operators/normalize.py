"""Snapshot documents to flat, fingerprinted, reconciled observation rows.

One document is one row and is bounded by the snapshot size limit, so every
check inside a document is an expression over its own arrays: parsing,
validating and reconciling move no data between tasks. Rows are exploded only
from documents that passed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.config import LIMITS
from ledgerline.functions import fingerprints
from ledgerline.functions.dates import calendar_date, instant_millis
from ledgerline.functions.fingerprints import COUNTERS, FIVE_COUNTERS
from ledgerline.functions.numbers import cost, counter
from ledgerline.functions.text import CONTROL_CHARACTERS, agent_name, model_list, model_name, opaque_id
from ledgerline.schemas import MODEL_ROW, SNAPSHOT

UNIFIED_SHAPE = "unified-daily"
STANDARD_SHAPE = "standard-daily"
NO_SESSIONS = "no session section"
MAX_SUM = (1 << 63) - 1

_JSON_COUNTERS = dict(zip(FIVE_COUNTERS, ("inputTokens", "outputTokens", "cacheReadTokens", "cacheCreationTokens", "totalTokens")))
_COST_KEYS = ("totalCost", "costUSD", "cost")
_SEP = "\x1f"


@dataclass(frozen=True)
class Snapshots:
    """The parsed batch: three row sets, one summary row per accepted file, and the rejects."""

    daily: DataFrame
    models: DataFrame
    sessions: DataFrame
    summary: DataFrame
    rejects: DataFrame


def _raw_cost(row: Column) -> Column:
    return F.coalesce(*[row[key] for key in _COST_KEYS])


def _components(row: Column) -> Column:
    first, *rest = [row[c] for c in COUNTERS]
    for value in rest:
        first = first + value
    return first


def _struct(values: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _kept(row: Column, *names: str) -> dict[str, Column]:
    return {name: row[name] for name in names}


def _counters(row: Column) -> dict[str, Column]:
    return {name: counter(row[key]) for name, key in _JSON_COUNTERS.items()}


def _model_rows(agent_row: Column) -> Column:
    """The breakdown array, or the breakdown object turned into rows when the array is empty."""
    from_object = F.transform(
        F.map_entries(agent_row["breakdown"]),
        lambda entry: entry["value"].withField("modelName", entry["key"]),
    )
    empty = F.array().cast(f"array<{MODEL_ROW}>")
    return F.when(F.size(agent_row["modelBreakdowns"]) > 0, agent_row["modelBreakdowns"]).otherwise(
        F.coalesce(from_object, empty)
    )


def _agent_rows(day: Column) -> Column:
    """The day's agents; a day without them is its own single agent row."""
    own = _struct(_kept(day, "agent", *_JSON_COUNTERS.values(), *_COST_KEYS, "modelBreakdowns", "breakdown"))
    return F.when(F.size(day["agents"]) > 0, day["agents"]).otherwise(F.array(own))


# Each step below reads the array the step before it made, so that no value is
# worked out twice inside one expression.

def _read_day(day: Column) -> Column:
    return _struct({
        "usage_date": calendar_date(F.coalesce(day["period"], day["date"])),
        **_counters(day),
        "agents": F.transform(_agent_rows(day), _read_agent),
    })


def _read_agent(row: Column) -> Column:
    return _struct({
        "agent": agent_name(row["agent"]),
        **_counters(row),
        "raw_cost": _raw_cost(row),
        "models": F.transform(_model_rows(row), _read_model),
    })


def _read_model(row: Column) -> Column:
    return _struct({
        "model": model_name(F.coalesce(row["modelName"], row["model"])),
        **_counters(row),
        "total_absent": row["totalTokens"].isNull(),
        "raw_cost": _raw_cost(row),
    })


def _read_session(row: Column) -> Column:
    meta = row["metadata"]
    return _struct({
        "agent": agent_name(F.coalesce(row["agent"], meta["agent"])),
        "session_id": opaque_id(F.coalesce(row["sessionId"], row["session"], row["period"])),
        **_counters(row),
        "total_absent": row["totalTokens"].isNull(),
        "raw_cost": _raw_cost(row),
        "raw_first": F.nullif(F.coalesce(row["firstActivity"], meta["firstActivity"]), F.lit("")),
        "raw_last": F.nullif(F.coalesce(row["lastActivity"], meta["lastActivity"]), F.lit("")),
        "models": model_list(F.coalesce(row["modelsUsed"], row["models"])),
        "path": F.coalesce(row["projectPath"], meta["projectPath"]),
    })


def _flat_agent(day: Column, row: Column) -> Column:
    return _struct({
        "usage_date": day["usage_date"],
        **_kept(row, "agent", *FIVE_COUNTERS, "raw_cost"),
        "cost_read": cost(row["raw_cost"]),
    })


def _flat_model(day: Column, agent_row: Column, row: Column) -> Column:
    return _struct({
        "usage_date": day["usage_date"],
        "agent": agent_row["agent"],
        **_kept(row, "model", *COUNTERS),
        "reported_total_tokens": _total_or_components(row),
        "raw_cost": row["raw_cost"],
        "cost_read": cost(row["raw_cost"]),
    })


def _flat_session(row: Column) -> Column:
    path = row["path"]
    return _struct({
        **_kept(row, "agent", "session_id", *COUNTERS),
        "reported_total_tokens": _total_or_components(row),
        **_kept(row, "raw_cost", "raw_first", "raw_last", "models"),
        "cost_read": cost(row["raw_cost"]),
        "first_activity": instant_millis(row["raw_first"]),
        "last_activity": instant_millis(row["raw_last"]),
        "project_path": F.when(
            (F.length(path) <= LIMITS.max_path_chars) & ~path.rlike(CONTROL_CHARACTERS), path),
    })


def _total_or_components(row: Column) -> Column:
    """A missing total is the sum of the components; a malformed one stays null."""
    return F.when(row["total_absent"], _components(row)).otherwise(row["reported_total_tokens"])


def _finished(row: Column, names: tuple[str, ...], make_hash) -> Column:
    fields = {
        **_kept(row, "usage_date", *names, *FIVE_COUNTERS),
        "accounting_delta_tokens": row["reported_total_tokens"] - _components(row),
        "reported_cost_usd": row["cost_read"],
        "is_tombstone": F.lit(False),
    }
    return _struct({**fields, "usage_hash": make_hash(fields.__getitem__)})


def _finished_session(row: Column) -> Column:
    known = {
        **_kept(row, "agent", "session_id", "first_activity", "last_activity", *FIVE_COUNTERS),
        "accounting_delta_tokens": row["reported_total_tokens"] - _components(row),
        "reported_cost_usd": row["cost_read"],
        "models": row["models"],
    }
    hashes = fingerprints.session_hashes({**known, "project_path": row["project_path"]}.__getitem__)
    # The project path ends here: it is part of one hash and is never kept.
    return _struct({"local_key_hash": hashes.pop("local_key_hash"), **known, **hashes})


def _sum_of(rows: Column, name: str) -> Column:
    """As decimal, so that a sum beyond a bigint is a mismatch of its document and not the end of the job."""
    return F.aggregate(rows, F.lit(0).cast("decimal(38,0)"), lambda acc, row: (acc + row[name]).cast("decimal(38,0)"))


def _any(rows: Column, test) -> Column:
    return F.coalesce(F.exists(rows, lambda row: F.coalesce(test(row), F.lit(False))), F.lit(False))


def _counter_missing(row: Column) -> Column:
    missing = row[FIVE_COUNTERS[0]].isNull()
    for name in FIVE_COUNTERS[1:]:
        missing = missing | row[name].isNull()
    return missing


def _cost_malformed(row: Column) -> Column:
    return row["raw_cost"].isNotNull() & row["cost_read"].isNull()


def _time_malformed(row: Column) -> Column:
    return (row["raw_first"].isNotNull() & row["first_activity"].isNull()) | (
        row["raw_last"].isNotNull() & row["last_activity"].isNull()
    )


def _conflict(rows: Column, key, content: str) -> Column:
    """Two rows under one key with different content."""
    keys = F.transform(rows, key)
    both = F.transform(rows, lambda row: F.concat_ws(_SEP, key(row), row[content]))
    return F.size(F.array_distinct(both)) > F.size(F.array_distinct(keys))


def _daily_key(row: Column) -> Column:
    return F.concat_ws(_SEP, row["usage_date"].cast("string"), row["agent"])


def _model_key(row: Column) -> Column:
    return F.concat_ws(_SEP, row["usage_date"].cast("string"), row["agent"], row["model"])


def _first_of_each(rows: str, key) -> Column:
    """Rows sorted by key, one per key. `rows` names a column already sorted."""
    array = F.col(rows)
    return F.filter(
        array, lambda row, i: (i == 0) | (key(row) != key(F.get(array, i - 1)))
    )


def _model_mismatch(row: Column) -> Column:
    differs = F.lit(False)
    for name in COUNTERS:
        differs = differs | (_sum_of(row["models"], name) != row[name])
    return (F.size(row["models"]) > 0) & differs


def _day_mismatch(day: Column) -> Column:
    differs = F.lit(False)
    for name in FIVE_COUNTERS:
        differs = differs | (_sum_of(day["agents"], name) != day[name])
    return differs


def well_formed_object(payload: Column) -> Column:
    """One JSON object and nothing else.

    The parser stops behind the first whole value. Wrapped as an array, the payload may end
    early only by a bracket; wrapped as a member, only by a brace; nothing passes both.
    """
    one = (F.json_array_length(F.concat(F.lit("["), payload, F.lit("]"))) == 1) & F.try_parse_json(F.concat(F.lit('{"x":'), payload, F.lit("}"))).isNotNull()
    return F.coalesce(one & payload.rlike(r"^\s*\{") & payload.rlike(r"\}\s*$"), F.lit(False))


def document_rows(documents: Column) -> tuple[Column, Column]:
    """The array of days of a document and the name of its shape."""
    standard = F.when(documents["type"] == "daily", documents["data"])
    rows = F.coalesce(documents["daily"], standard)
    shape = F.when(documents["daily"].isNotNull(), UNIFIED_SHAPE).when(standard.isNotNull(), STANDARD_SHAPE)
    return rows, shape


def session_rows(documents: Column) -> Column:
    """The first session array present wins, even when it is empty."""
    return F.coalesce(documents["session"], documents["sessions"], documents["sessionReport"]["sessions"])


def parse_documents(files: DataFrame, payload: str = "payload") -> DataFrame:
    """Each file with its checked arrays, its facets and the list of reasons to reject it.

    Reads `files(file_id, ..., payload)`; other columns pass through.
    """
    doc = F.col("_doc")
    days, shape = document_rows(doc)
    parsed = (
        files.withColumn("_well_formed", well_formed_object(F.col(payload)))
        .withColumn("_doc", F.from_json(F.when(F.col("_well_formed"), F.col(payload)), SNAPSHOT))
        .drop(payload)
        .withColumns({
            "source_shape": shape,
            "_days": F.transform(F.filter(days, lambda d: d.isNotNull()), _read_day),
            "_sessions": F.transform(F.filter(session_rows(doc), lambda s: s.isNotNull()), _read_session),
            "_totals": F.when(doc["totals"].isNotNull(), _struct(_counters(doc["totals"]))),
        })
        .drop("_doc")
    )
    flat = parsed.withColumns({
        "_agents": F.flatten(F.transform(
            "_days", lambda day: F.transform(day["agents"], lambda row: _flat_agent(day, row)))),
        "_model_parts": F.flatten(F.transform(
            "_days", lambda day: F.flatten(F.transform(day["agents"], lambda agent_row: F.transform(
                agent_row["models"], lambda row: _flat_model(day, agent_row, row)))))),
        "_sessions": F.transform("_sessions", _flat_session),
    })
    hashed = flat.withColumns({
        "_daily_all": F.array_sort(F.transform(
            "_agents", lambda row: _finished(row, ("agent",), fingerprints.daily_hash))),
        "_models_all": F.array_sort(F.transform(
            "_model_parts", lambda row: _finished(row, ("agent", "model"), fingerprints.model_hash))),
        "_sessions_all": F.array_sort(F.transform("_sessions", _finished_session)),
    })
    distinct = hashed.withColumns({
        "_daily": _first_of_each("_daily_all", _daily_key),
        "_models": _first_of_each("_models_all", _model_key),
        "_session_rows": _first_of_each("_sessions_all", lambda row: row["local_key_hash"]),
    })
    checked = distinct.withColumns({"reasons": _reasons(), "warnings": _warnings()}).drop(
        "_daily_all", "_models_all", "_sessions_all", "_sessions", "_agents", "_model_parts", "_totals"
    )
    # Exploding one struct keeps filters on the verdict above this point. Pushed
    # below, they would repeat the whole chain of array expressions inside the filter.
    return checked.select(F.explode(F.array(F.struct(*checked.columns))).alias("_p")).select("_p.*")


def _reasons() -> Column:
    days, agents, models, sessions = (F.col(c) for c in ("_days", "_agents", "_model_parts", "_sessions"))
    totals_missing = F.lit(False)
    totals_differ = F.lit(False)
    too_large = F.lit(False)
    for name in FIVE_COUNTERS:
        too_large = too_large | (_sum_of(F.col("_daily"), name) > F.lit(MAX_SUM).cast("decimal(38,0)"))
        totals_missing = totals_missing | F.col("_totals")[name].isNull()
        totals_differ = totals_differ | (_sum_of(F.col("_daily"), name) != F.col("_totals")[name])
    checks = {
        "malformed document": ~F.col("_well_formed"),
        "unsupported shape": F.col("_well_formed") & F.col("source_shape").isNull(),
        "empty report": F.size("_days") == 0,
        "invalid date": _any(days, lambda day: day["usage_date"].isNull()),
        "invalid agent": _any(agents, lambda row: row["agent"].isNull()),
        "invalid counter": _any(agents, _counter_missing) | _any(days, _counter_missing) | too_large,
        "invalid cost": _any(agents, _cost_malformed),
        "invalid model": _any(models, lambda m: m["model"].isNull() | _counter_missing(m) | _cost_malformed(m)),
        "conflicting daily rows": _conflict(F.col("_daily_all"), _daily_key, "usage_hash"),
        "conflicting model rows": _conflict(F.col("_models_all"), _model_key, "usage_hash"),
        "models do not reconcile with agent": _any(days, lambda day: _any(day["agents"], _model_mismatch)),
        "agents do not reconcile with day": _any(days, _day_mismatch),
        "invalid session": _any(sessions, lambda s: s["agent"].isNull() | s["session_id"].isNull()
                                | _counter_missing(s) | _cost_malformed(s) | _time_malformed(s)),
        "conflicting session rows": _conflict(
            F.col("_sessions_all"), lambda row: row["local_key_hash"], "session_hash"),
        "rows do not reconcile with totals": F.col("_totals").isNotNull() & (totals_missing | totals_differ),
    }
    named = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(reason)) for reason, test in checks.items()])
    return F.array_compact(named)


def _warnings() -> Column:
    without_models = F.flatten(F.transform("_days", lambda day: F.transform(
        F.filter(day["agents"], lambda row: (F.size(row["models"]) == 0)
                 & (sum((row[c] for c in COUNTERS[1:]), row[COUNTERS[0]]) > 0)),
        lambda row: F.concat(F.lit("no model breakdown for "), row["agent"], F.lit(" on "), day["usage_date"].cast("string")))))
    no_sessions = F.when(F.coalesce(F.size("_session_rows"), F.lit(0)) <= 0, F.array(F.lit(NO_SESSIONS))).otherwise(
        F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.coalesce(without_models, F.array().cast("array<string>")), no_sessions))


def split_documents(parsed: DataFrame, carry: tuple[str, ...] = ("file_id",)) -> Snapshots:
    """Accepted documents as rows and summaries, refused ones as rejects with reasons.

    `carry` names the file columns every row keeps (file, machine, import).
    """
    accepted = parsed.filter(F.size("reasons") == 0)

    def rows(array: str) -> DataFrame:
        return accepted.select(*carry, F.explode(array).alias("_row")).select(*carry, "_row.*")

    dates = F.transform("_days", lambda day: day["usage_date"])
    facets = {
        "scope_start": F.array_min(dates),
        "scope_end": F.array_max(dates),
        "agents": F.array_sort(F.array_distinct(F.transform("_daily", lambda row: row["agent"]))),
        "models": F.array_sort(F.array_distinct(F.transform("_models", lambda row: row["model"]))),
        "daily_rows": F.size("_daily"),
        "model_rows": F.size("_models"),
        "session_rows": F.greatest(F.coalesce(F.size("_session_rows"), F.lit(0)), F.lit(0)),
    }
    # Documents whose sums exceed a bigint are refused.
    facets.update({name: _sum_of(F.col("_daily"), name).try_cast("bigint") for name in FIVE_COUNTERS})
    return Snapshots(
        daily=rows("_daily"),
        models=rows("_models"),
        sessions=rows("_session_rows"),
        summary=accepted.select(*carry, "source_shape", "warnings", *[v.alias(k) for k, v in facets.items()]),
        rejects=parsed.filter(F.size("reasons") > 0).select(*carry, "reasons"),
    )


def parse_snapshots(files: DataFrame, carry: tuple[str, ...] = ("file_id",), payload: str = "payload") -> Snapshots:
    return split_documents(parse_documents(files, payload), carry)
