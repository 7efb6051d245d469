import copy
import hashlib
import json

import pytest

from ledgerline.operators.normalize import parse_documents, split_documents


def counters(i, o, r, c, total=None):
    return {"inputTokens": i, "outputTokens": o, "cacheReadTokens": r, "cacheCreationTokens": c,
            "totalTokens": i + o + r + c if total is None else total}


def good():
    return {
        "daily": [{
            "period": "2026-08-28", "agent": "all", **counters(90, 30, 180, 0),
            "agents": [
                {"agent": " Alpha ", **counters(40, 10, 50, 0), "totalCost": 0.5,
                 "modelBreakdowns": [{"modelName": "M-One", **counters(40, 10, 50, 0), "cost": 0.5}]},
                {"agent": "beta", **counters(50, 20, 130, 0),
                 "breakdown": {"m-two": {k: v for k, v in counters(50, 20, 130, 0).items() if k != "totalTokens"}}},
            ],
        }],
        "totals": counters(90, 30, 180, 0),
    }


def with_sessions(path="/workspace/a", price=1.25):
    doc = good()
    doc["session"] = [
        {"sessionId": "Session-A", "agent": "alpha", **counters(40, 10, 50, 0), "totalCost": price,
         "modelsUsed": ["B", "a", "a", ""], "metadata": {"firstActivity": "2026-08-28T10:00:00.000Z",
                                                   "lastActivity": "2026-08-28T11:00:00Z", "projectPath": path}},
        {"period": "Session-B", "agent": "beta", **counters(20, 10, 20, 0), "totalCost": 0.5},
    ]
    return doc


def bad_total(d): d["totals"]["totalTokens"] = 301
def bad_day(d): d["daily"][0]["totalTokens"] = 301
def bad_date(d): d["daily"][0]["period"] = "2026-02-30"
def no_counter(d): del d["daily"][0]["agents"][0]["inputTokens"]
def fraction_counter(d): d["daily"][0]["agents"][0]["inputTokens"] = 1.5
def huge_counter(d): d["daily"][0]["agents"][0]["inputTokens"] = "9007199254740992"
def model_drift(d): d["daily"][0]["agents"][0]["modelBreakdowns"][0]["inputTokens"] = 41
def agent_all(d): d["daily"][0]["agents"][0]["agent"] = "All"
def agent_long(d): d["daily"][0]["agents"][0]["agent"] = "a" * 129
def agent_control(d): d["daily"][0]["agents"][0]["agent"] = "a\u0007b"
def model_long(d): d["daily"][0]["agents"][0]["modelBreakdowns"][0]["modelName"] = "m" * 257
def negative_cost(d): d["daily"][0]["agents"][0]["totalCost"] = -1
def no_days(d): d["daily"] = []
def no_shape(d): del d["daily"]
def no_agent(d): d["daily"][0]["agents"] = []
def conflict(d): d["daily"][0]["agents"][1] = {**d["daily"][0]["agents"][1], "agent": "alpha"}


REJECTS = [
    (bad_total, "rows do not reconcile with totals"), (bad_day, "agents do not reconcile with day"),
    (bad_date, "invalid date"), (no_counter, "invalid counter"), (fraction_counter, "invalid counter"),
    (huge_counter, "invalid counter"), (model_drift, "models do not reconcile with agent"), (agent_all, "invalid agent"),
    (agent_long, "invalid agent"), (agent_control, "invalid agent"), (model_long, "invalid model"),
    (negative_cost, "invalid cost"), (no_days, "empty report"), (no_shape, "unsupported shape"),
    (no_agent, "invalid agent"), (conflict, "conflicting daily rows"),
]
MALFORMED = ["{bad", "[1]", "", "12", '{"daily": []} trailing', '{"daily": []}{"daily": []}', '{"daily": []}}']


def documents():
    docs = {"good": good(), "sessions": with_sessions(), "moved": with_sessions("/workspace/b", 9)}
    quoted = good()
    docs["standard"] = {"type": "daily", "data": quoted["daily"], "totals": {k: str(v) for k, v in quoted["totals"].items()}}
    docs["own agent"] = {"daily": [{"date": "2026-08-28", "agent": "alpha", **counters(1, 2, 3, 4, total=15)}]}
    twice = good()
    twice["daily"][0]["agents"].append(copy.deepcopy(twice["daily"][0]["agents"][0]))
    twice["daily"][0].update(counters(130, 40, 230, 0))
    docs["twice"] = twice
    bad_time = with_sessions()
    bad_time["session"][0]["metadata"]["firstActivity"] = "not a time"
    docs["bad time"] = bad_time
    clash = with_sessions()
    clash["session"].append({**clash["session"][1], "totalCost": 3})
    docs["session conflict"] = clash
    docs["empty wins"] = {**good(), "session": [], "sessions": with_sessions()["session"]}
    docs["report"] = {**good(), "sessionReport": {"sessions": with_sessions()["session"]}}
    for change, _ in REJECTS:
        doc = good()
        change(doc)
        docs[change.__name__] = doc
    texts = {k: json.dumps(d) for k, d in docs.items()}
    texts.update({f"malformed {i}": t for i, t in enumerate(MALFORMED)})
    return texts


class Parsed:
    def __init__(self, spark):
        files = spark.createDataFrame(list(documents().items()), "file_id string, payload string").coalesce(1)
        whole = parse_documents(files).cache()
        out = split_documents(whole)
        self.session_columns = out.sessions.columns
        self.tables = {n: getattr(out, n).collect() for n in ("daily", "models", "sessions", "summary", "rejects")}
        whole.unpersist()

    def rows(self, table, name):
        return [r for r in self.tables[table] if r.file_id == name]

    def summary(self, name):
        return self.rows("summary", name)[0]

    def reasons(self, name):
        return [x for r in self.rows("rejects", name) for x in r.reasons]


@pytest.fixture(scope="module")
def parsed(spark):
    return Parsed(spark)


def test_accepts_and_flattens(parsed):
    daily = {r.agent: r for r in parsed.rows("daily", "good")}
    assert set(daily) == {"alpha", "beta"}
    assert daily["alpha"].reported_total_tokens == 100 and daily["beta"].reported_total_tokens == 200
    assert {(r.agent, r.model, r.reported_total_tokens) for r in parsed.rows("models", "good")} == {
        ("alpha", "m-one", 100), ("beta", "m-two", 200)}
    row = parsed.summary("good")
    assert str(row.scope_start) == "2026-08-28" and row.agents == ["alpha", "beta"]
    assert row.reported_total_tokens == 300 and row.source_shape == "unified-daily"
    assert row.warnings == ["no session section"]


def test_daily_hash_is_the_documented_text(parsed):
    row = [r for r in parsed.rows("daily", "good") if r.agent == "alpha"][0]
    text = "daily-agent-v2|alpha|2026-08-28|40|10|50|0|100|0.5|present"
    assert row.usage_hash == hashlib.sha256(text.encode()).hexdigest()


def test_standard_shape_and_quoted_counters(parsed):
    assert parsed.summary("standard").source_shape == "standard-daily"


def test_day_as_its_own_agent(parsed):
    assert parsed.rows("daily", "own agent")[0].accounting_delta_tokens == 5
    assert "no model breakdown for alpha on 2026-08-28" in parsed.summary("own agent").warnings


def test_same_row_twice_collapses_but_counts_in_the_day(parsed):
    assert parsed.reasons("twice") == [] and len(parsed.rows("daily", "twice")) == 2


@pytest.mark.parametrize("change, reason", REJECTS)
def test_rejects(parsed, change, reason):
    assert reason in parsed.reasons(change.__name__)
    assert not parsed.rows("daily", change.__name__)


@pytest.mark.parametrize("i", range(len(MALFORMED)))
def test_malformed_documents(parsed, i):
    assert parsed.reasons(f"malformed {i}") == ["malformed document"]


def test_sessions_hide_the_path(parsed):
    assert "project_path" not in parsed.session_columns
    rows = {r.session_id: r for r in parsed.rows("sessions", "sessions")}
    assert rows["Session-A"].models == ["a", "b"] and rows["Session-A"].reported_total_tokens == 100
    assert str(rows["Session-A"].first_activity) == "2026-08-28 10:00:00"
    assert parsed.summary("sessions").warnings == []


def test_moved_session_keeps_identity_and_mirror(parsed):
    a, b = ({r.session_id: r for r in parsed.rows("sessions", n)}["Session-A"] for n in ("sessions", "moved"))
    assert a.identity_hash == b.identity_hash and a.mirror_hash == b.mirror_hash
    assert a.local_key_hash != b.local_key_hash and a.session_hash != b.session_hash


def test_session_rejects(parsed):
    assert parsed.reasons("bad time") == ["invalid session"]
    assert parsed.reasons("session conflict") == ["conflicting session rows"]


def test_first_session_array_wins_even_when_empty(parsed):
    assert len(parsed.rows("sessions", "empty wins")) == 0
    assert len(parsed.rows("sessions", "report")) == 2
