"""Mirror detection on small cases and against a direct count."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerline.operators import mirrors

D, T = dt.date, dt.datetime
SESSION = "machine_id string, agent string, identity_hash string, mirror_hash string, first_activity timestamp, last_activity timestamp"
DAILY = ("machine_id string, id string, agent string, usage_date date, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, "
         "cache_creation_tokens bigint, reported_total_tokens bigint, is_tombstone boolean, global_duplicate boolean")


def sessions(spark, rows):
    return spark.createDataFrame([(m, "a", i, h, T(2026, 8, s), T(2026, 8, e)) for m, i, h, s, e in rows], SESSION)


def daily(spark, rows):
    return spark.createDataFrame([(m, f"{m}-{d}", "a", D(2026, 8, d), n, 0, 0, 0, n, False, False) for m, d, n in rows], DAILY)


def analyse(spark, incoming, existing, in_daily, ex_daily, raw=None):
    left, right = sessions(spark, incoming), sessions(spark, existing)
    evidence = mirrors.session_evidence(left, right)
    rows = daily(spark, in_daily)
    links = mirrors.choose_links(rows, daily(spark, ex_daily), mirrors.strong_mirrors(left, right), raw)
    risk = [x.partial_mirror_risk for x in mirrors.partial_mirror_risk(rows, links, left, right).collect()]
    return evidence, links, rows, risk


TWO = [("new", "s1", "h1", 28, 28), ("new", "s2", "h2", 28, 29)]
SAME = [("old", "s1", "h1", 28, 28), ("old", "s2", "h2", 28, 29)]


def test_strong_mirror_links_one_row(spark):
    evidence, links, rows, risk = analyse(spark, TWO, SAME, [("new", 28, 100)], [("old", 28, 100)])
    link = links.collect()[0]
    assert (link.canonical_machine_id, link.reason, link.session_overlap_ratio) == ("old", "exact_daily_with_session_evidence", 1.0)
    assert mirrors.tokens_prevented(links, rows).collect()[0].duplicate_tokens_prevented == 100
    assert risk == [False]


def test_partial_mirror_is_only_a_risk(spark):
    evidence, links, rows, risk = analyse(spark, TWO[:1], [("old", "s1", "other", 28, 28)], [("new", 28, 100)], [("old", 28, 100)])
    row = evidence.collect()[0]
    assert (row.exact_matches, row.identity_matches, row.strong) == (0, 1, False)
    assert links.count() == 0
    assert risk == [True]


def test_same_file_links_without_sessions(spark):
    raw = spark.createDataFrame([("new", "old")], "machine_id string, other_machine_id string")
    _, links, _, _ = analyse(spark, [], [], [("new", 28, 100)], [("old", 28, 100), ("third", 28, 100)], raw)
    assert [(r.reason, r.canonical_machine_id, r.matched_session_count) for r in links.collect()] == [("exact_raw_snapshot", "old", 0)]


def test_divergent_counters_do_not_link(spark):
    evidence, links, rows, risk = analyse(spark, TWO, SAME, [("new", 28, 100)], [("old", 28, 101)])
    assert links.count() == 0 and mirrors.tokens_prevented(links, rows).count() == 0
    assert risk == [True]


def test_day_outside_the_window_does_not_link(spark):
    _, links, _, _ = analyse(spark, TWO, SAME, [("new", 27, 100)], [("old", 27, 100)])
    assert links.count() == 0


def test_links_never_point_to_their_own_machine(spark):
    _, links, _, _ = analyse(spark, TWO + SAME, TWO + SAME, [("new", 28, 5), ("old", 28, 5)], [("new", 28, 5), ("old", 28, 5)])
    assert {(r.machine_id, r.canonical_machine_id) for r in links.collect()} == {("new", "old"), ("old", "new")}
    own = mirrors.validate_links(links, daily(spark, [("new", 28, 5), ("old", 28, 5)]), daily(spark, [("new", 28, 5), ("old", 28, 5)]))
    assert own.count() == 2


def test_totals_without_pairs_equal_the_pairs(spark):
    rng = random.Random(5)
    rows = [(f"m{rng.randrange(9)}", f"i{rng.randrange(12)}", f"h{rng.randrange(12)}", 1 + rng.randrange(20), 25) for _ in range(200)]
    frame = sessions(spark, rows)
    pairs = mirrors.session_evidence(frame, frame).groupBy("machine_id").agg(
        F.sum("exact_matches").alias("exact_matches"), F.sum("identity_matches").alias("identity_matches"))
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in mirrors.match_totals(frame, frame).collect()}


def test_merged_windows_cover_the_same_days(spark):
    rng = random.Random(7)
    spans = []
    for _ in range(40):
        s = 1 + rng.randrange(28)
        spans.append((f"m{rng.randrange(3)}", "a", D(2026, 8, s), D(2026, 8, min(31, s + rng.randrange(4)))))
    frame = spark.createDataFrame(spans, "machine_id string, agent string, risk_start date, risk_end date")
    def days(rows):
        return {(r.machine_id, r.risk_start + dt.timedelta(n)) for r in rows for n in range((r.risk_end - r.risk_start).days + 1)}
    merged = mirrors.merged_windows(frame).collect()
    assert days(merged) == days(frame.collect()) and sum((r.risk_end - r.risk_start).days + 1 for r in merged) == len(days(merged))


def random_sessions(seed, machines=14, hot=True):
    """Machines copied from a few templates with some changes, and one session that nearly every machine holds."""
    rng = random.Random(seed)
    templates = [[f"t{t}-{n}" for n in range(rng.randrange(2, 12))] for t in range(4)]
    rows = []
    for m in range(machines):
        for name in rng.choice(templates):
            if rng.random() < 0.9:
                start = 1 + rng.randrange(20)
                rows.append((f"m{m}", f"i{name}", f"h{name}" if rng.random() < 0.9 else f"h{name}-{m}", start, start + rng.randrange(5)))
        if hot and rng.random() < 0.9:
            rows.append((f"m{m}", "ihot", "hhot", 9, 9))
    return rows


def test_strong_mirrors_equal_the_full_evidence(spark):
    for seed, matches, overlap in ((1, 2, 0.8), (2, 2, 0.8), (3, 1, 0.3), (4, 3, 1.0)):
        frame = sessions(spark, random_sessions(seed))
        columns = ["machine_id", "other_machine_id", "agent", "exact_matches", "exact_overlap_ratio", "evidence_start", "evidence_end"]
        full = mirrors.session_evidence(frame, frame, matches, overlap).filter("strong").select(columns).collect()
        fast = mirrors.strong_mirrors(frame, frame, matches, overlap).select(columns).collect()
        assert sorted(map(tuple, full)) == sorted(map(tuple, fast))
        assert full or overlap == 1.0


def test_a_session_every_machine_holds_forms_no_candidates(spark):
    """One fingerprint on 2,000 machines is one class; it tells nothing, so it forms none of its four million pairs."""
    rows = [(f"m{m}", f"i{m}-{n}", f"h{m}-{n}", 5, 5) for m in range(2000) for n in range(4)] + [(f"m{m}", "ihot", "hhot", 5, 5) for m in range(2000)]
    rows += [(f"m{m}", f"both{n}", f"hboth{n}", 3, 6) for m in (3, 4) for n in range(30)]
    frame = sessions(spark, rows)
    classes = mirrors.session_classes(mirrors.incoming_fingerprints(frame).filter("kind = 'mirror'"))
    assert classes.select("class").distinct().count() == 2 and classes.filter("holders = 2000").count() == 2000
    telling = mirrors._telling(classes, mirrors.identity_counts(frame, "sessions"), 2, 0.8).collect()
    assert {x.machine_id for x in telling} == {"m3", "m4"} and len({x["class"] for x in telling}) == 1
    strong = mirrors.strong_mirrors(frame, frame).collect()
    assert {(x.machine_id, x.other_machine_id, x.exact_matches) for x in strong} == {("m3", "m4", 31), ("m4", "m3", 31)}


def test_only_agents_of_the_daily_rows_are_compared(spark):
    frame = sessions(spark, [("m1", "i", "h", 1, 1), ("m2", "i", "h", 1, 1)])
    days = daily(spark, [("m1", 1, 1)])
    assert {x.machine_id for x in mirrors.in_agent_scope(frame, days).collect()} == {"m1"}
    assert mirrors.in_agent_scope(frame, days.withColumn("agent", F.lit("another"))).count() == 0


def test_days_meet_only_windows_of_their_months(spark):
    draw = random.Random(4)
    base = dt.date(2026, 1, 1)
    days = [("m", draw.choice("ab"), base + dt.timedelta(days=draw.randrange(400))) for _ in range(80)]
    windows = [("m", "a", base + dt.timedelta(days=k), base + dt.timedelta(days=k + draw.randrange(70))) for k in range(0, 400, 97)]
    got = mirrors.days_in_windows(spark.createDataFrame(days, "machine_id string, agent string, usage_date date"),
                                  spark.createDataFrame([*windows, ("m", "b", None, base)], "machine_id string, agent string, risk_start date, risk_end date"))
    want = {x for x in days if x[1] == "b" or any(w[2] <= x[2] <= w[3] for w in windows)}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_risk_equals_the_windows_of_the_full_evidence(spark):
    for seed in (1, 2):
        frame = sessions(spark, [r for r in random_sessions(seed, 8, hot=False)])
        days = daily(spark, [(f"m{m}", 1 + (m * 7 + n * 5) % 28, m) for m in range(8) for n in range(2)])
        links = mirrors.choose_links(days, days, mirrors.strong_mirrors(frame, frame))
        evidence = mirrors.session_evidence(frame, frame).collect()
        linked = {(x.machine_id, x.usage_date) for x in links.collect()}
        expected = {x.machine_id: False for x in days.collect()}
        for x in days.collect():
            if (x.machine_id, x.usage_date) not in linked and any(
                    e.machine_id == x.machine_id and e.risk_start <= x.usage_date <= e.risk_end for e in evidence):
                expected[x.machine_id] = True
        got = {x.machine_id: x.partial_mirror_risk for x in mirrors.partial_mirror_risk(days, links, frame, frame).collect()}
        assert got == expected


def test_row_between_two_shared_sessions(spark):
    mine = [("new", "s1", "x1", 1, 2), ("new", "s2", "x2", 20, 21)]
    same_machine = [("old", "s1", "y1", 1, 2), ("old", "s2", "y2", 20, 21)]
    two_machines = [("old", "s1", "y1", 1, 2), ("other", "s2", "y2", 20, 21)]
    for existing, expected in ((same_machine, [True]), (two_machines, [False])):
        assert analyse(spark, mine, existing, [("new", 10, 1)], [])[3] == expected
