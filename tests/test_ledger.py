"""Revisions, change classification, imports and sinks on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.config import LIMITS
from ledgerline.functions import fingerprints
from ledgerline.operators import checks, diff, imports, revisions
from ledgerline.operators.revisions import MODEL_KEYS
from ledgerline.sources import sinks, snapshots

D = dt.date
T = dt.datetime


def usage(spark, rows, model=False):
    """rows: (agent[, model], day of August 2026, total)."""
    out = []
    for r in rows:
        *names, day, total = r
        key = {"agent": names[0], **({"model": names[1]} if model else {})}
        out.append({**key, "machine_id": "m", "usage_date": D(2026, 8, day), "input_tokens": total, "output_tokens": 0,
                    "cache_read_tokens": 0, "cache_creation_tokens": 0, "reported_total_tokens": total,
                    "accounting_delta_tokens": 0, "reported_cost_usd": None, "is_tombstone": False, "id": "-", "import_id": "-",
                    "usage_hash": None})
    frame = spark.createDataFrame(out, schemas.MODEL_DAILY if model else schemas.DAILY)
    make = fingerprints.model_hash if model else fingerprints.daily_hash
    return frame.withColumn("usage_hash", make(F.col))


CURRENT = [("a", 27, 100), ("a", 28, 200), ("a", 29, 300), ("b", 27, 10), ("b", 28, 20), ("b", 29, 30),
           ("c", 27, 207790480), ("c", 28, 1642946820), ("c", 29, 369407169)]


def summary(changes):
    return diff.change_summary(changes).collect()[0]


def test_absence_is_not_deletion(spark):
    incoming = [r for r in CURRENT if r[0] != "c"] + [("a", 30, 5000)]
    changes = diff.classify_changes(usage(spark, incoming), usage(spark, CURRENT))
    row = summary(changes)
    assert (row.new_rows, row.removed_rows, row.unchanged_rows, row.net_change) == (1, 0, 6, 5000)
    assert row.after_total == row.before_total + row.net_change
    assert diff.rows_to_write(changes).count() == 1


def test_late_scope_and_downward_revision(spark):
    row = summary(diff.classify_changes(usage(spark, [("a", 27, 100), ("a", 30, 7000)]), usage(spark, CURRENT)))
    assert (row.removed_rows, row.net_change) == (0, 7000)
    row = summary(diff.classify_changes(usage(spark, [("a", 27, 40)]), usage(spark, CURRENT)))
    assert (row.revised_rows, row.net_change) == (1, -60)


def test_mixed_change(spark):
    row = summary(diff.classify_changes(usage(spark, [("a", 27, 100), ("b", 27, 15), ("d", 27, 200)]), usage(spark, CURRENT)))
    assert (row.unchanged_rows, row.revised_rows, row.new_rows, row.net_change) == (1, 1, 1, 205)


def test_explicit_removal_writes_one_tombstone(spark):
    current = usage(spark, [("a", 28, 100), ("c", 28, 50), ("c", 30, 60)])
    changes = diff.classify_changes(usage(spark, [("a", 28, 100)]), current, allow_removal=True)
    rows = diff.rows_to_write(changes).collect()
    assert [(r.agent, r.is_tombstone, r.reported_total_tokens) for r in rows] == [("c", True, 0)]
    scopes = spark.createDataFrame([("m", D(2026, 8, 1), D(2026, 8, 31))], "machine_id string, scope_start date, scope_end date")
    assert summary(diff.classify_changes(usage(spark, [("a", 28, 100)]), current, scopes=scopes, allow_removal=True)).removed_rows == 2


def test_model_rules_are_the_same(spark):
    current = usage(spark, [("a", "x", 27, 10), ("a", "y", 27, 20)], model=True)
    incoming = usage(spark, [("a", "x", 27, 11)], model=True)
    row = summary(diff.classify_changes(incoming, current, MODEL_KEYS))
    assert (row.revised_rows, row.removed_rows, row.net_change) == (1, 0, 1)
    removed = diff.classify_changes(incoming, current, MODEL_KEYS, allow_removal=True)
    assert [(r.model, r.is_tombstone) for r in diff.rows_to_write(removed, MODEL_KEYS).filter("is_tombstone").collect()] == [("y", True)]


def ledger(spark):
    made = spark.createDataFrame([
        ("i1", "m", "processed", T(2026, 8, 1), T(2026, 8, 1)), ("i2", "m", "processed", T(2026, 8, 2), T(2026, 8, 2)),
        ("i3", "m", "processing", T(2026, 8, 3), None), ("i4", "m", "processed", T(2026, 8, 4), None)],
        "import_id string, machine_id string, status string, created_at timestamp, processed_at timestamp")
    rows = usage(spark, [("a", 1, 10), ("a", 1, 20), ("a", 1, 99), ("b", 1, 5), ("b", 1, 0), ("c", 1, 7)])
    # a: i1 then i2, i3 unprocessed; b: i1 then a tombstone in i2; c: only the import without a processing time
    ids = ["i1", "i2", "i3", "i1", "i2", "i4"]
    local = [dict(r.asDict(), import_id=i, id=f"o{n}", is_tombstone=(n == 4)) for n, (r, i) in enumerate(zip(rows.collect(), ids))]
    facts = spark.createDataFrame(local, rows.schema).withColumn("created_at", F.lit(T(2026, 8, 1)))
    return facts, made


def test_latest_processed_revision_wins_and_tombstones_hide(spark):
    facts, made = ledger(spark)
    got = {(r.agent, r.reported_total_tokens) for r in revisions.current_daily(facts, made).collect()}
    assert got == {("a", 20), ("c", 7)}


def test_a_to_b_to_a_ends_at_a(spark):
    made = spark.createDataFrame([(f"i{n}", "processed", T(2026, 8, n), T(2026, 8, n)) for n in (1, 2, 3)],
                                 "import_id string, status string, created_at timestamp, processed_at timestamp")
    rows = usage(spark, [("a", 1, 10), ("a", 1, 20), ("a", 1, 10)]).collect()
    facts = spark.createDataFrame([dict(r.asDict(), import_id=f"i{n + 1}", id=f"o{n}") for n, r in enumerate(rows)], schemas.DAILY)
    got = revisions.current_daily(facts.withColumn("created_at", F.lit(T(2026, 8, 1))), made).collect()
    assert [(r.id, r.reported_total_tokens) for r in got] == [("o2", 10)]


def test_one_row_per_key_is_kept_before_the_shuffle(spark):
    facts, made = ledger(spark)
    plan = revisions.current_daily(facts, made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_link_counts_only_while_its_target_is_current(spark):
    facts, made = ledger(spark)
    links = spark.createDataFrame([("o1", "o5"), ("o5", "o0")], "observation_id string, canonical_observation_id string")
    flagged = revisions.with_mirror_flag(revisions.current_daily(facts, made), links)
    assert {(r.id, r.global_duplicate) for r in flagged.collect()} == {("o1", True), ("o5", False)}


def test_session_evidence_state(spark):
    machines = spark.createDataFrame([("a",), ("b",), ("c",)], "machine_id string")
    made = spark.createDataFrame([("i1", "processed"), ("i2", "failed")], "import_id string, status string")
    rows = spark.createDataFrame([("a", "i1", "x", "y"), ("a", "i2", "z", "z"), ("b", "i2", "x", "y")],
                                 "machine_id string, import_id string, identity_hash string, mirror_hash string").withColumn("created_at", F.lit(T(2026, 8, 1)))
    got = {r.machine_id: r.session_count for r in imports.session_evidence_state(machines, rows, made).collect()}
    assert got == {"a": 1, "c": 0}  # b has only unprocessed evidence and is absent


def files(spark, rows):
    return spark.createDataFrame([(i, m, h, T(2026, 8, 1) + dt.timedelta(minutes=n), "processed") for n, (i, m, h) in enumerate(rows)],
                                 "import_id string, machine_id string, raw_sha256 string, created_at timestamp, status string")


def test_exact_duplicates_of_one_hot_file(spark):
    rows = [(f"f{n:03d}", "m", "same" if n % 3 else f"own{n}") for n in range(300)]
    got = {r.import_id: r.duplicate_of_import_id for r in imports.mark_exact_duplicates(files(spark, rows), ["machine_id", "raw_sha256"]).collect()}
    assert len(got) == 300 and got["f001"] is None and got["f000"] is None
    assert {v for v in got.values() if v} == {"f001"} and sum(v is not None for v in got.values()) == 199


def test_failed_file_may_be_delivered_again(spark):
    made = files(spark, [("1", "m", "h"), ("2", "m", "h"), ("3", "m", "h")]).withColumn(
        "status", F.when(F.col("import_id") == "1", "failed").otherwise("processed"))
    got = {r.import_id: r.duplicate_of_import_id for r in imports.mark_exact_duplicates(made, ["machine_id", "raw_sha256"]).collect()}
    assert got == {"1": None, "2": None, "3": "2"}


@pytest.mark.parametrize("machine, known", [("m1", True), ("m", False), ("M1", False), ("-m1", False), ("off", False), ("gone", False)])
def test_registry(spark, machine, known):
    machines = spark.createDataFrame([("m1", True), ("m", True), ("off", False)], "machine_id string, is_active boolean")
    commands = spark.createDataFrame([("1", machine)], "import_id string, machine_id string")
    assert (checks.registry_rejects(commands, machines).count() == 0) is known


def test_same_content_elsewhere_takes_the_earliest_other_machine(spark):
    made = files(spark, [("1", "a", "h"), ("2", "a", "h"), ("3", "b", "h"), ("4", "c", "h"), ("5", "c", "k")])
    got = {r.import_id: r.other_import_id for r in imports.same_content_elsewhere(made.select("import_id", "machine_id", "raw_sha256"), made).collect()}
    assert got == {"1": "3", "2": "3", "3": "1", "4": "1", "5": None}


def test_stale_and_concurrent_processing(spark):
    now = T(2026, 8, 1, 12, 0)
    made = spark.createDataFrame([("1", "m", "processing", T(2026, 8, 1, 11, 44), None), ("2", "m", "processing", T(2026, 8, 1, 11, 45), None)],
                                 "import_id string, machine_id string, status string, created_at timestamp, processed_at timestamp")
    got = {r.import_id: r.status for r in imports.recover_stale(made, F.lit(now)).collect()}
    assert got == {"1": "failed", "2": "processing"}
    assert imports.concurrent_processing(made, ["machine_id"]).collect()[0].processing_imports == 2


def test_next_since_looks_back_three_days(spark):
    assert spark.range(1).select(imports.next_since(F.lit("2026-08-28").cast("date"))).collect()[0][0] == D(2026, 8, 26)


def test_promotion_is_idempotent(spark):
    facts, made = ledger(spark)
    rows = facts.filter("import_id = 'i3'")
    first = imports.promote(made, F.lit(T(2026, 8, 9)), rows, facts.limit(0))
    assert [(r.import_id, r.inserted_rows) for r in first.counts.collect()] == [("i3", 1)]
    assert first.imports.filter("status = 'processed'").count() == 4
    stored = first.daily.withColumn("created_at", F.lit(T(2026, 8, 9)))
    assert [(r.agent, r.reported_total_tokens) for r in revisions.current_daily(stored).collect()] == [("a", 99)]
    again = imports.promote(made, F.lit(T(2026, 8, 9)), rows, first.daily)
    assert again.counts.collect()[0].inserted_rows == 0
    assert imports.promote(first.imports, F.lit(T(2026, 8, 9)), rows, facts.limit(0)).daily.count() == 0


def test_future_day_is_judged_in_the_business_zone(spark):
    made = spark.createDataFrame([("1", D(2026, 8, 29))], "import_id string, scope_end date")
    late, early = F.lit("2026-08-28 23:30:00").cast("timestamp"), F.lit("2026-08-28 22:30:00").cast("timestamp")
    assert checks.future_dated(made, late, "Africa/Casablanca").count() == 0
    assert checks.future_dated(made, early, "Africa/Casablanca").count() == 1


def test_rules_report_every_broken_rule(spark):
    sha = "0" * 64
    row = ("o", "m", "i", " ", D(2026, 8, 1), 1, -1, 0, 0, 0, 0, None, True, "xyz")
    bad = spark.createDataFrame([row], schemas.DAILY)
    assert set(checks.violations(bad, checks.daily_rules()).collect()[0].violations) == {
        "agent length", "counters not negative", "hash format", "tombstone is zero"}
    links = spark.createDataFrame([("a", "a", "m", "guess", 1, 1.5)], schemas.LINKS)
    assert set(checks.violations(links, checks.link_rules()).collect()[0].violations) == {"link reason", "overlap ratio", "link not to itself"}
    good = spark.createDataFrame([("1", "m", sha, D(2026, 8, 1), D(2026, 8, 2), "processed", T(2026, 8, 1), None)], schemas.IMPORTS)
    assert checks.violations(good.withColumn("file_size_bytes", F.lit(10)), checks.import_rules()).count() == 0


def test_files_are_read_and_refused(spark, tmp_path):
    folder = tmp_path / "m1"
    folder.mkdir()
    (folder / "ok.json").write_text('{"daily": []}')
    (folder / "empty.json").write_bytes(b"")
    (folder / "bytes.json").write_bytes(b'{"a": "\xff"}')
    (folder / "big.json").write_bytes(b"x" * 200)
    found = snapshots.fingerprint_files(snapshots.read_snapshot_files(spark, str(tmp_path)))
    good, bad = snapshots.split_readable(found, max_bytes=100)
    assert [(r.machine_id, r.import_id, r.payload) for r in good.collect()] == [("m1", "ok", '{"daily": []}')]
    assert {r.import_id: r.reason for r in bad.collect()} == {"bytes": "not valid UTF-8", "big": "file too large"}
    empty = good.withColumns({"file_size_bytes": F.lit(0), "content": F.lit(b"")}).drop("payload")
    assert snapshots.split_readable(empty)[1].collect()[0].reason == "empty file"
    assert len(good.collect()[0].raw_sha256) == 64


def test_append_twice_stores_once(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = usage(spark, [("a", 1, 1), ("a", 2, 2)]).withColumn("project_path", F.lit("/secret"))
    keys = ["import_id", "agent", "usage_date"]
    sinks.append_facts(rows, path, keys)
    sinks.append_facts(rows.unionByName(usage(spark, [("a", 3, 3)]).withColumn("project_path", F.lit("/secret"))), path, keys)
    stored = spark.read.parquet(path)
    assert stored.count() == 3 and "project_path" not in stored.columns
    assert stored.select("usage_month").distinct().collect()[0][0] == "2026-08"
    assert sinks.read_facts(spark, path, "2026-08-02", "2026-08-02").count() == 1
    plan = sinks.read_facts(spark, path, "2026-08-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_month" in plan


@pytest.mark.parametrize("value, expected", [(1, 1), (LIMITS.max_counter, LIMITS.max_counter)])
def test_counter_bounds(spark, value, expected):
    from ledgerline.functions.numbers import counter
    assert spark.range(1).select(counter(F.lit(str(value)))).collect()[0][0] == expected
    assert spark.range(1).select(counter(F.lit(str(-value)))).collect()[0][0] is None
