"""Readings: validation, comparison, rollover, append rule and streams."""

import datetime as dt
import json
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import append, pacing, readings as r
from ledgerline.operators.skew import wide_join, with_previous
from ledgerline.plans import stream_queries
from ledgerline.streaming import ingest, rollups as stream_rollups
from ledgerline.sources.versioned import VersionedStore
from ledgerline.streaming import current, readings as live

T = dt.datetime
READING = "account string, reading_id bigint, observed_at timestamp, fetched_at timestamp, fraction decimal(9,4), status string, provider_resets_at timestamp"
CONTRACT = ("contract_id string, account string, tracking_start timestamp, reset_at timestamp, check_time string, baseline double, hard_limit double, "
            "safety_reserve double")
ENDS = T(2026, 9, 29, 10, 29)


def contract(spark):
    base = spark.createDataFrame([("c", "u", T(2026, 9, 1, 0), T(2026, 9, 11, 0), "12:00", 0.0, 1.0, 0.0)], CONTRACT)
    return pacing.with_schedule(base, "UTC")


def readings(spark, rows):
    """rows: (observed, fraction[, status[, resets]])."""
    out = []
    for n, row in enumerate(rows):
        observed, fraction, status, resets = [*row, "ok", ENDS][:2] + [row[2] if len(row) > 2 else "ok", row[3] if len(row) > 3 else ENDS]
        out.append(("u", n, observed, observed, Decimal(str(fraction)), status, resets))
    return spark.createDataFrame(out, READING)


def compare(spark, rows, now):
    return r.compare(contract(spark), readings(spark, rows), F.lit(now)).collect()[0]


NOW = T(2026, 9, 5, 12, 10)  # active ceiling 0.45


@pytest.mark.parametrize("rows, now, status", [
    ([], NOW, "SYNC_STALE"), ([], T(2026, 9, 11), "RESET_REQUIRED"),
    ([(T(2026, 9, 5, 12, 9), 0.2)], NOW, "ON_TRACK"), ([(T(2026, 9, 5, 12, 9), 0.44)], NOW, "NEAR_PLAN"),
    ([(T(2026, 9, 5, 12, 9), 0.45)], NOW, "NEAR_PLAN"), ([(T(2026, 9, 5, 12, 9), 0.43)], NOW, "NEAR_PLAN"),
    ([(T(2026, 9, 5, 12, 9), 0.4299)], NOW, "ON_TRACK"), ([(T(2026, 9, 5, 12, 9), 0.46)], NOW, "OVER_PACE"),
    ([(T(2026, 9, 5, 11, 40), 0.2)], NOW, "ON_TRACK"), ([(T(2026, 9, 5, 11, 39), 0.2)], NOW, "SYNC_STALE"),
    ([(T(2026, 9, 5, 12, 9), 1.0)], NOW, "LIMIT_EXCEEDED"), ([(T(2026, 9, 5, 12, 9), 0.1, "Rate_Limited")], NOW, "LIMIT_EXCEEDED"),
    ([(T(2026, 9, 5, 10), 0.08), (T(2026, 9, 5, 12, 9), 0.01, "ok", T(2026, 10, 29))], NOW, "RESET_REQUIRED"),
    ([(T(2026, 8, 30), 0.9, "ok", T(2026, 8, 31)), (T(2026, 9, 5, 12, 9), 0.2)], NOW, "ON_TRACK"),
    ([(T(2026, 9, 5, 12, 9), 0.2)], T(2026, 9, 11), "RESET_REQUIRED")])
def test_comparison_status(spark, rows, now, status):
    assert compare(spark, rows, now).comparison_status == status


def test_headroom_and_freshness(spark):
    row = compare(spark, [(T(2026, 9, 5, 12, 9), 0.2)], NOW)
    assert row.safe_headroom == pytest.approx(0.25) and row.provider_remaining == pytest.approx(0.8) and row.freshness == "LIVE"
    stale = compare(spark, [(T(2026, 9, 5, 11, 40), 0.2)], NOW)
    assert stale.freshness == "STALE"  # stale from 30 minutes on, while SYNC_STALE needs more than 30


@pytest.mark.parametrize("before, after, observed, expected", [
    (T(2026, 9, 5), T(2026, 10, 5), T(2026, 9, 5), True), (T(2026, 9, 5), T(2026, 9, 5, 0, 1), T(2026, 9, 5), False),
    (T(2026, 9, 15), T(2026, 9, 15, 0, 5), T(2026, 9, 5), False), (T(2026, 9, 15), T(2026, 9, 16), T(2026, 9, 5), True),
    (T(2026, 9, 15), T(2026, 9, 15), T(2026, 9, 20), False), (None, T(2026, 9, 15), T(2026, 9, 5), False)])
def test_rollover(spark, before, after, observed, expected):
    lit = lambda x: F.lit(x).cast("timestamp")
    assert spark.range(1).select(r.is_rollover(lit(before), lit(after), lit(observed))).collect()[0][0] is expected


def test_payloads(spark):
    good = {"usage": {"monthly": {"status": "ok", "percent": 19, "resetsAt": "2026-09-29T11:13:41.824Z"}}}
    def variant(**kw):
        return {"usage": {"monthly": {**good["usage"]["monthly"], **kw}}}
    bad = [{}, {"usage": None}, {"usage": {}}, variant(percent="19"), variant(percent=None), variant(percent=-1), variant(percent=101),
           variant(status=" "), variant(status=7), variant(resetsAt="soon"), variant(resetsAt="")]
    texts = [json.dumps(x) for x in [good, variant(percent=100), *bad]] + ['{"usage": {"monthly": {"percent": NaN}}}', "[]", "x"]
    raw = spark.createDataFrame([("u", n, T(2026, 9, 5), 1500, t) for n, t in enumerate(texts)],
                                "account string, reading_id bigint, fetched_at timestamp, fetch_duration_ms bigint, payload string")
    valid, refused = r.parse_payloads(raw)
    rows = {x.reading_id: x for x in valid.collect()}
    assert set(rows) == {0, 1} and rows[0].fraction == 0.19 and rows[1].fraction == 1.0
    assert rows[0].provider_resets_at == T(2026, 9, 29, 11, 13, 41)
    assert rows[0].observed_at == T(2026, 9, 4, 23, 59, 58, 500000)
    assert refused.count() == len(texts) - 2


def test_first_in_window_ignores_other_cycles(spark):
    rows = [(T(2026, 9, 5, 0, 30), 0.1), (T(2026, 9, 5, 23, 45), 0.2), (T(2026, 9, 5, 23, 50), 0.3), (T(2026, 9, 11, 1), 0.9), (T(2026, 8, 31, 13), 0.9)]
    got = {(x.day, float(x.fraction)) for x in r.first_in_window(readings(spark, rows), contract(spark)).collect()}
    assert got == {(4, 0.1), (5, 0.2)}


def test_checkpoint_rows_and_default_window(spark):
    frame = readings(spark, [(T(2026, 9, 3, 13), 0.1), (T(2026, 9, 5, 12, 9), 0.2)])
    rows = r.checkpoint_rows(contract(spark), frame, F.lit(NOW))
    got = {x.day: (x.status, x.observation) for x in rows.collect()}
    assert got[3] == ("On track", 0.1) and got[4] == ("—", None) and got[5] == ("On track", 0.2) and got[6] == ("Upcoming", None)
    assert sorted(x.day for x in r.default_rows(rows).collect()) == [2, 3, 4, 5, 6, 7, 8, 9, 10]
    later = readings(spark, [(T(2026, 9, 5, 12, 9), 0.2), (T(2026, 9, 20), 0.5)])
    live = r.checkpoint_rows(contract(spark), later, F.lit(NOW)).filter("is_current").collect()[0]
    assert (live.status, live.observation) == ("On track", None)  # the newest reading of all lies outside the contract


@pytest.mark.parametrize("rows_per_part", [2, 1000])
def test_wide_join_equals_a_plain_join(spark, rows_per_part):
    rows = spark.createDataFrame([(k, n) for n in range(20) for k in ("hot", "hot", None, f"k{n}")], "k string, n int")
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("k99", 4), (None, 5)], "k string, v int")
    got = wide_join(rows, lookup, ["k"], ["n"], rows_per_part).select("k", "n", "v").collect()
    assert sorted(got) == sorted(rows.join(lookup, "k").select("k", "n", "v").collect()) and len(got) == 81


def test_checkpoint_arrays_are_never_broadcast(spark):
    frame = readings(spark, [(T(2026, 9, 3, 13), 0.1), (T(2026, 9, 5, 12, 9), 0.2)])
    rows = r.checkpoint_rows(contract(spark), frame, F.lit(NOW))
    for result, joins in ((r.readings_with_ceiling(frame, contract(spark)), 1), (r.first_in_window(frame, contract(spark)), 1), (r.chart_points(contract(spark), rows), 4)):
        assert result._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= joins


def test_refresh_policy(spark):
    rows = [("a", T(2026, 9, 5, 12, 9, 30), T(2026, 9, 1), T(2026, 9, 11)), ("b", T(2026, 9, 5, 12, 8), T(2026, 9, 1), T(2026, 9, 11)),
            ("c", None, T(2026, 9, 1), T(2026, 9, 11)), ("d", T(2026, 9, 5, 12, 9, 30), T(2026, 9, 6), T(2026, 9, 11)), ("e", T(2026, 9, 5, 12, 9, 30), None, None)]
    frame = spark.createDataFrame(rows, "account string, observed_at timestamp, tracking_start timestamp, reset_at timestamp")
    got = {x.account: (x.due, x.cooling_down, x.cooldown_seconds_left) for x in r.refresh_policy(frame, F.lit(NOW)).collect()}
    assert got == {"a": (False, True, 15.0), "b": (True, False, 0.0), "c": (True, False, 0.0), "d": (False, False, 0.0), "e": (False, True, 15.0)}


def random_readings(seed, n, step, values, accounts=2):
    rng = random.Random(seed)
    rows, clock = [], {a: T(2026, 9, 1) for a in range(accounts)}
    for i in range(n):
        a = 0 if rng.random() < 0.7 else rng.randrange(accounts)
        clock[a] += dt.timedelta(seconds=rng.randrange(1, step))
        reset = ENDS + dt.timedelta(seconds=rng.choice([0, 0, 1, 30, 59, 61, 100, 200]) if rng.random() < 0.2 else 0)
        rows.append((f"a{a}", i, clock[a], clock[a] + dt.timedelta(seconds=rng.randrange(3)), Decimal(rng.randrange(values)) / 100, "ok", reset))
    return rows


def brute(rows, rule):
    kept, last = set(), {}
    for row in sorted(rows, key=lambda x: (x[2], x[1])):
        account, n, observed, fetched, fraction, status, reset = row
        before = last.get(account)
        store = before is None or before[4] != fraction or before[5] != status or abs((reset - before[6]).total_seconds()) > 60
        if not store:
            age = (fetched - before[2]).total_seconds()
            store = not (rule.cooldown_seconds is not None and age < rule.cooldown_seconds) and age > 3600
        if store:
            kept.add(n)
            last[account] = row
    return kept


@pytest.mark.parametrize("step, values, rule, hours", [(900, 1, append.ATOMIC, 24), (900, 1, append.PLAIN, 2), (1500, 2, append.ATOMIC, 3),
                                                      (5000, 3, append.PLAIN, 24), (60, 1, append.ATOMIC, 2)])
def test_append_rule_equals_the_direct_fold(spark, step, values, rule, hours):
    rows = random_readings(step + values, 700, step, values)
    frame = spark.createDataFrame(rows, READING)
    got = {x.reading_id for x in append.stored_readings(frame, rule, block_hours=hours).select("reading_id").collect()}
    assert got == brute(rows, rule)


def test_block_replays_keep_their_shuffle(spark):
    """Without its own exchange a replay could see a block in pieces once a join becomes a broadcast at run time."""
    frame = spark.createDataFrame(random_readings(1, 50, 900, 1), READING)
    plan = append.stored_readings(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == plan.count("Exchange hashpartitioning(xxhash64") == 1


def test_append_rule_on_many_partitions(spark):
    rows = random_readings(17, 6000, 400, 1, accounts=3)
    frame = spark.createDataFrame(rows, READING)
    kept = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in kept}
    for k, value in kept.items():
        spark.conf.set(k, value)
    got = {x.reading_id for x in append.stored_readings(frame).select("reading_id").collect()}
    for k, value in before.items():
        spark.conf.set(k, value)
    assert got == brute(rows, append.ATOMIC)


def test_append_rule_cases(spark):
    base = T(2026, 9, 5, 12)
    minutes = lambda m: base + dt.timedelta(minutes=m)
    rows = [(base, 0.1), (minutes(1), 0.1), (minutes(2), 0.2), (minutes(3), 0.2, "slow"), (minutes(4), 0.2, "slow", ENDS + dt.timedelta(seconds=60)),
            (minutes(5), 0.2, "slow", ENDS + dt.timedelta(seconds=61)), (minutes(65), 0.2, "slow", ENDS + dt.timedelta(seconds=61)),
            (minutes(66), 0.2, "slow", ENDS + dt.timedelta(seconds=61))]
    got = {x.reading_id for x in append.stored_readings(readings(spark, rows)).collect()}
    assert got == {0, 2, 3, 5, 7}


def test_previous_row_across_buckets(spark):
    rows = random_readings(3, 200, 7000, 4)
    frame = spark.createDataFrame(rows, READING)
    got = {x.reading_id: x.p and x.p.reading_id for x in with_previous(
        frame, ["account"], "observed_at", ["observed_at", "reading_id"], ["reading_id"], name="p").collect()}
    expected, last = {}, {}
    for row in sorted(rows, key=lambda x: (x[2], x[1])):
        expected[row[1]] = last.get(row[0])
        last[row[0]] = row[1]
    assert got == expected


def test_reading_stream_equals_the_batch(spark, tmp_path):
    rows = sorted(random_readings(11, 300, 1200, 2), key=lambda x: x[2])
    source = tmp_path / "in"
    for part in range(3):
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], READING).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(str(source))
    store = VersionedStore(spark, str(tmp_path / "store"))
    live.store_readings(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(x.reading_id for x in live.stored(store).collect()) == sorted(brute(rows, append.ATOMIC))
    assert len(store.versions()) == 3 and store.read("last").count() == 2


def test_a_late_trigger_follows_what_is_stored(spark, tmp_path):
    """Readings observed before the stored one, in a later trigger: a change is stored, age alone stores nothing."""
    base = T(2026, 9, 5, 12)
    waves = [[(base, 0.1)], [(base - dt.timedelta(hours=5), 0.1), (base - dt.timedelta(hours=4), 0.2), (base + dt.timedelta(minutes=30), 0.2)]]
    store = VersionedStore(spark, str(tmp_path / "store"))
    for n, wave in enumerate(waves):
        rows = readings(spark, wave).withColumn("reading_id", F.col("reading_id") + 10 * n)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        live.store_readings(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(x.reading_id for x in live.stored(store).collect()) == [0, 11, 12]


def test_triggers_in_any_order_equal_the_fold(spark, tmp_path):
    """Each trigger's readings in observed order, behind those of earlier triggers: also when these were observed later."""
    rows = sorted(random_readings(23, 400, 1500, 1), key=lambda x: x[2])
    waves = [rows[250:400], rows[:120], rows[120:250]]
    store = VersionedStore(spark, str(tmp_path / "store"))
    want, last = set(), {}
    for n, wave in enumerate(waves):
        for row in wave:
            account, k, observed, fetched, _, _, reset = row
            before = last.get(account)
            age = before and (fetched - before[2]).total_seconds()
            if before is None or abs((reset - before[6]).total_seconds()) > 60 or (age >= 45 and age > 3600):
                want.add(k)
                last[account] = row
        spark.createDataFrame(wave, READING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.store_readings(spark.readStream.schema(READING).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    assert {x.reading_id for x in live.stored(store).collect()} == want


def test_pointers_equal_the_rule_row_by_row():
    draw = np.random.default_rng(3)
    for rule in (append.PLAIN, append.ATOMIC, append.AppendRule(cooldown_seconds=7200)):
        for n in (1, 2, 7, 64, 200):
            observed = np.cumsum(draw.integers(0, 2000, n)) * append.MICROS
            decided = observed + draw.integers(-500, 500, n) * append.MICROS
            reset = draw.choice([0, 0, 0, 30, 61, 100], n) * append.MICROS
            certain = draw.random(n) < 0.05
            keeps = lambda i, j: certain[j] or rule.keeps((observed[i], reset[i]), decided[j], reset[j])
            want = [next((j for j in range(i + 1, n) if keeps(i, j)), n) for i in range(n)]
            after = append.following(rule, observed, decided, reset, certain)
            assert after.tolist() == want
            roots = certain | (np.arange(n) == 0)
            seen, todo = set(), [int(k) for k in np.flatnonzero(roots)]
            while todo:
                k = todo.pop()
                if k < n and k not in seen:
                    seen.add(k)
                    todo.append(want[k])
            assert set(np.flatnonzero(append.reached(after, roots)).tolist()) == seen


def test_daily_stream_equals_the_batch(spark, tmp_path):
    events = spark.createDataFrame([(T(2024, 1, 1 + n % 9, n % 24), f"k{n % 3}", n) for n in range(300)], "ts timestamp_ntz, k string, v bigint")
    late = spark.createDataFrame([(T(2024, 3, 1), "k0", 5), (T(2023, 1, 1), "k1", 7)], "ts timestamp_ntz, k string, v bigint")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    for row in late.collect():
        spark.createDataFrame([row], late.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    store = VersionedStore(spark, str(tmp_path / "days"))
    current.maintain_sums(stream, store, str(tmp_path / "cp"), ["k"], {"v": "v"}).awaitTermination()
    got = current.day_sums(store)
    both = events.unionByName(late)
    batch = both.groupBy(F.col("ts").cast("date").alias("usage_date"), "k").agg(F.sum("v").alias("v"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    monthly = stream_rollups.monthly_from_daily(got, ["k"], ["v"])
    assert sum(x.v for x in monthly.collect()) == sum(x.v for x in both.collect())


def test_backlog_file_is_kept_and_redelivery_dropped(spark, tmp_path):
    schema = "machine_id string, raw_sha256 string, created_at timestamp"
    def deliver(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.collect_new_contents(stream, VersionedStore(spark, str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    deliver(("m", "a", T(2026, 1, 10)))
    deliver(("m", "b", T(2026, 1, 20)))
    deliver(("m", "lost-pc", T(2026, 1, 5)), ("m", "a", T(2026, 1, 10)))
    assert sorted(x.raw_sha256 for x in VersionedStore(spark, str(tmp_path / "out")).read("contents").collect()) == ["a", "b", "lost-pc"]


@pytest.mark.parametrize("files", [0, 3])
def test_a_table_streams_from_one_file_or_a_folder(spark, tmp_path, files):
    rows = spark.createDataFrame([(n, "s", f"text {n % 4}") for n in range(9)], "doc_id bigint, source string, text string")
    if files:
        rows.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        rows.toPandas().to_parquet(tmp_path / "documents.parquet")
    rows.write.parquet(str(tmp_path / "other.parquet"))
    got = stream_queries.redelivery_stream(spark, str(tmp_path)).select("created_at").collect()
    assert sorted(x.created_at for x in got) == [T(2024, 1, 1, 0, n) for n in range(4)]


def test_revision_of_a_later_import_is_appended(spark, tmp_path):
    schema = "machine_id string, agent string, usage_date date, import_id string, v int"
    for n, day in enumerate([dt.date(2026, 9, 1), dt.date(2026, 9, 1), None]):
        spark.createDataFrame([("m", "a", day, f"i{n}", n)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for name in ("cp1", "cp2"):  # a second collector sees the same files again
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest.append_revisions(stream, str(tmp_path / "out"), str(tmp_path / name), ["machine_id", "agent", "usage_date", "import_id"]).awaitTermination(120)
    assert sorted(x.v for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
