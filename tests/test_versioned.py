"""The versioned store and the streams that commit to it."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import revisions
from ledgerline.sources import versioned
from ledgerline.sources.versioned import Conflict, VersionedStore
from ledgerline.streaming import current

ROWS = "k string, m string, v long"


def keyed(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def told(store, table="t", version=None):
    return sorted(tuple(r) for r in store.read(table, version).collect())


def win(rows, base, store):
    return store.merge("t", rows, ["m"], versioned.changes_win(["k", "m"], [F.col("v").desc()]), base)


def test_a_change_rewrites_only_the_partitions_it_touches(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    first = store.update(lambda base: [win(keyed(spark, [("a", "1/x", 1), ("b", None, 2), ("c", "2", 3)]), base, store)])
    second = store.update(lambda base: [win(keyed(spark, [("a", "1/x", 9), ("a", "1/x", 7), ("d", "1/x", 4)]), base, store)])
    assert told(store) == sorted([("a", "1/x", 9), ("d", "1/x", 4), ("b", None, 2), ("c", "2", 3)], key=str) or set(told(store)) == {("a", "1/x", 9), ("d", "1/x", 4), ("b", None, 2), ("c", "2", 3)}
    kept = {k: v for k, v in second.tables["t"].parts.items() if v == first.tables["t"].parts.get(k)}
    assert set(kept) == {"null", ".2"} and len(second.tables["t"].parts) == 3
    assert {r.v for r in store.read("t", parts=[".2"]).collect()} == {3}
    assert set(told(store, version=first)) == {("a", "1/x", 1), ("b", None, 2), ("c", "2", 3)}


def test_a_failure_between_write_and_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = VersionedStore(spark, str(tmp_path / "s"))
    store.update(lambda base: [win(keyed(spark, [("a", "1", 1)]), base, store)])
    monkeypatch.setattr(VersionedStore, "_publish", lambda self, new: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.update(lambda base: [win(keyed(spark, [("a", "1", 2)]), base, store)])
    monkeypatch.undo()
    assert told(store) == [("a", "1", 1)] and store.versions() == [1]
    assert store.vacuum() == 1 and told(store) == [("a", "1", 1)]


def test_of_two_writers_one_commits_and_the_other_goes_again(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    base = store.current()
    one, two = (win(keyed(spark, [(k, k, 1)]), base, store) for k in "ab")
    store.commit(base, [one])
    with pytest.raises(Conflict):
        store.commit(base, [two])
    assert told(store) == [("a", "a", 1)] and not [x for x in os.listdir(tmp_path / "s" / "commits") if x.startswith(".") and not x.endswith(".crc")]
    store.update(lambda base: [win(keyed(spark, [("b", "b", 1)]), base, store)], ("s", 4))
    before = store.versions()
    store.update(lambda base: [win(keyed(spark, [("b", "b", 5)]), base, store)], ("s", 4))
    assert told(store) == [("a", "a", 1), ("b", "b", 1)] and store.versions() == before


def test_vacuum_keeps_what_the_last_versions_hold(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    for v in range(4):
        store.update(lambda base, v=v: [win(keyed(spark, [("a", "1", v), (f"k{v}", "2", v)]), base, store)])
    want = told(store)
    assert store.vacuum(keep=2) > 0
    assert store.versions() == [3, 4] and told(store) == want and told(store, version=store.current(3))
    assert store.read("none", schema=keyed(spark, []).schema).count() == 0


def test_a_stream_keeps_the_current_truth(spark, tmp_path):
    """Revisions, tombstones and a backlog in any order, a batch delivered twice: the same rows as from all revisions at once."""
    draw = random.Random(7)
    rows = [(f"{k:04d}", f"m{draw.randrange(2)}", f"i{k % 9}", draw.choice("ab"), f"2026-0{draw.randint(1, 3)}-1{draw.randrange(3)}", draw.random() < 0.2, draw.randrange(5), draw.randrange(5))
            for k in range(300)]
    data = spark.createDataFrame(rows, "id string, machine_id string, import_id string, agent string, usage_date string, is_tombstone boolean, p int, c int").select(
        "id", "machine_id", "import_id", "agent", F.col("usage_date").cast("date"), "is_tombstone",
        F.when(F.col("p") > 0, F.timestamp_seconds(F.col("p"))).alias("processed_at"), F.timestamp_seconds(F.col("c")).alias("created_at"))
    source, store, checkpoint = str(tmp_path / "in"), VersionedStore(spark, str(tmp_path / "s")), str(tmp_path / "cp")
    for wave in ("is_tombstone", "not is_tombstone and p >= 3", "not is_tombstone and p < 3"):
        data.withColumn("p", F.coalesce(F.unix_seconds("processed_at"), F.lit(0))).filter(wave).drop("p").coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(source)
        current.maintain_current(stream, store, checkpoint).awaitTermination()
    want = revisions.current_daily(data)
    got = current.current_rows(store)
    assert {r.id for r in got.collect()} == {r.id for r in want.collect()} and got.columns == want.columns
    run = current.run_of(spark, checkpoint)
    assert store.current().batches[run] == len(store.versions()) - 1


def test_day_sums_of_fifty_batches_and_a_lost_checkpoint(spark, tmp_path):
    rows = [(f"2026-01-{1 + k % 28:02d} 05:00:00", "a" if k % 3 else None, k) for k in range(100)]
    data = spark.createDataFrame(rows, "ts string, k string, v long")
    data.repartition(50, "v").sortWithinPartitions("v").write.parquet(str(tmp_path / "in"))
    stream = lambda n: spark.readStream.schema(data.schema).option("maxFilesPerTrigger", n).parquet(str(tmp_path / "in"))
    store = VersionedStore(spark, str(tmp_path / "s"))
    current.maintain_sums(stream(1), store, str(tmp_path / "cp1"), ["k"], {"n": "1L", "v": "v"}).awaitTermination()
    want = sorted((str(r[0]), r[1] or "", r[2], r[3]) for r in data.groupBy(F.col("ts").cast("timestamp").cast("date"), "k").agg(F.count("*"), F.sum("v")).collect())
    shown = lambda: sorted((str(r.usage_date), r.k or "", r.n, r.v) for r in current.day_sums(store).collect())
    assert shown() == want and len(store.versions()) > 40
    assert sum(len(x) for x in store.current().tables["daily"].parts.values()) == 1
    current.maintain_sums(stream(20), store, str(tmp_path / "cp2"), ["k"], {"n": "1L", "v": "v"}).awaitTermination()
    assert shown() == want
