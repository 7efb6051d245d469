"""Change-only reading stream: each batch runs the append rule on from the last stored reading of its accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.append import ATOMIC, AppendRule, stored_readings
from ledgerline.operators.skew import spread_join
from ledgerline.session import materialized
from ledgerline.sources.versioned import Change, Version, VersionedStore, changes_win
from ledgerline.streaming.current import committed

#: The last stored readings lie in so many partitions by account, of which a batch rewrites those of its accounts.
BUCKETS = 64


def store_readings(readings: DataFrame, store: VersionedStore, checkpoint: str, rule: AppendRule = ATOMIC, decided_at: str = "fetched_at") -> StreamingQuery:
    """Keep the readings the rule stores, in table `readings`, and the last stored one of each account, in `last`; then stop.

    Within one trigger readings are taken in observed order, behind what earlier triggers stored, whenever that was
    observed. Both tables change in one commit. The rule works in blocks of time, so an account
    that holds most readings of a trigger is worked on by many tasks, as in the batch job.
    """
    def make(batch: DataFrame, base: Version) -> list[Change]:
        held = VersionedStore(batch.sparkSession, store.path)
        columns = batch.columns
        rows = materialized(batch.withColumn("bucket", F.pmod(F.xxhash64("account"), F.lit(BUCKETS)).cast("int")), "batch")
        first = rows.groupBy("account").agg(F.min("observed_at").alias("_first"), F.min("bucket").alias("bucket"))
        last = held.read("last", base, ["." + str(x["bucket"]) for x in rows.select("bucket").distinct().collect()], rows.schema)
        # The stored reading comes first, even where a reading of the batch was observed before it.
        known = last.join(first.select("account", "_first"), "account").withColumns({
            "follows": F.timestamp_micros(F.least(F.unix_micros("observed_at"), F.unix_micros("_first")) - 1), "known": F.lit(True)}).drop("_first")
        fresh = rows.withColumns({"follows": F.col("observed_at"), "known": F.lit(False)})
        both = spread_join(known.unionByName(fresh), last.select("account", F.col("observed_at").alias("stored_at")), ["account"], ["reading_id"])
        kept = materialized(stored_readings(both, rule, decided_at, order_at="follows", floor_at="stored_at"), "kept")
        newest = kept.filter("not known").groupBy("account").agg(F.max_by(F.struct(*columns, "bucket"), F.struct("follows", "reading_id")).alias("r")).select("r.*")
        added = held.stage("readings", kept.filter("not known").select(*columns).withColumn("observed_day", F.col("observed_at").cast("date")), ["observed_day"])
        return [added, held.merge("last", newest, ["bucket"], changes_win(["account"], [F.col("reading_id")]), base)]

    return committed(readings, store, checkpoint, make)


def stored(store: VersionedStore) -> DataFrame:
    """All readings that streams have stored."""
    return store.read("readings").drop("observed_day")
