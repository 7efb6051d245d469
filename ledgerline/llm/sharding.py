"""Shards of near equal size, by longest-processing-time scheduling of groups that stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.numbering import numbered, text_key
from ledgerline.session import materialized

#: A size class keeps so many leading bits of a size, so there are at most 55 << CLASS_BITS classes at any input size.
CLASS_BITS = 9


def schedule(classes: list[tuple[int, int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """For size classes (class, groups, total size), the largest first, the runs (shard, groups) each is cut into.

    Each group goes to the least-loaded shard, kept in a heap. A class of many groups of
    one size first fills the shards up to a common level, which gives the loads that
    handing them out one by one would give.
    """
    loads = [0.0] * shards
    out = {}
    for number, groups, total in sorted(classes, reverse=True):
        mean, given = total / groups, [0] * shards
        if groups > 4 * shards:
            low, high = min(loads), max(loads) + total
            for _ in range(80):
                level = (low + high) / 2
                fits = sum(max(0, int((level - x) // mean)) for x in loads)
                low, high = (level, high) if fits <= groups - shards else (low, level)
            given = [max(0, int((low - x) // mean)) for x in loads]
        heap = [(x + mean * n, k) for k, (x, n) in enumerate(zip(loads, given))]
        heapq.heapify(heap)
        for _ in range(groups - sum(given)):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + mean, k))
            given[k] += 1
        loads = [x + mean * n for x, n in zip(loads, given)]
        out[number] = [(k, n) for k, n in enumerate(given) if n]
    return out


def size_class(size):
    """The leading CLASS_BITS bits of a size and their place; grows with the size, exact for small sizes."""
    shift = F.greatest(F.length(F.bin(size)) - CLASS_BITS, F.lit(0)).cast("int")
    return (shift.cast("long") * (1 << CLASS_BITS) + F.expr(f"shiftright(size, cast(greatest(length(bin(size)) - {CLASS_BITS}, 0) as int))")).cast("long")


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put documents (doc_id, text) into shards; equal texts stay together.

    Returns doc_id, size (UTF-8 bytes plus 1; null text counts as none), text_crc32,
    law = 'bytes', shard, slot (gapless from 0 in each shard) and a null grown_shard.
    Null texts are one group, apart from empty ones. Repeated rows each get a slot. An
    empty table gives none. Other columns are not read.

    Only the table of size classes, bounded by CLASS_BITS, reaches the driver. A group's
    shard follows from its number in its class; rows join their group by plain
    exchanges, so that Spark can split a group of very many copies.
    """
    spark = docs.sparkSession
    rows = materialized(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), text_key(F.col("text")).alias("key")), "sharding-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    groups = materialized(groups.withColumn("class", size_class(F.col("size"))), "sharding-groups")
    classes = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("total")).collect()
    runs = []
    for number, parts in schedule([tuple(x) for x in classes], shards).items():
        ends, at = [], 0
        for _, n in parts:
            ends.append(at := at + n)
        runs.append((number, ends, [k for k, _ in parts]))
    table = spark.createDataFrame(runs, "class long, ends array<long>, shards array<int>")
    ranked = numbered(groups, "class", ["key"], "rank", sum(x["n"] for x in classes))
    placed = ranked.join(table, "class").select("key", F.expr("shards[size(filter(ends, e -> e <= rank))]").alias("shard"))
    placed = materialized(placed, "sharding-placed")
    joined = materialized(rows.join(placed, "key").drop("key"), "sharding-joined")
    slots = numbered(joined, "shard", ["doc_id", "text_crc32", "size"], "slot", joined.count())
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
