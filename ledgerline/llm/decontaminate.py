"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, exact weighted similarity.

Built-in functions only. A window that shares no shingle with an item has similarity 0
with it, so windows are laid only where a shingle of a document stands in some item:
the window has the item's size and begins where the item would begin.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ledgerline.session import materialized

WORD = r"[^\x20\x09-\x0D]+"
SIZE, BITS, BLOCKS = 5, 64, 8
#: Weight of a shingle that one item has; one that k items share has a k-th of it, at least 1.
WEIGHT = 12


class Settings(NamedTuple):
    """Matches lie within `radius` differing bits and have a weighted Jaccard similarity of `percent` or more."""

    percent: int = 75
    radius: int = 20


def shingled(rows: DataFrame, id_: str, text: str = "text") -> DataFrame:
    """id, n_words and the hashes of all 5-word shingles in order, of lower-cased texts."""
    words = rows.select(F.col(id_).alias("id"), F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), 0).alias("words"))
    hashed = words.select("id", F.size("words").alias("n_words"), F.expr("transform(words, w -> xxhash64(w))").alias("h"))
    hashed = hashed.withColumn("h", F.when(F.col("n_words") >= SIZE, F.col("h")))
    step = lambda name, expr: hashed.withColumn(name, F.expr(expr))
    hashed = step("two", "zip_with(slice(h, 1, n_words - 1), slice(h, 2, n_words - 1), (a, b) -> xxhash64(a, b))")
    hashed = step("four", "zip_with(slice(two, 1, n_words - 3), slice(two, 3, n_words - 3), (a, b) -> xxhash64(a, b))")
    return hashed.select("id", "n_words", F.expr("zip_with(slice(four, 1, n_words - 4), slice(h, 5, n_words - 4), (a, b) -> xxhash64(a, b))").alias("shingles"))


def weighed(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """key, h, n (occurrences) and w (weight) for rows of key and shingles."""
    counted = rows.select("key", F.explode("shingles").alias("h")).groupBy("key", "h").agg(F.count("*").alias("n"))
    return counted.join(weights, F.col("h") == F.col("_h"), "left").select("key", "h", "n", F.coalesce("_w", F.lit(WEIGHT)).cast("long").alias("w"))


def fingerprints(parts: DataFrame) -> DataFrame:
    """key, SimHash of 64 bits and total weight: a bit is set where the weighted votes of the shingles' bits are positive."""
    # The shingles' hashes are mixed once more, so that bits are not those that identify them.
    mixed = parts.select("key", (F.col("n") * F.col("w")).alias("v"), F.xxhash64("h", F.lit("simhash")).alias("m"))
    votes = [F.sum(F.when(F.expr(f"shiftrightunsigned(m, {b}) & 1") == 1, F.col("v")).otherwise(-F.col("v"))).alias(f"b{b}") for b in range(BITS)]
    voted = mixed.groupBy("key").agg(F.sum("v").alias("total"), *votes)
    bits = F.lit(0).cast("long")
    for b in range(BITS):
        bits = bits.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.expr(f"shiftleft(1L, {b})")).otherwise(F.lit(0).cast("long")))
    return voted.select("key", "total", bits.alias("print"))


def blocks_of(prints: DataFrame, flips: int) -> DataFrame:
    """A row per 8-bit block and per value that differs from it in up to `flips` bits: block, value."""
    width = BITS // BLOCKS
    masks = [sum(1 << b for b in chosen) for k in range(flips + 1) for chosen in combinations(range(width), k)]
    keyed = prints.withColumn("block", F.explode(F.array(*[F.lit(k) for k in range(BLOCKS)])))
    own = F.expr(f"cast(shiftrightunsigned(print, block * {width}) & {(1 << width) - 1} AS int)")
    return keyed.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks]))).withColumn("value", own.bitwiseXOR(F.col("mask"))).drop("mask")


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, similarity (whole percent) and start (word of the best window, the first of equals) of every match.

    docs has doc_id and text, benchmark item_id and text; other columns are not read. A
    window at an edge of a document is moved inside it; a document shorter than the item
    is one window. Items of fewer than 5 words, rows without an id and rows without text
    match nothing. Repeated rows match as one.

    Of `radius` differing bits, one of 8 blocks has at most radius // 8: items are indexed
    under every value their blocks may take then, so no fingerprint within the radius is
    missed. Equal windows are compared once. The items' shingles are joined as a table; Spark
    broadcasts it while it is small.
    """
    s = settings
    items = shingled(benchmark.filter("item_id IS NOT NULL").dropDuplicates(["item_id"]), "item_id")
    items = materialized(items.filter("shingles IS NOT NULL"), "items")
    places = items.select("id", "n_words", F.posexplode("shingles").alias("place", "h"))
    weights = places.groupBy("h").agg(F.countDistinct("id").alias("df")).select(F.col("h").alias("_h"), F.expr(f"greatest(1, {WEIGHT} div df)").alias("_w"))
    weights = materialized(weights, "weights")
    index = materialized(places.select(F.col("h").alias("_h"), F.col("n_words").alias("n"), "place").distinct(), "places")
    real = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    # The outer form, as for the other one Spark would work the shingles out again in a filter before it.
    anchors = shingled(real, "doc_id").select("id", "n_words", F.posexplode_outer("shingles").alias("at", "h")).join(index, F.col("h") == F.col("_h"))
    begin = F.greatest(F.lit(0), F.least(F.col("at") - F.col("place"), F.col("n_words") - F.col("n")))
    windows = materialized(anchors.select("id", "n", begin.alias("start")).distinct().groupBy("id").agg(F.collect_list(F.struct("n", "start")).alias("windows")), "windows")
    # Written, as a filter on the shingles would else be worked out for all documents, below the join.
    hit = materialized(real.join(windows.withColumnRenamed("id", "_id"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "windows"), "hit")
    texts = shingled(hit.select(F.struct("doc_id", "windows").alias("both"), "text"), "both").select("id.doc_id", "n_words", "shingles", F.explode("id.windows").alias("w")).filter("shingles IS NOT NULL")
    cut = texts.select("doc_id", "w.n", "w.start", F.expr("slice(shingles, w.start + 1, least(w.n, n_words) - 4)").alias("shingles"))
    cut = materialized(cut.withColumn("key", F.concat_ws(":", "n", F.sha2(F.to_json("shingles"), 256))), "cut")
    contents = cut.select("key", "n", "shingles").dropDuplicates(["key"])
    parts = materialized(weighed(contents, weights), "window-parts")
    prints = fingerprints(parts).withColumn("n", F.split_part("key", F.lit(":"), F.lit(1)).cast("int"))
    prints = materialized(prints, "window-prints")
    item_parts = materialized(weighed(items.select(F.col("id").alias("key"), "shingles"), weights), "item-parts")
    item_prints = fingerprints(item_parts).join(items.select(F.col("id").alias("_id"), "n_words"), F.col("key") == F.col("_id")).drop("_id")
    table = blocks_of(item_prints, s.radius // BLOCKS).select(
        F.col("key").alias("item"), F.col("total").alias("item_total"), F.col("print").alias("item_print"), F.col("n_words").alias("_n"), F.col("block").alias("_block"), F.col("value").alias("_value"))
    table = materialized(table, "blocks")
    near = blocks_of(prints, 0).join(table, (F.col("n") == F.col("_n")) & (F.col("block") == F.col("_block")) & (F.col("value") == F.col("_value")))
    near = near.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= s.radius)
    near = materialized(near.select("key", "total", "item", "item_total").distinct(), "near")
    ours = parts.select(F.col("key").alias("_key"), "h", "n", "w")
    theirs = item_parts.select(F.col("key").alias("_item"), F.col("h").alias("_h"), F.col("n").alias("_n"))
    common = near.join(ours, F.col("key") == F.col("_key")).join(theirs, (F.col("item") == F.col("_item")) & (F.col("h") == F.col("_h")))
    both = common.groupBy("key", "item", "total", "item_total").agg(F.sum(F.col("w") * F.least("n", "_n")).alias("both"))
    either = F.col("total") + F.col("item_total") - F.col("both")
    good = both.filter(F.col("both") * 100 >= either * s.percent).select(F.col("key").alias("_key"), "item", F.expr("both * 100 div (total + item_total - both)").alias("similarity"))
    found = cut.select("doc_id", "key", "start").join(materialized(good, "verified"), F.col("key") == F.col("_key"))
    best = found.groupBy("doc_id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", F.col("item").alias("item_id"), F.col("best.similarity").cast("long").alias("similarity"), (-F.col("best.back")).cast("long").alias("start"))


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents without a match; rows without doc_id or text stay."""
    found = materialized(leaks(docs, benchmark, settings).select(F.col("doc_id").alias("_doc")).distinct(), "leaks")
    return docs.join(found, F.col("doc_id") == F.col("_doc"), "left_anti")
