"""Pairs across components inside groups of documents, screened by the odd sketches of their whole sets.

The odd sketch of a whole set has the parity of its members in each cell. Two sketches
differ in at most as many cells as the sets have members that aren't shared, so the bound
is lossless; with four cells a member it drops nearly all pairs that are below the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm import kernel
from ledgerline.llm.graph import components
from ledgerline.session import materialized

LEAST_BITS, MOST_BITS = 256, 1 << 16
#: The bitmap of ids has 2 ** BITS bits and is made in parts of PART_BITS, which Spark's bitmap functions fix.
BITS, PART_BITS = 26, 32768
#: A task looks through groups of so many rows together at least, and so many pairs and words of their sketches at once.
WAIT, PAIRS, WORDS = 1 << 13, 1 << 20, 1 << 21


def sets_of(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted shingle set of each text."""
    data, bounds = kernel.flat(texts)
    starts, ends = kernel.word_spans(data, bounds)
    return kernel.shingles(kernel.word_hashes(data, starts, ends), kernel.rows_of(starts, bounds), size)


def width(n: int) -> int:
    """Bits of the whole sketch of a set of n members."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (4 * n - 1).bit_length()))


def whole_sketch(own: np.ndarray) -> bytes:
    """The odd sketch of a whole set; cells go by the low bits, so that a sketch folds to half its width."""
    bits = width(len(own))
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded_to(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded to fewer words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def id_bits(ids: DataFrame) -> bytes:
    """A bitmap of fixed size with a bit for each id's hash: lets tasks pass over most documents that nobody asked for, so that texts need not be
    shuffled to be joined. It tells of no asked id wrongly; the fuller it is, the more others pass with them, which costs time but changes nothing."""
    id_ = F.col(ids.columns[0]).cast("long")
    folded = id_.bitwiseXOR(F.shiftrightunsigned(id_, BITS)).bitwiseXOR(F.shiftrightunsigned(id_, 2 * BITS)).bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    found = ids.select(folded.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    held = {x["part"]: bytes(x["bits"]) for x in found}
    return b"".join(held.get(k, bytes(PART_BITS >> 3)) for k in range(1, (1 << BITS) // PART_BITS + 1))


def among(ids: np.ndarray, bits: bytes) -> np.ndarray:
    """Which of these 64-bit ids may be of the bitmap's."""
    ids = ids.astype(np.int64).view(np.uint64)
    at = ((ids ^ (ids >> np.uint64(BITS)) ^ (ids >> np.uint64(2 * BITS))) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return ((np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def asked(batch: pa.RecordBatch, bits: bytes) -> pa.RecordBatch:
    """The rows of a batch (doc_id, ...) whose id may be one of the bitmap's; null ids never are."""
    ids = batch.column("doc_id")
    return batch.filter(pa.array(among(ids.fill_null(0).to_numpy(zero_copy_only=False), bits) & ids.is_valid().to_numpy(zero_copy_only=False)))


def whole_sketches(docs: DataFrame, wanted: DataFrame, size: int, share: int = 1, unique: bool = False) -> DataFrame:
    """id, size and whole sketch, folded to one `share`-th of its width, of the documents whose doc_id is in `wanted` (id), and of some others; one row an id."""
    shared = docs.sparkSession.sparkContext.broadcast(id_bits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = asked(batch, shared.value)
            for part in kernel.slices(batch, "text", 4 << 20):
                sets = sets_of(part.column("text"), size)
                sketches = [whole_sketch(x) for x in sets]
                if share > 1:
                    sketches = [folded_to(np.frombuffer(x, np.uint64)[None, :], len(x) // 8 // share).tobytes() for x in sketches]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(sketches, pa.binary())], names=["id", "size", "sketch"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = texts.mapInArrow(run, "id long, size long, sketch binary")
    return made if unique else made.dropDuplicates(["id"])


def mixed_groups(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Groups for `across`: the buckets (key, id, lead) that hold several components of `found` (node, component), put together by their smallest member; written.

    Buckets of one lead mostly have the same members, so they meet once instead of once a bucket.
    """
    named = found.select(F.col("node").alias("_node"), "component")
    labelled = materialized(buckets.join(named, F.col("id") == F.col("_node"), "left").select("key", "id", "lead", F.coalesce("component", "id").alias("component")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select(F.col("key").alias("_key"))
    return materialized(labelled.join(mixed, F.col("key") == F.col("_key"), "left_semi").select(F.col("lead").alias("key"), "id", "component").distinct(), "mixed-members")


def open_groups(members: DataFrame, failed: DataFrame, found: DataFrame) -> DataFrame:
    """Those groups of `members` (key, id, component) that hold both documents of one of the pairs `failed` (a, b), with the components of `found`; written.

    Pairs that the likeliest one of a group stood for are only open where that one has failed.
    """
    side = lambda c: members.select(F.col("key").alias("_key" + c), F.col("id").alias("_" + c))
    keys = failed.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), (F.col("b") == F.col("_b")) & (F.col("_keya") == F.col("_keyb"))).select("_keya").distinct()
    named = found.select(F.col("node").alias("_node"), F.col("component").alias("_now"))
    left = members.join(keys, F.col("key") == F.col("_keya"), "left_semi").join(named, F.col("id") == F.col("_node"), "left")
    return materialized(left.select("key", "id", F.coalesce("_now", "id").alias("component")), "open-members")


def across(members: DataFrame, marks: DataFrame, percent: int, block: int, every: bool) -> DataFrame:
    """Pairs (a, b) of one group that lie in different components and may reach the threshold, and how many further ones they stand for (more).

    Of the pairs between two components, only the likeliest one of a block pair, or every one if so asked. If that one
    turns out to link, the others say nothing new; if it doesn't and stands for others, these have to be asked for.

    members: key (of the group), id, component. A group of more than `block` members
    is cut into blocks; each pair of blocks is one task's group, so every pair of members
    meets and no task holds more than two blocks of one key.
    """
    sizes = members.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n"))
    cut = members.join(sizes, F.col("key") == F.col("_key")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component")
    marked = dealt.join(marks.select(F.col("id").alias("_id"), "size", "sketch"), F.col("id") == F.col("_id")).drop("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            place = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")])
            new = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0))
            if n_held >= WAIT:
                begins = held[-1][1] is not None and len(place.T) and (held[-1][1] != place[:, 0]).any()
                cut = 0 if begins else int(new[0]) + 1 if len(new) else None
                if cut is not None:
                    yield _looked_through(pa.concat_tables([t for t, _ in held] + [rows.slice(0, cut)]), percent, every)
                    rows, held, n_held = rows.slice(cut), [], 0
            if rows.num_rows:
                held.append((rows, place[:, -1]))
                n_held += rows.num_rows
        if held:
            yield _looked_through(pa.concat_tables([t for t, _ in held]), percent, every)

    n = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = marked.select("key", "i", "j", "own", "id", "component", "size", "sketch").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.mapInArrow(run, "a long, b long, more long").groupBy("a", "b").agg(F.max("more").alias("more"))


def _unlike(a: np.ndarray, b: np.ndarray, words: np.ndarray, folded: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """In how many cells the sketches of rows a and b differ, at the width of the narrower one."""
    out, width_of = np.zeros(len(a), np.int64), np.minimum(words[a], words[b])
    for m in np.unique(width_of).tolist():
        some = np.flatnonzero(width_of == m)
        place, table = folded[m]
        for at in range(0, len(some), max(1, WORDS // m)):
            part = some[at:at + max(1, WORDS // m)]
            out[part] = np.bitwise_count(table[place[a[part]]] ^ table[place[b[part]]]).sum(axis=1, dtype=np.int64)
    return out


def _looked_through(rows: pa.Table, percent: int, every: bool) -> pa.RecordBatch:
    """The pairs of `across` for whole groups, all at once. Rows go by group and size, so that those a row's size allows are one stretch."""
    key, i, j, own, ids, component, size = (rows.column(c).to_numpy() for c in ("key", "i", "j", "own", "id", "component", "size"))
    new = np.concatenate([[False], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    order = np.lexsort((ids, size, np.cumsum(new)))
    group, i, j, own, ids, component, size = (x[order] for x in (np.cumsum(new), i, j, own, ids, component, size))
    sketch = rows.column("sketch").take(pa.array(order)).to_pylist()
    words = np.array([len(x) // 8 for x in sketch])
    folded = {}
    for m in np.unique(words).tolist():
        some = np.flatnonzero((words == m) | (words == 2 * m))
        place = np.zeros(len(words), np.int64)
        place[some] = np.arange(len(some))
        parts = np.empty((len(some), m), np.uint64)
        for w in (m, 2 * m):
            at = words[some] == w
            if at.any():
                parts[at] = folded_to(np.frombuffer(b"".join([sketch[k] for k in some[at]]), np.uint64).reshape(-1, w), m)
        folded[m] = place, parts
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    tall = (group[right].astype(np.int64) << 40) | size[right]
    base = group[left].astype(np.int64) << 40
    low, high = np.searchsorted(tall, base | -(-percent * size[left] // 100)), np.searchsorted(tall, base | (100 * size[left] // percent), side="right")
    alone = i[left] == j[left]
    low = np.where(alone, np.maximum(low, np.searchsorted(right, left) + 1), low)
    many = np.maximum(high - low, 0)
    begins = np.cumsum(many) - many
    held = [np.zeros(0, np.int64)] * 6 + [np.zeros(0)]
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(begins, begins[at] + PAIRS)))
        n = many[at:end]
        a = np.repeat(left[at:end], n)
        b = right[np.repeat(low[at:end] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        at = end
        keep = (component[a] != component[b]) & (np.maximum(words[a], words[b]) <= 2 * np.minimum(words[a], words[b]))
        a, b = a[keep], b[keep]
        apart, both = _unlike(a, b, words, folded), size[a] + size[b]
        keep = both + 2 * (-percent * both // (100 + percent)) >= apart
        a, b, share = a[keep], b[keep], (apart / np.maximum(both, 1))[keep]
        found = [group[a], np.minimum(component[a], component[b]), np.maximum(component[a], component[b]), np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]),
                 np.zeros(len(a), np.int64) if every else np.ones(len(a), np.int64), share]
        held = [np.concatenate(x) for x in zip(held, found)]
        if not every:
            held = _likeliest(held)
    a, b, more = held[3], held[4], held[5] if every else held[5] - 1
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, more)], names=["a", "b", "more"])


def _likeliest(pairs: list[np.ndarray]) -> list[np.ndarray]:
    """Of the pairs (group, two components, a, b, count, share) of one group and two components the one of least share, with the sum of the counts."""
    group, one, two, a, b, count, share = pairs
    order = np.lexsort((b, a, share, two, one, group))
    group, one, two, a, b, count, share = (x[order] for x in pairs)
    if not len(order):
        return pairs
    leads = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
    return [group[leads], one[leads], two[leads], a[leads], b[leads], np.add.reduceat(count, leads), share[leads]]


def settled(buckets: DataFrame, found: DataFrame, tried: DataFrame, links: DataFrame, marks_of: Callable[[DataFrame], DataFrame],
            confirm: Callable[[DataFrame], DataFrame], percent: int, block: int) -> DataFrame:
    """The components (node, component) of all links between members of one bucket, from those that `tried` pairs (a, b) have shown.

    buckets: key, id, lead (the bucket's smallest id); links: a, b, of which `found` are the components. `marks_of` makes
    the whole sketches of some ids, `confirm` keeps the pairs of a written table that link. First the likeliest pair between any two
    components of a group is confirmed; where one of these fails that stands for others, all pairs that the bound leaves are.
    """
    members, every = mixed_groups(buckets, found), False
    marks = materialized(marks_of(members.select("id").distinct()), "whole-sketches")
    while True:
        proposed = materialized(across(members, marks, percent, block, every), "across")
        pairs = materialized(proposed.join(tried, ["a", "b"], "left_anti").select("a", "b"), "pairs")
        if not pairs.isEmpty():
            more = materialized(confirm(pairs), "links")
            if not more.isEmpty():
                links = links.unionByName(more)
                found = components(links)
        if every:
            return found
        # A tried pair that isn't a link may stand for others too.
        failed = proposed.filter("more > 0").join(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        if failed.isEmpty():
            return found
        members, tried, every = open_groups(members, failed, found), tried.unionByName(pairs), True
