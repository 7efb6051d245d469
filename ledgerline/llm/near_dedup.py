"""Near duplicates: banded MinHash candidates, screened by odd sketches, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm import kernel, settle
from ledgerline.llm.graph import components
from ledgerline.session import materialized


class Settings(NamedTuple):
    """`rows` * `bands` MinHash samples. With 5 and 50 a pair at similarity 0.75 shares no band once in 700,000.

    An odd sketch of `bits` bits holds the parity of all samples; its estimate has a
    standard error of about 0.03 at 0.75. Pairs estimated below `floor` aren't confirmed.
    Members of buckets that hold several components get odd sketches of their whole sets, whose
    bound is lossless. `block` bounds the members of a bucket that a task holds.
    """

    percent: int = 75
    size: int = 5
    rows: int = 5
    bands: int = 50
    bits: int = 1024
    floor: float = 0.63
    block: int = 4000


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, set_key, bands and odd sketch of each document (doc_id, text)."""
    n = s.rows * s.bands
    rng = np.random.Generator(np.random.PCG64(11))
    factors = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    salts = rng.integers(1, 2**63, n, dtype=np.uint64)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "text", 4 << 20):
                sizes, keys, bands, bits = [], [], [], []
                for own in settle.sets_of(part.column("text"), s.size):
                    sizes.append(len(own))
                    if not len(own):
                        keys.append(None), bands.append(None), bits.append(None)
                        continue
                    keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                    least = samples(own, factors)
                    with np.errstate(over="ignore"):
                        mixed = kernel.mixed(least.astype(np.uint64) + salts)
                        bands.append(kernel.mixed(mixed.reshape(s.bands, s.rows).sum(axis=1, dtype=np.uint64)).view(np.int64))
                    bits.append(folded(mixed, s.bits))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                                                  pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def samples(own: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash samples of a set: the least of its members under each multiplier."""
    values = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(values), 2048):
            some = values[at:at + 2048]
            wide = max(1, 40_000 // len(some))
            for k in range(0, len(factors), wide):
                np.minimum(least[k:k + wide], (factors[k:k + wide, None] * some[None, :]).min(axis=1), out=least[k:k + wide])
    return least


def folded(mixed: np.ndarray, bits: int) -> bytes:
    """The odd sketch: which of its cells an odd number of samples falls into."""
    return np.packbits(np.bincount((mixed >> np.uint64(17)) % np.uint64(bits), minlength=bits).astype(np.uint8) & 1).tobytes()


def estimate(differing: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Similarity from the number of differing cells: each unequal sample flips two."""
    share = np.minimum(2 * np.asarray(differing, float) / bits, 1 - 1e-9)
    return 1 + bits / 2 * np.log1p(-share) / (2 * n)


def _unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def screened(pairs: DataFrame, marks: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) whose odd sketches tell of enough similarity; marks has id and sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, s.bits // 64) for k in (2, 3))
            good = estimate(_unlike(a, b), s.bits, s.rows * s.bands) >= s.floor
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    named = lambda c: marks.select(F.col("id").alias("_" + c), F.col("sketch").alias("sketch_" + c))
    joined = pairs.join(named("a"), F.col("a") == F.col("_a")).join(named("b"), F.col("b") == F.col("_b"))
    return joined.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, s: Settings, unique: bool = False) -> DataFrame:
    """Pairs (a, b) of doc_ids whose full shingle sets reach the threshold. `pairs` is a written table; `unique` says that no doc_id repeats."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bits = docs.sparkSession.sparkContext.broadcast(settle.id_bits(wanted))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(settle.asked(batch, bits.value), "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in settle.sets_of(part.column("text"), s.size)], pa.binary())], names=["id", "members"])

    sets = texts.mapInArrow(make, "id long, members binary")
    sets = materialized(sets if unique else sets.dropDuplicates(["id"]), "sets")
    named = lambda c: sets.select(F.col("id").alias("_" + c), F.col("members").alias("set_" + c))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = kernel.common(x, y)
                good.append(100 * both >= s.percent * (len(x) + len(y) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    joined = pairs.join(named("a"), F.col("a") == F.col("_a")).join(named("b"), F.col("b") == F.col("_b"))
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, for documents (doc_id, text).

    Documents without a word, null text or doc_id are linked with nothing and kept.
    Documents with equal sets are one class from the start, so copies meet once; repeated
    rows share a component. Other columns are not read; an empty table gives no rows.

    Candidates are confirmed in rounds. First each class of a bucket against the bucket's
    smallest, if their odd sketches look similar. Then, in buckets that still hold several components,
    the odd sketches of whole sets are compared in bounded blocks: of the pairs between two components that
    pass their bound the likeliest is confirmed, and all others where that one fails (`settle.settled`).
    """
    s = settings
    rows = materialized(sketches(docs, s), "sketches")
    real = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialized(real.groupBy("set_key").agg(F.min("doc_id").alias("id")), "classes")
    heads = rows.join(classes.select(F.col("id").alias("_id"), F.col("set_key").alias("_key")), (F.col("doc_id") == F.col("_id")) & (F.col("set_key") == F.col("_key")), "left_semi")
    heads = materialized(heads.select(F.col("doc_id").alias("id"), "bands", "sketch").dropDuplicates(["id"]), "heads")
    marks = heads.select("id", "sketch")
    banded = heads.select("id", F.explode("bands").alias("key"))
    leads = materialized(banded.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.count("*").alias("n")).filter("lead < last").select(
        F.col("key").alias("_key"), "lead", "n"), "leads")
    buckets = materialized(banded.join(leads, F.col("key") == F.col("_key")).drop("_key"), "buckets")
    stars = buckets.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    tried = materialized(screened(stars, marks, s), "stars")
    # Where doc_ids repeat, what is made of their texts is reduced to one row each, which moves it once more.
    unique = real.groupBy("doc_id").count().filter("count > 1").isEmpty()
    links = materialized(confirmed(tried, docs, s, unique), "links")
    found = components(links)
    found = settle.settled(buckets, found, tried, links, lambda ids: settle.whole_sketches(docs, ids, s.size, unique=unique), lambda pairs: confirmed(pairs, docs, s, unique), s.percent, s.block)
    found = found.select(F.col("node").alias("_node"), "component")
    members = rows.select("doc_id", "n_shingles", "set_key").join(classes.withColumnRenamed("set_key", "_key"), (F.col("set_key") == F.col("_key")) & F.col("doc_id").isNotNull(), "left")
    members = materialized(members.select("doc_id", "n_shingles", "id"), "members")
    told = members.join(found, F.col("id") == F.col("_node"), "left")
    component = F.coalesce("component", "id", "doc_id")
    return told.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
