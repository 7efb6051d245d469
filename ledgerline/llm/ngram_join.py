"""Exact similarity join of shingle sets by prefixes under several global token orders.

Two sets that reach the threshold share a token among the first few of each, under every
order that both follow. The first order, by rarity, is indexed and proposes pairs; the
prefixes under the other orders must meet too before full sets are compared. All filters
are lossless, whatever the rarity table says: it changes the number of candidates only.
"""

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

#: Cells of the rarity table: one byte each when it is shared, at any input size.
CELLS = 1 << 20
#: Up to so many documents of a token are compared with each other, to pass over those that none of the others can match.
COMPARED = 1 << 10
#: Bits of rarity that each order drops, and what its ties go by: from fine to coarse.
ORDERS = ((0, 0x9E3779B97F4A7C15), (3, 0xC2B2AE3D27D4EB4F), (5, 0x165667B19E3779F9))


class Settings(NamedTuple):
    """Sets link when 100 * intersection >= percent * union. The index is dealt over parts of about `part` entries; a part of more
    than `most` goes another way, by rows. `block` bounds the members of a group that a task holds."""

    percent: int = 80
    size: int = 5
    part: int = 1 << 20
    most: int = 8 << 20
    block: int = 4000


def prefix_length(n, percent: int):
    """How many tokens of a set of n a similar set must meet, under any order."""
    return n + (-percent * n) // 100 + 1


def cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64) % CELLS


def ranked(tokens: np.ndarray, table: np.ndarray, order: int, length: int) -> np.ndarray:
    """The first tokens of a set under one of the orders."""
    dropped, salt = ORDERS[order]
    with np.errstate(over="ignore"):
        ranks = ((table[cell(tokens)] >> dropped).astype(np.uint64) << np.uint64(56)) | (kernel.mixed(tokens + np.uint64(salt)) >> np.uint64(8))
    return tokens[np.argsort(ranks, kind="stable")[:length]]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def scanned(docs: DataFrame, s: Settings) -> DataFrame:
    """First pass: doc_id, n_shingles and set_key of each document (part null), and each task's token counts by part of the table."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary())])
    parts = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for part in kernel.slices(batch, "text", 4 << 20):
                sets = settle.sets_of(part.column("text"), s.size)
                counts += np.bincount(cell(np.concatenate(sets)), minlength=CELLS).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(sets), pa.int32()), part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()),
                                                  pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())], schema=schema)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.nulls(parts, pa.int64()), pa.nulls(parts, pa.int64()),
                                              pa.array([x.astype("<u4").tobytes() for x in np.split(counts, parts)], pa.binary())], schema=schema)

    return _columns(docs).mapInArrow(run, "part int, doc_id long, n_shingles long, set_key binary")


def rarity(scan: DataFrame) -> bytes:
    """The rarity table: 8 times the binary logarithm of each cell's count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[part] = sums.get(part, 0) + np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64)
        if sums:
            code = [np.minimum(8 * np.log2(1 + x), 255).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(code, pa.binary())], names=["part", "code"])

    found = scan.filter("part IS NOT NULL").select("part", F.col("set_key").alias("raw")).repartition(16, "part").mapInArrow(run, "part int, code binary").collect()
    return b"".join(bytes(x["code"]) for x in sorted(found, key=lambda x: x["part"])) or bytes(CELLS)


#: Tokens are told apart by 32 bits inside a part; a clash only adds a candidate.
_ENTRY = np.dtype([("token", "<u4"), ("id", "<i8"), ("n", "<u4"), ("place", "<u4")])


def indexed(docs: DataFrame, heads: DataFrame, table: bytes, n_parts: int, s: Settings) -> DataFrame:
    """The index of the first order: part, entries and their number. Entries of many documents make one row of each part.

    It covers the documents in `heads` (id), one of each class; few of the others pass the bitmap, and are treated like any document.
    """
    shared = docs.sparkSession.sparkContext.broadcast((table, settle.id_bits(heads)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, bits = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
        held, parts, n_held = [], [], 0

        def dealt() -> pa.RecordBatch:
            all_, part = np.concatenate(held), np.concatenate(parts)
            order = np.argsort(part, kind="stable")
            all_, part = all_[order], part[order]
            leads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = [*leads[1:].tolist(), len(part)]
            return pa.RecordBatch.from_arrays([pa.array(part[leads], pa.int64()), pa.array([_packed(all_[a:b]) for a, b in zip(leads.tolist(), ends)], pa.binary()),
                                               pa.array(np.diff([*leads, len(part)]), pa.int64())], names=["part", "entries", "n"])

        for batch in batches:
            for some in kernel.slices(settle.asked(batch, bits), "text", 4 << 20):
                for doc, own in zip(some.column("doc_id").to_pylist(), settle.sets_of(some.column("text"), s.size)):
                    first = ranked(own, codes, 0, prefix_length(len(own), s.percent))
                    rows, first = np.empty(len(first), _ENTRY), kernel.mixed(first)
                    rows["token"], rows["id"], rows["n"], rows["place"] = first >> np.uint64(32), doc, len(own), np.arange(len(first))
                    held.append(rows)
                    parts.append((first % np.uint64(n_parts)).astype(np.int64))
                    n_held += len(rows)
                if n_held >= s.part:
                    yield dealt()
                    held, parts, n_held = [], [], 0
        if n_held:
            yield dealt()

    return _columns(docs).mapInArrow(run, "part long, entries binary, n long")


def _packed(rows: np.ndarray) -> bytes:
    """Entries that go by document: tokens, places of 2 bytes where these are enough, and each document's id, size and number of entries once."""
    lead = np.flatnonzero(np.concatenate([[True], (rows["id"][1:] != rows["id"][:-1]) | (rows["n"][1:] != rows["n"][:-1])]))
    wide = bool(rows["place"].max() > 0xFFFF)
    return b"".join([np.array([wide, len(lead)], "<u4").tobytes(), rows["token"].tobytes(), rows["place"].astype("<u4" if wide else "<u2").tobytes(),
                     rows["id"][lead].tobytes(), rows["n"][lead].tobytes(), np.diff([*lead.tolist(), len(rows)]).astype("<u4").tobytes()])


def _entries(raw: bytes, n: int) -> np.ndarray:
    wide, docs = np.frombuffer(raw, "<u4", 2).tolist()
    at, out = 8, np.empty(n, _ENTRY)

    def column(kind: str, many: int) -> np.ndarray:
        nonlocal at
        values = np.frombuffer(raw, kind, many, at)
        at += values.nbytes
        return values

    out["token"], out["place"] = column("<u4", n), column("<u4" if wide else "<u2", n)
    ids, sizes, many = column("<i8", docs), column("<u4", docs), column("<u4", docs)
    out["id"], out["n"] = np.repeat(ids, many), np.repeat(sizes, many)
    return out


def _met(rows: np.ndarray, percent: int) -> np.ndarray:
    """Which entries, in order of their tokens, some other document with that token may match, by the sizes of the sets and the places of the token.

    Of a token with more than `COMPARED` entries all are kept."""
    token, id_, n, place = rows["token"], rows["id"], rows["n"].astype(np.int64), rows["place"].astype(np.int64)
    met = np.zeros(len(rows), bool)
    if not len(rows):
        return met
    cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    many = np.diff(np.append(cuts, len(rows)))
    met[np.repeat(many > COMPARED, many)] = True
    at = np.flatnonzero(~met)
    spot = (np.arange(len(rows)) - np.repeat(cuts, many))[at]
    for back in range(1, int(many[many <= COMPARED].max(initial=1))):
        # Who has met one needs no further ones, but may still be the one that another meets.
        at, spot = at[spot >= back], spot[spot >= back]
        a = at[~(met[at] & met[at - back])]
        b = a - back
        both = n[a] + n[b]
        fits = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        fits &= np.minimum(place[a], place[b]) + 1 + np.minimum(n[a] - place[a], n[b] - place[b]) - 1 >= -(-percent * both // (100 + percent))
        fits &= id_[a] != id_[b]
        met[a[fits]] = met[b[fits]] = True
    return met


LIVE = "key long, id long, n long, place long, lead long, lead_n long, lead_place long"
_LIVE = pa.schema([(x.split()[0], pa.int64()) for x in LIVE.split(", ")])


def live(index: DataFrame, s: Settings) -> DataFrame:
    """Entries whose token other documents have too, with the smallest of these (lead); `index` is a written table.

    Those that none of the others can match by size and place are left out: two similar sets pass this bound at every token that they share.
    A part is sorted in one task. Parts of more than `most` entries, where some token is very
    frequent, become rows that Spark aggregates and joins by token, so that skew is split.
    """
    large = materialized(index.groupBy(F.col("part").alias("_part")).agg(F.sum("n").alias("total")).filter(F.col("total") > s.most).select("_part"), "large-parts")

    def sorted_(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
        all_ = np.concatenate(held)
        token = np.sort(all_["token"])
        again = np.unique(token[1:][token[1:] == token[:-1]])
        at = np.searchsorted(again, all_["token"])
        at[at == len(again)] = 0
        all_ = all_[again[at] == all_["token"]] if len(again) else all_[:0]
        all_ = all_[np.lexsort((all_["id"], all_["token"]))]
        all_ = all_[_met(all_, s.percent)]
        new = np.concatenate([[True], all_["token"][1:] != all_["token"][:-1]]) if len(all_) else np.zeros(0, bool)
        lead = all_[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(all_) else all_
        columns = [(part << 32) + all_["token"].astype(np.int64), all_["id"], all_["n"], all_["place"], lead["id"], lead["n"], lead["place"]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).astype(np.int64), pa.int64()) for x in columns], schema=_LIVE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, raw, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if part != now:
                    if held:
                        yield sorted_(now, held)
                    now, held = part, []
                held.append(_entries(raw.as_buffer(), n))
        if held:
            yield sorted_(now, held)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                x = _entries(raw.as_buffer(), n)
                yield pa.RecordBatch.from_arrays([pa.array((part << 32) + x["token"].astype(np.int64))] + [pa.array(x[c].astype(np.int64)) for c in ("id", "n", "place")], names=["key", "id", "n", "place"])

    n_tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = index.join(large, F.col("part") == F.col("_part"), "left_anti").select("part", "entries", "n")
    told = small.repartition(n_tasks, "part").sortWithinPartitions("part").mapInArrow(run, LIVE)
    if large.isEmpty():
        return told
    apart = materialized(index.join(large, F.col("part") == F.col("_part"), "left_semi").select("part", "entries", "n").mapInArrow(rows, "key long, id long, n long, place long"), "large-rows")
    leads = apart.groupBy(F.col("key").alias("_key")).agg(F.min(F.struct("id", "n", "place")).alias("lead"), F.max("id").alias("last")).filter("lead.id < last")
    joined = apart.join(leads, F.col("key") == F.col("_key")).select("key", "id", "n", "place", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.place").alias("lead_place"))
    return told.unionByName(joined)


def _beside(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b and the columns of both documents."""
    side = lambda c: rows.select(F.col("id").alias("_" + c), *[F.col(x).alias(f"{x}_{c}") for x in columns])
    joined = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    return joined.select("a", "b", *[f"{x}_a" for x in columns], *[f"{x}_b" for x in columns])


def screened(pairs: DataFrame, docs: DataFrame, s: Settings, unique: bool = False) -> DataFrame:
    """Pairs (a, b) that the odd sketches of whole sets, folded to about one cell a member, can't exclude. `pairs` is a written table."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n, x, m, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                x, y = np.frombuffer(x, np.uint64)[None, :], np.frombuffer(y, np.uint64)[None, :]
                words = min(x.shape[1], y.shape[1])
                apart = int(np.bitwise_count(settle.folded_to(x, words) ^ settle.folded_to(y, words)).sum())
                good.append(n + m + 2 * (-s.percent * (n + m) // (100 + s.percent)) >= apart)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    marks = materialized(settle.whole_sketches(docs, wanted, s.size, 4, unique), "folded")
    return _beside(pairs, marks, ["size", "sketch"]).mapInArrow(near, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, table: bytes, s: Settings, unique: bool = False) -> DataFrame:
    """Pairs (a, b) that reach the threshold: first their prefixes must meet under each further order, then full sets are compared. `pairs` is a written
    table; `unique` says that no doc_id repeats."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    shared = docs.sparkSession.sparkContext.broadcast((table, settle.id_bits(wanted)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value[1]
        for batch in batches:
            for part in kernel.slices(settle.asked(batch, bits), "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in settle.sets_of(part.column("text"), s.size)], pa.binary())], names=["id", "members"])

    sets = _columns(docs).mapInArrow(make, "id long, members binary")
    sets = materialized(sets if unique else sets.dropDuplicates(["id"]), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer(shared.value[0], np.uint8)
        firsts: dict[tuple[int, int], np.ndarray] = {}

        def first(id_: int, own: np.ndarray, order: int) -> np.ndarray:
            if (id_, order) not in firsts:
                if len(firsts) > 2000:
                    firsts.clear()
                firsts[id_, order] = np.sort(ranked(own, codes, order, prefix_length(len(own), s.percent)))
            return firsts[id_, order]

        for batch in batches:
            good = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                met = all(kernel.common(first(a, x, k), first(b, y, k)) for k in range(1, len(ORDERS)))
                both = kernel.common(x, y) if met else 0
                good.append(met and 100 * both >= s.percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return _beside(pairs, sets, ["members"]).mapInArrow(compare, "a long, b long")


def linked(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links) for documents (doc_id, text).

    Documents without a word, null text or doc_id are linked with nothing. Documents with equal
    sets are one class from the start, so copies meet once; repeated rows share a component.
    A doc_id stands for one text. Other columns are not read; an empty table gives no rows.

    Each token's documents are first paired with the smallest of them. Tokens whose documents
    then still lie in several components form groups by that smallest one; in these, the likeliest pair
    between any two components is verified, and all others that the odd sketches of whole sets can't exclude
    where that one fails (`settle.settled`). No link between different texts is lost.
    """
    s = settings
    scan = materialized(scanned(docs, s), "ngram-scan")
    table = rarity(scan)
    rows = scan.filter("part IS NULL").select("doc_id", "n_shingles", "set_key")
    real = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialized(real.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles")).alias("head")).select("set_key", F.col("head.doc_id").alias("id"), F.col("head.n_shingles").alias("n")), "classes")
    # Where doc_ids repeat, what is made of their texts is reduced to one row each, which moves it once more.
    unique = real.groupBy("doc_id").count().filter("count > 1").isEmpty()
    total = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * s.percent / 100) + 1)).first()[0] or 0
    index = materialized(indexed(docs, classes.select("id"), table, -(-total // s.part) or 1, s), "ngram-index")
    entries = materialized(live(index, s), "ngram-live")
    least = F.ceil(s.percent * (F.col("n") + F.col("lead_n")) / (100 + s.percent))
    fits = (F.least("place", "lead_place") + 1 + F.least(F.col("n") - F.col("place") - 1, F.col("lead_n") - F.col("lead_place") - 1)) >= least
    sizes = 100 * F.least("n", "lead_n") >= s.percent * F.greatest("n", "lead_n")
    tried = materialized(entries.filter((F.col("id") != F.col("lead")) & sizes & fits).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    near = materialized(screened(tried, docs, s, unique), "screened")
    links = materialized(verified(near, docs, table, s, unique), "links")
    found = components(links)
    buckets = entries.select("key", "id", "lead")
    found = settle.settled(buckets, found, tried, links, lambda ids: settle.whole_sketches(docs, ids, s.size, unique=unique),
                           lambda pairs: verified(pairs, docs, table, s, unique), s.percent, s.block)
    named = found.select(F.col("node").alias("_node"), "component")
    members = rows.join(classes.select(F.col("set_key").alias("_key"), "id"), (F.col("set_key") == F.col("_key")) & F.col("doc_id").isNotNull(), "left")
    told = members.select("doc_id", "n_shingles", "id").join(named, F.col("id") == F.col("_node"), "left")
    return told.select("doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id"))

