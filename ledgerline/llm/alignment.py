"""Alignment of two tokenizers over the same bytes, and how many documents link each pair of ids.

Texts are cut where neither tokenizer can join what stands on both sides, into short chunks
that recur; each chunk is tokenised and aligned once per process. Pairs of ids with the
same bytes are counted in a vector over the first vocabulary; all other pairs, which only
irregular groups hold, are summed up in each task before they are shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm import kernel
from ledgerline.llm.tokens import tokenizer_path
from ledgerline.session import materialized

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE, PARTS = 2 << 20, 32
_LOW = (1 << 32) - 1


class Settings(NamedTuple):
    """`held` bounds the distinct pairs a task sums up before it hands them on, `table` the pairs of a part of the count table that tasks share."""

    held: int = 2_000_000
    table: int = 4_000_000


class _Grown:
    """An array that grows by doubling."""

    def __init__(self, kind) -> None:
        self.data, self.n = np.zeros(1024, kind), 0

    def extend(self, values) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            data = np.zeros(max(need, 2 * len(self.data)), self.data.dtype)
            data[:self.n] = self.data[:self.n]
            self.data = data
        self.data[self.n:need] = values
        self.n = need

    def __getitem__(self, at):
        return self.data[:self.n][at]


class _Places(dict):
    """Chunks to their numbers; new ones wait to be learned."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = place = len(self)
        self.waiting.append(chunk)
        return place


class Aligner:
    """Chunks of the two tokenizers, aligned."""

    MOST_CHUNKS, MOST_SIGNS = 400_000, 32 << 20

    def __init__(self, first: str, second: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        size_a = self.a.get_vocab_size()
        # Added tokens aren't byte-level; they never occur, as their strings are plain text.
        self.bytes_a = [bytes(signs.get(c, 63) for c in self.a.id_to_token(k) or "") for k in range(size_a)]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        real = {}
        for k in range(len(pieces) - 1, -1, -1):
            if not (self.b.is_control(k) or self.b.is_unknown(k)):
                real[self.bytes_b[k]] = k if not self.b.is_byte(k) or self.bytes_b[k] not in real else real[self.bytes_b[k]]
        self.shift = (len(pieces) - 1).bit_length()
        self.same = np.array([real.get(x, -1) for x in self.bytes_a], np.int64)
        self.length_a, self.length_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.raw_a, self.raw_b = (np.frombuffer(b"".join(y), np.uint8) for y in (self.bytes_a, self.bytes_b))
        self.names = [str(k) for k in range(max(size_a, len(pieces)))]
        self.encode_a = self._by_ranks(first) or (lambda chunks: [x.ids for x in self.a.encode_batch(chunks, add_special_tokens=False)])
        # A chunk may begin with a blank that no piece has behind another sign.
        inside = {c for k, p in enumerate(pieces) if not self.b.is_byte(k) for c in p.replace("▁", " ").lstrip(" ")[1:]}
        if " " in inside:
            raise ValueError("the second tokenizer joins words")
        safe = " " + "".join(c for c in "\n\t" if c not in inside)
        self.cut = re.compile(rf"\s*\S+(?:[^\S{safe}]\s*\S+)*(?:[^\S{safe}]\s*\Z)?|\s+").findall
        self.clear()

    def _by_ranks(self, first: str):
        """A faster encoder for the first tokenizer, if a file of the same vocabulary as ranks lies beside it."""
        ranks = os.path.splitext(first)[0] + ".tiktoken"
        if not os.path.exists(ranks):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if any(k >= len(self.bytes_a) or self.bytes_a[k] != x for x, k in known.items()):
            return None
        encode = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary
        return lambda chunks: list(map(encode, chunks))

    def clear(self) -> None:
        self.places, self.signs = _Places(), 0
        self.texts: list[str] = []
        self.fine, self.n_a, self.n_b, self.n_groups, self.n_links = _Grown(bool), *(_Grown(np.int64) for _ in range(4))
        #: Distinct pairs of chunk k and their occurrences: places first[k] to first[k + 1].
        self.first, self.pairs, self.times = _Grown(np.int64), _Grown(np.int64), _Grown(np.int64)
        self.first.extend([0])

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of all texts, and where each text's begin; the caches are ready for them."""
        if len(self.places) > self.MOST_CHUNKS or self.signs > self.MOST_SIGNS:
            self.clear()
        found = [list(map(self.places.__getitem__, self.cut(" " + t))) if t else [] for t in texts]
        if self.places.waiting:
            self.learn(self.places.waiting)
            self.places.waiting = []
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        return np.array(list(chain.from_iterable(found)), np.int64), bounds

    def learn(self, chunks: list[str]) -> None:
        """Tokenise and align new chunks, all at once: their bytes make one stream, cut where both sides have a token's end."""
        ids_a = self.encode_a(chunks)
        # A letter before each chunk keeps the second tokenizer from putting its blank there; it is a token of its own.
        ids_b = [x[1:] for x in self.b.encode(["a" + c for c in chunks], num_threads=1)]
        raw = [c.encode() for c in chunks]
        size = np.array(list(map(len, raw)), np.int64)
        n_a, n_b = (np.array(list(map(len, y)), np.int64) for y in (ids_a, ids_b))
        a, b = (np.array(list(chain.from_iterable(y)), np.int64) for y in (ids_a, ids_b))
        fine = _equal(a, n_a, self.length_a, self.raw_a, raw, size) & _equal(b, n_b, self.length_b, self.raw_b, raw, size)
        if not fine.all():
            a, b = a[np.repeat(fine, n_a)], b[np.repeat(fine, n_b)]
            n_a, n_b = np.where(fine, n_a, 0), np.where(fine, n_b, 0)
        self.signs += sum(map(len, chunks))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        many_a, many_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        chunk_a = np.repeat(np.arange(len(chunks)), n_a)
        first_b = np.cumsum(many_b) - many_b
        repeat = many_b[group_a]
        at_b = np.repeat(first_b[group_a], repeat) + np.arange(int(repeat.sum())) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        keys = (np.repeat(chunk_a, repeat) << 32) | (np.repeat(a, repeat) << self.shift) | b[at_b]
        keys, times = np.unique(keys, return_counts=True)
        counts = np.bincount(keys >> 32, minlength=len(chunks))
        chunk_of_group = np.zeros(len(ends), np.int64)
        chunk_of_group[group_a] = chunk_a
        n_groups = np.bincount(chunk_of_group, minlength=len(chunks)) if len(ends) else np.zeros(len(chunks), np.int64)
        links = np.zeros(len(chunks), np.int64)
        np.add.at(links, chunk_of_group, many_a * many_b)
        self.fine.extend(fine), self.n_a.extend(n_a), self.n_b.extend(n_b), self.n_groups.extend(n_groups), self.n_links.extend(links)
        self.first.extend(self.pairs.n + np.cumsum(counts)), self.pairs.extend(keys & ((1 << 32) - 1)), self.times.extend(times)
        names = self.names
        left, right = [names[k] for k in a.tolist()], [names[k] for k in b.tolist()]
        parts, x, y = [], 0, 0
        for i, j in zip(many_a.tolist(), many_b.tolist()):
            if i == 1 == j:
                parts.append(f"{left[x]}|{right[y]}")
            else:
                parts.append(f"{','.join(left[x:x + i])}|{','.join(right[y:y + j])}")
            x += i
            y += j
        cuts = np.cumsum(n_groups).tolist()
        self.texts += [";".join(parts[i:j]) for i, j in zip([0, *cuts], cuts)]

    def spread(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all pairs of these chunks, and the place in `chunks` each comes from."""
        begin, n = self.first[chunks], self.first[chunks + 1] - self.first[chunks]
        own = np.repeat(np.arange(len(chunks)), n)
        return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), own


def _equal(ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, bytes_: np.ndarray, raw: list[bytes], size: np.ndarray) -> np.ndarray:
    """Which chunks their tokens give back byte by byte."""
    owner = np.repeat(np.arange(len(n)), n)
    long = lengths[ids]
    good = np.bincount(owner, long, len(n)).astype(np.int64) == size
    keep = good[owner]
    ids, long = ids[keep], long[keep]
    begins = (np.cumsum(lengths) - lengths)[ids]
    at = np.repeat(begins - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
    told = np.frombuffer(b"".join([r for r, g in zip(raw, good.tolist()) if g]), np.uint8)
    differ = np.flatnonzero(bytes_[at] != told)
    if len(differ):
        good[np.flatnonzero(good)[np.searchsorted(np.cumsum(size[good]), differ, side="right")]] = False
    return good


class Table(NamedTuple):
    """Counts of pairs with first ids from `low` up to `high`: those with the same bytes by first id, the others sorted; and each first id's highest."""

    low: int
    high: int
    same: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    highest: np.ndarray

    def look(self, pairs: np.ndarray, same_bytes: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = pairs >> shift, pairs & ((1 << shift) - 1)
        inside = (a >= self.low) & (a < self.high)
        found = np.zeros(len(pairs), np.int64)
        equal = same_bytes[a] == b
        found[equal] = self.same[a[equal]]
        if len(self.keys):
            rest = np.flatnonzero(~equal & inside)
            at = np.searchsorted(self.keys, pairs[rest])
            at[at == len(self.keys)] = 0
            found[rest] = np.where(self.keys[at] == pairs[rest], self.counts[at], 0)
        return np.where(inside, found, 0), inside & (found == self.highest[a])


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    """The one aligner of this Python process for these files."""
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(first, second)
    return _ALIGNERS[first, second]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _fits(known: Aligner, chunks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts both tokenizers give back byte by byte."""
    broken = np.concatenate([[0], np.cumsum(~known.fine[chunks])])
    return (broken[bounds[1:]] == broken[bounds[:-1]]) & (bounds[1:] > bounds[:-1])


_LINKED = [("row", "long"), ("doc_id", "long"), *[(c, "long") for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", "string"), ("pairs", "binary"), ("times", "binary"),
           ("key", "long"), ("n", "long"), ("vector", "binary")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def linked(docs: DataFrame, first: str, second: str, s: Settings = Settings()) -> DataFrame:
    """The one pass over texts. A row per document with its digests, its distinct pairs of ids (first id shifted, or-ed with the second) and their
    occurrences; and, task by task, how many documents hold a pair: key and n, or a part n of a vector of the pairs with the same bytes."""
    schema = pa.schema([(c, _ARROW[k]) for c, k in _LINKED])

    def rows(many: int, /, **columns) -> pa.RecordBatch:
        arrays = [columns.get(f.name) for f in schema]
        return pa.RecordBatch.from_arrays([pa.nulls(many, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(arrays, schema)], schema=schema)

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(first, second)
        vector, held, n_held = np.zeros(len(known.same), np.int64), [], 0
        for batch in batches:
            for part in kernel.slices(batch, "text", SLICE):
                chunks, bounds = known.numbers(part.column("text").to_pylist())
                fits = _fits(known, chunks, bounds)
                sums = {}
                for name in ("n_a", "n_b", "n_groups", "n_links"):
                    running = np.concatenate([[0], np.cumsum(getattr(known, name)[chunks])])
                    sums[name] = np.where(fits, running[bounds[1:]] - running[bounds[:-1]], 0)
                listed, texts = chunks.tolist(), known.texts
                digests = [hashlib.sha256(";".join([texts[k] for k in listed[a:b]]).encode()).hexdigest() if good else ""
                           for good, a, b in zip(fits.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())]
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                keep = fits[doc]
                once, often = np.unique((doc[keep] << 32) | chunks[keep], return_counts=True)
                at, own = known.spread(once & _LOW)
                told = ((once >> 32)[own] << 32) | known.pairs[at]
                order = np.argsort(told)
                told, times = told[order], (known.times[at] * often[own])[order]
                lead = np.flatnonzero(np.concatenate([[True], told[1:] != told[:-1]])) if len(told) else np.zeros(0, np.int64)
                times = np.add.reduceat(times, lead) if len(lead) else times
                of, pairs = told[lead] >> 32, told[lead] & _LOW
                cuts = np.searchsorted(of, np.arange(part.num_rows + 1)).tolist()
                small, counts = pairs.astype("<u4"), times.astype("<u4")
                yield rows(part.num_rows, row=part.column("row"), doc_id=part.column("doc_id"), groups_sha256=digests, **sums,
                           pairs=[small[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], times=[counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])
                a, b = pairs >> known.shift, pairs & ((1 << known.shift) - 1)
                equal = known.same[a] == b
                vector += np.bincount(a[equal], minlength=len(vector))
                held.append(np.unique(pairs[~equal], return_counts=True))
                n_held += len(held[-1][0])
                if n_held > s.held:
                    held = [summed(held)]
                    n_held = len(held[0][0])
                    if n_held > s.held // 2:
                        yield rows(n_held, key=held[0][0], n=held[0][1])
                        held, n_held = [], 0
        if n_held:
            keys, n = summed(held)
            yield rows(len(keys), key=keys, n=n)
        if vector.any():
            yield rows(PARTS, n=range(PARTS), vector=[x.tobytes() for x in np.array_split(vector, PARTS)])

    return _texts(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in _LINKED))


class Counts(NamedTuple):
    """`pairs` (a, b, documents) of pairs with different bytes, a written table; `same`: documents by first id of the pairs with the same bytes."""

    pairs: DataFrame
    same: np.ndarray
    shift: int


def pair_counts(told: DataFrame, first: str | None = None, second: str | None = None) -> Counts:
    """Over all documents, how many link each pair of ids; `told` is a written table of `linked`."""
    known = aligner(first or tokenizer_path(BYTE_BPE), second or tokenizer_path(PIECE_BPE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[part] = sums.get(part, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "vector"])

    parts = told.filter("vector IS NOT NULL").select(F.col("n").alias("part"), "vector").repartition(PARTS, "part").mapInArrow(run, "part long, vector binary").collect()
    same = np.concatenate([np.frombuffer(bytes(x["vector"]), np.int64) for x in sorted(parts, key=lambda x: x["part"])]) if parts else np.zeros(len(known.same), np.int64)
    pairs = told.filter("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("documents"))
    pairs = pairs.select(F.expr(f"key div {1 << known.shift}").cast("int").alias("a"), (F.col("key") % (1 << known.shift)).cast("int").alias("b"), "documents")
    return Counts(materialized(pairs, "pairs"), same, known.shift)


def tables(counts: Counts, s: Settings = Settings()) -> Iterator[Table]:
    """The count table in ranges of first ids, each of at most `table` pairs, or of one first id."""
    size = len(counts.same)
    sizes = np.zeros(size, np.int64)
    for row in counts.pairs.groupBy("a").count().collect():
        sizes[row["a"]] = row["count"]
    low = 0
    while low < size:
        ahead = np.cumsum(sizes[low:])
        high = low + max(1, int(np.searchsorted(ahead, s.table, side="right")))
        some = counts.pairs.filter((F.col("a") >= low) & (F.col("a") < high)) if low or high < size else counts.pairs
        packed = some.select(((F.col("a").cast("long") * (1 << counts.shift)) + F.col("b")).alias("key"), F.col("documents").alias("n")).mapInArrow(
            lambda batches: (pa.RecordBatch.from_arrays([pa.array([x.column(k).to_numpy().tobytes()], pa.binary()) for k in range(2)], names=["keys", "n"]) for x in batches), "keys binary, n binary").collect()
        keys, n = (np.concatenate([np.frombuffer(bytes(x[c]), np.int64) for x in packed] or [np.zeros(0, np.int64)]) for c in ("keys", "n"))
        order = np.argsort(keys)
        highest = counts.same.copy()
        np.maximum.at(highest, keys >> counts.shift, n)
        yield Table(low, high, counts.same, keys[order], n[order], highest)
        low = high


_SUMS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
COLUMNS = [x.split()[0] for x in _SUMS.split(", ")][1:]


def _weighed(told: DataFrame, table: Table, same_bytes: np.ndarray, shift: int) -> DataFrame:
    """Documents with the sums over their links of first ids that the table covers."""
    shared = told.sparkSession.sparkContext.broadcast((table, same_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, same_bytes = shared.value
        for batch in batches:
            for some in kernel.slices(batch, "pairs", SLICE):
                pairs, times = (np.frombuffer(b"".join(some.column(c).to_pylist()), "<u4").astype(np.int64) for c in ("pairs", "times"))
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in some.column("pairs").to_pylist()], dtype=np.int64)])
                counts, best = table.look(pairs, same_bytes, shift)
                sums = {}
                for name, values in (("n_best", np.where(best, times, 0)), ("count_sum", counts * times)):
                    running = np.concatenate([[0], np.cumsum(values)])
                    sums[name] = pa.array(running[bounds[1:]] - running[bounds[:-1]])
                yield pa.RecordBatch.from_arrays([sums[c] if c in sums else some.column(c) for c in ["row", *COLUMNS]], names=["row", *COLUMNS])

    return told.filter("row IS NOT NULL").select("row", *[c for c in COLUMNS if c not in ("n_best", "count_sum")], "pairs", "times").mapInArrow(run, _SUMS)


def aligned(docs: DataFrame, first: str | None = None, second: str | None = None, s: Settings = Settings()) -> DataFrame:
    """Per document (doc_id, text): tokens of both tokenizers, groups, links, best links, the sum of the links' counts and the groups' hash.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens: zeros
    and an empty hash. Every row gives one row, repeated ones and those without doc_id too; each counts as a
    document. Other columns are not read; an empty table gives no rows.

    Texts are read once; each document's pairs are written. The count table is shared with all tasks while it has at
    most `table` pairs. A larger one is taken in ranges of first ids, one after the other, and the sums of all ranges are added up.
    """
    first, second = first or tokenizer_path(BYTE_BPE), second or tokenizer_path(PIECE_BPE)
    told = materialized(linked(docs, first, second, s), "linked")
    counts, known = pair_counts(told, first, second), aligner(first, second)
    parts = []
    for table in tables(counts, s):
        some = _weighed(told, table, known.same, known.shift)
        if table.low == 0 and table.high == len(counts.same):
            return some.select(*COLUMNS)
        parts.append(materialized(some, "aligned"))
    sums = parts[0].select("row", "n_best", "count_sum")
    for part in parts[1:]:
        sums = sums.unionByName(part.select("row", "n_best", "count_sum"))
    sums = sums.groupBy(F.col("row").alias("_row")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return parts[0].drop("n_best", "count_sum").join(sums, F.col("row") == F.col("_row")).select(*COLUMNS)
