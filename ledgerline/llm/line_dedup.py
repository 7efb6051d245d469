"""Line dedup: exact set-similarity join over the words of lines.

Tokens of a line are ordered by rarity; two lines can only be similar if their first
few tokens share one (prefix filter), so an index of these tokens finds all candidates.
Length, position and parity-bitmap bounds screen them, full sets verify them. A line
goes when an earlier one matches it. All bounds are lossless: the order of tokens
changes the number of candidates, never the result.

Lines of a few words have too short prefixes for that. They match by the sets of words
they share: each is a key, and the earliest line of each size at a key settles the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm import kernel, settle
from ledgerline.session import materialized

#: Cells of the rarity table, which has one byte per cell and this size at any input size, in as many parts.
CELLS, PARTS = 1 << 24, 256
SLICE = 1 << 20
#: Lines meet so many others of their key many keys at a time, further ones key by key.
SHORT = 64
#: Entries that a task deals out together, and that a part of the index should have at most.
HELD, PART = 1 << 19, 1 << 18
#: Lines of at most so many distinct words carry parity bitmaps of 32 and 64 bits, others one of 128.
NARROW, MIDDLE = 16, 48
#: What spreads lines over bitmaps: a line's number times this is xored with its doc_id.
SPREAD = 0x5851F42D
#: A key with more other lines is dealt out in the second round.
BLOCK = 1000
#: Groups of the second round that are larger meet as they stream by.
GROUP = 1 << 12
#: Most bits of a line's sketch, which has four cells a word.
WIDEST = 1 << 12
#: Pairs of lines that both have so many distinct words are found by the join, all others by the sets of words they share.
JOINED = 6


class Settings(NamedTuple):
    """Lines with fewer than `least` distinct words are left alone; by default every line with a word takes part. Tokens rarer than
    `common` occurrences are indexed alone; a more common one only together with another common token, which splits its lists. A class
    of more than one in `heavy` lines is indexed by its first line only."""

    percent: int = 75
    least: int = 1
    common: int = 1000
    heavy: int = 10_000


class Lines(NamedTuple):
    """Lines of a slice that take part: place of the row, line number, set size, their tokens in order of (line, token), and
    the 64-bit words of lines of few words: there one clash of shorter hashes would make a match."""

    row: np.ndarray
    number: np.ndarray
    size: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    token: np.ndarray
    words: dict[int, bytes]


def most_few(percent: int) -> int:
    """The most distinct words of a line that may match one of less than `JOINED`."""
    return 100 * (JOINED - 1) // percent


def lines_of(texts: pa.Array, least: int, few: int = 0) -> Lines:
    """Distinct 40-bit token hashes of each line with at least `least` distinct words; 64-bit ones too of lines with at most `few`."""
    data, bounds = kernel.flat(texts)
    starts, ends = kernel.word_spans(data, bounds)
    wide = kernel.word_hashes(data, starts, ends)
    hashes = wide >> np.uint64(24)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, starts)
    row = np.searchsorted(bounds, starts, side="right") - 1
    where = line + row
    # Words come line by line, so a line's words stand together.
    begins = np.concatenate([[True], where[1:] != where[:-1]]) if len(where) else np.zeros(0, bool)
    own = np.cumsum(begins) - 1
    counts = np.bincount(own)
    fit = counts >= least
    keep = fit[own] if len(own) else np.zeros(0, bool)
    renumbered = np.cumsum(fit) - 1
    owner, token = renumbered[own[keep]], hashes[keep]
    if int(fit.sum()) < 1 << 24:
        # The line's number fits above the token: one sort of plain numbers.
        keys = np.sort((owner.astype(np.uint64) << np.uint64(40)) | token)
        owner, token = (keys >> np.uint64(40)).astype(np.int64), keys & np.uint64((1 << 40) - 1)
    else:
        order = np.lexsort((token, owner))
        owner, token = owner[order], token[order]
    once = np.concatenate([[True], (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])]) if len(owner) else np.zeros(0, bool)
    owner, token = owner[once], token[once]
    size = np.bincount(owner, minlength=int(fit.sum()))
    lead = np.flatnonzero(begins)
    rows, numbers = row[lead][fit], (line[lead] - np.searchsorted(breaks, bounds[row[lead]]))[fit]
    enough = size >= least
    spot = np.cumsum(enough) - 1
    inside = enough[owner] if len(owner) else np.zeros(0, bool)
    size_ = size[enough]
    words = {}
    if few and len(size):
        of = renumbered[own[keep]]
        short = (enough & (size <= few))[of]
        of, word = spot[of[short]], wide[keep][short]
        order = np.lexsort((word, of))
        of, word = of[order], word[order]
        once = np.concatenate([[True], (of[1:] != of[:-1]) | (word[1:] != word[:-1])]) if len(of) else np.zeros(0, bool)
        of, raw = of[once], word[once].tobytes()
        leads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        words = {k: raw[8 * a:8 * b] for k, a, b in zip(of[leads].tolist(), leads.tolist(), [*leads[1:].tolist(), len(of)])}
    return Lines(rows[enough], numbers[enough], size_, np.cumsum(size_) - size_, spot[owner[inside]], token[inside], words)


def set_keys(lines: Lines) -> list[bytes]:
    raw = lines.token.tobytes()
    return [xxhash.xxh3_128_digest(lines.words.get(k) or raw[8 * a:8 * (a + n)]) for k, (a, n) in enumerate(zip(lines.first.tolist(), lines.size.tolist()))]


def cell(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(8)).astype(np.int64) % CELLS


def _needed(size: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap a set of that size has with any similar one."""
    return -(-percent * size // 100)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL AND text IS NOT NULL")


def _classes(s: Settings) -> int:
    """How many classes the common tokens fall into."""
    return min(8, int(_needed(np.array(max(s.least, JOINED)), s.percent)) - 1)


def most_entries(size: np.ndarray, s: Settings) -> int:
    """About how many index entries lines of these sizes have at most; those of few words have none."""
    size = size[size >= JOINED]
    prefix, n = size - _needed(size, s.percent) + 1, max(1, _classes(s))
    return int((prefix + (prefix + n) * (prefix + n - 1) // (2 * n)).sum())


def _rarity_code(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: 0 for none, 1 for one, then by steps of an eighth of a binary logarithm."""
    return np.where(counts > 0, np.minimum(1 + np.rint(8 * np.log2(np.maximum(counts, 1))), 255), 0).astype(np.uint8)


def scanned(docs: DataFrame, s: Settings) -> DataFrame:
    """First pass: part null: doc_id, line and set_key of every line, and the words of one of few words that may match a different one;
    else a task's occurrences of the tokens of that part of the rarity table, and in doc_id of part 0 how many index entries its lines have at most."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("line", pa.int32()), ("set_key", pa.binary()), ("words", pa.binary())])
    few = most_few(s.percent)
    alone = [n for n in range(1, few + 1) if 100 * n < s.percent * (n + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n_entries = np.zeros(CELLS, np.uint32), 0
        for batch in batches:
            for part in kernel.slices(batch, "text", SLICE):
                lines = lines_of(part.column("text"), s.least, few)
                cells, n = np.unique(cell(lines.token[lines.size[lines.owner] >= JOINED]), return_counts=True)
                counts[cells] += n.astype(np.uint32)
                n_entries += most_entries(lines.size, s)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(lines.row), pa.int32()), part.column("doc_id").take(pa.array(lines.row)),
                                                  pa.array(lines.number, pa.int32()), pa.array(set_keys(lines), pa.binary()),
                                                  pa.array([w if w and len(w) // 8 not in alone else None for w in map(lines.words.get, range(len(lines.row)))], pa.binary())], schema=schema)
        for k in range(PARTS):
            own = counts[k * CELLS // PARTS:(k + 1) * CELLS // PARTS]
            seen = np.flatnonzero(own)
            raw = seen.astype("<u2").tobytes() + _rarity_code(own[seen]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0 if k else n_entries], pa.int64()), pa.array([len(seen)], pa.int32()), pa.array([raw], pa.binary()), pa.nulls(1, pa.binary())], schema=schema)

    return _columns(docs).mapInArrow(run, "part int, doc_id long, line int, set_key binary, words binary")


def rarity(scan: DataFrame) -> bytes:
    """The rarity table: occurrences of the tokens of each cell, by steps of an eighth of a binary logarithm. Parts are summed as they stream by."""
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_rarity_code(total).tobytes()])], schema=schema)
        for batch in batches:
            for part, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if part != at:
                    if at is not None:
                        yield done()
                    at, total = part, np.zeros(CELLS // PARTS)
                total[np.frombuffer(raw, "<u2", n)] += 2 ** ((np.frombuffer(raw, "<u1", n, 2 * n) - 1.0) / 8)
        if at is not None:
            yield done()

    parts = scan.filter("part IS NOT NULL").select("part", F.col("line").alias("n"), F.col("set_key").alias("raw"))
    n_tasks = min(PARTS, int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = {x["part"]: bytes(x["counts"]) for x in parts.repartition(n_tasks, "part").sortWithinPartitions("part").mapInArrow(run, "part int, counts binary").collect()}
    return b"".join(found.get(k, bytes(CELLS // PARTS)) for k in range(PARTS))


def _who(doc_id: str = "doc_id", line: str = "line") -> Column:
    """A number for a line, for bitmaps."""
    return F.col(doc_id).bitwiseXOR(F.col(line).cast("long") * SPREAD)


def packed_index(docs: DataFrame, table: bytes, heavy: dict[bytes, tuple[int, int]], s: Settings, heads: bytes | None = None, n_parts: int = 1) -> DataFrame:
    """Second pass: an index entry for each rare prefix token and each chosen pair of common ones that more than one line may have.

    If the first token that two similar lines share is rare, both index it. Else all tokens they share are common,
    and at least c + 1 of them stand in both prefixes if these are c tokens longer. Tokens fall into c classes by
    hash, so two of them share a class: pairs within a class are enough.

    part, entries and their number: those of many lines make one row of each part. An entry has a key, the place of its first token in the
    line's order, doc_id, line, size and the parity bitmap of the set. `heads` is a bitmap of the first lines of all sets: most others are
    passed over, as they match those anyway; the rest are treated like any line.
    """
    least, few, n_classes = max(s.least, JOINED), most_few(s.percent), _classes(s)
    shared = docs.sparkSession.sparkContext.broadcast((table, heavy, heads))
    common = _rarity_code(np.array([s.common]))[0]

    def entries_of(lines: Lines, docs_: np.ndarray, shown: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Key, place and line of each entry."""
        rank = (counts[cell(lines.token)].astype(np.uint64) << np.uint64(40)) | lines.token
        if len(lines.row) <= 1 << 16:
            # The line's number fits above the token's rank: one sort of plain numbers.
            rank = np.sort((lines.owner.astype(np.uint64) << np.uint64(48)) | rank) & np.uint64((1 << 48) - 1)
        else:
            rank = rank[np.lexsort((rank, lines.owner))]
        token, count = rank & np.uint64((1 << 40) - 1), rank >> np.uint64(40)
        place = np.arange(len(rank)) - np.repeat(lines.first, lines.size)
        prefix = lines.size - _needed(lines.size, s.percent) + 1
        open_ = (count > 1) & shown[lines.owner]
        frequent = (count >= common) & (n_classes > 0)
        alone = np.flatnonzero(open_ & ~frequent & (place < prefix[lines.owner]))
        dense = np.flatnonzero(open_ & frequent & (place < (prefix + n_classes)[lines.owner]))
        class_ = lines.owner[dense] * max(1, n_classes) + (kernel.mixed(token[dense]) % np.uint64(max(1, n_classes))).astype(np.int64)
        order = np.argsort(class_, kind="stable")
        dense, class_ = dense[order], class_[order]
        n = np.arange(len(dense)) - np.searchsorted(class_, class_)
        own = np.repeat(np.arange(len(dense)), n)
        at, other = dense[own], dense[own - 1 - (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))]
        paired = kernel.mixed(kernel.mixed(np.minimum(token[other], token[at])) + np.maximum(token[other], token[at]))
        # Of a pair, the token that comes first tells the place: lines that share the pair share it.
        return [np.concatenate([kernel.mixed(token[alone]), paired]), np.concatenate([place[alone], place[other]]), np.concatenate([lines.owner[alone], lines.owner[at]])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, heavy, heads = shared.value
        counts = np.frombuffer(table, np.uint8)
        held, n_held, n_lines = [], 0, 0
        for batch in batches:
            for part in kernel.slices(batch, "text", SLICE):
                lines = lines_of(part.column("text"), least, few)
                if not len(lines.row):
                    continue
                docs_ = part.column("doc_id").to_numpy(zero_copy_only=False)[lines.row]
                shown = np.ones(len(docs_), bool) if heads is None else settle.among(docs_ ^ (lines.number.astype(np.int64) * SPREAD), heads)
                if heavy:
                    shown &= np.array([k not in heavy or heavy[k] == (d, n) for k, d, n in zip(set_keys(lines), docs_.tolist(), lines.number.tolist())])
                place_bit = lines.token & np.uint64(127)
                bit = np.uint64(1) << (place_bit & np.uint64(63))
                half = place_bit >= 64
                even = np.bitwise_xor.reduceat(np.where(half, np.uint64(0), bit), lines.first)
                odd = np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), lines.first)
                even, odd = np.where(lines.size <= MIDDLE, even ^ odd, even), np.where(lines.size <= MIDDLE, np.uint64(0), odd)
                even = np.where(lines.size <= NARROW, _folded(even, odd), even)
                key, place, owner = entries_of(lines, docs_, shown, counts)
                held.append((key, place, owner + n_lines, docs_, lines.number, lines.size, even, odd))
                n_held, n_lines = n_held + len(key), n_lines + len(docs_)
                if n_held >= HELD:
                    yield _dealt([np.concatenate(x) for x in zip(*held)], n_parts)
                    held, n_held, n_lines = [], 0, 0
        if n_held:
            yield _dealt([np.concatenate(x) for x in zip(*held)], n_parts)

    return _columns(docs).mapInArrow(run, "part long, entries binary, n long")


def _dealt(held: list[np.ndarray], n_parts: int) -> pa.RecordBatch:
    """A row of each part for entries (key, place, owner) of lines (doc_id, line, size, even, odd)."""
    key, place, owner, *lines = held
    part = (key % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part * len(lines[0]) + owner, kind="stable")
    key, place, owner, part = key[order] >> np.uint64(32), place[order], owner[order], part[order]
    leads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = [*leads[1:].tolist(), len(part)]
    rows = []
    for a, b in zip(leads.tolist(), ends):
        own = owner[a:b]
        lead = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        rows.append(_packed(key[a:b], place[a:b], np.diff([*lead.tolist(), len(own)]), *[x[own[lead]] for x in lines]))
    return pa.RecordBatch.from_arrays([pa.array(part[leads], pa.int64()), pa.array(rows, pa.binary()), pa.array(np.diff([*leads.tolist(), len(part)]), pa.int64())],
                                      names=["part", "entries", "n"])


_KINDS = ("<u1", "<u2", "<u4", "<u8")


def _packed(key: np.ndarray, place: np.ndarray, many: np.ndarray, doc: np.ndarray, line: np.ndarray, size: np.ndarray, even: np.ndarray, odd: np.ndarray) -> bytes:
    """Entries that go by line, of which each has `many`. Keys are told apart by 32 bits inside a part; a clash only adds a candidate.

    Numbers take as many bytes as the largest needs, doc_ids as steps from one line to the next."""
    steps = np.diff(doc.astype(np.int64).view(np.uint64), prepend=np.uint64(0))
    columns, kinds = [], []
    for x in (place, many, steps, line, size):
        kind = int(np.searchsorted([1 << 8, 1 << 16, 1 << 32], int(x.max()), side="right"))
        kinds.append(kind)
        columns.append(x.astype(_KINDS[kind]).tobytes())
    small = b"".join(columns)
    squeezed = pa.compress(small, codec="zstd", asbytes=True)
    head = np.array([len(key), len(doc), len(small), len(squeezed), *kinds], "<u4").tobytes()
    return b"".join([head, squeezed, key.astype("<u4").tobytes(), even[size <= NARROW].astype("<u4").tobytes(), even[size > NARROW].astype("<u8").tobytes(),
                     odd[size > MIDDLE].astype("<u8").tobytes()])


def _by_line(raw: pa.Buffer) -> list[np.ndarray]:
    """Key and place of each entry, and of each line how many entries it has, doc_id, line, size, even and odd."""
    n, n_lines, n_small, n_squeezed, *kinds = np.frombuffer(raw, "<u4", 9).tolist()
    small = pa.decompress(raw.slice(36, n_squeezed), n_small, codec="zstd")
    at, columns = 0, []
    for kind, many in zip(kinds, (n, n_lines, n_lines, n_lines, n_lines)):
        columns.append(np.frombuffer(small, _KINDS[kind], many, at).astype(np.int64))
        at += columns[-1].size * np.dtype(_KINDS[kind]).itemsize
    place, many, steps, line, size = columns
    at = 36 + n_squeezed
    key = np.frombuffer(raw, "<u4", n, at)
    even, odd = np.zeros(n_lines, np.uint64), np.zeros(n_lines, np.uint64)
    at += 4 * n
    for into, some, kind in ((even, size <= NARROW, "<u4"), (even, size > NARROW, "<u8"), (odd, size > MIDDLE, "<u8")):
        into[some] = np.frombuffer(raw, kind, int(some.sum()), at)
        at += int(some.sum()) * np.dtype(kind).itemsize
    return [key, place, many, np.cumsum(steps.view(np.uint64), dtype=np.uint64).view(np.int64), line, size, even, odd]


def _entries(raw: pa.Buffer) -> list[np.ndarray]:
    """Key, doc_id, line, size, place, even and odd of each entry."""
    key, place, many, *lines = _by_line(raw)
    doc, line, size, even, odd = (np.repeat(x, many) for x in lines)
    return [key, doc, line, size, place, even, odd]


def indexed(docs: DataFrame, table: bytes, heavy: dict[bytes, tuple[int, int]], s: Settings) -> DataFrame:
    """The entries of `packed_index` as rows: key, doc_id, line, size, even, odd."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("size", pa.int32()), ("even", pa.int64()), ("odd", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                key, doc, line, size, _, even, odd = _entries(raw.as_buffer())
                columns = ((part << 32) + key.astype(np.int64), doc, line, size, even.view(np.int64), odd.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    return packed_index(docs, table, heavy, s).mapInArrow(run, "key long, doc_id long, line int, size int, even long, odd long")


def _folded(even: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Parity bitmaps folded to 32 bits; narrower ones fold to what they are."""
    both = even ^ odd
    return (both ^ (both >> np.uint64(32))) & np.uint64(0xFFFFFFFF)


def _most_apart(size, size2, percent: int):
    """In how many members two sets of these sizes that match differ at most; less than none where their sizes rule it out."""
    both = size + size2
    return np.where(100 * np.minimum(size, size2) >= percent * np.maximum(size, size2), both - 2 * -(-percent * both // (100 + percent)), -1)


def _apart(size, even, odd, size2, even2, odd2):
    """In how many cells the parity bitmaps of sets differ, at the width of the narrower one."""
    even, odd = even ^ even2, odd ^ odd2
    wide = np.bitwise_count(even).astype(np.int64) + np.bitwise_count(odd)
    least = np.minimum(size, size2)
    return np.where(least > MIDDLE, wide, np.where(least > NARROW, np.bitwise_count(even ^ odd), np.bitwise_count(_folded(even, odd))))


def candidates(index: DataFrame, s: Settings) -> DataFrame:
    """For each line, key by key, the earliest other one that may match it: doc_id, line, doc_id2, line2, and whether there are more.

    Where there are more for any line of a key, all its lines that may match another follow, with key, doc_id, line, size, even and odd: who looks
    for a line's other matches needs no more of the index. A part of the index is sorted in one task, and the lines of a key are compared with those of like size only.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("doc_id2", pa.int64()), ("line2", pa.int32()), ("more", pa.bool_()),
                        ("key", pa.int64()), ("size", pa.int32()), ("even", pa.int64()), ("odd", pa.int64())])

    def near(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lossless bounds: the narrowest parity against what a set of either size allows for all; length, place and the wider parities for what is left."""
        size, place, even, odd, folded, cap = rows
        good = np.bitwise_count(folded[a] ^ folded[b]) <= np.minimum(cap[a], cap[b])
        some = np.nonzero(good)
        a, b = (x[some] for x in np.broadcast_arrays(a, b))
        size, size2, place, place2 = size[a], size[b], place[a], place[b]
        most = _most_apart(size, size2, s.percent)
        met = np.minimum(place, place2) + 1 + np.minimum(size - place - 1, size2 - place2 - 1)
        good[some] = (2 * met >= size + size2 - most) & (most >= _apart(size, even[a], odd[a], size2, even[b], odd[b]))
        return good

    def met_by(rows: list[np.ndarray], low: np.ndarray, when: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows that go by key and size the earliest match, the number of earlier ones, and whether a later row matches it.

        A row is compared with those before it down to `low`, the first one of its key that is not too small for it."""
        earliest, total, met = np.full(len(when), len(when) + 1), np.zeros(len(when), np.int64), np.zeros(len(when), bool)

        def told(a: np.ndarray, b: np.ndarray) -> None:
            # Repeated rows of a doc_id are one document: a line is not its own match.
            late, soon = (np.concatenate(x) for x in zip(*((y[when[y] > when[z]], z[when[y] > when[z]]) for y, z in ((a, b), (b, a)))))
            np.minimum.at(earliest, late, when[soon])
            np.add.at(total, late, 1)
            met[soon] = True

        reach = np.arange(len(low)) - low
        live = np.flatnonzero(reach)
        for back in range(1, SHORT + 1):
            live = live[reach[live] >= back]
            if not len(live):
                break
            hit = live[near(rows, live, live - back)]
            told(hit, hit - back)
        live = live[reach[live] > SHORT]
        at = 0
        while at < len(live):
            own = live[at:at + 256]
            # Of one key: its first rows reach back to one place, and a place of a later key comes behind all of this one.
            own = own[low[own] < own[0]]
            at += len(own)
            for c in range(int(low[own].min()), int(own[-1]) - SHORT, 1024):
                others = np.arange(c, min(int(own[-1]) - SHORT, c + 1024))
                good = near(rows, own[:, None], others[None, :]) & (others[None, :] >= low[own][:, None]) & (others[None, :] < own[:, None] - SHORT)
                x, y = np.nonzero(good)
                told(own[x], others[y])
        return earliest, total, met

    def settled(part: int, held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, place, many, doc, line, size, even, odd = [np.concatenate(x) for x in zip(*held)]
        times = np.lexsort((line, doc))
        new = np.concatenate([[True], (doc[times][1:] != doc[times][:-1]) | (line[times][1:] != line[times][:-1])])
        when = np.empty(len(times), np.int64)
        when[times] = np.cumsum(new) - 1
        times = times[new]
        order = np.lexsort((when, size))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        own = np.repeat(rank, many)
        if len(order) <= 1 << 20 and int(place.max()) < 1 << 12:
            # The line's rank and the place fit beside the key: one sort of plain numbers.
            all_ = np.sort((key.astype(np.uint64) << np.uint64(32)) | (own.astype(np.uint64) << np.uint64(12)) | place.astype(np.uint64))
            key, own, place = all_ >> np.uint64(32), ((all_ >> np.uint64(12)) & np.uint64((1 << 20) - 1)).astype(np.int64), (all_ & np.uint64((1 << 12) - 1)).astype(np.int64)
        else:
            spot = np.lexsort((own, key))
            key, own, place = key[spot], own[spot], place[spot]
        again = key[1:] == key[:-1]
        some = np.concatenate([again, [False]]) | np.concatenate([[False], again])
        key, place, own = key[some], place[some], order[own[some]]
        if not len(key):
            return
        size, even, odd, at = size[own], even[own], odd[own], when[own]
        # Sets that match differ in no more members than this share of either.
        rows = [size, place, even, odd, _folded(even, odd).astype(np.uint32), np.minimum((100 - s.percent) * size // s.percent, 255).astype(np.uint8)]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(cuts, len(key)))
        span = np.repeat(np.arange(len(cuts)), n) * (int(size.max()) + 1)
        earliest, total, met = met_by(rows, np.searchsorted(span + size, span + _needed(size, s.percent)), at)
        hit = np.flatnonzero(total)
        told = [doc[own[hit]], line[own[hit]], doc[times[earliest[hit]]], line[times[earliest[hit]]], total[hit] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(told, schema)] + [pa.nulls(len(hit), f.type) for f in list(schema)[5:]], schema=schema)
        every = np.flatnonzero(np.repeat(np.logical_or.reduceat(total > 1, cuts), n) & ((total > 0) | met))
        shown = [(part << 32) + key[every].astype(np.int64), size[every], even[every].view(np.int64), odd[every].view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[own[every]]), pa.array(line[own[every]], pa.int32())] + [pa.nulls(len(every), f.type) for f in list(schema)[2:5]]
                                         + [pa.array(x, f.type) for x, f in zip(shown, list(schema)[5:])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now:
                    if held:
                        yield from settled(now, held)
                    now, held = part, []
                held.append(_by_line(raw.as_buffer()))
        if held:
            yield from settled(now, held)

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = index.select("part", "entries").repartition(n, "part").sortWithinPartitions("part")
    return ordered.mapInArrow(run, "doc_id long, line int, doc_id2 long, line2 int, more boolean, key long, size int, even long, odd long")


def matched_few(firsts: DataFrame, s: Settings) -> DataFrame:
    """doc_id and line of those of `firsts` (doc_id, line and words of the first line of each set) that an earlier one of another
    set matches, in pairs of which one has less than `JOINED` words.

    Similar lines share a set of words that is large enough for either. The sets that a line of
    `most_few` words or less can share are its keys, a bounded number; whether two lines of a key match follows from
    their sizes and the key's, so the earliest line of each size is all that a key has to tell.
    """
    schema = pa.schema([("key", pa.binary()), ("shared", pa.int32()), ("size", pa.int32()), ("doc_id", pa.int64()), ("line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, line, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = [raw[a:a + 8] for a in range(0, len(raw), 8)]
                for k in range(int(_needed(np.array(len(words)), s.percent)), min(len(words), JOINED - 1) + 1):
                    rows += [(xxhash.xxh3_128_digest(b"".join(c)), k, len(words), doc, line) for c in combinations(words, k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 5, schema)], schema=schema)

    shown = firsts.filter("words IS NOT NULL").select("doc_id", "line", "words")
    keyed = materialized(shown.mapInArrow(run, "key binary, shared int, size int, doc_id long, line int"), "line-shared")
    earliest = keyed.groupBy(F.col("key").alias("_key"), "size").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"))
    earliest = earliest.groupBy("_key").agg(F.collect_list(F.struct("size", "first")).alias("others"), F.sum("n").alias("n")).filter("n > 1").select("_key", "others")
    own = F.struct("doc_id", "line")
    fits = lambda x: (100 * F.col("shared") >= s.percent * (F.col("size") + x["size"] - F.col("shared"))) & (x["first"] < own)
    return keyed.join(earliest, F.col("key") == F.col("_key")).filter(F.exists("others", fits)).select("doc_id", "line").distinct()


def _sketched(lines: Lines) -> list[bytes]:
    """The odd sketch of each line's set: the parity of its members in each of about four cells a member. Cells go by the low bits, so that a sketch folds to half its width."""
    bits = np.minimum(WIDEST, np.maximum(64, 1 << np.ceil(np.log2(4 * lines.size)).astype(np.int64)))
    begin = np.cumsum(bits) - bits
    at = begin[lines.owner] + (lines.token.astype(np.int64) & (bits[lines.owner] - 1))
    raw = np.packbits(np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1).tobytes()
    return [raw[a:a + n] for a, n in zip((begin >> 3).tolist(), (bits >> 3).tolist())]


def _sketches_apart(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many cells the sketches of each row of x and y differ, at the width of the narrower one."""
    (data, bounds), (data2, bounds2) = kernel.flat(x), kernel.flat(y)
    data, data2 = (np.frombuffer(d.tobytes(), np.uint64) for d in (data, data2))
    n, n2, first, first2 = np.diff(bounds) >> 3, np.diff(bounds2) >> 3, bounds[:-1] >> 3, bounds2[:-1] >> 3
    out = np.zeros(len(n), np.int64)
    for w, w2 in np.unique(np.stack([n, n2], axis=1), axis=0).tolist() if len(n) else ():
        rows = np.flatnonzero((n == w) & (n2 == w2))
        own, other = data[first[rows][:, None] + np.arange(w)], data2[first2[rows][:, None] + np.arange(w2)]
        out[rows] = np.bitwise_count(settle.folded_to(own, min(w, w2)) ^ settle.folded_to(other, min(w, w2))).sum(axis=1, dtype=np.int64)
    return out


def lines_at(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """doc_id, line, content, size (of its set) and sketch of the lines `ends` (doc_id, line), and of some others; written.

    Bitmaps of the documents and lines asked for pick them out where the texts are read, so that no text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast((settle.id_bits(ends.select("doc_id")), settle.id_bits(ends.select(_who().alias("who")))))
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("content", pa.binary()), ("size", pa.int32()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_docs, of_lines = shared.value
        for batch in batches:
            for part in kernel.slices(settle.asked(batch, of_docs), "text", SLICE):
                data, bounds = kernel.flat(part.column("text"))
                breaks = np.flatnonzero(data == 10)
                # Each row has one line more than breaks; the last one ends where the row does.
                before = np.searchsorted(breaks, bounds)
                n = np.diff(before) + 1
                row = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                edges = np.concatenate([[-1], breaks])
                start = np.where(number == 0, bounds[row], edges[before[row] + number] + 1)
                end = np.where(number == n[row] - 1, bounds[row + 1], np.append(breaks, 0)[np.minimum(before[row] + number, len(breaks))])
                doc = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
                some = np.flatnonzero(settle.among(doc ^ (number * SPREAD), of_lines))
                raw = data.tobytes()
                contents = pa.array([raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist())], pa.binary())
                # Lines without a word take no part.
                lines = lines_of(contents, 1)
                some = some[lines.row]
                columns = (doc[some], number[some], contents.take(pa.array(lines.row)), lines.size, _sketched(lines))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    texts = _columns(docs)
    found = texts.mapInArrow(run, "doc_id long, line int, content binary, size int, sketch binary")
    repeated = not texts.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return materialized(found.dropDuplicates(["doc_id", "line"]) if repeated else found, "line-contents")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("doc_id", "line").unionByName(pairs.select(F.col("doc_id2").alias("doc_id"), F.col("line2").alias("line")))


def _beside(pairs: DataFrame, lines: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (doc_id, line, doc_id2, line2) with the columns of both lines."""
    named = lambda c: lines.select(F.col("doc_id").alias("_d" + c), F.col("line").alias("_l" + c), *[F.col(x).alias(x + c) for x in columns])
    joined = pairs.join(named("1"), (F.col("doc_id") == F.col("_d1")) & (F.col("line") == F.col("_l1"))).join(named("2"), (F.col("doc_id2") == F.col("_d2")) & (F.col("line2") == F.col("_l2")))
    return joined.select("doc_id", "line", "doc_id2", "line2", *[x + "1" for x in columns], *[x + "2" for x in columns])


_PAIR = "doc_id long, line int, doc_id2 long, line2 int"


def screened(pairs: DataFrame, lines: DataFrame, s: Settings) -> DataFrame:
    """Those of `pairs` (doc_id, line, doc_id2, line2) that the sketches of `lines_at` can't exclude; their bound is lossless."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, size2 = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (4, 6))
            good = _most_apart(size, size2, s.percent) >= _sketches_apart(batch.column(5), batch.column(7))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))

    return _beside(pairs, lines, ["size", "sketch"]).mapInArrow(near, _PAIR)


def verified(pairs: DataFrame, lines: DataFrame, s: Settings) -> DataFrame:
    """Those of `pairs`, a written table, whose full sets reach the threshold; `lines` is one of `lines_at`."""
    shared = lines.sparkSession.sparkContext.broadcast(settle.id_bits(_ends(pairs).select(_who().alias("who"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = batch.column(0).to_numpy(zero_copy_only=False) ^ (batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) * SPREAD)
            yield batch.filter(pa.array(settle.among(who, shared.value), pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(settle.sets_of(batch.column(4), 1), settle.sets_of(batch.column(5), 1)):
                both = kernel.common(x, y)
                good.append(100 * both >= s.percent * (len(x) + len(y) - both))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))

    picked = lines.select("doc_id", "line", "content").mapInArrow(pick, "doc_id long, line int, content binary")
    return _beside(pairs, picked, ["content"]).mapInArrow(compare, _PAIR)


def confirmed(docs: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """Pairs (doc_id, line, doc_id2, line2) whose full sets reach the threshold; `pairs` is a written table. Contents move only for pairs that sketches can't exclude."""
    lines = lines_at(docs, _ends(pairs))
    return verified(materialized(screened(pairs, lines, s), "line-near"), lines, s)


def matched_in_place(docs: DataFrame, index: DataFrame, left: DataFrame, s: Settings) -> DataFrame:
    """doc_id and line of those of `left` (doc_id, line) that any earlier line matches, by all keys of the index.

    A semi-join keeps the index rows that may match some line of `left` at their key, so rows
    in are rows out at most. Then the lines meet key by key: those of `left` are held, the others
    stream by. A key with many others is dealt out in parts of about `BLOCK`, each of which sees all
    its lines of `left`. First only sketches meet, and the likeliest pair of each line at each key is verified.
    Lines that none of these confirms, but that have further pairs, meet by their full sets; only verdicts leave the task then.
    """
    probes = materialized(index.join(left, ["doc_id", "line"], "left_semi"), "line-probes")
    asked = probes.select(*[F.col(c).alias("p_" + c) for c in ("key", "doc_id", "line", "size", "even", "odd")])
    least = F.ceil(s.percent * (F.col("size") + F.col("p_size")) / (100 + s.percent))
    earlier = (F.col("doc_id") < F.col("p_doc_id")) | ((F.col("doc_id") == F.col("p_doc_id")) & (F.col("line") < F.col("p_line")))
    even, odd = F.col("even").bitwiseXOR(F.col("p_even")), F.col("odd").bitwiseXOR(F.col("p_odd"))
    both, least_size = even.bitwiseXOR(odd), F.least("size", "p_size")
    narrow = both.bitwiseXOR(F.shiftrightunsigned(both, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    apart = F.when(least_size > MIDDLE, F.bit_count(even) + F.bit_count(odd)).when(least_size > NARROW, F.bit_count(both)).otherwise(F.bit_count(narrow))
    near = (100 * F.least("size", "p_size") >= s.percent * F.greatest("size", "p_size")) & (F.col("size") + F.col("p_size") - 2 * least >= apart)
    keys = docs.sparkSession.sparkContext.broadcast(settle.id_bits(probes.select("key")))

    def at_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(settle.among(batch.column(0).to_numpy(zero_copy_only=False), keys.value), pa.bool_()))

    # Most index rows have a key that no line of `left` has: a bitmap leaves them out before the join moves the others.
    beside = index.select("key", "doc_id", "line", "size", "even", "odd").mapInArrow(at_keys, "key long, doc_id long, line int, size int, even long, odd long")
    others = materialized(beside.join(asked, (F.col("key") == F.col("p_key")) & earlier & near, "left_semi"), "line-others")
    parts = materialized(others.groupBy(F.col("key").alias("_key")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "line-parts")
    named = ["key", "part", "doc_id", "line", "size", "even", "odd", "mine"]
    dealt = lambda rows, part, mine: rows.join(parts, F.col("key") == F.col("_key")).withColumn("part", part).withColumn("mine", F.lit(mine)).select(*named)
    lines = lines_at(docs, left.select("doc_id", "line").unionByName(others.select("doc_id", "line")))
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meeting(probes: DataFrame, others: DataFrame, column: str) -> DataFrame:
        """Key by key, first the lines of `left`, then the others, with a column of their contents. Where sketches meet, no parity bitmaps move."""
        if column == "sketch":
            probes, others = (x.withColumns({"even": F.lit(0).cast("long"), "odd": F.lit(0).cast("long")}) for x in (probes, others))
        rows = dealt(probes, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), True).unionByName(
            dealt(others, F.pmod(F.xxhash64("doc_id", "line"), F.col("parts")).cast("int"), False))
        beside = lines.select(F.col("doc_id").alias("_doc"), F.col("line").alias("_line"), column)
        if column == "content":
            wanted = probes.select("doc_id", "line").unionByName(others.select("doc_id", "line")).distinct().select(F.col("doc_id").alias("_d"), F.col("line").alias("_l"))
            beside = beside.join(wanted, (F.col("_doc") == F.col("_d")) & (F.col("_line") == F.col("_l")), "left_semi")
        rows = rows.join(beside, (F.col("doc_id") == F.col("_doc")) & (F.col("line") == F.col("_line"))).select(*named, column)
        return rows.repartition(n, "key", "part").sortWithinPartitions("key", "part", F.desc("mine"))

    found = materialized(meeting(probes, others, "sketch").mapInArrow(lambda batches: _likeliest(batches, s), _PAIR + ", more boolean"), "line-likeliest")
    tried = materialized(found.select("doc_id", "line", "doc_id2", "line2").distinct(), "line-pairs")
    matched = materialized(verified(tried, lines, s).select("doc_id", "line").distinct(), "line-matches")
    rest = found.groupBy("doc_id", "line").agg(F.max("more").alias("more")).filter("more").select("doc_id", "line")
    rest = materialized(rest.join(matched, ["doc_id", "line"], "left_anti"), "line-rest")
    if rest.isEmpty():
        return matched
    probes = materialized(probes.join(rest, ["doc_id", "line"], "left_semi"), "line-probes")
    others = materialized(others.join(probes.select(F.col("key").alias("p_key")).distinct(), F.col("key") == F.col("p_key"), "left_semi"), "line-others")
    by_sets = meeting(probes, others, "content").mapInArrow(lambda batches: _met(batches, s), "doc_id long, line int")
    return matched.unionByName(by_sets).distinct()


def _likeliest(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Of the pairs that each line of `meeting` has at a key and the sketches can't exclude the likeliest one: doc_id, line, doc_id2, line2, and whether there are more.

    Groups of up to `GROUP` rows meet many at a time, larger ones as they stream by."""
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("doc_id2", pa.int64()), ("line2", pa.int32()), ("more", pa.bool_())])
    now, own, sketches, best, count = None, [], None, [], None

    def columns_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        key, part, doc, line, size, _, _, mine = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:8])
        return [key, part, doc, line, size.astype(np.int64), mine]

    def pairs_near(own: list[np.ndarray], others: list[np.ndarray], x: np.ndarray, y: np.ndarray, sketch: pa.Array, sketch2: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of rows x of `own` and y of `others` (doc_id, line, size each) those that may match, the likeliest of each x first, and their share of difference."""
        (doc, line, size), (doc2, line2, size2) = own, others
        some = ((doc2[y] < doc[x]) | ((doc2[y] == doc[x]) & (line2[y] < line[x]))) & (_most_apart(size[x], size2[y], s.percent) >= 0)
        x, y = x[some], y[some]
        far = _sketches_apart(sketch.take(pa.array(x)), sketch2.take(pa.array(y)))
        some = far <= _most_apart(size[x], size2[y], s.percent)
        x, y, share = x[some], y[some], far[some] / (size[x[some]] + size2[y[some]])
        order = np.lexsort((share, x))
        return x[order], y[order], share[order]

    def small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Whole groups."""
        key, part, doc, line, size, mine = columns_of(batch)
        group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        n, n_mine = np.bincount(group), np.bincount(group, mine).astype(np.int64)
        lead = np.cumsum(n) - n
        asking = np.flatnonzero(mine & (n > n_mine)[group])
        others = (n - n_mine)[group[asking]]
        done = np.cumsum(others)
        at = 0
        while at < len(asking):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + (1 << 13))))
            many = others[at:to]
            x = np.repeat(asking[at:to], many)
            # The lines asked about lead their group.
            y = np.repeat((lead + n_mine)[group[asking[at:to]]], many) + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
            at = to
            x, y, _ = pairs_near([doc, line, size], [doc, line, size], x, y, batch.column(8), batch.column(8))
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            columns = (doc[x[first]], line[x[first]], doc[y[first]], line[y[first]], np.diff(np.append(first, len(x))) > 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def done() -> pa.RecordBatch:
        hit = np.flatnonzero(count > 0)
        columns = (own[0][hit], own[1][hit], best[1][hit], best[2][hit], count[hit] > 1)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    def streamed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows of one group, or of a part of it."""
        nonlocal now, own, sketches, best, count
        key, part, doc, line, size, mine = columns_of(batch)
        if (key[0], part[0]) != now:
            yield from closed()
            now, own, sketches = (key[0], part[0]), [x[:0] for x in (doc, line, size)], batch.column(8).slice(0, 0)
            best, count = [np.zeros(0), doc[:0].copy(), line[:0].copy()], np.zeros(0, np.int64)
        m = int(mine.sum())
        if m:
            own, sketches = [np.concatenate(x) for x in zip(own, [doc[:m], line[:m], size[:m]])], pa.concat_arrays([sketches, batch.column(8).slice(0, m)])
            best, count = [np.concatenate([x, np.full(m, y, x.dtype)]) for x, y in zip(best, (np.inf, 0, 0))], np.concatenate([count, np.zeros(m, np.int64)])
        step = max(1, (1 << 16) // max(1, len(count)))
        for c in range(m, len(doc), step):
            others = [x[c:c + step] for x in (doc, line, size)]
            x, y = (z.ravel() for z in np.indices((len(count), len(others[0]))))
            x, y, share = pairs_near(own, others, x, y, sketches, batch.column(8).slice(c, len(others[0])))
            lead = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            better = lead[share[lead] < best[0][x[lead]]]
            best[0][x[better]], best[1][x[better]], best[2][x[better]] = share[better], others[0][y[better]], others[1][y[better]]
            count += np.bincount(x, minlength=len(count))

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal now
        if now is not None and count.any():
            yield done()
        now = None

    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            rest = None
        if not len(batch):
            continue
        key, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        ends = np.append(cuts[1:], len(batch))
        large = ends - cuts > GROUP
        large[0] |= (key[0], part[0]) == now
        last = int(cuts[-1])
        if not large[-1]:
            rest, cuts, ends, large = batch.slice(last), cuts[:-1], ends[:-1], large[:-1]
        at = 0
        for a, b in zip(cuts[large].tolist(), ends[large].tolist()):
            if a > at:
                yield from small(batch.slice(at, a - at))
            yield from streamed(batch.slice(a, b - a))
            at = b
        if rest is not None and last > at:
            yield from small(batch.slice(at, last - at))
    if rest is not None:
        yield from small(rest)
    yield from closed()


def _met(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """doc_id and line of the lines of `meeting` whose full set one of the others matches."""
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32())])

    def met(own: list[np.ndarray], open_: np.ndarray, batch: list[np.ndarray]) -> None:
        doc, line, size, even, odd, members = batch
        for k in np.flatnonzero(open_):
            doc_, line_, size_, even_, odd_, mine = (x[k] for x in own)
            before = (doc < doc_) | ((doc == doc_) & (line < line_))
            some = np.flatnonzero(before & (_most_apart(size_, size, s.percent) >= _apart(size_, even_, odd_, size, even, odd)))
            for at in range(0, len(some), 64):
                sets = [members[i] for i in some[at:at + 64]]
                n = np.array([len(x) for x in sets])
                all_ = np.concatenate(sets)
                spot = np.searchsorted(mine, all_)
                spot[spot == len(mine)] = 0
                both = np.add.reduceat(mine[spot] == all_, np.cumsum(n) - n, dtype=np.int64)
                if (100 * both >= s.percent * (len(mine) + n - both)).any():
                    open_[k] = False
                    break

    now, own, open_ = None, None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array(x[~open_], f.type) for x, f in zip(own, schema)], schema=schema)
    for batch in batches:
        key, part, doc, line, size, even, odd, mine = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:8])
        members = np.empty(len(key), object)
        members[:] = settle.sets_of(batch.column(8), 1)
        columns = [doc, line, size.astype(np.int64), even.view(np.uint64), odd.view(np.uint64), members]
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (mine[1:] != mine[:-1])])) if len(key) else []
        for a, b in zip(cuts, [*cuts[1:], len(key)]):
            here, own_part = (key[a], part[a]), [x[a:b] for x in columns]
            if here != now:
                if now is not None and not open_.all():
                    yield done()
                now, own, open_ = here, [x[:0] for x in columns], np.zeros(0, bool)
            if mine[a]:
                own, open_ = [np.concatenate(x) for x in zip(own, own_part)], np.concatenate([open_, np.ones(b - a, bool)])
            else:
                met(own, open_, own_part)
    if now is not None and not open_.all():
        yield done()


def repeated_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id and line (from 0) of every line that an earlier one matches, for documents (doc_id, text).

    Earlier means by (doc_id, line). Lines match when the Jaccard similarity of their word
    sets reaches `percent`; whether the earlier one is itself removed doesn't matter. Rows
    of one doc_id count as one document; rows with null doc_id or text take no part.

    Round one verifies for each line the earliest candidate of each of its keys; a line
    that one of them confirms is done. Only lines with further candidates and no match so
    far are compared with all their candidates, whose sets they meet key by key. Pairs of
    which one has less than `JOINED` words are settled by `matched_few`.
    """
    s = settings
    scan = materialized(scanned(docs, s), "lines")
    lines = scan.filter("part IS NULL").select("doc_id", "line", "set_key", "words")
    firsts = materialized(lines.groupBy("set_key").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"), F.min("words").alias("words")), "line-classes")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    heavy = {bytes(x["set_key"]): (x["first"]["doc_id"], x["first"]["line"]) for x in firsts.filter((F.col("n") > 1) & (F.col("n") * s.heavy > total)).collect()}
    heads = settle.id_bits(firsts.select(_who("first.doc_id", "first.line").alias("who")))
    n_parts = -(-(scan.filter("part = 0").agg(F.sum("doc_id")).first()[0] or 0) // PART) or 1
    told = materialized(candidates(packed_index(docs, rarity(scan), heavy, s, heads, n_parts), s), "line-candidates")
    found, index = told.filter("key IS NULL").select("doc_id", "line", "doc_id2", "line2", "more"), told.filter("key IS NOT NULL").select("key", "doc_id", "line", "size", "even", "odd")
    tried = materialized(found.groupBy("doc_id", "line", "doc_id2", "line2").agg(F.max("more").alias("more")), "line-pairs")
    matched = materialized(confirmed(docs, tried.drop("more"), s).select("doc_id", "line").distinct(), "line-matches")
    left = tried.groupBy("doc_id", "line").agg(F.max("more").alias("more"), F.count("*").alias("k")).filter("more OR k > 1").select("doc_id", "line")
    left = materialized(left.join(matched, ["doc_id", "line"], "left_anti"), "line-rest")
    if not left.isEmpty():
        matched = matched.unionByName(matched_in_place(docs, index, left, s))
    if s.least < JOINED:
        matched = matched.unionByName(matched_few(firsts.select("first.doc_id", "first.line", "words"), s))
    repeated = firsts.filter("n > 1")
    keys = docs.sparkSession.sparkContext.broadcast(settle.id_bits(repeated.select(F.xxhash64("set_key").alias("key"))))

    def at_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1, 2]).filter(pa.array(settle.among(batch.column(3).to_numpy(zero_copy_only=False), keys.value), pa.bool_()))

    # Most lines have no copy: a bitmap leaves them out before the join moves the others.
    copied = lines.select("doc_id", "line", "set_key", F.xxhash64("set_key").alias("key")).mapInArrow(at_keys, "doc_id long, line int, set_key binary")
    later = copied.join(repeated.select(F.col("set_key").alias("_key"), "first"), F.col("set_key") == F.col("_key")).filter(
        (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.line") != F.col("line"))).select("doc_id", "line")
    return later.unionByName(matched).distinct()


def without_repeated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents with the lines of `repeated_lines` taken out of their text; all columns and rows stay."""
    gone = materialized(repeated_lines(docs, settings).groupBy("doc_id").agg(F.collect_set("line").alias("_gone")).withColumnRenamed("doc_id", "_doc"), "gone")
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone["_doc"], "left")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.expr(r"array_join(filter(split(text, '\n', -1), (x, i) -> NOT array_contains(_gone, i)), '\n')"))
    return joined.withColumn("text", text).select(*docs.columns)
