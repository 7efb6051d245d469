"""Token-id files: canonical length-limited Huffman codes from global counts, decoded by table.

A file is a row of frames: magic, length, range, place, body, line end. The frame with
place 0 holds the code lengths and the checkpoint step, the others are blocks that can
be decoded each on its own. A block lists its documents and, for every `step` ids of a
document, the bit offset where decoding can begin; all these stretches of a block are
decoded side by side. Ranges follow each other in doc_id order, blocks and documents
inside them too.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerline.llm.kernel import slices
from ledgerline.llm.tokens import encoder, tokenizer_path
from ledgerline.session import ensure_checkpoint_dir

#: Fixed values of the format.
MAGIC, FRAME, DOC = b"LTK1", struct.Struct("<4sQIII"), np.dtype([("known", "<u1"), ("doc_id", "<i8"), ("n", "<u4"), ("at", "<u4")])
LONGEST_CODE, STEP, BLOCK_TOKENS, FILE_TOKENS = 18, 256, 1 << 19, 1 << 25

_IDS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_CODED = pa.schema([("range", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("body", pa.binary())])


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Huffman code lengths of at most `longest` bits, by package-merge; 0 for ids that never occur."""
    seen = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(seen) < 2:
        lengths[seen] = 1
        return lengths
    if len(seen) > 1 << longest:
        raise ValueError(f"{len(seen)} ids need codes of more than {longest} bits")
    order = seen[np.argsort(counts[seen], kind="stable")]
    leaves = counts[order].astype(np.float64)
    items, levels = leaves, [np.ones(len(leaves), bool)]
    for _ in range(longest - 1):
        packages = items[:len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        sorted_ = np.argsort(both, kind="stable")
        items = both[sorted_]
        levels.append(sorted_ < len(leaves))
    take, own = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for is_leaf in reversed(levels):
        n = int(np.count_nonzero(is_leaf[:take]))
        own[:n] += 1
        take = 2 * (take - n)
    lengths[order] = own
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by id, and the ids in code order."""
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    wide = lengths[order].astype(np.int64)
    top = int(wide.max()) if len(wide) else 1
    spans = np.left_shift(np.int64(1), top - wide)
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = ((np.cumsum(spans) - spans) >> (top - wide)).astype(np.uint64)
    return codes, order


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each window of bits: id * 32 + code length; and the window's width."""
    _, order = canonical(lengths)
    top = int(lengths.max()) if len(order) else 1
    table = np.repeat((order.astype(np.uint32) << np.uint32(5)) | lengths[order], 1 << (top - lengths[order].astype(np.int64)))
    return np.concatenate([table, np.ones((1 << top) - len(table), np.uint32)]), top


def encoded(docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> list[bytes]:
    """Each document's body: its bit offsets at every `step` ids (32 bits each), then its bits, from a whole byte on."""
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate(docs) if len(docs) else np.zeros(0, np.uint32)
    wide = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(wide)])
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    bits = ends[firsts[1:]] - ends[firsts[:-1]]
    begins = np.concatenate([[0], np.cumsum((bits + 7) >> 3)])
    place = ends[:-1] + np.repeat(begins[:-1] * 8 - ends[firsts[:-1]], sizes)
    words = np.zeros(int(begins[-1] >> 3) + 2, np.uint64)
    if len(ids):
        word, room = place >> 6, 64 - (place & 63) - wide
        code = codes[ids]
        own = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        groups = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        words[word[groups]] = np.add.reduceat(own, groups)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    packed = words.byteswap().tobytes()
    out = []
    for k, (a, n) in enumerate(zip(firsts[:-1].tolist(), sizes.tolist())):
        marks = (place[a:a + n:step] - begins[k] * 8).astype("<u4").tobytes()
        out.append(marks + packed[begins[k]:begins[k + 1]])
    return out


def block(rows: list[tuple[int | None, int, bytes]]) -> bytes:
    """The frame body of documents (doc_id, number of ids, body)."""
    head, at = np.zeros(len(rows), DOC), 0
    for k, (doc, n, body) in enumerate(rows):
        head[k] = (doc is not None, doc or 0, n, at)
        at += len(body)
    return struct.pack("<I", len(rows)) + head.tobytes() + b"".join(x[2] for x in rows)


def frame(range_: int, place: int, body: bytes) -> bytes:
    return FRAME.pack(MAGIC, len(body), range_, place, zlib.crc32(body)) + body


def decoded(body: bytes, table: np.ndarray, top: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's documents (DOC), all its ids and where each document's begin among them."""
    n_docs = struct.unpack_from("<I", body)[0]
    docs = np.frombuffer(body, DOC, n_docs, 4)
    base = 4 + n_docs * DOC.itemsize
    data = np.frombuffer(body + bytes(8), np.uint8)
    counts = docs["n"].astype(np.int64)
    stretches = -(-counts // step)
    owner = np.repeat(np.arange(n_docs), stretches)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    mark_at = base + docs["at"].astype(np.int64)[owner] + 4 * place
    marks = sum(data[mark_at + k].astype(np.int64) << (8 * k) for k in range(4)) if len(owner) else np.zeros(0, np.int64)
    position = (base + docs["at"].astype(np.int64) + 4 * stretches)[owner] * 8 + marks
    firsts = np.concatenate([[0], np.cumsum(counts)])
    target, size = firsts[:-1][owner] + place * step, np.minimum(step, counts[owner] - place * step)
    order = np.argsort(-size, kind="stable")
    position, target, size = position[order], target[order], size[order]
    window = (data[:-3].astype(np.uint32) << np.uint32(24)) | (data[1:-2].astype(np.uint32) << np.uint32(16)) | (data[2:-1].astype(np.uint32) << np.uint32(8)) | data[3:]
    ids, mask = np.zeros(int(firsts[-1]), np.uint32), np.uint32((1 << top) - 1)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))
        p = position[:n]
        entry = table[(window[p >> 3] >> (32 - top - (p & 7)).astype(np.uint32)) & mask]
        ids[target[:n] + k] = entry >> np.uint32(5)
        p += entry & np.uint32(31)
    return docs, ids, firsts


def token_rows(docs: DataFrame, end_id: int, path: str) -> DataFrame:
    """kind 0: doc_id, n_tokens and ids of each document (16 bits each where they fit); kind 1: a task's counts by id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, counts = encoder(path).ids, np.zeros(end_id + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                rows, all_ = [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(np.frombuffer(ids_of(text), "<u4"), np.uint32(end_id))
                    rows.append((0, doc, len(ids), ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else ids.tobytes()))
                    all_.append(ids)
                own = np.bincount(np.concatenate(all_))
                if len(own) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(own) - len(counts), np.int64)])
                counts[:len(own)] += own
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _IDS)], schema=_IDS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pylist([{"kind": 1, "n_tokens": len(seen), "ids": seen.astype("<i8").tobytes() + counts[seen].astype("<i8").tobytes()}], schema=_IDS)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "kind int, doc_id long, n_tokens long, ids binary")


def global_counts(rows: DataFrame) -> np.ndarray:
    """Counts by id over all documents. Bounded by the vocabulary on its way to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                both = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["id", "n"])

    found = rows.filter("kind = 1").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((x["id"] for x in found), default=0) + 1, np.int64)
    for x in found:
        counts[x["id"]] = x["n"]
    return counts


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, longest: int = LONGEST_CODE, step: int = STEP,
                      block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS) -> None:
    """Encode documents (doc_id, text) and write them in doc_id order under a new path.

    Each document gets the tokenizer's ids and `end_id`; null text has no ids of its own.
    Rows without doc_id come first; rows of one doc_id stay together, in the order of
    their bits. Tokens are written once (zstd) so that texts are encoded once. Documents
    are coded before they are shuffled into ranges of about `file_tokens` ids.
    """
    spark = docs.sparkSession
    where = f"{ensure_checkpoint_dir(spark)}/token-rows-{uuid.uuid4().hex}"
    token_rows(docs, end_id, tokenizer or tokenizer_path()).write.option("compression", "zstd").parquet(where)
    rows = spark.read.parquet(where)
    lengths = code_lengths(global_counts(rows), longest)
    codes, _ = canonical(lengths)
    only = rows.filter("kind = 0")
    total = only.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = max(total // file_tokens, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = only.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 100_000)).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids", 2 << 20):
                names, sizes = part.column("doc_id").to_pylist(), part.column("n_tokens").to_pylist()
                ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype(np.uint32) for x, n in zip(part.column("ids").to_pylist(), sizes)]
                range_ = [0 if d is None else int(np.searchsorted(bounds, d, side="left")) for d in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((range_, names, sizes, encoded(ids, lengths, codes, step)), _CODED)], schema=_CODED)

    table = struct.pack("<I", step) + zlib.compress(lengths.tobytes(), 9)

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.schema([("range", pa.int32()), ("value", pa.binary())])
        at, place, held, n = None, 0, [], 0

        def flush():
            nonlocal place, held, n
            place, body = place + 1, block(held)
            held, n = [], 0
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([frame(at, place, body)])], schema=made)

        for batch in batches:
            for range_, doc, size, body in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if range_ != at:
                    if held:
                        yield flush()
                    at, place = range_, 0
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([frame(at, 0, table)])], schema=made)
                held.append((doc, size, body))
                n += size
                if n >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    coded = only.select("doc_id", "n_tokens", "ids").mapInArrow(code, "range int, doc_id long, n_tokens long, body binary")
    dealt = coded.repartition(min(ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))), "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "body")
    dealt.mapInArrow(framed, "range int, value binary").select("range", F.col("value").cast("string").alias("value")).write.partitionBy("range").option("lineSep", "\n").text(path)


def frames(content: bytes) -> list[tuple[int, int, bytes]]:
    """(range, place, body) of a file's frames, in order; a damaged file raises ValueError."""
    out, at = [], 0
    while at < len(content):
        if content[at:at + 4] != MAGIC or at + FRAME.size > len(content):
            raise ValueError(f"no frame begins at byte {at}")
        _, size, range_, place, crc = FRAME.unpack_from(content, at)
        body = content[at + FRAME.size:at + FRAME.size + size]
        if len(body) != size or zlib.crc32(body) != crc:
            raise ValueError(f"the frame at byte {at} is damaged")
        out.append((range_, place, body))
        at += FRAME.size + size + 1
    return sorted(out, key=lambda x: x[:2])


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (32 bits each)."""
    schema = pa.schema([("range", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                start = 0
                for range_, place, body in frames(bytes(content.as_buffer())):
                    if place == 0:
                        step = struct.unpack_from("<I", body)[0]
                        table, top = decoding_table(np.frombuffer(zlib.decompress(body[4:]), np.uint8))
                        start = 0
                        continue
                    docs, ids, firsts = decoded(body, table, top, step)
                    raw = ids.astype("<u4").tobytes()
                    rows = []
                    for k, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
                        own = raw[4 * a:4 * b]
                        rows.append((range_, start + a, int(docs["doc_id"][k]) if docs["known"][k] else None, b - a, zlib.crc32(own)) + ((own,) if with_ids else ()))
                    start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kinds = "range int, place long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    where = f"{ensure_checkpoint_dir(spark)}/token-read-{uuid.uuid4().hex}"
    files.mapInArrow(read, kinds).write.parquet(where)
    rows = spark.read.schema(kinds).parquet(where)
    sums = rows.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = sums.select(F.col("range").alias("_range"), F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, F.col("range") == F.col("_range")).select(
        "doc_id", (F.col("_before") + F.col("place")).cast("long").alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
