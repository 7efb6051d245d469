"""Packing of documents into sequences: vector best-fit over tokens, documents and attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.kernel import slices
from ledgerline.llm.tokens import encoder, tokenizer_path
from ledgerline.session import materialized

PIECES_PER_GROUP = 4000


class Limits(NamedTuple):
    """What a sequence may hold, and how far each capacity counts when a bin is chosen.

    `tokens` bounds the sum of lengths, `documents` the number of pieces and `attention`
    the sum of squared lengths. The defaults of the last two never bind before `tokens`.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


def pieces(docs: DataFrame, limit: int = 4096, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Token pieces of documents (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document's ids are the tokenizer's with `end_id` behind them; null text is empty.
    Only longer ones are cut, and only the last piece is shorter than the limit.
    """
    path = tokenizer or tokenizer_path()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(path).ids, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = ids_of(text) + end
                    for k, at in enumerate(range(0, len(ids), 4 * limit)):
                        own = ids[at:at + 4 * limit]
                        rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)) + ((own,) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, kinds)


def best_fit(lengths: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every piece, for pieces sorted by falling length.

    Each piece goes to the open bin that can take it under all three capacities and has
    the smallest weighted norm of what would be left ('norm') or the largest weighted
    dot product of need and residual ('dot'); ties go to the oldest bin.
    """
    caps = np.array([limits.tokens, limits.documents, limits.attention], float)
    weights = np.array(limits.weights, float)
    left, names, used = np.zeros((64, 3)), np.zeros(64, np.int64), 0
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    least = lengths.min() if len(lengths) else 0
    for k, length in enumerate(lengths.tolist()):
        need = np.array([length, 1.0, float(length) * length])
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        open_ = left[:used]
        fits = (open_[:, 0] >= need[0]) & (open_[:, 1] >= need[1]) & (open_[:, 2] >= need[2])
        at = np.flatnonzero(fits)
        if len(at):
            if limits.rule == "dot":
                score = -(open_[at] * (need / caps / caps * weights)).sum(axis=1)
            else:
                score = ((((open_[at] - need) / caps) ** 2) * weights).sum(axis=1)
            best = at[np.argmin(score)]
        else:
            if used == len(left):
                left, names = np.concatenate([left, np.zeros_like(left)]), np.concatenate([names, np.zeros_like(names)])
            left[used], names[used] = caps, made
            best, used, made = used, used + 1, made + 1
        bins[k], offsets[k] = names[best], limits.tokens - left[best, 0]
        left[best] -= need
        if left[best, 0] < least or left[best, 1] < 1 or left[best, 2] < least * least:
            left[best:used - 1], names[best:used - 1] = left[best + 1:used].copy(), names[best + 1:used].copy()
            used -= 1
    return bins, offsets


def pack(rows: DataFrame, limits: Limits = Limits(), per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Place pieces (any columns with doc_id, piece and length) into sequences: adds sequence_id and offset.

    Pieces are dealt by hash into groups of about `per_group`, which are packed side by
    side. Sequences that a group leaves less than 95 % full are opened again and their
    pieces packed once more in fewer groups, so that groups cost next to nothing.
    `rows` is read twice, so it should be a written table.
    """
    columns, fields = rows.columns, [f"{n} {t}" for n, t in rows.dtypes]
    schema = ", ".join([*fields, "sequence_id long", "offset long", "done boolean"])

    def dealt(frame: DataFrame, n: int, salt: int) -> DataFrame:
        return frame.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), F.lit(max(1, -(-n // per_group)))))

    def packer(last: bool):
        def packed(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True])
            bins, offsets = best_fit(group["length"].to_numpy(np.int64), limits)
            full = np.bincount(bins, weights=group["length"].to_numpy(float)) >= 0.95 * limits.tokens if len(bins) else np.zeros(0, bool)
            first = int(group["_group"].iloc[0]) * 2 + last
            return group[columns].assign(sequence_id=(first << 32) + bins, offset=offsets, done=full[bins] | last)
        return packed

    placed = materialized(dealt(rows, rows.count(), 1).groupBy("_group").applyInPandas(packer(False), schema), "packing-first")
    rest = placed.filter("not done").select(*columns)
    again = dealt(rest, rest.count(), 2).groupBy("_group").applyInPandas(packer(True), schema)
    return placed.filter("done").unionByName(again).drop("done")


def sequences(placed: DataFrame) -> DataFrame:
    """Whole sequences from placed pieces that carry `ids`: sequence_id, ids (joined bytes), doc_ids and lengths."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    return parts.select("sequence_id", F.expr("aggregate(p, cast('' AS binary), (b, x) -> concat(b, x.ids))").alias("ids"),
                        F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
