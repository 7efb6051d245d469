"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties; a temperature
fitted on rows kept apart calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm import kernel
from ledgerline.session import materialized

DIMENSIONS, ORDERS, PARTS = 1 << 16, 3, 64
UNKNOWN = "und"


class Settings(NamedTuple):
    """`most_rows` bounds the rows that the weights are fitted on, in expectation: each language has the same share of them, and one with fewer rows all
    of its own. Languages and document counts are those of all rows."""

    most_rows: int = 4000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    kept_apart: int = 5


class Model(NamedTuple):
    names: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float


_PLACES = kernel._PLACES[:ORDERS]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of 1 to 3 signs of a text and 1 + log of how often each occurs; all but letters reads as a blank."""
    signs = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    plain = (signs >= 97) & (signs <= 122) | (signs >= 0xC0) & (signs != 0xD7) & (signs != 0xF7)
    signs = np.where(plain, signs, 32).astype(np.uint64)
    blank = signs == 32
    signs = np.concatenate([[np.uint64(32)], signs[~(blank & np.concatenate([[True], blank[:-1]]))], [np.uint64(32)]])
    out = []
    with np.errstate(over="ignore"):
        for n in range(1, ORDERS + 1):
            if len(signs) >= n:
                total = np.full(len(signs) - n + 1, n, np.uint64)
                for k in range(n):
                    total += (signs[k:len(signs) - n + 1 + k] + np.uint64(1)) * _PLACES[k]
                out.append((total * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))
    cells, n = np.unique(np.concatenate(out), return_counts=True)
    return cells.astype(np.int64), (1 + np.log(n)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def scaled(cells: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf[cells]
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, s: Settings) -> np.ndarray:
    """Weights (cells by classes); most stay exactly zero."""
    z, n = np.zeros((DIMENSIONS, classes)), np.zeros((DIMENSIONS, classes))

    def leader(z, n):
        return np.where(np.abs(z) > s.l1, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2), 0.0)

    for epoch in range(s.epochs):
        for k in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows)):
            label, cells, x = rows[k]
            zc, nc = z[cells], n[cells]
            w = leader(zc, nc)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            z[cells] = zc + g - (np.sqrt(nc + g * g) - np.sqrt(nc)) / s.alpha * w
            n[cells] = nc + g * g
    return leader(z, n)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, from a grid."""
    if not len(labels):
        return 1.0
    def loss(t):
        x = scores / t
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]).mean())
    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def trained(docs: DataFrame, s: Settings = Settings()) -> Model:
    """A model of rows (doc_id, text, lang) with text and lang. Document counts of n-grams are taken over all of them."""
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = {x["lang"]: x["count"] for x in rows.groupBy("lang").count().collect()}
    total = sum(counts.values())
    if not total:
        return Model([], np.zeros((DIMENSIONS, 0)), np.zeros(DIMENSIONS, np.float32), 1.0)
    # Drawn by a hash of the row, so that every run and every number of tasks draws the same rows.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, s.most_rows / len(counts) / n) * (1 << 30)))])
    chosen = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 30)) < F.element_at(share, F.col("lang"))
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("doc_id", pa.string()), ("cells", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                out = []
                for doc, text, lang, taken in zip(*(part.column(k).to_pylist() for k in range(4))):
                    cells, counts = grams(text)
                    seen[cells] += 1
                    n += 1
                    if taken:
                        out.append((None, lang, doc, cells.astype("<u2").tobytes(), counts.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        for k in range(PARTS):
            yield pa.RecordBatch.from_pylist([{"part": k, "counts": seen[k * DIMENSIONS // PARTS:(k + 1) * DIMENSIONS // PARTS].astype("<i8").tobytes()}], schema=schema)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(raw, "<i8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()])], names=["part", "counts"])

    read = materialized(rows.withColumn("taken", chosen).mapInArrow(run, "part int, lang string, doc_id string, cells binary, counts binary"), "language-rows")
    parts = read.filter("part IS NOT NULL").select("part", "counts").repartition(PARTS, "part").mapInArrow(summed, "part int, counts binary").collect()
    frequency = np.concatenate([np.frombuffer(bytes(x["counts"]), "<i8") for x in sorted(parts, key=lambda x: x["part"])])
    idf = np.log((1 + total) / (1 + frequency)).astype(np.float32) + 1
    sample = sorted(read.filter("part IS NULL").select("doc_id", "lang", "cells", "counts").dropDuplicates(["doc_id", "lang", "cells"]).collect(), key=lambda x: (x["doc_id"] or "", bytes(x["cells"])))
    names = sorted(counts)
    place = {n: k for k, n in enumerate(names)}
    examples = []
    for x in sample:
        cells = np.frombuffer(bytes(x["cells"]), "<u2").astype(np.int64)
        examples.append((place[x["lang"]], cells, scaled(cells, np.frombuffer(bytes(x["counts"]), np.float32), idf).astype(float)))
    apart = examples[::s.kept_apart] if len(examples) > 5 * s.kept_apart else []
    weights = fit_ftrl([e for k, e in enumerate(examples) if not apart or k % s.kept_apart], len(names), s)
    scores = np.array([x @ weights[cells] for _, cells, x in apart]) if apart else np.zeros((0, len(names)))
    return Model(names, weights.astype(np.float32), idf, fit_temperature(scores, np.array([label for label, _, _ in apart], np.int64)))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (probability) for every row (doc_id, text). Null texts and texts without a letter are
    'und' with score 0, as is everything for a model without classes. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in kernel.slices(batch, "text"):
                out = []
                for text in part.column("text").to_pylist():
                    if not m.names or not has_letter(text):
                        out.append((UNKNOWN, 0.0))
                        continue
                    cells, counts = grams(text)
                    p = softmax((scaled(cells, counts, m.idf) @ m.weights[cells]).astype(float) / m.temperature)
                    k = int(p.argmax())
                    out.append((m.names[k], float(p[k])))
                names, scores = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names), pa.array(scores)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
