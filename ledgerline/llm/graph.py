"""Connected components of edges: contraction inside tasks, then alternating star rounds, each a few joins over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.session import materialized

#: Edges that one task contracts.
EDGES = 200_000


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none itself."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("top")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("top").alias("top")).filter("up > 1 OR up = 1 AND top = 1").isEmpty()


def _roots(a: list[int], b: list[int]) -> dict[int, int]:
    """Each node's smallest reachable one, by these edges alone."""
    up: dict[int, int] = {}

    def top(n: int) -> int:
        while (m := up.setdefault(n, n)) != n:
            up[n] = up[m]
            n = up[n]
        return n

    for x, y in zip(a, b):
        x, y = top(x), top(y)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in up}


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges dealt over so many tasks; each hangs the nodes it sees on the smallest one they are connected to by its edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(x.column(0).to_pylist(), x.column(1).to_pylist()) for x in batches]
        roots = _roots([n for a, _ in ends for n in a], [n for _, b in ends for n in b])
        hung = np.array([(n, r) for n, r in roots.items() if n != r], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(hung[:, 0]), pa.array(hung[:, 1])], names=["a", "b"])

    return edges.select("a", "b").repartition(parts).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60, per_task: int = EDGES) -> DataFrame:
    """node, component (the smallest node reachable) for edges (a, b) of long nodes; nodes without an edge are absent.

    First each task contracts about `per_task` edges, which leaves at most one edge a node and task, and short chains.
    Every round hangs the larger neighbours of a node, then the smaller ones, on the
    smallest of its neighbourhood; it ends when all nodes hang on the smallest of their component, after about as
    many rounds as the logarithm of the longest chain.
    """
    now = materialized(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    parts = -(-now.count() // per_task)
    if parts:
        now = materialized(contracted(now, parts).distinct(), "edges")
    for _ in range(most_rounds):
        # What one task has contracted is settled.
        if parts <= 1 or _is_settled(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialized(large.filter("a <> b").distinct(), "large")
        small = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        hung = large.join(small, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = materialized(hung.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("the components didn't settle")
    return materialized(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
