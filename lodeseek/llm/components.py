"""Distributed connected components (union-find by contraction) in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


#: So many edges are finished by one task (union-find on 16 bytes an edge).
LAST = 200_000


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "up"])


def connected_components(edges: DataFrame, native: bool = False) -> DataFrame:
    """edges (a, b: long) -> (node, root) for every node of an edge; equal roots: one component. `native` takes nodes of any type.

    Each round, every node points at the neighbour (or itself) of least hashed rank, pointers jump once, and the
    edges are rewritten to what their ends point at; loops and repeats go. The ranks are hashed anew each round, so
    chains are short and the graph shrinks geometrically. A hub's edges are pre-aggregated before each shuffle, and
    joins have one row per node on one side, so AQE can split a hub. Once no more than LAST edges are left, one task
    finishes them; `native` contracts to the end instead, without Python. Null ends are no edges, repeated edges count once, a node tied with itself is left out; an empty input
    gives an empty result.
    """
    pairs = edges.select("a", "b") if native else edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", narrow=True)
    maps: list[DataFrame] = []
    while n := e.count():
        if n <= LAST and not native:
            maps.append(cut(e.coalesce(1).mapInArrow(finish, "node long, up long"), "jump", narrow=True))
            break
        rank = lambda c: F.xxhash64(F.lit(len(maps)), c)  # noqa: E731, B023
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b"))).alias("m"))
        step = step.select(F.col("a").alias("node"), F.when(F.col("m.r") < rank(F.col("a")), F.col("m.b")).otherwise(F.col("a")).alias("up"))
        step = cut(step, "step", narrow=True)
        above = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = cut(step.join(above, "up").select("node", F.col("top").alias("up")), "jump", narrow=True)
        forget(step)
        maps.append(jump)
        left = jump.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = jump.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        after = e.join(left, "a").join(right, "b").where("ua <> ub")
        after = cut(after.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges", narrow=True)
        forget(e)
        e = after
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    root = maps[-1].select("node", F.col("up").alias("root"))
    for m in reversed(maps[:-1]):
        over = root.select(F.col("node").alias("up"), F.col("root").alias("far"))
        root = m.join(over, "up", "left").select("node", F.coalesce("far", "up").alias("root"))
    return root
