"""Approximate nearest vectors: cells around centroids; a search reads the cells nearest to the query only.

The centroids are fitted on a bounded sample of vectors (SAMPLE, those of least hashed id); every vector is put into the
cell of its nearest centroid and stored there. Within the cells read, cosines are exact. Clustered vectors need few cells;
the test's nearly uniform ones (64 dimensions) take half of them for nine in ten of the nearest.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..sources.store import Store
from .retrieval import dense, top

#: Vectors that the centroids are fitted on at most, and cells by default.
SAMPLE, CELLS = 20_000, 64


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_cells(vectors: DataFrame, cells: int = CELLS, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids (unit length) by k-means on directions; fewer if there are fewer vectors."""
    rows = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("vector").toArrow()
    x = np.array(rows["vector"].to_pylist(), np.float32)
    if not len(x):
        return np.zeros((0, 0), np.float32)
    x = _unit(x)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=len(c)) == 0
        sums[empty] = x[rng.integers(0, len(x), int(empty.sum()))]
        c = _unit(sums)
    return c


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds `bucket`, the cell of the nearest centroid."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(np.stack(v.to_numpy()) @ shared.value.T, axis=1)) if len(v) else pd.Series([], dtype="int32")

    return vectors.withColumn("bucket", nearest("vector"))


def build(store: Store, vectors: DataFrame, cells: int = CELLS) -> None:
    """Stores all vectors by cell, and the centroids."""
    centroids = fit_cells(vectors, cells)
    store.write("centroids", store.spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "cell int, centroid array<float>"))
    if len(centroids):
        store.replace("cells", assign(vectors, centroids), list(range(len(centroids))))


def search(store: Store, query: Sequence[float], k: int, probes: int = CELLS // 2, schema: str = schemas.VECTORS, where=None) -> DataFrame:
    """(chunk_id, score, rank): the k nearest in the `probes` nearest cells; the other cells are not read."""
    rows = store.read("centroids").collect()  # CELLS rows
    near = sorted(rows, key=lambda r: (-float(np.dot(r.centroid, query)), r.cell))[:probes]
    return top(dense(store.read_buckets("cells", schema, [r.cell for r in near]), query, where), k)
