"""N-gram Jaccard join by parity sketches.

A document's distinct word shingles are hashed and XORed into the cells of a sketch. A shingle falls into one cell, so
two sketches differ in no more cells than the sets have elements in their symmetric difference; at Jaccard similarity t
that is D = floor((a + b)(1 - t)/(1 + t)) at most for sets of sizes a and b. All other cells agree (pigeonhole): of the
cells of a document that hold something, the first D + 1 in an order common to all documents meet one of the other's.

Documents are joined per size band, and each band has its own number of cells: the fewest of SCALES, in proportion to
its sizes, at which every document of the band fills more than D cells. So a cell holds about two shingles where sets
are large, and a key stands for them all. The common order puts cells with a rare shingle first, by counts over the
whole corpus, so that passages which many documents share make few candidates. A document that may have a smaller
partner in the band below stands there too. Dense sketches of single bits (as many as shingles, or more) bound the
distance from below and rule candidates out; the rest is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import SPACED, blocks, distinct, mix, shingles, tally, texts, word_hashes
from .common import cut, small_batches
from .linkage import PACKED, SETS, buckets_for, compare_sketched, link, merge_tables, node_filter, pack, parity, set_rows, shared_postings, table_rows, table_size

WORDS, PERCENT = 5, 75
#: Size bands grow by this power of two.
BAND = 2
#: A band of sizes from L on has L * 2**s cells, s from 0; the last scale is as good as a cell for each shingle.
SCALES = 40
#: Keys that stand at this level of counts (1 + log2) are spread over buckets.
HOT = 11
#: Sets that a task remembers having sent on.
REMEMBERED = 200_000
#: Bytes of text worked on at once, and keys sent on at once.
BLOCK, FLUSH = 1 << 20, 1 << 18

U = np.uint64


def sets_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by text, the sets' sizes, and their nodes (hash of the set)."""
    h, size = distinct(*shingles(*word_hashes(data, at, SPACED), WORDS), len(at) - 1)
    low = np.concatenate([[0], np.cumsum(size)])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h))])
    node = mix(sums[low[1:]] - sums[low[:-1]] + size.astype(np.uint64)).view(np.int64)
    return h, size, node


def most_apart(n: np.ndarray, percent: int) -> np.ndarray:
    """Most symmetric difference of a set of n elements and any linked with it."""
    return (n + n * 100 // percent) * (100 - percent) // (100 + percent)


def band_of(n: np.ndarray) -> np.ndarray:
    """Number of the size band, from 0."""
    return np.searchsorted(1 << (BAND * np.arange(1, 31)), n, "right")


def cells_of(h: np.ndarray, band: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Cell of each hash, ascending with it: its share of the band's cells (in 64 bits: hash times cells over 2**64)."""
    cells = (BAND * band + scale).astype(np.uint64)  # log2 of their number
    return np.where(cells > 0, h >> (U(64) - np.maximum(cells, U(1))), U(0))


def filled(h: np.ndarray, own: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """Cells that hold something, by set."""
    new = np.ones(len(h), bool)
    new[1:] = (own[1:] != own[:-1]) | (cell[1:] != cell[:-1])
    return np.bincount(own[new], minlength=n)


def needed_scale(h: np.ndarray, size: np.ndarray, band: np.ndarray, percent: int) -> np.ndarray:
    """Least scale at which each set fills more cells of that band than may differ."""
    out, left = np.zeros(len(size), np.int64), np.flatnonzero(size > 0)
    own = np.repeat(np.arange(len(size)), size)
    want = most_apart(size, percent)
    for s in range(SCALES):
        if not len(left):
            break
        if s:
            pick = np.isin(own, left)
            h, own = h[pick], own[pick]
        got = filled(h, own, cells_of(h, band[own], np.full(len(own), s)), len(size))
        left = left[got[left] <= want[left]]
        out[left] = s + 1
    return out


def keys_of(h: np.ndarray, size: np.ndarray, node: np.ndarray, levels: np.ndarray, scales: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the first D + 1 filled cells of each set in each of its bands, with node and spread."""
    out = []
    shift = U(64 - (len(levels).bit_length() - 1))
    for below in (False, True):
        band = band_of(size)
        if below:
            lower = band_of(np.maximum(-(-size * percent // 100), 1))
            use = (lower < band) & (size > 0)
            band = lower
        else:
            use = size > 0
        if not use.any():
            continue
        own = np.repeat(np.arange(len(size)), size)
        mine = h
        if not use.all():
            pick = use[own]
            own, mine = own[pick], h[pick]
        cell = cells_of(mine, band[own], scales[band][own])
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (cell[1:] != cell[:-1])
        start = np.flatnonzero(new)
        level = np.minimum.reduceat(levels[(mine >> shift).astype(np.int64)], start).astype(np.uint64)
        pattern = np.bitwise_xor.reduceat(mix(mine), start)
        own = own[start]
        pattern = mix(pattern ^ mix(cell[start] + U(1)) ^ (band[own].astype(np.uint64) << U(56)))
        order = (level << U(58)) | (pattern >> U(6))
        low = np.searchsorted(own, np.arange(len(size) + 1))
        most = most_apart(size, percent) + 1
        for i in np.flatnonzero(use).tolist():
            part = order[low[i] : low[i + 1]]
            part.sort()
        rank = np.arange(len(own)) - low[own]
        take = rank < most[own]
        order, own = order[take], own[take]
        level = (order >> U(58)).astype(np.int64)
        hot = np.where(level >= HOT, 1 << np.clip(level - HOT + 1, 1, 16), 0)
        out.append((mix(order), node[own], hot))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def describe(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n, node, sketch, bands' scales) of every document, and this task's counts of shingles by hashed bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, shift = np.zeros(size, np.uint8), U(64 - (size.bit_length() - 1))
        names = ["doc_id", "n", "node", "sketch", "scale", "lower", "block", "part", "counts"]
        for batch in batches:
            data, at = texts(batch.column(1))
            for i, j in blocks(at, BLOCK):
                h, n, node = sets_of(data[at[i] : at[j]], at[i : j + 1] - at[i])
                bins, more = tally(h >> shift)
                bins = bins.astype(np.int64)
                table[bins] = np.minimum(table[bins] + more, 255)
                scale = needed_scale(h, n, band_of(n), percent)
                under = band_of(np.maximum(-(-n * percent // 100), 1))
                lower, other = scale.copy(), under < band_of(n)
                pick = np.repeat(other, n)
                lower[other] = needed_scale(h[pick], n[other], under[other], percent)
                none = [pa.nulls(j - i, t) for t in (pa.int32(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int32()), pa.array(node), parity(h, n), pa.array(scale, pa.int32()), pa.array(lower, pa.int32()), *none], names)
        rows = table_rows(table, TaskContext.get().partitionId())
        none = [pa.nulls(rows.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*none, *rows.columns], names)

    return docs.mapInArrow(run, "doc_id long, n int, node long, sketch array<bigint>, scale int, lower int, block int, part int, counts binary")


def join(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, node) of every row of docs (doc_id, text), verified links (a, b) of nodes, and (node, root) of the nodes that have some.

    Nodes name distinct sets. The links connect all linked sets; others within a component are not listed.
    """
    with small_batches(docs.sparkSession):
        return _join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent)


def scales_of(described: DataFrame, percent: int) -> np.ndarray:
    """Scale of each size band: the most that a document standing in it needs. A row for each size at most is collected, of about 60 bands."""
    log = lambda c: F.floor(F.log2(c.cast("double")) / BAND + 1e-9).cast("int")
    n = F.col("n")
    rows = described.where("n > 0").select(F.explode(F.array(F.struct(log(n).alias("band"), F.col("scale").alias("s")), F.struct(log(F.greatest(F.ceil(n * percent / 100), F.lit(1))).alias("band"), F.col("lower").alias("s")))).alias("x"))
    out = np.zeros(40, np.int64)
    for r in rows.groupBy("x.band").agg(F.max("x.s").alias("s")).collect():
        out[r.band] = r.s
    return out


def _join(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = docs.sparkSession
    size = table_size(docs.count())
    described = cut(describe(docs, size, percent), "described")
    levels = spark.sparkContext.broadcast(merge_tables(described.where("block is not null").select("block", "part", "counts")))
    rows = described.where("block is null")
    members = rows.select("doc_id", "n", "node")
    scales = scales_of(rows, percent)
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = buckets_for(docs, total // 3)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = [], 0
        for batch in batches:
            data, at = texts(batch.column(0))
            for i, j in blocks(at, BLOCK):
                got.append(keys_of(*sets_of(data[at[i] : at[j]], at[i : j + 1] - at[i]), levels.value, scales, percent))
                n += len(got[-1][0])
                if n >= FLUSH:
                    yield from pack(*(np.concatenate(x) for x in zip(*got, strict=True)), buckets)
                    got, n = [], 0
        if got:
            yield from pack(*(np.concatenate(x) for x in zip(*got, strict=True)), buckets)

    postings = cut(shared_postings(docs.select("text").mapInArrow(emit, PACKED)), "shared", narrow=True)
    shared = cut(postings.select("node").distinct(), "nodes", narrow=True)
    known = rows.select("node", F.col("n").alias("size"), "sketch").join(shared, "node", "left_semi")
    sketches = cut(known.dropDuplicates(["node"]), "sketches")
    wanted = spark.sparkContext.broadcast(node_filter(shared))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # of this task; a further copy goes again, to no effect
        for batch in batches:
            data, at = texts(batch.column(0))
            for i, j in blocks(at, BLOCK):
                h, n, node = sets_of(data[at[i] : at[j]], at[i : j + 1] - at[i])
                found = set_rows(node, n, h, wanted.value, sent)
                sent = set() if len(sent) > REMEMBERED else sent
                if found is not None:
                    yield found

    sets = docs.select("text").mapInArrow(fetch, SETS).join(shared.hint("shuffle_hash"), "node", "left_semi")
    sets = cut(sets.dropDuplicates(["node"]), "sets")
    links, roots = link(postings, lambda nodes: sketches.join(nodes, "node", "left_semi"), lambda pairs: compare_sketched(pairs, sketches, sets, percent), percent)
    return members, links, roots


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the least doc_id that links reach (links: 100 * intersection >= percent * union of the shingle
    sets), its own where there are none. Null and empty texts have no shingles and no links; texts of one to four
    words are one shingle. Repeated rows give repeated results, a null doc_id is no component's least unless all are
    null; an empty table gives no rows.
    """
    members, _, roots = join(docs, percent)
    labelled = members.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
    least = labelled.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = labelled.join(least, "label", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: of the least doc_id, and of several rows with that id one of the least text.

    Rows without doc_id stay. Columns of docs stay; an empty table gives no rows. Rows of one id are reduced to one in
    each task before they are shuffled.
    """
    kept = components(docs, percent).where("doc_id = component_id").select("doc_id").distinct()
    whole = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct("text")).alias("__row")
    one = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(whole)
    one = one.join(kept, F.col("__id").cast("long") == F.col("doc_id"), "left_semi").select("__row.*")
    return one.unionByName(docs.where("doc_id is null"))
