"""Shared machinery of the near-duplicate operators: packed postings, bounded byte tables, exact linking of sets.

Candidate keys travel as packed arrays, one row per batch and bucket. Within a key, every node is first compared with
one centre, then with the best connected one. What then is left in different components of a key is compared across
them, unless sizes, the distances to the common centre (triangle inequality) or sketches rule a link out. What is left
out this way cannot change the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import mix
from .common import cut, forget, parts
from .components import connected_components

PACKED = "part int, base int, keys binary, nodes binary, runs binary"
SETS = "node long, items binary"
#: Least bits of a dense parity sketch.
BITS = 1024
#: Entries of one row of a byte table; fewest and most entries of a table.
ENTRIES, LEAST, MOST = 1 << 16, 1 << 16, 1 << 26
#: Keys of a node that pairs look through so as to come from one key only.
FEW = 256
#: Buckets that a spread key goes to at most.
SPREAD = 1 << 16

U = np.uint64


def pack(keys: np.ndarray, nodes: np.ndarray, spread: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Postings as rows of PACKED, by bucket of their key; of a key the low 32 bits travel. A node's keys stand together.

    A key with spread > 0 is dealt over so many buckets by its nodes; `base` is its own bucket, -1 for the others.
    """
    base = ((keys >> U(32)) % U(buckets)).astype(np.int32)
    hot = np.flatnonzero(spread > 0)
    if len(hot):
        salt = (mix(nodes[hot].view(np.uint64)) % np.minimum(spread[hot], SPREAD).astype(np.uint64)).astype(np.int64)
        yield from _packed(keys[hot], nodes[hot], ((base[hot] + salt) % buckets).astype(np.int32), base[hot])
        rest = spread == 0
        keys, nodes, base = keys[rest], nodes[rest], base[rest]
    yield from _packed(keys, nodes, base, None)


def _packed(keys: np.ndarray, nodes: np.ndarray, part: np.ndarray, base: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if not len(keys):
        return
    small = part.max(initial=0) < 1 << 16
    order = np.argsort(part.astype(np.uint16) if small else part, kind="stable") if base is None else np.lexsort((nodes, base, part))
    keys, nodes, part = (keys[order] & U(0xFFFFFFFF)).astype(np.uint32), nodes[order], part[order]
    row = np.ones(len(part), bool)
    row[1:] = part[1:] != part[:-1]
    if base is not None:
        base = base[order]
        row[1:] |= base[1:] != base[:-1]
    run = row.copy()
    run[1:] |= nodes[1:] != nodes[:-1]
    at, run = np.flatnonzero(row), np.flatnonzero(run)
    length = np.diff(np.append(run, len(part))).astype(np.uint32)
    low = np.append(np.searchsorted(run, at), len(run)).tolist()
    ends = np.append(at, len(part)).tolist()
    k, n, r = [], [], []
    for i in range(len(at)):
        k.append(keys[ends[i] : ends[i + 1]].tobytes())
        n.append(nodes[run[low[i] : low[i + 1]]].tobytes())
        r.append(length[low[i] : low[i + 1]].tobytes())
    own = np.full(len(at), -1, np.int32) if base is None else base[at]
    yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(own), *(pa.array(x, pa.binary()) for x in (k, n, r))], ["part", "base", "keys", "nodes", "runs"])


def shared_postings(packed: DataFrame) -> DataFrame:
    """(key, node) of the keys that two or more nodes of a bucket have, and of all spread keys.

    Keys of the same nodes make the same candidates: unless it is spread, a key is replaced by a hash of its nodes.
    """

    def run(table: pa.Table) -> pa.Table:
        part, keys, nodes, hot = table["part"][0].as_py(), [], [], []
        for base, k, n, r in zip(*(table[c].to_pylist() for c in ("base", "keys", "nodes", "runs")), strict=True):
            keys.append(np.frombuffer(k, np.uint32).astype(np.uint64) | U((part if base < 0 else base) << 32))
            nodes.append(np.repeat(np.frombuffer(n, np.int64), np.frombuffer(r, np.uint32)))
            hot.append(np.full(len(keys[-1]), base >= 0))
        keys, nodes, hot = np.concatenate(keys), np.concatenate(nodes), np.concatenate(hot)
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        some = hot[order]
        some[1:] |= same
        some[:-1] |= same
        order = order[some]
        keys, nodes, hot = keys[order], nodes[order], hot[order]
        order = np.lexsort((nodes, keys))
        keys, nodes, hot = keys[order], nodes[order], hot[order]
        if len(keys):
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
            start = np.flatnonzero(new)
            hot, keys, nodes = np.logical_or.reduceat(hot, start), keys[start], nodes[start]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            count = np.diff(np.append(first, len(keys)))
            any_hot = np.logical_or.reduceat(hot, first)
            names = mix(np.add.reduceat(mix(nodes.view(np.uint64)), first) + count.astype(np.uint64))
            keep = np.repeat((count > 1) | any_hot, count)
            keys = np.where(np.repeat(any_hot, count), mix(keys + U(1)), np.repeat(names, count))[keep]
            nodes = nodes[keep]
        return pa.table({"key": keys.view(np.int64), "node": nodes})

    return packed.groupBy("part").applyInArrow(run, "key long, node long").distinct()


def table_rows(table: np.ndarray, part: int) -> pa.RecordBatch:
    """A byte table of this task, as rows of ENTRIES."""
    n = len(table) // ENTRIES
    return pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([table[i * ENTRIES : (i + 1) * ENTRIES].tobytes() for i in range(n)], pa.binary())],
        ["block", "part", "counts"],
    )


def table_size(rows: int) -> int:
    """A power of two from LEAST to MOST, of 16 entries and more a row."""
    return min(MOST, max(LEAST, 1 << (16 * max(1, rows) - 1).bit_length()))


def merge_tables(rows: DataFrame) -> np.ndarray:
    """Sum of the byte tables of all tasks as levels: 0 for nothing, else 1 + floor(log2 of the sum).

    rows: (block, part, counts bytes). 32 tables at a time are summed, then 32 sums, and so on.
    """

    def adding(last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
        def add(key: tuple, table: pa.Table) -> pa.Table:
            total = np.zeros(ENTRIES, np.int64)
            for c in table["counts"].to_pylist():
                total += np.frombuffer(c, np.uint8 if len(c) == ENTRIES else np.uint32)
            made = np.ceil(np.log2(total + 1.0)).astype(np.uint8) if last else np.minimum(total, 2**32 - 1).astype(np.uint32)
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([made.tobytes()], pa.binary())})

        return add

    most = rows.agg(F.max("part")).first()[0]
    if most is None:
        return np.zeros(LEAST, np.uint8)
    while True:
        last = most < 32
        rows = rows.withColumn("part", (F.col("part") / 32).cast("int")).groupBy("block", "part")
        rows = rows.applyInArrow(adding(last), "block int, part int, counts binary")
        if last:
            break
        most //= 32
    got = rows.select("block", "counts").collect()  # MOST bytes at most
    return np.frombuffer(b"".join(r.counts for r in sorted(got)), np.uint8)


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A bounded filter of node hashes: 1 where some node falls, by the upper bits of the mixed hash."""
    size = table_size(nodes.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(size, np.uint8)
        for b in batches:
            table[slot_of(b.column(0).to_numpy(zero_copy_only=False), size)] = 1
        yield table_rows(table, TaskContext.get().partitionId())

    return merge_tables(nodes.select("node").mapInArrow(run, "block int, part int, counts binary"))


def slot_of(nodes: np.ndarray, size: int) -> np.ndarray:
    return (mix(nodes.view(np.uint64)) >> U(64 - (size.bit_length() - 1))).astype(np.int64)


def parity(h: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Dense parity sketches of sets (elements h by set, in order): each element toggles the bit h mod bits.

    A sketch has BITS bits, or BITS times a power of four that is no less than its set.
    """
    grow = np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / BITS) / 2)).astype(np.int64)
    bits = BITS << (2 * grow)
    low = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    odd = (np.bincount(low[:-1][owner] + (h & (bits[owner] - 1).astype(np.uint64)).astype(np.int64), minlength=int(low[-1])) & 1).astype(np.uint8)
    longs = np.packbits(odd, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array((low // 64).astype(np.int32)), pa.array(longs))


def set_rows(nodes: np.ndarray, sizes: np.ndarray, h: np.ndarray, wanted: np.ndarray, sent: set[int]) -> pa.RecordBatch | None:
    """Rows of SETS for the sets whose node may be wanted, each node once, and not if it is in `sent`. h: elements, sorted, by owner."""
    own = np.flatnonzero(wanted[slot_of(nodes, len(wanted))] > 0)
    if len(own):
        own = own[np.unique(nodes[own], return_index=True)[1]]
        own = own[[x not in sent for x in nodes[own].tolist()]]
    if not len(own):
        return None
    sent.update(nodes[own].tolist())
    low = np.concatenate([[0], np.cumsum(sizes)])
    pick = np.concatenate([h[low[i] : low[i + 1]] for i in own.tolist()])
    at = (np.concatenate([[0], np.cumsum(sizes[own])]) * 8).astype(np.int32)
    items = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(at), pa.py_buffer(pick.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), items], ["node", "items"])


def bound(a: Column, b: Column, percent: int) -> Column:
    """Most symmetric difference of two sets of these sizes at that Jaccard similarity."""
    return F.floor((a + b) * (100 - percent) / (100 + percent))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ; the longer one is folded to the other's length, which keeps parities."""
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)

    def fold(x: Column) -> Column:
        n = (F.size(x) / 4).cast("int")
        part = lambda k: F.slice(x, n * k + 1, n)
        xor = lambda p, q: F.zip_with(p, q, lambda u, v: u.bitwiseXOR(v))
        return xor(xor(part(0), part(1)), xor(part(2), part(3)))

    # sizes of partners differ by a third at most, so lengths by one step; beyond that the sizes tell
    return (
        F.when(F.size(a) == F.size(b), apart(a, b)).when(F.size(a) == F.size(b) * 4, apart(fold(a), b))
        .when(F.size(b) == F.size(a) * 4, apart(a, fold(b))).otherwise(F.lit(0))
    )


def compare_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) -> (a, b, least, most, linked): their symmetric difference, exactly. sets: (node, items)."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b").select("a", "b", "ia", "ib")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate([x, y]))
                common = int((z[1:] == z[:-1]).sum())
                distance.append(len(x) + len(y) - 2 * common)
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance, pa.int32()), pa.array(linked, pa.bool_())], ["a", "b", "distance", "linked"])

    exact = both.mapInArrow(run, "a long, b long, distance int, linked boolean")
    return exact.select("a", "b", F.col("distance").alias("least"), F.col("distance").alias("most"), "linked")


def compare_sketched(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """As `compare_sets`; pairs whose sketches (node, size, sketch) rule a link out get bounds only."""
    one, two = (sketches.select(F.col("node").alias(x), F.col("size").alias(f"s{x}"), F.col("sketch").alias(f"k{x}")) for x in "ab")
    near = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", F.greatest(F.abs(F.col("sa") - F.col("sb")), hamming(F.col("ka"), F.col("kb"))).alias("low"))
    near = cut(near.withColumn("far", F.col("low") > bound(F.col("sa"), F.col("sb"), percent)), "near", narrow=True)
    exact = compare_sets(near.where("not far").select("a", "b"), sets, percent)
    far = near.where("far").select("a", "b", F.col("low").cast("int").alias("least"), (F.col("sa") + F.col("sb")).alias("most"), F.lit(False).alias("linked"))
    return exact.unionByName(far)


def _in_columns(rows: DataFrame) -> DataFrame:
    """A sketch of the least size as columns s0, s1, ..., others as they are: columns are compared in compiled code."""
    least = F.size("sketch") == BITS // 64
    return rows.select(
        *[c for c in rows.columns if c != "sketch"], F.when(~least, F.col("sketch")).alias("sketch"),
        *[F.when(least, F.get("sketch", F.lit(i))).alias(f"s{i}") for i in range(BITS // 64)],
    )


def _as_array(side: str, words: int) -> Column:
    return F.array(*[F.col(f"{side}_s{i}") for i in range(words)])


def link(postings: DataFrame, facts: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame], percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) that connect all linked nodes, and the components (node, root) they make.

    facts: (node) to (node, size, sketch), each node once. compare: pairs (a, b) to (a, b, least, most, linked), with
    bounds of their symmetric difference.

    Complete for components: two nodes that share a key and are linked are in one component. First every node of a key
    is compared with the least one, then with the one that has most links; then nodes of a key that are still in
    different components are compared, unless their sizes, their distances to the common centre (triangle inequality)
    or their sketches rule a link out.
    """
    keep = postings.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("k")).where("k > 1")
    hashed = lambda df: df.hint("shuffle_hash")  # noqa: E731  a row a key or node: small, and the other side needs no sorting
    p = cut(postings.join(hashed(keep.select("key", "centre")), "key"), "postings", narrow=True)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = p.where("node <> centre").select(*pair(F.col("node"), F.col("centre"))).distinct()
    tested = cut(compare(star), "tested", narrow=True)
    good = tested.where("linked")
    degree = good.select(F.col("a").alias("node")).unionByName(good.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("deg"))
    roots = cut(connected_components(good.select("a", "b")), "roots", narrow=True)

    def still_open(p: DataFrame, roots: DataFrame) -> DataFrame:
        labelled = p.join(hashed(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo <> hi and k > 2").select("key")
        return labelled.join(hashed(split), "key")

    left = cut(still_open(p, roots), "open", narrow=True)  # a key of two nodes is done with
    if left.isEmpty():
        return good.select("a", "b"), roots
    ranked = left.join(hashed(degree), "node", "left")
    best = ranked.groupBy("key").agg(F.max(F.struct(F.coalesce("deg", F.lit(0)).alias("deg"), F.col("node"))).alias("m")).select("key", F.col("m.node").alias("best"))
    second = left.drop("centre", "root").join(hashed(best), "key").select("key", "node", "best")
    star = second.where("node <> best").select(*pair(F.col("node"), F.col("best"))).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    known = tested.unionByName(cut(compare(star), "tested", narrow=True))
    good = known.where("linked").select("a", "b")
    roots = cut(connected_components(good), "roots", narrow=True)
    left = still_open(second, roots)
    a, b = pair(F.col("node"), F.col("best"))
    left = left.withColumn("a", a).withColumn("b", b).join(known.select("a", "b", "least", "most"), ["a", "b"], "left")
    left = left.where("node <> best").select("key", "node", "root", F.coalesce("least", F.lit(0)).alias("least"), F.coalesce("most", F.lit(2**30)).alias("most"))
    left = cut(left, "open", narrow=True)
    few = left.groupBy("node").agg(F.count("*").alias("k")).where(F.col("k") <= FEW).select("node")
    own = left.join(few, "node", "left_semi").groupBy("node").agg(F.collect_list("key").alias("keys"))
    left = _in_columns(left.join(facts(left.select("node").distinct()), "node").join(own, "node", "left"))
    left = cut(left, "open", narrow=True)
    x, y = left.select(*[F.col(c).alias(f"x_{c}") for c in left.columns]), left.select(*[F.col(c).alias(f"y_{c}") for c in left.columns])
    most = bound(F.col("x_size"), F.col("y_size"), percent)
    fits = (
        (F.col("x_key") == F.col("y_key"))
        & (F.col("x_root") < F.col("y_root"))
        & (F.least("x_size", "y_size") * 100 >= F.greatest("x_size", "y_size") * percent)
        & (F.col("x_least") - F.col("y_most") <= most)
        & (F.col("y_least") - F.col("x_most") <= most)
    )
    words = BITS // 64
    quick = sum(F.bit_count(F.col(f"x_s{i}").bitwiseXOR(F.col(f"y_s{i}"))) for i in range(words))
    other = hamming(F.coalesce("x_sketch", _as_array("x", words)), F.coalesce("y_sketch", _as_array("y", words)))
    fits &= F.when(F.col("x_s0").isNotNull() & F.col("y_s0").isNotNull(), quick).otherwise(other) <= most
    # a pair comes from the least of its keys only; written once, so that it is evaluated last and not beforehand
    fits &= F.coalesce(F.array_min(F.array_intersect("x_keys", "y_keys")), F.col("x_key")) == F.col("x_key")
    cross = x.join(y, fits).select(*pair(F.col("x_node"), F.col("y_node"))).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
    last = cut(compare(cross).where("linked").select("a", "b"), "tested", narrow=True)
    links = cut(good.unionByName(last), "links", narrow=True)
    out = cut(connected_components(links), "roots", narrow=True)
    forget(p, left, roots, last)
    return links, out


def buckets_for(df: DataFrame, values: int) -> int:
    """Buckets of about 2 million postings, and no fewer than the session's shuffle partitions."""
    return max(parts(df.sparkSession), values >> 21)
