"""Line dedup by MinHash.

Lines are sets of character shingles; a line shorter than a shingle is one shingle. A one-permutation MinHash with
optimal densification gives each distinct line a signature; its bands (recall 0.997 at the threshold, more above) make
candidates; the Jaccard similarity of their whole shingle sets (64-bit hashes) verifies them; connected components of the links keep one
line each: the first of the least document. Exact copies of a line share one name from the start, so a line that a
third of all rows repeat is counted, not paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import FOLD, U, distinct, mix
from .common import cut, numbered, small_batches
from .linkage import PACKED, buckets_for, link, node_filter, pack, parity, shared_postings, slot_of

#: Characters in a shingle.
CHARS, PERCENT = 8, 75
BANDS, ROWS = 16, 4
#: Bytes of lines signed at once, positions hashed at once, and keys sent on at once.
BLOCK, STEP, FLUSH = 1 << 20, 1 << 19, 1 << 18
#: Lines that a task remembers having signed (a further copy is signed again, to no effect).
REMEMBERED = 200_000

LOWER = FOLD.tobytes()
BLANKS = b" \t\n\v\f\r"


def lines_of(text: str | None) -> list[bytes]:
    """The lines of a text as they are judged: A-Z as a-z, without the blanks around them. Lines end at line feeds."""
    return [x.strip(BLANKS) for x in text.encode().translate(LOWER).split(b"\n")] if text is not None else []


def name_of(line: bytes) -> bytes:
    """128 bits; the same for equal lines only."""
    return blake2b(line, digest_size=16).digest()


def points_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lines of CHARS characters and more, a line feed between them, and the first shingle and the number of shingles of each."""
    points = np.frombuffer(b"\n".join(lines).decode().encode("utf-32-le"), np.uint32)
    feed = np.flatnonzero(points == 10)
    start = np.concatenate([[0], feed + 1])
    return points, start, np.append(feed, len(points)) - start - CHARS + 1


def shingles_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles, by line, and their number in each."""
    points, start, count = points_of(lines)
    two = np.ndarray((len(points) - 1,), "<u8", points, 0, (4,))  # two characters are one number
    out = np.empty(len(points) - CHARS + 1, np.uint64)
    for low in range(0, len(out), STEP):
        h = np.zeros(min(STEP, len(out) - low), np.uint64)
        for j in range(0, CHARS, 2):
            h ^= two[low + j : low + j + len(h)]
            h *= U(0x9E3779B97F4A7C15)
            h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
        out[low : low + len(h)] = h
    inside = np.ones(len(out), bool)
    for back in range(CHARS):  # windows over the end of a line
        inside[start[1:] - 1 - back] = False
    return out[inside], count


def signatures(lines: list[bytes]) -> np.ndarray:
    """BANDS * ROWS minima for each line of CHARS characters and more. An empty bin takes that of a bin drawn for it.

    For these a character counts by eight bits (its own up to 255), so that a shingle is one number.
    """
    k, n = BANDS * ROWS, len(lines)
    points, start, count = points_of(lines)
    small = np.zeros(len(points) + CHARS, np.uint8)
    for low in range(0, len(points), STEP):
        part = points[low : low + STEP]
        small[low : low + len(part)] = part ^ ((part >> np.uint32(8)) * np.uint32(0x9D))
    eight = np.ndarray((len(points) - CHARS + 1,), "<u8", small, 0, (1,))
    out = np.full((n + 1) * k, 0xFFFFFFFF, np.uint32)  # windows over the end of a line go to the last row
    row = np.full(len(eight), n * k, np.int32 if n * k < 2**31 else np.int64)
    for i, (a, c) in enumerate(zip(start.tolist(), count.tolist(), strict=True)):
        row[a : a + c] = i * k
    for low in range(0, len(eight), STEP):
        h = eight[low : low + STEP] * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
        h *= U(0xBF58476D1CE4E5B9)
        value = (h >> U(16)).astype(np.uint32)
        h >>= U(48)
        h *= U(k)
        h >>= U(16)
        np.minimum.at(out, row[low : low + len(h)] + h.astype(np.int32), value)
    out = out[: n * k].reshape(n, k)
    has = out != 0xFFFFFFFF
    row, col = np.nonzero(~has & has.any(axis=1, keepdims=True))
    attempt = 0
    while len(row):
        attempt += 1
        draw = (mix(np.arange(k, dtype=np.uint64) * U(4099) + U(attempt)) % U(k)).astype(np.int64)[col]
        ok = has[row, draw]
        out[row[ok], col[ok]] = out[row[ok], draw[ok]]
        row, col = row[~ok], col[~ok]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(sig), BANDS), np.uint64)
    for i in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + rows[:, :, i])
    return mix(key + np.arange(BANDS, dtype=np.uint64) * U(0xD1342543DE82EF95))


def spread_of(keys: np.ndarray, many: int = 1024) -> np.ndarray:
    """Into how many buckets each key goes: 16 for one that `many` lines sent on at once have, else 0 (its own bucket).

    What is sent on at other times may differ on a key, so the first line of a spread one goes to its own bucket, where all meet it.
    """
    out = np.zeros(len(keys), np.int64)
    ordered = np.sort(keys)
    hot = np.unique(ordered[many - 1 :][ordered[many - 1 :] == ordered[: max(0, len(keys) - many + 1)]])
    if len(hot):
        at = np.flatnonzero(np.isin(keys, hot))
        out[at] = 16
        out[at[np.unique(keys[at], return_index=True)[1]]] = 1
    return out


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of about so much length together; a longer one stands alone."""
    low, total = 0, 0
    for k, n in enumerate(lengths):
        if total and total + n > most:
            yield low, k
            low, total = k, 0
        total += n
    if low < len(lengths):
        yield low, len(lengths)


def distinct_shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h, count = shingles_of(lines)
    return distinct(h, np.repeat(np.arange(len(lines), dtype=np.int32), count), len(lines))


def compare_lines(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """(a, b) -> (a, b, least, most, linked): the symmetric difference of two lines' shingles. lines: (node, line binary)."""
    both = pairs.join(lines.select(F.col("node").alias("a"), F.col("line").alias("ta")), "a")
    both = both.join(lines.select(F.col("node").alias("b"), F.col("line").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, j in slices([len(x) + len(y) for x, y in zip(one, two, strict=True)], BLOCK):
                h, size = distinct_shingles([x for both in zip(one[i:j], two[i:j], strict=True) for x in both])
                size = size.reshape(-1, 2).sum(axis=1)
                low = np.concatenate([[0], np.cumsum(size)])
                for k in range(j - i):
                    h[low[k] : low[k + 1]].sort()
                same = np.append(h[1:] == h[:-1], False)
                same[low[1:] - 1] = False
                common = np.add.reduceat(same, low[:-1], dtype=np.int64)
                linked = 100 * common >= percent * (size - common)
                columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(size - 2 * common, pa.int32()), pa.array(linked)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "distance", "linked"])

    done = both.mapInArrow(run, "a long, b long, distance int, linked boolean")
    return done.select("a", "b", F.col("distance").alias("least"), F.col("distance").alias("most"), "linked")


def sketched(lines: DataFrame) -> DataFrame:
    """(node, line) -> (node, size, sketch): the number of shingles and their dense parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices([len(x) for x in texts], BLOCK):
                h, size = distinct_shingles(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size, pa.int32()), parity(mix(h), size)], ["node", "size", "sketch"])

    return lines.select("node", "line").mapInArrow(run, "node long, size int, sketch array<bigint>")


def duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, line, kept_doc_id, kept_row, kept_line) of every line of docs (doc_id, text) that goes, with the line kept for it.

    row: struct<file, row> names the row of docs, so rows may share an id or have none. Lines are numbered from 0. Lines of
    blanks only are left alone. Of each component, the first line of the least doc_id stays (a null id before all
    others; between rows of one id, by a hash of their text, then by their place).
    """
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    at = lambda p: F.struct(F.col(f"{p}file").alias("file"), F.col(f"{p}row").alias("row"))
    gone = _duplicates(rows.withColumnRenamed("__file", "file").withColumnRenamed("__row", "row"), percent)
    return gone.select("doc_id", at("").alias("row"), "line", F.col("kept.doc_id").alias("kept_doc_id"), at("kept.").alias("kept_row"), F.col("kept.line").alias("kept_line"))


def _duplicates(docs: DataFrame, percent: int) -> DataFrame:
    spark = docs.sparkSession
    place = ("doc_id", "hash", "file", "row", "line")

    def list_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, names, hashes = [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                found = [(k, name_of(x)) for k, x in enumerate(lines_of(text)) if x]
                if found:
                    k, name = zip(*found, strict=True)
                    at.append(np.full(len(k), i))
                    number.append(np.array(k, np.int32))
                    names.append(b"".join(name))
                    hashes.append(np.full(len(k), int.from_bytes(blake2b(b"".join(name), digest_size=8).digest(), "little", signed=True)))
            if at:
                rows = pa.array(np.concatenate(at))
                both = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                columns = [*(batch.column(c).take(rows) for c in range(3)), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(number)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "file", "row", "hash", "line", "node", "more"])

    with small_batches(spark):
        lines = cut(docs.select("doc_id", "file", "row", "text").mapInArrow(list_lines, "doc_id long, file long, row long, hash long, line int, node long, more long"), "lines")
        roots = _linked(docs, lines, percent)
        first = F.min(F.struct(*place)).alias("first")
        distinct = cut(lines.groupBy("node", "more").agg(first, F.count("*").alias("n")), "distinct", narrow=True)
    joined = distinct.join(roots.hint("shuffle_hash"), "node")  # few lines have links
    least = joined.groupBy("root").agg(F.min("first").alias("kept"))
    joined = joined.join(least.hint("shuffle_hash"), "root").select("node", "more", "kept")
    alone = distinct.where("n > 1").join(roots.select("node"), "node", "left_anti").select("node", "more", F.col("first").alias("kept"))
    gone = lines.join(joined.unionByName(alone).hint("shuffle_hash"), ["node", "more"])
    return gone.where(F.struct(*place) != F.col("kept"))


def _linked(docs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the lines that have links. The first 64 bits of a line's name are its node."""
    spark = docs.sparkSession
    buckets = buckets_for(docs, lines.count() * BANDS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()  # nodes sent on before
        found: list[bytes] = []
        nodes: list[int] = []
        got, n, size = [], 0, 0

        def sign() -> None:
            nonlocal found, nodes, size, n
            if found:
                got.append((band_keys(signatures(found)).reshape(-1), np.repeat(np.array(nodes, np.int64), BANDS)))
                n += len(found) * BANDS
            found, nodes, size = [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            keys, nodes = (np.concatenate(x) for x in zip(*got, strict=True))
            yield from pack(keys, nodes, spread_of(keys), buckets)

        for batch in batches:
            for text in batch.column(0):
                for x in lines_of(text.as_py()):
                    if len(x) < CHARS or len(x) < 4 * CHARS and len(x.decode()) < CHARS or (node := node_of(x)) in known:
                        continue
                    known.add(node)
                    found.append(x)
                    nodes.append(node)
                    size += len(x)
                    if size >= BLOCK:
                        sign()
                        if n >= FLUSH:
                            yield from packed()
                            got, n = [], 0
                            if len(known) > REMEMBERED:
                                known = set()
        sign()
        if got:
            yield from packed()

    postings = cut(shared_postings(docs.select("text").mapInArrow(emit, PACKED)), "shared", narrow=True)
    shared = cut(postings.select("node").distinct(), "nodes", narrow=True)
    wanted = spark.sparkContext.broadcast(node_filter(shared))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # of this task; a further copy goes again, to no effect
        for batch in batches:
            found = list({x for text in batch.column(0) for x in lines_of(text.as_py()) if len(x) >= CHARS})
            nodes = np.array([node_of(x) for x in found], np.int64)
            pick = np.flatnonzero(wanted.value[slot_of(nodes, len(wanted.value))] > 0)
            pick = pick[[x not in sent for x in nodes[pick].tolist()]] if len(pick) else pick
            sent = set() if len(sent) > REMEMBERED else sent
            sent.update(nodes[pick].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(nodes[pick]), pa.array([found[k] for k in pick.tolist()], pa.binary())], ["node", "line"])

    texts = docs.select("text").mapInArrow(fetch, "node long, line binary").join(shared.hint("shuffle_hash"), "node", "left_semi")
    texts = cut(texts.dropDuplicates(["node"]), "texts")
    facts = lambda nodes: sketched(texts.join(nodes, "node", "left_semi"))
    return link(postings, facts, lambda pairs: compare_lines(pairs, texts, percent), percent)[1]


def node_of(line: bytes) -> int:
    return int.from_bytes(name_of(line)[:8], "little", signed=True)


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with the lines of `duplicates` taken out of `text`, and n_lines, n_removed long.

    Columns of docs stay (an n_lines or n_removed among them is replaced). Null texts stay null with no lines; an empty
    text is one empty line. The other lines stay as they are, joined by line feeds; a text of which nothing stays is
    empty. Each row is a document of its own: of repeated rows, one keeps the lines. An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = numbered(docs.select(*keep))
    work = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("__file").alias("file"), F.col("__row").alias("row"))
    gone = _duplicates(work, percent).groupBy(F.col("file").alias("__file"), F.col("row").alias("__row")).agg(F.collect_set("line").alias("__gone"))
    out = rows.join(gone.hint("shuffle_hash"), ["__file", "__row"], "left")  # so that the texts need no sorting
    hit = F.col("__gone").isNotNull()
    out = out.withColumn("__lines", F.when(hit, F.split("text", "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.when(hit, F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")).otherwise(F.col("text"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    out = out.withColumn("n_lines", n).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long")).withColumn("text", text)
    return out.select(*keep, "n_lines", "n_removed")
