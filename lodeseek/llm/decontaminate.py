"""Benchmark decontamination by suffix arrays over the training text.

Every task holds shards of the training documents. A shard's words become numbers of the benchmark's vocabulary, and its
suffix array (prefix doubling) orders the suffixes that begin with such a word; a word of none of the items ends a
suffix, as no match goes over it. Every test suffix is looked up by binary search, a word at a time: the range of the
array that still agrees with it is all its occurrences, and the depth at which an occurrence leaves the range is the
length of its longest verbatim match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, Lookup, blocks, hash_spans, texts, words
from .common import cut, numbered

#: Words in a window.
WINDOW = 10
#: Benchmark words broadcast in one pass at most (about 60 bytes each); the hits of several passes are united.
PASS_WORDS = 1_000_000

MATCH = "array<struct<item_id:string,item_word:int,doc_word:int,n_words:int,start:int,end:int>>"
_MATCH = pa.list_(
    pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
)
_KEYS = ("item_id", "item_word", "doc_word", "n_words", "start", "end")


class Tests:
    """The benchmark items as numbers of their vocabulary (0: the end of an item), and their suffixes."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        data, at = texts(pa.array([t for _, t in items], pa.string()))
        s, e, first = words(data, at, ALNUM)
        vocabulary, token = np.unique(hash_spans(data, s, e), return_inverse=True)
        self.find, self.kinds = Lookup(vocabulary, 3), len(vocabulary)
        self.ids = np.array([i for i, _ in items], dtype=object)
        size = np.diff(first)
        self.item = np.repeat(np.arange(len(size)), size)
        #: the words from each suffix to its item's end, and those that a hit needs
        self.left = first[1:][self.item] - np.arange(len(self.item))
        self.need = np.minimum(size, window)[self.item]
        self.word = np.arange(len(self.item)) - first[:-1][self.item]
        self.token = np.concatenate([token.astype(np.int32) + 1, np.zeros(1, np.int32)])
        self.before = np.concatenate([np.zeros(1, np.int32), self.token[:-2]]) if len(token) else np.zeros(0, np.int32)
        self.before[self.word == 0] = -1
        self.longest = int(size.max(initial=0))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each is in."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n), which


def suffix_array(token: np.ndarray, run: np.ndarray, depth: int) -> np.ndarray:
    """The places with run > 0 by the words that follow, as far as their run goes, to `depth` words at least."""
    array = np.flatnonzero(run > 0)
    rank = np.zeros(len(token) + 1, np.int64)
    array = array[np.argsort(token[array], kind="stable")]
    step, key = 1, token[array].astype(np.int64)
    while len(array):
        new = np.ones(len(array), bool)
        new[1:] = key[1:] != key[:-1]
        number = np.cumsum(new)
        rank[array] = number
        if number[-1] == len(array) or step >= depth:
            break
        after = np.where(run[array] > step, rank[np.minimum(array + step, len(token))], 0)
        key = number * (len(array) + 1) + after
        tied = ~new
        tied[:-1] |= ~new[1:]  # the others have their place
        tied = np.flatnonzero(tied)
        order = np.argsort(key[tied], kind="stable")
        array[tied], key[tied] = array[tied][order], key[tied][order]
        step *= 2
    return array


def _bisect(word, low: np.ndarray, high: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """By range, the first place whose word is no less than (right: greater than) the wanted one."""
    lo, hi = low.copy(), high.copy()
    active = np.flatnonzero(lo < hi)
    while len(active):
        mid = (lo[active] + hi[active]) >> 1
        go = word(mid) <= want[active] if right else word(mid) < want[active]
        lo[active[go]] = mid[go] + 1
        hi[active[~go]] = mid[~go]
        active = active[lo[active] < hi[active]]
    return lo


def occurrences(tests: Tests, token: np.ndarray, run: np.ndarray, longest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, suffix) of all test suffixes that agree on as many words as a hit needs; and (place, suffix, words) of the longest matches."""
    array = suffix_array(token, run, tests.longest if longest else min(WINDOW, tests.longest))
    kinds = np.searchsorted(token[array], np.arange(1, tests.kinds + 2))
    q = np.arange(len(tests.item))
    q = q[tests.left >= tests.need]
    first = tests.token[q]
    low, high = kinds[first - 1], kinds[first]
    depth, hits, ended = 1, [], []
    pairs = None  # once a hit is deep enough, its occurrences one by one
    while True:
        alive = low < high
        q, low, high = q[alive], low[alive], high[alive]
        full = tests.need[q] == depth
        if full.any():
            place, which = _ranges(low[full], high[full])
            found = (array[place], q[full][which])
            hits.append(found)
            if longest:
                pairs = found if pairs is None else tuple(np.concatenate(x) for x in zip(pairs, found, strict=True))
            q, low, high = q[~full], low[~full], high[~full]
        if pairs is not None:
            place, own = pairs
            go = (run[place] > depth) & (tests.left[own] > depth)
            go[go] = token[place[go] + depth] == tests.token[own[go] + depth]
            ended.append((place[~go], own[~go], np.full(int((~go).sum()), depth)))
            pairs = (place[go], own[go]) if go.any() else None
        if not len(q) and pairs is None:
            break
        if len(q):

            def word(i: np.ndarray, depth: int = depth) -> np.ndarray:
                p = array[i]
                return np.where(run[p] > depth, token[np.minimum(p + depth, len(token) - 1)], 0)

            want = tests.token[q + depth]
            low = _bisect(word, low, high, want, False)
            high = _bisect(word, low, high, want, True)
        depth += 1
    none = np.zeros(0, np.int64)
    place, own = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (none, none)
    p, o, n = (np.concatenate(x) for x in zip(*ended, strict=True)) if ended else (none, none, none)
    return place, own, p, o, n


def search(tests: Tests, data: np.ndarray, at: np.ndarray, with_matches: bool) -> tuple[np.ndarray, np.ndarray, list, list, list]:
    """For each text of a shard: words, hit words, sorted ids of items, matches, and the runs of hit words (begin, end)."""
    s, e, first = words(data, at, ALNUM)
    n_docs, n = len(at) - 1, len(s)
    n_words = np.diff(first)
    items, matches, runs = ([[] for _ in range(n_docs)] for _ in range(3))
    n_hit = np.zeros(n_docs, np.int64)
    if not n or not len(tests.item):
        return n_words, n_hit, items, matches, runs
    token = tests.find(hash_spans(data, s, e))
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), n_words)
    # how many known words of the same document stand from here on
    stop = np.minimum.accumulate(np.where(token == 0, np.arange(n), n)[::-1])[::-1]
    run = np.minimum(stop, first[1:][doc]) - np.arange(n)
    place, own, p, o, length = occurrences(tests, token, run, with_matches)
    if not len(place):
        return n_words, n_hit, items, matches, runs
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + tests.need[own], -1)
    hit = np.cumsum(edge[:-1]) > 0
    n_hit = np.bincount(doc[hit], minlength=n_docs)
    begin = np.flatnonzero(hit & (np.concatenate([[True], ~hit[:-1]]) | np.isin(np.arange(n), first)))
    last = np.flatnonzero(hit & (np.concatenate([~hit[1:], [True]]) | np.isin(np.arange(1, n + 1), first)))
    for b, z in zip(begin.tolist(), last.tolist(), strict=True):
        runs[doc[b]].append((b - int(first[doc[b]]), z + 1 - int(first[doc[b]])))
    for d, i in np.unique(np.stack([doc[place], tests.item[own]]), axis=1).T.tolist():
        items[d].append(tests.ids[i])
    items = [sorted(set(x)) for x in items]
    if with_matches:  # those that go no further to the left
        same = (p > first[:-1][doc[p]]) & (tests.before[o] > 0)
        same[same] = token[p[same] - 1] == tests.before[o[same]]
        p, o, length = p[~same], o[~same], length[~same]
        order = np.lexsort((tests.word[o], tests.item[o], p))
        points: dict[int, np.ndarray] = {}
        for b, w, k in zip(p[order].tolist(), o[order].tolist(), length[order].tolist(), strict=True):
            d = int(doc[b])
            if d not in points:
                points[d] = np.concatenate([[0], np.cumsum((data[at[d] : at[d + 1]] & 0xC0) != 0x80, dtype=np.int32)])
            begin, end = (int(points[d][x - at[d]]) for x in (s[b], e[b + k - 1]))
            matches[d].append((tests.ids[tests.item[w]], int(tests.word[w]), b - int(first[d]), k, begin, end))
    return n_words, n_hit, items, matches, runs


def load_tests(benchmark: DataFrame, window: int = WINDOW, most: int = PASS_WORDS) -> Iterator[Tests]:
    """The items, in passes of bounded size. Items without id or words find nothing."""
    rows, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where("item_id is not null and text is not null").toLocalIterator():
        rows.append((r.i, r.text))
        n += len(r.text) // 2 + 1
        if n >= most:
            yield Tests(rows, window)
            rows, n = [], 0
    if rows:
        yield Tests(rows, window)


def _scan(docs: DataFrame, tests: Tests, keep: tuple[str, ...]) -> DataFrame:
    """`keep` (long columns), n_words, n_hit, item_ids, matches, runs for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(tests)
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts(batch.column(k))
            for i, j in blocks(at):
                n_words, n_hit, items, matches, runs = search(shared.value, data[at[i] : at[j]], at[i : j + 1] - at[i], True)
                found = pa.array([[dict(zip(_KEYS, m, strict=True)) for m in x] for x in matches], _MATCH)
                spans = pa.array([[{"a": a, "b": b} for a, b in x] for x in runs], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
                columns = [*(batch.column(c).slice(i, j - i) for c in range(k)), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), found, spans]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_words", "n_hit", "item_ids", "matches", "runs"])

    types = ", ".join(f"{c} long" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{types}, n_words long, n_hit long, item_ids array<string>, matches {MATCH}, runs array<struct<a:int,b:int>>")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = PASS_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids array<string>, matches) for each row of docs (doc_id, text, ...).

    Null and empty texts have no words; repeated rows give repeated results; an empty table none, an empty benchmark
    no hits; items without id are left out, items of one id count as one. matches hold the longest verbatim matches of
    as many words as a hit needs: item, first word in item and document, words, and place in code points. A benchmark
    of up to `most` words needs no shuffle: each task reads its documents and the broadcast tests. A larger one takes a
    pass over the documents for each `most` words; the hits of a row are then united by its place.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = ["doc_id", "n_words", "n_hit", "item_ids", "matches"]
    passes = load_tests(benchmark, window, most)
    first = next(passes, None) or Tests([], window)
    more = next(passes, None)
    if more is None:
        return _scan(docs, first, ("doc_id",)).select(*out)
    rows = numbered(docs)
    place = ("doc_id", "__file", "__row")
    base = cut(_scan(rows, first, place), "hits")
    hits = base.where("n_hit > 0").select(*place[1:], "item_ids", "matches", "runs")
    while more is not None:
        hits = hits.unionByName(cut(_scan(rows, more, place).where("n_hit > 0").select(*place[1:], "item_ids", "matches", "runs"), "hits"))
        more = next(passes, None)
    each = lambda name: F.flatten(F.collect_list(name))  # noqa: E731  of one text
    united = hits.groupBy(*place[1:]).agg(F.array_sort(F.array_distinct(each("item_ids"))).alias("item_ids"), each("matches").alias("matches"), each("runs").alias("runs"))
    words_ = F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["a"], x["b"] - 1))))
    united = united.select(*place[1:], "item_ids", "matches", F.size(words_).cast("long").alias("n_hit"))
    found = base.select(*place, "n_words").join(united, list(place[1:]), "left")
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("matches", F.array().cast(MATCH)).alias("matches"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = PASS_WORDS) -> DataFrame:
    """docs without the rows whose text holds a window of any item; columns stay. Needs a `text` column.

    Rows with null or empty texts stay, repeated rows stay or go together; an empty benchmark takes nothing.
    """
    spark, schema, k = docs.sparkSession, docs.schema, docs.columns.index("text")
    for one in load_tests(benchmark, window, most):
        tests = spark.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = texts(batch.column(k))
                clean = [search(tests.value, data[at[i] : at[j]], at[i : j + 1] - at[i], False)[1] == 0 for i, j in blocks(at)]
                yield batch.filter(pa.array(np.concatenate(clean) if clean else np.zeros(0, bool)))

        docs = docs.mapInArrow(run, schema)
    return docs


def digest(reported: DataFrame) -> DataFrame:
    return reported.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
