"""The Jaccard join against all pairs in plain Python."""

import random
import re

import numpy as np

from lodeseek.llm import ngram_join
from lodeseek.llm.queries import QUERIES


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    """Union-find over all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    by, up = {}, list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        count = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    count[j] = count.get(j, 0) + 1
        for j, n in count.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[find(i)] = find(j)
                seen.add((i, j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, size int").repartition(3)
    got = sorted(tuple(r) for r in ngram_join.components(df).collect())
    assert got == expected(rows)
    return df


def edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_planted(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for size in (1, 3, 5, 6, 8, 15, 20, 40, 150, 900):  # near copies around the threshold, across size bands
        base = fresh(size)
        rows += [edited(base, k, rng) for k in range(0, max(2, size // 8)) for _ in range(2)]
        rows += [" ".join(base + fresh(size // 4)), " ".join(base[: max(1, 3 * size // 4)])]
    passage = fresh(60)
    rows += [" ".join(fresh(30) + passage + fresh(30)) for _ in range(60)]  # a shared passage is no link
    hub = fresh(146)
    rows += [edited(hub, rng.randrange(12), rng) for _ in range(150)]  # a group in which most pairs are unlinked
    rows += ["same text of seven words in all"] * 70 + ["", None, "  ", "\x1f", "É é", "x" * 100_000, " ".join(fresh(30_000))]
    rows = list(enumerate(rows))
    rows.append(rows[5])
    rng.shuffle(rows)
    df = check(spark, rows)
    want = {c for d, n, c in expected(rows)}
    one = ngram_join.one_of_each(df)
    assert one.columns == df.columns and sorted(r.doc_id for r in one.collect()) == sorted(want)
    assert ngram_join.components(df.limit(0)).count() == 0


def test_a_hot_passage_makes_few_pairs(spark, monkeypatch):
    """Of documents that share a passage, hardly any are compared: pairs do not grow with the square of the group."""
    rng = random.Random(12)
    compared, compare = [], ngram_join.compare_sketched

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(ngram_join, "compare_sketched", counting)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 90))] + passage)) for i in range(400)]
    rows += [(400 + i, rows[i][1] + " tail") for i in range(100)]
    check(spark, rows)
    assert 100 <= sum(compared) <= 3 * len(rows), compared


def test_cells_and_bands():
    """Every set fills more cells at its band's scale than may differ, and linked sets share a key, across bands too."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 5, 15, 16, 17, 63, 64, 65, 200, 1030, 5000):
        for _ in range(20):
            a = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
            keep = rng.permutation(n)[: -(-n * 3 // 4)]
            b = np.sort(np.concatenate([a[keep], rng.integers(0, 2**64, max(0, len(keep) * 4 // 3 - n), dtype=np.uint64)]))
            common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            sets = [a, b]
            h, size = np.concatenate(sets), np.array([len(a), len(b)])
            scales = np.zeros(40, np.int64)
            for band in (ngram_join.band_of(size), ngram_join.band_of(np.maximum(-(-size * 75 // 100), 1))):
                need = ngram_join.needed_scale(h, size, band, 75)
                np.maximum.at(scales, band, need)
                own = np.repeat([0, 1], size)
                cells = ngram_join.filled(h, own, ngram_join.cells_of(h, band[own], need[own]), 2)
                assert (cells > ngram_join.most_apart(size, 75)).all()
            keys, node, _ = ngram_join.keys_of(h, size, np.array([1, 2]), np.ones(1 << 16, np.uint8), scales, 75)
            if 100 * common >= 75 * union:
                assert set(keys[node == 1].tolist()) & set(keys[node == 2].tolist()), n


def test_hot_keys_are_spread(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, edited(base, rng.randrange(8), rng)) for i in range(300)]
    old, ngram_join.HOT = ngram_join.HOT, 3
    try:
        check(spark, rows)
    finally:
        ngram_join.HOT = old


def test_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op4_ngram_join"](spark, d).collect()) == expected(rows)
