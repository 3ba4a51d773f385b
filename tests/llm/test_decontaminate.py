"""Decontamination against a direct search for every window."""

import hashlib
import random
import re

import pyarrow as pa

from lodeseek.llm import decontaminate
from lodeseek.llm.bytetext import texts
from lodeseek.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (at := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= at
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_table(spark, sf_dir):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op2_decontaminate"](spark, sf_dir).collect())
    assert got == expected([r[:2] for r in read("documents")], read("benchmark"))
    assert any(r[5] for r in got)


def test_edges(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    items = [(1, ten + " x y"), (2, "W3, w4"), (3, ""), (4, None), (5, "Café noir"), (10, ten), (6, "aa"), (1, ten + " x y")]
    texts = ["", None, ten, f"pre {ten} x y post", "w3 w4", "w3-W4 w3 w5", "café NOIR x", "w0 w1 w2", "aa " * 3, "é" * 100_000 + " " + ten.upper() + " z" * 70_000, "w9", "w3"]
    docs = [(i, t, "w0", 1) for i, t in enumerate(texts)] + [(2, ten, "w0", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, n_hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(df, bench)
    assert sorted(tuple(r) for r in decontaminate.digest(got).collect()) == expected([d[:2] for d in docs], [i for i in items if i[1]])
    m = {r.doc_id: r.matches for r in got.collect()}
    long = [x for x in m[3] if x.item_id == "1"]
    assert [(x.item_word, x.doc_word, x.n_words) for x in long][0] == (0, 1, 12) and texts[3][long[0].start : long[0].end] == ten + " x y"
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, *_, bad in expected([d[:2] for d in docs], [i for i in items if i[1]]) if not bad)
    assert decontaminate.report(df.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_any_size_of_benchmark(spark):
    """Several passes give what one gives, on both sides of a pass's words."""
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([3, 9, 10, 25, 60])))) for i in range(40)]
    docs = []
    for d in range(60):
        w = [rng.choice(pool) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1].split()
            low = rng.randrange(max(1, len(part) - 9))
            k = rng.randrange(len(w) + 1)
            w[k:k] = part[low : low + rng.randrange(9, 40)]
        docs.append((d if d % 7 else 7, " ".join(w)))
    docs += [(None, docs[3][1]), (None, docs[4][1]), (1, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.report(df, bench).collect()
    want = sorted(tuple(r) for r in decontaminate.digest(decontaminate.report(df, bench)).collect() if r.doc_id is not None)
    assert want == expected([d for d in docs if d[0] is not None], items)
    for most in (10**6, 500, 40):
        got = decontaminate.report(df, bench, most=most).collect()
        plain = lambda rows: sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids, sorted(map(tuple, r.matches))) for r in rows)
        assert plain(got) == plain(whole)
        left = decontaminate.decontaminate(df, bench, most=most).collect()
        assert sorted(str(r.doc_id) for r in left) == sorted(str(r.doc_id) for r in whole if not r.n_hit)


def test_longest_matches():
    """Every maximal common run of words that holds a window, against a direct search."""
    rng = random.Random(8)
    for _ in range(30):
        pool = [f"v{i}" for i in range(rng.choice([2, 5, 40]))]
        text = lambda n: [rng.choice(pool) for _ in range(n)]
        items = [text(rng.randrange(1, 30)) for _ in range(4)]
        docs = [text(rng.randrange(0, 60)) + rng.choice(items) + ["unknown"] + text(5) for _ in range(5)]
        tests = decontaminate.Tests([(str(k), " ".join(x)) for k, x in enumerate(items)])
        data, at = texts(pa.array([" ".join(d) for d in docs]))
        got = decontaminate.search(tests, data, at, True)[3]
        for d, found in zip(docs, got, strict=True):
            want = set()
            for k, x in enumerate(items):
                for i in range(len(x)):
                    for j in range(len(d)):
                        if i and j and x[i - 1] == d[j - 1]:
                            continue
                        n = 0
                        while i + n < len(x) and j + n < len(d) and x[i + n] == d[j + n]:
                            n += 1
                        if n >= min(10, len(x)):
                            want.add((str(k), i, j, n))
            assert {m[:4] for m in found} == want and len(found) == len(want)
