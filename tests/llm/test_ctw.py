"""Context-tree weighting against a direct recursive tree, and the base score against plain counting."""

import math
import zlib
from collections import Counter

import numpy as np

from lodeseek.llm import ctw
from lodeseek.llm.queries import QUERIES

SPACE = " \t\n\v\f\r"


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE[1:]:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def check_base(rows, got):
    counts = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*split(t), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (i if i is not None else -1, len(split(t)) + 1, sum(counts[w] > 0 for w in [*split(t), None]), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*split(t), None])) for i, t in rows
    )
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.base_score) for r in got)
    assert len(want) == len(have)
    for a, b in zip(want, have, strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 * max(1, abs(a[3]))
    assert all(r.train_tokens == n and r.score < 0 for r in got)


def tree_score(train, text, depth):
    """Mixes node by node, from dictionaries of bit counts."""
    counts = {}

    def steps(t):
        b = bytes(depth) + t.encode() + b"\xff"
        for k in range(depth, len(b)):
            for i in range(8):
                yield b[k - depth : k][::-1], (1 << i) | (b[k] >> (8 - i)), (b[k] >> (7 - i)) & 1

    for t in train:
        for ctx, pre, bit in steps(t):
            for d in range(depth + 1):
                counts.setdefault((ctx[:d], pre), [0, 0])[bit] += 1
    children = {}
    for ctx, pre in counts:
        if ctx:
            children.setdefault((ctx[:-1], pre), []).append((ctx, pre))
    memo = {}

    def kt(key):
        a, b = counts.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(key):
        if key not in memo:
            own = kt(key)
            memo[key] = own if len(key[0]) == depth else math.log(0.5) + np.logaddexp(own, sum(map(pw, children.get(key, ()))))
        return memo[key]

    def p(ctx, pre, bit, d):
        a, b = counts.get((ctx[:d], pre), (0, 0))
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == depth:
            return own
        stop = math.exp(math.log(0.5) + kt((ctx[:d], pre)) - pw((ctx[:d], pre)))
        return stop * own + (1 - stop) * p(ctx, pre, bit, d + 1)

    return sum(math.log10(p(ctx, pre, bit, 0)) for ctx, pre, bit in steps(text))


def test_small(spark):
    texts = ["abracadabra abracadabra", "the cat sat", None, "", "The CAT\tsat on\x0bé\U0001f600", "zzz unseen", "the cat sat"] * 3
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, "cat")]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = ctw.score(df).collect()
    check_base(rows, got)
    train = [t or "" for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        want = tree_score(train, text, ctw.DEPTH)
        assert abs(r.score - want) < 1e-6 * max(1, abs(want)), text
    assert ctw.score(df.limit(0)).count() == 0
    nothing = ctw.score(df.where("doc_id = 5"), 1, 0).first()  # all held out
    assert abs(nothing.score + math.log10(2) * 8 * 11) < 1e-9 and nothing.n_known == 0


def test_rare_words_are_joined(spark):
    rows = [(i, f"common common w{i} w{i // 2} held{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old, ctw.HEAD = ctw.HEAD, 3
    try:
        check_base(rows, ctw.score(df).collect())
    finally:
        ctw.HEAD = old


def test_many_strings_keep_the_depth(spark, monkeypatch):
    """Beyond STRINGS distinct byte strings the context stays as deep; rare strings' probabilities are joined."""
    monkeypatch.setattr(ctw, "STRINGS", 40)
    rows = [(i, f"the cat {i % 7} sat on mat {i} é") for i in range(60)] + [(60, None), (61, "zzz zzz zzz")]
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    check_base(rows, got)
    train = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    for r in got:
        want = tree_score(train, dict(rows)[r.doc_id] or "", ctw.DEPTH)
        assert abs(r.score - want) < 1e-6 * abs(want)


def test_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op9_ctw"](spark, sf_dir).collect()
    check_base(rows, got)
    held = [r.bits_per_byte for r in got if r.held_out]
    assert sum(held) / len(held) < 3.5


def test_whole_texts_of_the_table(spark, sf_dir):
    """The scores of whole documents against the recursive tree, some seen in training and some not."""
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars between 300 and 5000").orderBy("doc_id").limit(24).select("doc_id", "text")
    rows = [tuple(r) for r in some.collect()]
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.held_out for r in got} == {True, False}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    picked = [r for r in got if r.held_out][:3] + [r for r in got if not r.held_out][:3]
    for r in picked:
        want = tree_score(train, dict(rows)[r.doc_id], ctw.DEPTH)
        assert abs(r.score - want) < 1e-6 * abs(want)
