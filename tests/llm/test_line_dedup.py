"""Line dedup against all pairs of lines in plain Python."""

import random

import numpy as np

from lodeseek.llm import line_dedup
from lodeseek.llm.bytetext import hash_spans
from lodeseek.llm.queries import QUERIES


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def lines_of(rows):
    out = []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            s = fold(line).strip(" \t\n\v\f\r")
            if s:
                out.append(((d if d is not None else -1, k), s))
    return sorted(out)


def components(rows):
    """The first line of each line's component, over all pairs that share a shingle."""
    lines = lines_of(rows)
    texts = sorted({s for _, s in lines})
    sets = [{s[i : i + line_dedup.CHARS] for i in range(max(1, len(s) - line_dedup.CHARS + 1))} for s in texts]
    by, up = {}, list(range(len(texts)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, s in enumerate(sets):
        count = {}
        for x in s:
            for j in by.setdefault(x, []):
                count[j] = count.get(j, 0) + 1
            by[x].append(i)
        for j, n in count.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[find(i)] = find(j)
    at = {s: find(i) for i, s in enumerate(texts)}
    first = {}
    for key, s in lines:
        first.setdefault(at[s], key)
    return {key: first[at[s]] for key, s in lines}


def compare(got, rows):
    want = components(rows)
    gone = {(r.doc_id if r.doc_id is not None else -1, r.line): (r.kept_doc_id if r.kept_doc_id is not None else -1, r.kept_line) for r in got}
    expected = {k for k, v in want.items() if k != v}
    assert all(want[k] == want[v] for k, v in gone.items())  # only lines that are linked indeed
    assert set(gone) == expected
    return gone


def test_planted(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    base = [line(n) for n in (5, 8, 12, 20, 40, 60)]
    texts = []
    for k in range(60):
        own = [line(rng.randrange(3, 30)) for _ in range(3)]
        for b in base:
            if rng.random() < 0.5:
                w = b.split(" ")
                for _ in range(len(w) // 12):
                    w[rng.randrange(len(w))] = word()
                own.insert(rng.randrange(len(own) + 1), rng.choice(["", "  "]) + " ".join(w).upper().replace("É", "é") + rng.choice(["", "\r"]))
        texts.append("\n".join(own) + rng.choice(["", "\n"]))
    texts += ["", None, "\n\n\n", "short\nshort\nshort", "x" * 50_000, texts[0], "\U0001f600" * 30 + "\n" + "\U0001f600" * 30]
    rows = [*enumerate(texts), (None, base[3])]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, n_lines int, line string").repartition(3)
    gone = compare(line_dedup.duplicates(df).collect(), rows)
    out = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    for d, t in rows:
        parts = (t or "").split("\n")
        left = [x for k, x in enumerate(parts) if (d if d is not None else -1, k) not in gone]
        assert out[d].text == (None if t is None else "\n".join(left)) and out[d].n_lines == (0 if t is None else len(parts)) and out[d].n_removed == len(parts) - len(left)
    twice = line_dedup.dedup(df.unionByName(df.where("doc_id = 1"))).where("doc_id = 1").collect()
    assert len(twice) == 2 and sorted(r.text.strip() == "" for r in twice) == [False, True]
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    """A line goes from the row that repeats it, and from no other row of the same id or without one."""
    own = ["all alone stands this first line", "and nothing repeats the second one here", "quite another third line of text"]
    both = "here is a line that two of the documents have"
    for ids in ([None, None, None], [2, 2, 2], [None, 2, 2]):
        rows = [(ids[0], f"{own[0]}\n{both}"), (ids[1], f"{own[1]}\n{both.upper()}"), (ids[2], f"{own[2]}\nthe end of it")]
        got = [r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()]
        assert sum(own[k] in t for k in range(3) for t in got) == 3 and sum("the end of it" in t for t in got) == 1
        assert sum(both in t.lower() for t in got) == 1


def test_different_long_lines_stay(spark):
    """Strings that polynomials modulo 2**64 confuse."""
    word = ["a", "b"]
    for _ in range(11):
        word = [word[0] + word[1], word[1] + word[0]]
    rows = [(1, word[0]), (2, word[1]), (3, word[0].upper())]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = {w: {w[i : i + 8] for i in range(len(w) - 7)} for w in word}
    linked = 100 * len(n[word[0]] & n[word[1]]) >= 75 * len(n[word[0]] | n[word[1]])
    assert got == {1: word[0], 2: "" if linked else word[1], 3: ""}
    a, b = (np.frombuffer(w.encode(), np.uint8) for w in word)
    h = hash_spans(np.concatenate([a, b, a]), np.array([0, 2048, 4096]), np.array([2048, 4096, 6144]))
    assert h[0] == h[2] != h[1]
    short = hash_spans(np.concatenate([a[:128], b[:128]]), np.array([0, 128]), np.array([128, 256]))
    assert short[0] != short[1]


def test_long_lines(spark, monkeypatch):
    """Lines longer than what is worked on at once."""
    monkeypatch.setattr(line_dedup, "STEP", 1000)
    monkeypatch.setattr(line_dedup, "BLOCK", 5000)
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh é") for _ in range(70_000)).strip()
    rows = list(enumerate([base, base[:200] + "xyz" + base[200:], base[:60_000], base[:30_000], base[::-1], "short\n" + base[:9]]))
    compare(line_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    for lines in ([base, base[:20], "é" * 9], ["a" * 8], ["\U0001f600b" * 4, "b" * 3000]):
        h, size = line_dedup.distinct_shingles([x.encode() for x in lines])
        assert size.tolist() == [len({x[i : i + 8] for i in range(len(x) - 7)}) for x in lines] and len(h) == size.sum()


def test_hot_lines_and_stored_rows(spark, tmp_path):
    """A third of the rows are one text, another third near copies of one line; parquet rows are named in place."""
    rng = random.Random(2)
    line = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    rows = [(i, "the very same text in a third of all rows\nof two lines") for i in range(200)]
    rows += [(200 + i, line[:7] + "".join(rng.choice("xyz") for _ in range(6)) + line[13:]) for i in range(200)]
    rows += [(400 + i, "".join(rng.choice("klmnopqrs ") for _ in range(60))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/docs")
    compare(line_dedup.duplicates(spark.read.parquet(f"{tmp_path}/docs")).collect(), rows)


def test_recall_at_the_threshold():
    """Signatures of lines at similarity 0.75 share a band nearly always, whatever their length."""
    rng = random.Random(1)
    for n in (14, 35, 140, 700):
        missed = 0
        for _ in range(300):
            line = "".join(chr(rng.randrange(97, 20_000)) for _ in range(n + 7)).encode("utf-8", "replace").decode()
            cut_ = n - n // 7  # shingles of the first part are common
            other = line[: cut_ + 7] + "".join(chr(rng.randrange(20_000, 40_000)) for _ in range(n // 7))
            a, b = line_dedup.band_keys(line_dedup.signatures([line.encode(), other.encode()]))
            missed += not (a == b).any()
        assert missed <= 5, n


def test_spread_keys_meet():
    keys = np.array([5] * 3 + [6] + [7] * 2, np.uint64)
    assert line_dedup.spread_of(keys, 3).tolist() == [1, 16, 16, 0, 0, 0]
    assert line_dedup.spread_of(keys, 7).tolist() == [0] * 6 and not len(line_dedup.spread_of(keys[:0]))


def test_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op8_line_dedup"](spark, sf_dir).collect()
    want = components(rows)
    assert len(got) == len(rows)
    gone = {k for k, v in want.items() if k != v}
    text = dict(rows)
    for r in got:
        assert r.text == "\n".join(x for k, x in enumerate(text[r.doc_id].split("\n")) if (r.doc_id, k) not in gone)
