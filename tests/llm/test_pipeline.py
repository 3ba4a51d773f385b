"""Every stage of the pipeline against a plain version of it on its own input, and what must stay or go."""

import random

import pytest

import corpus_pipeline as P
from lodeseek.llm import sp_codec
from tests.llm.test_decontaminate import expected as contaminated
from tests.llm.test_line_dedup import components as line_components
from tests.llm.test_ngram_join import expected as near


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage over sf0.001."""
    d, at = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, d).write.parquet(f"{at}/{k}")
        out = spark.read.parquet(f"{at}/{k}")
        seen.append((name, docs.collect(), out.collect(), out.columns))
        docs = out
    return seen


def test_columns(stages):
    for name, _, _, columns in stages[:-1]:
        assert columns == list(P.COLUMNS), name


def test_quality(stages, spark):
    _, before, after, _ = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert all(tuple(r) in {tuple(x) for x in before} for r in after)
    good, bad = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in bad) <= 0.3 * len(bad)


def test_lines(stages):
    _, before, after, _ = stages[1]
    want = line_components([(r.doc_id, r.text) for r in before])
    gone = {k for k, v in want.items() if k != v}
    left = {r.doc_id: r for r in after}
    for r in before:
        text = "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, k) not in gone)
        if r.doc_id not in left:
            assert not text.strip()
        else:
            assert left[r.doc_id].text == text and left[r.doc_id].n_chars == len(text)


def test_run_is_its_stages(stages, spark):
    got = sorted((r.doc_id, list(r.token_ids)) for r in P.run(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted((r.doc_id, list(r.token_ids)) for r in stages[4][2])


def test_near_duplicates(stages):
    _, before, after, _ = stages[2]
    want = {c for _, _, c in near([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(want)


def test_decontamination(stages, spark):
    _, before, after, _ = stages[3]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    want = [d for d, *_, hit in contaminated([(r.doc_id, r.text) for r in before], items) if not hit]
    assert sorted(r.doc_id for r in after) == sorted(want)


def test_tokens(stages):
    _, before, after, _ = stages[4]
    text = {r.doc_id: r.text for r in before}
    codec = sp_codec.Pieces.read(sp_codec.MODEL).ready()
    assert len(after) == len(text)
    assert all(codec.decode(list(r.token_ids)).decode() == text[r.doc_id] and r.n_tokens == len(r.token_ids) for r in after)


def test_edges(spark, tmp_path):
    """Nulls, empty texts, repeated rows and empty tables pass all stages."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id at all in this row", "en", "s", 24)] + [(4, "one line of text stands here twice", "en", "s", 34)] * 2 + [(5, "\n \n", "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, part in (("full", rows), ("none", [])):
        d = tmp_path / name
        spark.createDataFrame(part, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = sorted((r.doc_id is None, r.doc_id or 0) for r in P.run(spark, str(d)).collect())
        assert got == ([(False, 1), (False, 2), (False, 4), (False, 5), (True, 0)] if part else [])


def test_long_texts_and_ties(spark, tmp_path):
    """A text of some megabytes, one line of a megabyte, and rows that tie in all but their id."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    long, one = "\n".join(line(40) for _ in range(12_000)), line(180_000)
    tie = "\n".join(line(20) for _ in range(3))
    rows = [(1, long), (2, one), (5, tie), (4, tie), (4, tie), (3, "\n".join(long.split("\n")[:100])), (None, line(30))]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t), "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, gone string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, line(30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r.doc_id: r.n_tokens for r in P.run(spark, d).collect()}
    assert set(got) == {1, 2, 4, None} and min(got[1], got[2]) > 200_000
