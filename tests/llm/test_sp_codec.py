"""Encoding against a brute-force best path, and exact round trips."""

import numpy as np
import sentencepiece

from lodeseek.llm import sp_codec
from lodeseek.llm.queries import QUERIES


def brute(pieces, text):
    """Best total score over all segmentations of ' ' + text, tried piece by piece."""
    if not text:
        return 0.0
    t = " " + text
    best = [0.0] + [-np.inf] * len(t)
    for k in range(1, len(t) + 1):
        for n in range(1, min(k, 20) + 1):
            got = pieces.score.get(t[k - n : k])
            if got:
                best[k] = max(best[k], best[k - n] + got[1])
        if t[k - 1] not in pieces.score:
            best[k] = max(best[k], best[k - 1] + pieces.unknown)
    return best[-1]


def score_of(pieces, ids):
    by_id = {i: s for i, s in pieces.score.values()}
    spelled = b"".join(pieces.spelled[i] if i in set(pieces.byte) else b"" for i in ids).decode()
    return sum(by_id.get(i, 0.0) for i in ids) + len(spelled) * pieces.unknown


TEXTS = ["", None, " ", "  a   b ", "line\nline\n\n x", "café ▁ ▁x <0x0A> </s> <unk>", "你好\U0001f600\U0001f3fd", "\x00\t\r", "the of and " * 30_000, "x" * 100_000, " " * 5000 + "y"]


def test_edges(spark):
    pieces = sp_codec.Pieces.read(sp_codec.MODEL)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "k")], "doc_id long, text string, n_tokens string")
    enc = sp_codec.encode(df, check=True)
    rows = enc.collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.round_trip for r in rows)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        if len(text) < 20_000:
            assert abs(score_of(pieces, r.token_ids) - brute(pieces, text)) < 1e-6 * max(1, abs(brute(pieces, text)))
    back = {r.doc_id: r.text for r in sp_codec.decode(enc).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    theirs = sentencepiece.SentencePieceProcessor(model_file=sp_codec.MODEL)
    for r in rows:
        if TEXTS[r.doc_id] and sp_codec.BLANK not in TEXTS[r.doc_id] and "\x00" not in TEXTS[r.doc_id]:
            assert theirs.decode(list(r.token_ids)) == TEXTS[r.doc_id]
    assert sp_codec.encode(df.limit(0)).count() == 0


def test_table(spark, sf_dir):
    pieces = sp_codec.Pieces.read(sp_codec.MODEL)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op7_sp_codec"](spark, sf_dir).collect()
    assert len(rows) == len(text) and all(r.round_trip for r in rows)
    for r in rows:
        assert r.n_tokens == len(r.token_ids)
        assert abs(score_of(pieces, r.token_ids) - brute(pieces, text[r.doc_id])) < 1e-6 * abs(brute(pieces, text[r.doc_id]))
