"""Held-out accuracy of the quality classifier, and its edge cases."""

import zlib

import numpy as np
import pyarrow as pa

from lodeseek.llm import quality
from lodeseek.llm.bytetext import texts
from lodeseek.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = QUERIES["op6_quality"](spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    low = [p for a, p in held if a == 0]
    assert low and sum(low) / len(low) < 0.3


def test_edges(spark):
    texts = ["Good plain words stand in this line.\nAnd some more of them.", "x | y | z | # |", "", None, "a" * 200_000, "é \U0001f600"]
    docs = spark.createDataFrame([(i, texts[i % 6], "en", "s", 1, 0.5) for i in range(60)] + [(None, "no id", "en", "s", 1, 0.5)], "doc_id long, text string, lang string, source string, n_chars int, score double")
    labels = spark.createDataFrame([(i, int(i % 6 != 1), 0) for i in range(60)] + [(2, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 61 and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score(docs.limit(0), model).count() == 0
    assert {r.score for r in quality.score(docs, quality.learn(docs, labels.limit(0))).collect()} == {1.0}
    assert quality.learn(docs.limit(0), labels).weights is None
    twice = quality.learn(docs.unionByName(docs).repartition(3), labels.unionByName(labels))
    assert abs(twice.prior - model.prior) < 0.2 and np.isfinite(twice.weights).all()


def planted(n, prior, seed):
    """Features of n unlabelled rows, of which a share `prior` is positive, and of n // 2 positives."""
    rng = np.random.default_rng(seed)

    def rows(k, positive):
        x = rng.normal(0, 1, (k, quality.WIDTH))
        x[:, 0] += 3 * positive
        x[:, 3] -= 2 * positive
        return x.astype(np.float16)

    own = rng.random(n) < prior
    return np.concatenate([rows(1, o) for o in own]), rows(n // 2, 1), own


def test_risk_and_prior(spark):
    """The fit minimises the non-negative risk as written out here, and the prior comes from positives and unlabelled rows alone."""
    for prior in (0.3, 0.8):
        u, p, own = planted(3000, prior, 3)
        rows = [(False, k % 2, x.tobytes()) for k, x in enumerate(u)] + [(True, k % 2, x.tobytes()) for k, x in enumerate(p)]
        sums = quality.Sums(spark.createDataFrame(rows, "p boolean, part int, x binary").repartition(3))
        model = quality.Classifier(np.zeros(quality.WIDTH, np.float32), np.ones(quality.WIDTH, np.float32), None, 0.5)
        assert abs(quality.estimate_prior(sums, model) - prior) < 0.08
        w = quality.fit(sums, model, prior, 25)
        zp, zu = model.inputs(p).astype(float), model.inputs(u).astype(float)
        decay = quality.DECAY + quality.MORE / len(p)

        def risk(w):
            loss = lambda z, y: np.log1p(np.exp(-y * (z @ w))).mean()
            return prior * loss(zp, 1) + max(0, loss(zu, -1) - prior * loss(zp, -1)) + decay / 2 * w @ w

        rng = np.random.default_rng(1)
        assert all(risk(w) <= risk(w + d) + 1e-4 for d in rng.normal(0, 0.05, (40, len(w))))
        assert np.mean((zu @ w > 0) == own) > 0.85


def test_features_of_long_texts_in_pieces(monkeypatch):
    """What is counted in pieces is the same as at once; texts do not run into one another."""
    some = ["Plain words, and some more.\nA second line!", "", "a", "ab", "é | # |\n\n| x |" * 300, "word " * 2000]
    data, at = texts(pa.array(some))
    whole = quality.features(data, at)
    monkeypatch.setattr(quality, "BLOCK", 97)
    assert np.allclose(quality.features(data, at), whole)
    each = np.concatenate([quality.features(*texts(pa.array([t]))) for t in some])
    assert np.allclose(each, whole, atol=1e-6)
