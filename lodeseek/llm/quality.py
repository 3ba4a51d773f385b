"""Quality classifier by positive-unlabelled learning.

The text alone is described by its shape (classes of neighbouring characters, words, repetition, lines) and by hashed
words and character trigrams. A logistic model minimises the non-negative unbiased risk of trusted positives and
unlabelled text: prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)). The class prior is estimated from
positives and unlabelled text alone: no set of texts can hold less than prior times its share of the positives, so
the least ratio of shares, over the sets that a first model of positives against unlabelled puts above a threshold, is
a bound, and the estimate. Known negatives are not used. Every document and every learnt label takes part: the model
is fitted by Newton steps whose sums are taken over a stored table of features.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import FOLD, SPACED, U, blocks, distinct, hash_spans, mix, shingles, texts, words
from .common import crc_rest, cut, forget, small_batches

THRESHOLD = 0.7
#: Bytes of text worked on at once.
BLOCK = 1 << 20
#: Buckets of hashed words and of hashed character trigrams.
LEXICAL = 64
#: Weight of the squared parameters (and more of it for few positives: MORE over their number), Newton steps at most, and
#: bins of scores for the prior's estimate.
DECAY, MORE, STEPS, BINS = 3e-3, 1.5, 12, 512
#: Width over which the maximum in the risk is rounded off.
SMOOTH = 0.01
#: Weight of the hashed words and trigrams against the shape.
LEXICAL_SCALE = 0.2
#: Standard deviations allowed for a share in that estimate.
SIGMAS = 1.64
#: Tasks that sum over the features at most: each sends WIDTH**2 numbers to the driver.
TASKS = 32

#: Classes of characters: lower case, capitals, digits, blanks, line ends, stops, other signs, beyond ASCII.
CLASSES = 9
KIND = np.full(256, 6, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 8
KIND[[9, 11, 12, 13, 32]], KIND[10], KIND[[44, 46]], KIND[[33, 59, 58, 63, 39, 45, 34, 40, 41]] = 3, 4, 5, 7
LINE = np.arange(256) != 10


def _share(per_text: np.ndarray, of: np.ndarray) -> np.ndarray:
    return per_text / np.maximum(of, 1)


def _repeats(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By text: distinct hashes, and how often the most frequent one stands."""
    packed = np.sort((text.astype(np.uint64) << U(52)) | (h >> U(12)))
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    own = (packed[first] >> U(52)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, own, np.diff(np.append(first, len(packed))))
    return np.bincount(own, minlength=n), most


def _bytewise(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text: counts of pairs of character classes, and of hashed trigrams of bytes; in pieces of BLOCK bytes."""
    n = len(at) - 1
    grid, grams = np.zeros(n * CLASSES**2, np.int64), np.zeros(n * LEXICAL, np.int64)
    for low in range(0, len(data), BLOCK):
        part = data[low : low + BLOCK + 2]
        text = np.searchsorted(at, np.arange(low, low + len(part)), "right") - 1
        kind = KIND[part]
        size = min(BLOCK, len(part) - 1)
        inside = np.flatnonzero(text[:size] == text[1 : size + 1])
        grid += np.bincount(text[inside] * CLASSES**2 + kind[inside].astype(np.int64) * CLASSES + kind[inside + 1], minlength=len(grid))
        size = min(BLOCK, len(part) - 2)
        if size > 0:
            inside = np.flatnonzero(text[:size] == text[2 : size + 2])
            low_ = FOLD[part].astype(np.uint32)
            h = ((low_[inside] * np.uint32(0x9E3779B1) + low_[inside + 1] * np.uint32(0x85EBCA77) + low_[inside + 2] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(26)
            grams += np.bincount(text[inside] * LEXICAL + h, minlength=len(grams))
    return grid.reshape(n, -1), grams.reshape(n, -1)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of numbers for each text; an empty text has a row of its own kind."""
    n, size = len(at) - 1, np.diff(at)
    grid, grams = _bytewise(data, at)
    s, e, first = words(data, at, SPACED)
    n_words = np.diff(first)
    own = np.repeat(np.arange(n), n_words)
    h = hash_spans(data, s, e)
    length = (e - s).astype(np.float32)
    kinds, most = _repeats(h, own, n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    lexical = np.bincount(own * LEXICAL + (mix(h) >> U(58)).astype(np.int64), minlength=n * LEXICAL).reshape(n, -1)
    h3, t3 = shingles(h, first, 3)
    total3 = np.bincount(t3, minlength=n)
    kinds3 = distinct(h3, t3, n)[1]
    ls, le, lfirst = words(data, at, LINE)
    n_lines = np.diff(lfirst)
    lown = np.repeat(np.arange(n), n_lines)
    lkinds, _ = _repeats(hash_spans(data, ls, le), lown, n)
    kind = KIND[data]
    over = lambda mask: (np.add.reduceat(mask, ls, dtype=np.int64) if len(ls) else np.zeros(0)) / np.maximum(le - ls, 1)  # noqa: E731  line ends are neither
    odd_most, loud_most = np.zeros(n), np.zeros(n)
    np.maximum.at(odd_most, lown, over((kind == 6) | (kind == 7)))
    np.maximum.at(loud_most, lown, over(kind == 1))
    extra = [
        np.log1p(n_words) / 8,
        _share(np.bincount(own, weights=length, minlength=n), n_words) / 10,
        _share(kinds, n_words),
        _share(most, n_words),
        _share(np.bincount(own, weights=again, minlength=n), n_words),
        _share(kinds3, total3),
        _share(lkinds, n_lines),
        np.log1p(n_lines) / 5,
        odd_most,
        loud_most,
        _share(np.bincount(own, weights=length <= 3, minlength=n), n_words),
        _share(np.bincount(own, weights=length > 14, minlength=n), n_words),
        (n_words == 0).astype(float),
    ]
    shares = [np.sqrt(x / np.maximum(of, 1)[:, None]) for x, of in ((grid, size - 1), (grams, size - 2), (lexical, n_words))]
    return np.column_stack([*shares, *extra]).astype(np.float32)


WIDTH = CLASSES**2 + 2 * LEXICAL + 13


def of_column(column: pa.Array) -> np.ndarray:
    """Features of a column of texts; null is empty."""
    data, at = texts(column)
    got = [features(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in blocks(at, BLOCK)]
    return np.concatenate(got) if got else np.zeros((0, WIDTH), np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


class Classifier:
    """A fitted model, or a constant where there is nothing to fit. Scores are probabilities of label 1."""

    def __init__(self, mean: np.ndarray | None, scale: np.ndarray | None, weights: np.ndarray | None, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and a one."""
        z = np.clip((x.astype(np.float32) - self.mean) * self.scale, -5, 5)
        return np.concatenate([z, np.ones((len(z), 1), np.float32)], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.weights is None else sigmoid(self.inputs(x).astype(float) @ self.weights)


class Sums:
    """Sums over the stored features: rows (p boolean, part int, x binary), x holding a float16 row."""

    def __init__(self, table: DataFrame):
        self.table = table.coalesce(TASKS)

    def __call__(self, of: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
        """The totals of what `of` makes of batches (features, p, part); one row a task comes to the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float16).reshape(-1, WIDTH)
                got = of(x, batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy())
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([np.ravel(t) for t in total]).astype(float).tobytes()], pa.binary())], ["sums"])

        shapes = [np.shape(t) for t in of(np.zeros((0, WIDTH), np.float16), np.zeros(0, bool), np.zeros(0, np.int32))]
        rows = self.table.select("p", "part", "x").mapInArrow(run, "sums binary").collect()  # TASKS rows at most
        flat = sorted(r.sums for r in rows)  # the same sum whatever the order of arrival
        size = sum(math.prod(s) for s in shapes)
        total = np.sum([np.frombuffer(f, float) for f in flat], axis=0) if flat else np.zeros(size)
        ends = np.cumsum([math.prod(s) for s in shapes])
        return [t.reshape(s) for t, s in zip(np.split(total, ends[:-1]), shapes, strict=True)]


def fit_against(sums: Sums, model: Classifier, part: int, steps: int = 8) -> np.ndarray:
    """Logistic weights of positives against unlabelled rows of one part, both sides weighing the same."""
    w = np.zeros(WIDTH + 1)
    for _ in range(steps):

        def of(x, p, own, w=w):
            use = own == part
            z, p = model.inputs(x[use]).astype(float), p[use]
            s = sigmoid(z @ w)
            g, c = [z[k].T @ (s[k] - float(one)) for k, one in ((p, True), (~p, False))], s * (1 - s)
            return [*g, *((z[k] * c[k, None]).T @ z[k] for k in (p, ~p)), np.array([p.sum(), (~p).sum()], float)]

        gp, gu, hp, hu, n = sums(of)
        g, h = (0.5 * (a / max(n[0], 1) + b / max(n[1], 1)) for a, b in ((gp, gu), (hp, hu)))
        decay = DECAY + MORE / max(n[0], 1)
        step = np.linalg.solve(h + decay * np.eye(len(w)), g + decay * w)
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    return w


def estimate_prior(sums: Sums, model: Classifier) -> float:
    """The share of positives in unlabelled text, from scores of rows that the scoring model did not learn from."""
    w = fit_against(sums, model, 0)

    def of(x, p, own):
        use = own == 1
        at = np.minimum((sigmoid(model.inputs(x[use]).astype(float) @ w) * BINS).astype(int), BINS - 1)
        return [np.bincount(at[k], minlength=BINS).astype(float) for k in (p[use], ~p[use])]

    positive, unlabelled = (np.cumsum(x[::-1]) for x in sums(of))
    n, m = positive[-1], unlabelled[-1]
    if not n or not m:
        return 1.0
    a, b = positive / n, unlabelled / m
    above, below = b + SIGMAS * np.sqrt(b * (1 - b) / m), a - SIGMAS * np.sqrt(a * (1 - a) / n)  # as far as the shares may be off
    return float(np.clip(np.min(np.where(below > 0, above / np.maximum(below, 1e-9), np.inf)), 0.01, 0.99))


def fit(sums: Sums, model: Classifier, prior: float, steps: int = STEPS) -> np.ndarray:
    """Minimises prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)), logistic loss.

    With that loss both branches of the maximum are convex, so their maximum is: Newton steps on the smoothed maximum
    (SMOOTH), shortened where they do not lower it.
    """
    w, best, least, direction, short = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.inf, None, 1.0
    for _ in range(steps):

        def of(x, p, own, w=w):
            z = model.inputs(x).astype(float)
            odds = z @ w
            s = sigmoid(odds)
            curved = [(z[k] * (s[k] * (1 - s[k]))[:, None]).T @ z[k] for k in (p, ~p)]
            scalars = np.array([softplus(-odds[p]).sum(), softplus(odds[p]).sum(), softplus(odds[~p]).sum(), p.sum(), (~p).sum()])
            return [z[p].T @ (s[p] - 1), z[p].sum(0), z[~p].T @ s[~p], *curved, scalars]

        up, all_p, down, curve_p, curve_u, (plus, minus, minus_u, n, m) = sums(of)
        if not n or not m:
            return w
        decay = DECAY + MORE / n
        bracket = minus_u / m - prior * minus / n
        risk = prior * plus / n + SMOOTH * softplus(bracket / SMOOTH) + decay / 2 * w @ w
        if risk < least:
            gain, best, least, short = least - risk, w, risk, 1.0
            one, two = prior * up / n, down / m - prior * all_p / n  # gradients without and with the bracket
            share = sigmoid(bracket / SMOOTH)
            gradient = (1 - share) * one + share * two + decay * w
            curve = (1 - share) * prior * curve_p / n + share * curve_u / m + share * (1 - share) / SMOOTH * np.outer(two - one, two - one)
            direction = np.linalg.solve(curve + decay * np.eye(len(w)), gradient)
            if gain < 1e-5 or gradient @ direction < 1e-6:
                break
        else:
            short /= 3
        w = best - short * direction
    return best


def _held(modulus: int, rest: int) -> Column:
    return F.coalesce(crc_rest(F.col("doc_id"), modulus) == rest, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2) -> Classifier:
    """Fits on all documents whose crc32(doc_id as text) mod `modulus` is not `rest`, and on the positive labels of such.

    A document is a trusted positive if any of its labels is 1; it counts as unlabelled text, too, as do all others.
    Repeated rows count repeatedly; rows without id are unlabelled. Without positives or documents every score is 1 if
    nothing is labelled, else 0.5.
    """
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality = 1")
    lab = lab.where(~_held(modulus, rest)).select("doc_id", F.lit(True).alias("p")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~_held(modulus, rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = of_column(batch.column(1)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    with small_batches(docs.sparkSession):
        stored = cut(rows.mapInArrow(run, "doc_id long, x binary"), "features")
        part = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
        both = stored.withColumn("part", F.coalesce(part, F.lit(0)))
        positive = both.join(lab, "doc_id").select("p", "part", "x")
        table = cut(both.select(F.lit(False).alias("p"), "part", "x").unionByName(positive), "learnt")
        model = _learn(Sums(table), 1.0 if lab.isEmpty() else 0.5)
    forget(stored, table)
    return model


def _learn(sums: Sums, none: float) -> Classifier:
    def moments(x, p, part):
        x = x[~p].astype(float)
        return [x.sum(0), (x * x).sum(0), np.array([len(x), p.sum()], float)]

    total, squares, (n, positive) = sums(moments)
    if not n or not positive:
        return Classifier(None, None, None, none)
    mean = total / n
    scale = 1 / np.maximum(np.sqrt(np.maximum(squares / n - mean * mean, 0)), 1e-2)
    scale[CLASSES**2 : CLASSES**2 + 2 * LEXICAL] *= LEXICAL_SCALE
    model = Classifier(mean.astype(np.float32), scale.astype(np.float32), None, none)
    model.prior = estimate_prior(sums, model)
    model.weights = fit(sums, model, model.prior)
    return model


def score(docs: DataFrame, classifier: Classifier, modulus: int = 4, rest: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; null and empty texts are scored as empty.

    Repeated rows give repeated results; an empty table gives none; scores of equal texts are equal.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value(of_column(batch.column(2))))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held(modulus, rest).alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns; needs a `text` column.

    Null and empty texts are scored as empty, repeated rows stay or go together, an empty table gives no rows.
    """
    shared, k = docs.sparkSession.sparkContext.broadcast(classifier), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value(of_column(batch.column(k))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
