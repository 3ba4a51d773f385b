"""LM scoring by context-tree weighting over bytes.

Each byte is eight binary decisions, each in the context of the bytes before it (to DEPTH) and of its own earlier bits.
Every context node has a Krichevsky-Trofimov estimate of its decisions; at every node that estimate and the product of
the longer contexts' estimates are mixed half and half, bottom up over the training counts. The posterior weights of
that mixture give the probability of every further decision: the code length of a text.

The counts are those of byte strings of DEPTH + 1 over the whole corpus. Strings that only other texts have are in the
table with count 0, so every string of the corpus has its probability and scoring is a look-up. The table stays
distributed, by the nearest SPLIT bytes of context: deeper nodes lie within one bucket, the few above are summed up.
Only the frequent strings' probabilities are broadcast, those of the others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import SPACED, Lookup, binaries, blocks, hash_spans, merged, mix, tally, texts, words
from .common import crc_rest, cut, parts

#: Bytes of context; 5 * 8 bits and a document's number share a word of 64 bits.
DEPTH = 4
#: Levels of context above those that buckets finish: 256**SPLIT nodes' worth of decisions at most on the driver.
SPLIT = 2
#: Most byte strings whose probabilities are broadcast (16 bytes each); the occurrences of rarer strings are joined.
STRINGS = 1 << 22
#: Most words whose counts are broadcast; the occurrences of rarer words are joined.
HEAD = 1 << 19
END = 255  # no byte of UTF-8

COUNTS = "kind int, key long, n long"


def strings(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings that end at each byte and at the end of each text (packed, latest byte lowest), by text."""
    n, docs = len(data), len(at) - 1
    size = np.diff(at)
    out = np.zeros(n + docs * (depth + 1), np.uint64)
    doc = np.repeat(np.arange(docs), size)
    out[np.arange(n) + doc * (depth + 1) + depth] = data
    ends = at[1:] + np.arange(1, docs + 1) * (depth + 1) - 1
    out[ends] = END
    packed = out.copy()
    for j in range(1, depth + 1):
        packed[j:] |= out[:-j] << np.uint64(8 * j)
    keep = np.ones(len(out), bool)
    begins = at[:-1] + np.arange(docs) * (depth + 1)
    keep[(begins[:, None] + np.arange(depth)).reshape(-1)] = False
    return packed[keep], size + 1


def count(docs: DataFrame, held: str, depth: int) -> DataFrame:
    """(kind, key, n): kind 0 words and 1 byte strings, pre-aggregated per batch, then summed. Held-out rows count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts(batch.column(0))
            learn = ~np.array(batch.column(1), dtype=bool)
            got: list[list] = [[], []]
            for i, j in blocks(at, 2 << 20):
                own = at[i : j + 1] - at[i]
                part = data[at[i] : at[j]]
                s, e, first = words(part, own, SPACED)
                use = np.repeat(learn[i:j], np.diff(first))
                got[0].append(tally(hash_spans(part, s[use], e[use])))
                packed, size = strings(part, own, depth)
                use = np.repeat(learn[i:j], size)
                got[1].append(tally(packed[use]))
                if not learn[i:j].all():
                    keys, n = tally(packed[~use])
                    got[1].append((keys, np.zeros_like(n)))
                del packed, use
            for kind, found in enumerate(got):
                keys, n = merged(found) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["kind", "key", "n"])

    return docs.select("text", held).mapInArrow(run, COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series after shifting x up."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of such counts in any one order under the Krichevsky-Trofimov estimate."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def decision(packed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit k of each string's last byte, and the bits before it under a leading 1."""
    last = packed & np.uint64(255)
    bit = ((last >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
    return bit, (np.uint64(1) << np.uint64(k)) | (last >> np.uint64(8 - k))


def nodes_of(packed: np.ndarray, prefix: np.ndarray, d: int) -> np.ndarray:
    """The node of each string's decision in the context of d bytes."""
    return (((packed >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | prefix


def mixed(own: np.ndarray, under: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of a node that has children, and the posterior weight of stopping there."""
    total = math.log(0.5) + np.logaddexp(own, under)
    return total, np.exp(math.log(0.5) + own - total)


def weigh(packed: np.ndarray, n: np.ndarray, depth: int, split: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """For whole contexts of `split` bytes: each string's eight probabilities as mixed from `depth` up to `split`, and what
    the nodes of split - 1 bytes get from them (node, zeros, ones, sum of the log probabilities below).
    """
    out, up = np.zeros((len(packed), 8)), []
    for k in range(8):
        bit, prefix = decision(packed, k)
        below: tuple[np.ndarray, np.ndarray] | None = None
        for d in range(depth, split - 1, -1):
            _, one, node = np.unique(nodes_of(packed, prefix, d), return_index=True, return_inverse=True)
            zeros, ones = (np.bincount(node, weights=np.where(bit == b, n, 0), minlength=len(one)) for b in (False, True))
            total, stop = log_kt(zeros, ones), np.ones(len(one))
            if below is not None:
                child, value = below
                total, stop = mixed(total, np.bincount(node[child], weights=value, minlength=len(one)))
            below = (one, total)
            out[:, k] = stop[node] * ((np.where(bit, ones[node], zeros[node]) + 0.5) / ((zeros + ones)[node] + 1)) + (1 - stop[node]) * out[:, k]
        if split:
            key, at = np.unique(nodes_of(packed, prefix, split - 1)[one], return_inverse=True)
            up.append((key, *(np.bincount(at, weights=x, minlength=len(key)) for x in (zeros, ones, total))))
    return out, tuple(np.concatenate(x) for x in zip(*up, strict=True)) if up else (np.zeros(0, np.uint64), *[np.zeros(0)] * 3)


def tops(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, under: np.ndarray, split: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By depth from split - 1 to 0, for all nodes: posterior weight of stopping, zeros, ones. Takes the sums of `weigh`."""
    out = []
    for d in range(split - 1, -1, -1):
        z, o, u = (np.bincount(node, weights=x, minlength=1 << (8 * d + 8)) for x in (zeros, ones, under))
        total, stop = mixed(log_kt(z, o), u)
        out.append((stop, z, o))
        node = np.arange(len(z)) & ((1 << (8 * d)) - 1)  # without the byte furthest back
        zeros, ones, under = z, o, total  # 0 for a node without counts
    return out


def probabilities(grams: DataFrame, depth: int) -> DataFrame:
    """(key, n, value): each byte string with its count and the log10 probability of its last byte. grams: (key, n), stored."""
    spark, split = grams.sparkSession, min(SPLIT, depth)
    buckets = max(parts(spark), grams.count() >> 18)  # whole contexts of SPLIT bytes, so no more than 2**24 strings to one
    names = ["key", "n", "p", "node", "zeros", "ones", "under"]

    def deep(table: pa.Table) -> pa.Table:
        key, n = table["key"].to_numpy(), table["n"].to_numpy()
        p, (node, *sums) = weigh(key.view(np.uint64), n, depth, split)
        rows = pa.table([pa.array(key), pa.array(n), binaries(p.reshape(-1), np.full(len(p), 8)), *[pa.nulls(len(p), t) for t in (pa.int64(), *[pa.float64()] * 3)]], names)
        more = pa.table([*[pa.nulls(len(node), t) for t in (pa.int64(), pa.int64(), pa.binary())], pa.array(node.astype(np.int64)), *map(pa.array, sums)], names)
        return pa.concat_tables([rows, more])

    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * split)) - 1).cast("long"))
    dealt = grams.select("key", "n", F.pmod(F.xxhash64(context), F.lit(buckets)).alias("bucket"))
    made = cut(dealt.groupBy("bucket").applyInArrow(deep, "key long, n long, p binary, node long, zeros double, ones double, under double"), "strings")
    sums = made.where("node is not null").groupBy("node").agg(*[F.sum(c).alias(c) for c in names[4:]]).toArrow()  # 65,536 rows at most
    above = spark.sparkContext.broadcast(tops(*(sums[c].to_numpy() for c in names[3:]), split))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(0).to_numpy().view(np.uint64)
            low = np.concatenate([np.frombuffer(x.as_buffer(), float) for x in batch.column(2)]).reshape(-1, 8) if len(packed) else np.zeros((0, 8))
            out = np.zeros(len(packed))
            for k in range(8):
                bit, prefix = decision(packed, k)
                p = low[:, k]
                for d, (stop, zeros, ones) in zip(range(split - 1, -1, -1), above.value, strict=True):
                    at = nodes_of(packed, prefix, d).astype(np.int64)
                    p = stop[at] * ((np.where(bit, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)) + (1 - stop[at]) * p
                out += np.log10(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["key", "n", "value"])

    return made.where("node is null").select("key", "n", "p").mapInArrow(finish, "key long, n long, value double")


class Model:
    """The frequent byte strings with their log10 probabilities, and the counts of the frequent words."""

    def __init__(self, packed: np.ndarray, value: np.ndarray, depth: int, words_: np.ndarray, counts: np.ndarray, tokens: int, kinds: int, ends: int):
        self.depth = depth
        hashed = mix(packed)
        order = np.argsort(hashed)
        self.find, self.value = Lookup(hashed[order], 1), np.concatenate([[0.0], value[order]])
        order = np.argsort(words_)
        self.word, self.count = Lookup(words_[order], 1), np.concatenate([[0], counts[order]])
        self.tokens, self.kinds, self.ends = tokens, kinds, ends

    def base(self, c):
        return np.log10((c + 1) / (self.tokens + self.kinds + 1))


def level() -> Column:
    """Eighths of a power of two in the count; -1 for none."""
    return F.when(F.col("n") > 0, F.floor(F.log2(F.col("n").cast("double")) * 8)).otherwise(F.lit(-1))


def frequent(counted: DataFrame, room: int) -> Column:
    """Whether a row of (key, n) is of the most frequent ones, `room` at most."""
    by_level = sorted(((r.level, r.k) for r in counted.groupBy(level().alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least = math.inf
    for at, k in by_level:  # a few hundred rows
        if k > room:
            break
        room, least = room - k, at
    return level() >= F.lit(float(least))


def fit(docs: DataFrame, held: str, depth: int = DEPTH) -> tuple[Model, DataFrame]:
    """The model, and the table (kind, key, n, value) of words and byte strings too rare for it. docs: (text, held boolean)."""
    counted = cut(count(docs, held, depth), "counts")
    words_ = counted.where("kind = 0").select("key", "n")
    tokens, kinds = words_.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = docs.where(f"not {held}").count()
    kinds += bool(ends)
    often = frequent(words_, HEAD)
    head = _columns(words_.where(often), "n")
    grams = counted.where("kind = 1").select("key", "n")
    likely = probabilities(grams, depth)
    common = frequent(grams, STRINGS)
    packed, value = _columns(likely.where(common), "value")
    model = Model(packed.view(np.uint64), value, depth, head[0].view(np.uint64), head[1], tokens + ends, kinds, ends)
    base = F.log10((F.col("n") + 1) / F.lit(float(model.tokens + model.kinds + 1)))
    rare = words_.where(~often).select(F.lit(0).alias("kind"), "key", "n", base.alias("value"))
    return model, rare.unionByName(likely.where(~common).select(F.lit(1).alias("kind"), "key", "n", "value"))


def _columns(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    got = df.select("key", value).toArrow()
    return got["key"].to_numpy(), got[value].to_numpy()


def rare_rows(missed: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """For each of n texts what the model lacks, as (kind, key, tf). missed: by kind, keys and the texts they are in, ascending."""
    text, kind, key, tf = [], [], [], []
    for k, (keys, own) in enumerate(missed):
        order = np.lexsort((keys, own))
        keys, own = keys[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])) if len(keys) else np.zeros(0, np.int64)
        text.append(own[first])
        kind.append(np.full(len(first), k, np.int32))
        key.append(keys[first])
        tf.append(np.diff(np.append(first, len(keys))))
    text = np.concatenate(text)
    order = np.argsort(text, kind="stable")
    kind, key, tf = (np.concatenate(x)[order] for x in (kind, key, tf))
    rows = pa.StructArray.from_arrays([pa.array(kind, pa.int32()), pa.array(key.view(np.int64)), pa.array(tf, pa.int64())], ["kind", "key", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)), rows)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<struct<kind:int,key:bigint,tf:bigint>>"


def score(docs: DataFrame, modulus: int = 7, rest: int = 2, depth: int = DEPTH) -> DataFrame:
    """One row per row of docs (doc_id, text): the unigram base score and the context-tree score, both log10.

    Learns from the rows whose crc32(doc_id as text) mod `modulus` is not `rest` (null ids: learnt from). Null texts are
    empty: one end token, and one end byte to code. bits_per_byte counts the end as a byte. Without any row to learn
    from, every decision has probability 1/2. Repeated rows count repeatedly; an empty table gives no rows. The
    heads of the byte strings (STRINGS) and of the words (HEAD) bound what is broadcast; rarer ones are joined, each once
    for a text, and being rare they form no hot key.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(crc_rest(F.col("doc_id"), modulus) == rest, F.lit(False)).alias("held_out"))
    spark = docs.sparkSession
    model, rare = fit(docs, "held_out", depth)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, at = texts(batch.column(1))
            for i, j in blocks(at, 1 << 20):
                own = at[i : j + 1] - at[i]
                part = data[at[i] : at[j]]
                s, e, first = words(part, own, SPACED)
                h = hash_spans(part, s, e)
                c = m.count[m.word(h)]
                seen = c > 0
                logs = np.concatenate([[0.0], np.cumsum(np.where(seen, m.base(c), 0.0))])
                known = np.concatenate([[0], np.cumsum(seen)])
                packed, size = strings(part, own, m.depth)
                at_ = m.find(mix(packed))
                value = m.value[at_]
                lost = at_ == 0
                missed = [(h[~seen], np.repeat(np.arange(j - i), np.diff(first))[~seen]), (packed[lost], np.repeat(np.arange(j - i), size)[lost])]
                sums = np.add.reduceat(value, np.cumsum(size) - size) if len(size) else value
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array(np.diff(first) + 1, pa.int64()),
                        pa.array(known[first[1:]] - known[first[:-1]] + (m.ends > 0), pa.int64()),
                        pa.array(logs[first[1:]] - logs[first[:-1]] + m.base(m.ends)),
                        pa.array(sums),
                        pa.array(np.diff(own), pa.int64()),
                        rare_rows(missed, j - i),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "rare"],
                )

    scored = docs.select("doc_id", "text", "held_out").mapInArrow(run, SCORED)
    scored = cut(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")  # stored, so ids are stable
    each = scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.kind", "r.key", "r.tf")
    none = F.log10(F.lit(1 / float(model.tokens + model.kinds + 1)))  # words of held-out texts only
    each = each.join(rare, ["kind", "key"], "left").withColumn("value", F.col("tf") * F.coalesce("value", none))
    is_word = F.col("kind") == 0
    added = each.groupBy("rid").agg(
        F.sum(F.when(is_word, F.col("value"))).alias("more"),
        F.sum(F.when(is_word & (F.col("n") > 0), F.col("tf"))).alias("more_known"),
        F.sum(F.when(~is_word, F.col("value"))).alias("more_score"),
    )
    full = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return scored.join(added, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        full.alias("score"),
        (-full * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
