"""Document fingerprints by threshold-scaled sketches [native].

A sketch keeps every word-shingle hash below a fixed fraction of the hash range. As the threshold is the same for all
documents, sketches merge by union and the share of common hashes estimates containment even between a paragraph and a
book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ascii_lower

#: Words in a shingle; one hash in so many is kept.
WORDS, SCALE = 5, 2
#: Neighbouring ids go to buckets of about so many rows: quantile pieces of the ids, PIECES at most, each cut into
#: equal widths, CUTS at most. What is broadcast to deal out neighbours stays under PIECES * CUTS rows.
ROWS, PIECES, CUTS = 2_000, 256, 256


def hashes(text: Column) -> Column:
    """Hash of every shingle of WORDS words (fewer words: one shingle of all; none: none)."""
    words = F.filter(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def kept(words: Column, scale: int = SCALE) -> Column:
    """The sketch: sorted distinct shingle hashes under the threshold. words: hashes of the words in order."""
    last = F.greatest(F.size(words) - WORDS, F.lit(0))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WORDS)]))
    low = F.lit(-(2**63) + 2**64 // scale).cast("long")
    some = F.array_sort(F.array_distinct(F.filter(each, lambda h: h < low)))
    return F.when(F.size(words) > 0, some).otherwise(F.array().cast("array<bigint>"))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the documents' shingles, 0 if both sketches are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles that the other has, 0 if a sketch is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def merge(sketches: DataFrame, keys: list[str], sketch: str = "sketch") -> DataFrame:
    """(keys, sketch): the sketch of the union of each group's documents.

    Repeated rows change nothing; groups of empty or null sketches only are left out; an empty table gives none. Hashes
    are made distinct in each task before they are shuffled.
    """
    return sketches.select(*keys, F.explode(sketch).alias("h")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("h")).alias(sketch))


def dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket): buckets of neighbouring ids; they ascend with the ids, null ids are in bucket -1."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    pieces = max(1, min(PIECES, n // ROWS))
    bounds = docs.approxQuantile("doc_id", [k / pieces for k in range(pieces + 1)], 0.2 / pieces) or [0.0]
    low = sorted({float(x) for x in bounds[:-1] or bounds})
    cuts = min(CUTS, max(1, n // ROWS // pieces))
    width = [max(1.0, (b - a) / cuts) for a, b in zip(low, [*low[1:], bounds[-1] + 1], strict=True)]
    i = F.col("doc_id").cast("double")
    piece = F.greatest(F.size(F.filter(F.lit(low), lambda x: x <= i)) - 1, F.lit(0))
    inside = F.floor((i - F.get(F.lit(low), piece)) / F.get(F.lit(width), piece))  # grows with the id
    inside = F.least(F.greatest(inside, F.lit(0)), F.lit(cuts - 1))
    return docs.withColumn("bucket", F.when(i.isNull(), -1).otherwise(piece * CUTS + inside).cast("long"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> adds next_text, the text of the next doc_id, after the last that of the first.

    One shuffle moves the texts, to buckets of neighbouring ids; the first row of a bucket also goes to the bucket
    before it. Rows of one doc_id follow each other by text; null ids come first. Only the buckets' first ids, PIECES *
    CUTS at most, are broadcast. If ids are bunched, the quantiles keep a bucket under a 256th of the rows or so; it spills.
    """
    docs = dealt(docs)
    firsts = docs.groupBy("bucket").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("bucket")  # PIECES * CUTS + 1 rows at most
    firsts = firsts.withColumn("before", F.lag("bucket").over(order)).withColumn("last", F.max("bucket").over(Window.partitionBy()))
    firsts = firsts.select(F.col("bucket").alias("own"), "first", F.coalesce("before", "last").alias("before"))
    placed = docs.join(F.broadcast(firsts), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    spots = F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("guest"))))
    spots = spots.otherwise(F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("at"), F.lit(1).alias("guest"))))
    placed = placed.select("doc_id", "text", F.explode(spots).alias("s")).select("doc_id", "text", "s.at", "s.guest")
    w = Window.partitionBy("at").orderBy("guest", "doc_id", "text")
    return placed.withColumn("next_text", F.lead("text").over(w)).where("guest = 0").drop("at", "guest")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds `<name>_sketch` array<bigint> and `<name>` string: shingles, digest of the text, kept hashes.

    Null texts count as empty: no shingles, an empty sketch. Equal texts have equal fingerprints. Columns of docs
    stay.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__words", hashes(t)).withColumn(f"{name}_sketch", kept(F.col("__words")))
    n = F.when(F.size("__words") > 0, F.greatest(F.size("__words") - WORDS + 1, F.lit(1))).otherwise(0)
    hexes = F.array_join(F.transform(f"{name}_sketch", lambda h: F.lower(F.hex(h))), ".")
    return out.withColumn(name, F.concat_ws(":", F.lit(str(SCALE)), n.cast("string"), F.substring(F.md5(t), 1, 16), hexes)).drop("__words")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and their likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document. near_* is
    resemblance, contained_* containment; texts with equal digests have 1, of others those with two empty sketches 0.
    Null texts are empty; rows that tie in their id follow each other by text; a table of one row is its own next;
    an empty table gives no rows.
    """
    pairs = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    pairs = fingerprints(fingerprints(fingerprints(pairs), "edited", "edited_fingerprint"), "next_text", "next_fingerprint")
    same = lambda x: F.substring_index("fingerprint", ":", 3) == F.substring_index(x, ":", 3)
    like = lambda f, x: F.when(same(x), F.lit(1.0)).otherwise(f(F.col("fingerprint_sketch"), F.col(f"{x}_sketch")))
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        like(resemblance, "edited_fingerprint").alias("near_edited"),
        like(resemblance, "next_fingerprint").alias("near_next"),
        like(containment, "edited_fingerprint").alias("contained_edited"),
        like(containment, "next_fingerprint").alias("contained_next"),
    )
