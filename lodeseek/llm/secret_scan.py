"""Secret scan with corpus-wide ownership frequency [native].

Candidates are found by patterns; the hash of each that looks random is then counted over the whole corpus by distinct
repositories and owners. A value that several owners have is a copied example; one that a single owner has in few
repositories is marked as live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prefix_sums

# The base patterns, in the order of kinds, with the least length of the judged part.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"[A-Za-z0-9_-]{20,}"
#: kind, pattern, group judged, least length of that group, cheap test whether a text can have a match
KINDS = (
    ("assign", ASSIGN, 2, 8, r"(?i)passw|secret|token|api_?key"),
    ("access", ACCESS, 0, 16, "AKIA[A-Z0-9]"),
    ("hex", HEX, 0, 32, HEX),
    ("opaque", OPAQUE, 0, 20, OPAQUE),
)
#: A value that looks random: least characters, letters beside digits, and bits of entropy a character.
LEAST_CHARS, LEAST_GLUED, LEAST_BITS = 16, 2, 3.05
GLUED = "[A-Za-z][0-9]|[0-9][A-Za-z]"
#: Live: one owner, so many repositories at most. Example: so many owners at least.
LIVE_REPOS, EXAMPLE_OWNERS = 2, 3
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,hash:bigint,vstart:int,looks:boolean>>"


def entropy(v: Column) -> Column:
    """Bits a character, by the value's own characters."""
    each, n = F.split(v, ""), F.length(v)
    counts = F.transform(F.array_distinct(each), lambda c: F.size(F.filter(each, lambda x: x == c)) / n)
    return F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def looks_random(v: Column) -> Column:
    """Words and numbers joined by signs (release-2024-notes) do not: their letters stand beside no digits."""
    glued = F.size(F.regexp_extract_all(v, F.lit(GLUED), F.lit(0)))
    return F.when(F.length(v) < LEAST_CHARS, False).when(glued < LEAST_GLUED, False).otherwise(entropy(v) >= LEAST_BITS)


def _spans(text: Column, ord_: int, kind: str, pattern: str, group: int, least: int, test: str) -> Column:
    """Leftmost non-overlapping matches with code point offsets: gaps and matches have alternating lengths."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    steps = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))
    before = prefix_sums(steps)
    z = F.arrays_zip(hits.alias("h"), values.alias("v"), before.alias("s"), F.slice(gaps, F.lit(1), F.size(hits)).alias("g"))
    at = F.transform(
        z,
        lambda x: F.struct(
            (x["s"] + F.length(x["g"])).alias("start"),
            F.lit(ord_).alias("ord"),
            (x["s"] + F.length(x["g"]) + F.length(x["h"])).alias("end"),
            F.lit(kind).alias("kind"),
            F.xxhash64(x["v"]).alias("hash"),
            (x["s"] + F.length(x["g"]) + F.length(x["h"]) - F.length(x["v"])).alias("vstart"),
            (looks_random(x["v"]) & (F.length(x["v"]) >= least)).alias("looks"),
            F.length(x["v"]).alias("vlen"),
        ),
    )
    kept = F.filter(at, lambda x: x["vlen"] >= least)
    kept = F.transform(kept, lambda x: F.struct(*[x[n].alias(n) for n in ("start", "ord", "end", "kind", "hash", "vstart", "looks")]))
    return F.when(text.rlike(test), kept.cast(SPAN)).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, repo: Column | str = "source", owner: Column | str = "source", live_repos: int = LIVE_REPOS, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per row of docs: doc_id, spans array<struct<start,ord,end,kind>> sorted by start, then kind.

    Base spans (assign, access, hex) are the patterns' own. To values that look random (of base matches, or opaque
    strings of 20 characters and more) a span is added: `live` if one owner has the value in the whole corpus, in
    live_repos repositories at most; `example` if example_owners or more have it. repo and owner are columns of docs or
    expressions. Null text has no spans, a null owner or repository counts as one of its own, repeated rows
    give repeated results and count once, and an empty table gives none. A value in a third of all rows is
    pre-aggregated by owner before each shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    got = docs.select(
        "doc_id",
        F.coalesce((F.col(repo) if isinstance(repo, str) else repo).cast("string"), F.lit("")).alias("repo"),
        F.coalesce((F.col(owner) if isinstance(owner, str) else owner).cast("string"), F.lit("")).alias("owner"),
        *[_spans(text, i, *k).alias(k[0]) for i, k in enumerate(KINDS)],
    )
    found = got.select("doc_id", "repo", "owner", F.concat("assign", "access", "hex").alias("base"), "opaque")
    found = cut(found.withColumn("rid", F.monotonically_increasing_id()), "candidates")  # stored, so ids are stable
    each = found.select("rid", "repo", "owner", F.explode(F.concat("base", "opaque")).alias("c")).where("c.looks")
    each = each.select("rid", "repo", "owner", F.col("c.hash").alias("hash"), F.col("c.vstart").alias("start"), F.col("c.end").alias("end"))
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    freq = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    kind = F.when((F.col("owners") == 1) & (F.col("repos") <= live_repos), "live").when(F.col("owners") >= example_owners, "example")
    marked = freq.select("hash", kind.alias("kind")).where("kind is not null")
    order = F.when(F.col("kind") == "live", len(KINDS)).otherwise(len(KINDS) + 1)
    add = each.join(marked, "hash").groupBy("rid").agg(F.collect_set(F.struct("start", order.alias("ord"), "end", "kind")).alias("more"))
    plain = F.transform("base", lambda x: F.struct(*[x[n].alias(n) for n in ("start", "ord", "end", "kind")]))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    return found.join(add, "rid", "left").select(
        "doc_id", F.array_sort(F.concat(plain.cast("array<struct<start:int,ord:int,end:int,kind:string>>"), F.coalesce("more", none))).alias("spans")
    )


def digest(scanned: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["ord"] < 3)
    join = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(join(base), 256).alias("base_sha256"),
        join(F.col("spans")).alias("spans"),
    )
