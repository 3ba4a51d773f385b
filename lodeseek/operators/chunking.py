"""Chunks from symbols and from plain lines: headers, parts, windows, removal of overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions.ids import chunk_id, content_hash
from ..functions.text import split_lines, universal

#: Fixed value: what an overlap keeps, least first.
PRIORITY = {"function": 0, "method": 0, "struct": 1, "interface": 1, "class": 2, "namespace": 3, "code": 4}
OVERLAP = 0.8


def lines_of(text: Column) -> Column:
    """Lines with their line feeds (any line end is one); a final line feed opens no further line."""
    parts = F.split(universal(text), "\n", -1)
    last = F.size(parts) - 1
    kept = F.transform(parts, lambda x, i: F.when(i < last, F.concat(x, F.lit("\n"))).otherwise(x))
    return F.filter(kept, lambda x: x != "")


def step_of(c: Chunking) -> int:
    return max(1, c.max_lines - c.overlap_lines)


def starts(n: Column, step: int) -> Column:
    """Offsets of all windows over n lines."""
    none = F.array().cast("array<int>")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(none)


def sliding_chunks(files: DataFrame, c: Chunking) -> DataFrame:
    """Windows of max_lines over (file_path, language, project_name, content), while they have min_lines.

    Window sizes do not grow along a file, so the size filter ends where a scan would stop.
    """
    lined = files.withColumn("lines", lines_of(F.col("content")))
    w = lined.select("file_path", "language", "project_name", "lines", F.explode(starts(F.size("lines"), step_of(c))).alias("at"))
    w = w.withColumn("part", F.slice("lines", F.col("at") + 1, c.max_lines)).where(F.size("part") >= c.min_lines)
    text = F.array_join("part", "")
    out = w.select("file_path", "language", (F.col("at") + 1).alias("start_line"), (F.col("at") + F.size("part")).alias("end_line"), text.alias("content"), "project_name")
    return _finished(out.withColumns({"symbol_type": F.lit("code"), "symbol_name": F.lit(""), "parent_class": F.lit(""), "namespace": F.lit("")}))


def header() -> Column:
    """First line of a symbol's chunk: file, class if it has one, kind and name."""
    inside = F.when(F.col("parent_class") != "", F.concat(F.lit(" | class: "), F.col("parent_class"))).otherwise("")
    return F.concat(F.lit("// File: "), F.col("file_path"), inside, F.lit(" | "), F.col("symbol_type"), F.lit(": "), F.col("symbol_name"))


def symbol_chunks(symbols: DataFrame, c: Chunking) -> DataFrame:
    """(file_path, language, project_name, symbol columns) -> chunks.

    Symbols of fewer than min_lines go unless they have a parent; those beyond max_lines are split into parts that
    overlap, each with its number in the header.
    """
    s = symbols.withColumn("lines", split_lines(F.col("content"))).withColumn("n", F.size("lines"))
    s = s.where((F.col("n") >= c.min_lines) | (F.col("parent_class") != ""))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(1).alias("of")))
    cuts = starts(F.col("n"), step_of(c))
    parts = F.transform(cuts, lambda at, i: F.struct(at.alias("at"), (i + 1).alias("i"), F.size(cuts).alias("of")))
    s = s.withColumn("p", F.explode(F.when(F.col("n") <= c.max_lines, whole).otherwise(parts)))
    split = F.col("p.i") > 0
    body = F.slice("lines", F.col("p.at") + 1, c.max_lines)
    mark = F.when(split, F.concat(F.lit(" (part "), F.col("p.i").cast("string"), F.lit("/"), F.col("p.of").cast("string"), F.lit(")"))).otherwise("")
    out = s.select(
        "file_path", "language", "symbol_type", "symbol_name", "parent_class", "namespace", "project_name",
        (F.col("start_line") + F.col("p.at")).alias("start_line"),
        F.when(split, F.col("start_line") + F.col("p.at") + F.size(body) - 1).otherwise(F.col("end_line")).alias("end_line"),
        F.concat(header(), mark, F.lit("\n"), F.when(split, F.array_join(body, "\n")).otherwise(F.col("content"))).alias("content"),
    )
    return dedupe_overlaps(_finished(out))


def _finished(chunks: DataFrame) -> DataFrame:
    out = chunks.withColumn("chunk_id", chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"))).withColumn("content_hash", content_hash(F.col("content")))
    names = ("chunk_id", "file_path", "language", "start_line", "end_line", "symbol_type", "symbol_name", "parent_class", "namespace", "content", "content_hash", "project_name")
    return out.select(*names)


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common lines over those of the smaller range."""
    common = F.least(a1, b1) - F.greatest(a0, b0) + 1
    return F.when(common > 0, common / F.least(a1 - a0 + 1, b1 - b0 + 1)).otherwise(0.0)


def priority(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p]), kind), F.lit(4))


def overlap_pairs(chunks: DataFrame, least: float = OVERLAP) -> DataFrame:
    """Pairs of chunks of one file that overlap by `least`."""
    side = lambda x: chunks.select("file_path", *[F.col(c).alias(f"{x}_{c}") for c in ("chunk_id", "start_line", "end_line")])
    ratio = overlap_ratio(F.col("a_start_line"), F.col("a_end_line"), F.col("b_start_line"), F.col("b_end_line"))
    return side("a").join(side("b"), "file_path").where("a_chunk_id < b_chunk_id").withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") >= least)


_RANGE = "array<struct<i:int,rank:int,a:int,b:int,child:boolean,holder:boolean>>"


def dedupe_overlaps(chunks: DataFrame) -> DataFrame:
    """Drops a chunk that one of higher priority, kept itself, overlaps by OVERLAP.

    A class, struct or interface does not go by a chunk that has a parent; chunks of one priority do not touch one
    another. A file's chunks meet in one row, once, and are gone through by priority there.
    """
    columns = chunks.columns
    rows = chunks.groupBy(F.col("file_path").alias("__path")).agg(F.collect_list(F.struct(priority(F.col("symbol_type")).alias("__rank"), *columns)).alias("items"))
    ranges = F.transform(
        "items",
        lambda x, i: F.struct(
            i.alias("i"), x["__rank"].alias("rank"), x["start_line"].alias("a"), x["end_line"].alias("b"),
            (F.coalesce(x["parent_class"], F.lit("")) != "").alias("child"), x["symbol_type"].isin("class", "struct", "interface").alias("holder"),
        ),
    )
    rows = rows.select("items", F.array_sort(ranges.cast(_RANGE), lambda x, y: x["rank"] - y["rank"]).alias("ranges"))

    def step(kept: Column, c: Column) -> Column:
        beaten = F.exists(kept, lambda k: (k["rank"] < c["rank"]) & ~(k["child"] & c["holder"]) & (overlap_ratio(k["a"], k["b"], c["a"], c["b"]) >= OVERLAP))
        return F.when(beaten, kept).otherwise(F.concat(kept, F.array(c)))

    rows = rows.select("items", F.aggregate("ranges", F.array().cast(_RANGE), step).alias("kept"))
    return rows.select(F.explode(F.transform("kept", lambda k: F.get("items", k["i"]))).alias("c")).select(*[F.col("c")[c].alias(c) for c in columns])
