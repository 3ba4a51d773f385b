"""Figures of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Under so many vectors, more disk than this is worth a warning.
FEW_VECTORS, MUCH_DISK_MB = 1000, 100


def index_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total_files")).crossJoin(chunks.agg(F.count("*").alias("total_chunks")))  # one row each


def project_stats(roots: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_path, files, chunks, last_indexed) for each root, also where it has none. Chunks are counted per file first.

    A file is joined by equality with those of its ancestors (and itself) that are roots.
    """
    per_file = chunks.groupBy("file_path").agg(F.count("*").alias("n_chunks"))
    steps = F.split(F.translate("file_path", "\\", "/"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    f = files.join(per_file, "file_path", "left").select(F.explode(above).alias("root"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "indexed_at")
    r = roots.select("source_path", F.regexp_replace(F.translate("source_path", "\\", "/"), "/+$", "").alias("root"))
    matched = f.join(F.broadcast(r), "root").groupBy("source_path").agg(  # roots: a row for each configured path
        F.count("*").alias("files"), F.sum("n_chunks").alias("chunks"), F.max("indexed_at").alias("last_indexed")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return r.select("source_path").join(matched, "source_path", "left").select("source_path", zero("files"), zero("chunks"), "last_indexed")


def status(files: DataFrame, chunks: DataFrame, vectors: DataFrame, cache: DataFrame, disk_bytes: int) -> DataFrame:
    """One row: files, chunks, vectors, cache entries and megabytes, megabytes on disk, and whether few vectors take much disk."""
    counted = index_stats(files, chunks).crossJoin(vectors.agg(F.count("*").alias("total_vectors"))).crossJoin(cache_stats(cache))  # one row each
    disk = F.lit(disk_bytes / (1024 * 1024))
    return counted.withColumn("disk_mb", F.round(disk, 1)).withColumn("size_mismatch", (F.col("total_vectors") < FEW_VECTORS) & (disk > MUCH_DISK_MB))


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries, and megabytes of their 4-byte floats."""
    size = F.coalesce(F.sum(4 * F.size("vector")), F.lit(0))
    return cache.agg(F.count("*").alias("entries"), F.round(size / (1024 * 1024), 1).alias("size_mb"))
