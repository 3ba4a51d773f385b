"""Changes of tables, as the state after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing with the rows of new (one a key) in place of those of equal keys."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new.select(*existing.columns))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def delete_project(files: DataFrame, chunks: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) without the project; its files stay while another project has chunks of them."""
    gone = F.col("project_name") == project
    left = chunks.where(~gone)
    others = left.select("file_path").distinct()
    kept = files.where(gone).join(others, "file_path", "left_semi")
    return files.where(~gone).unionByName(kept.select(*files.columns)), left


def cache_gc(cache: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cache entries some chunk uses."""
    return cache.join(chunks.select("content_hash"), "content_hash", "left_semi")


def cache_misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts to embed, each content once."""
    return chunks.dropDuplicates(["content_hash"]).join(cache.select("content_hash"), "content_hash", "left_anti").select("content_hash", "content")
