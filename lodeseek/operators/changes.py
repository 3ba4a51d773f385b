"""Snapshot diff of a file listing against the indexed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds within which modification times are equal.
MTIME_TOLERANCE = 0.01


def detect_changes(current: DataFrame, indexed: DataFrame, scope: Column | None = None) -> DataFrame:
    """(file_path, status) with status new, modified or deleted.

    Both sides: (file_path, mtime, sha256). Indexed rows out of scope are deleted. A moved modification time alone is no
    change: contents are compared then. One full outer join on the path.
    """
    cur = current.dropDuplicates(["file_path"]).select("file_path", F.col("mtime").alias("c_mtime"), F.col("sha256").alias("c_sha"), F.lit(True).alias("c"))
    old = indexed.select("file_path", F.col("mtime").alias("o_mtime"), F.col("sha256").alias("o_sha"), F.lit(True).alias("o"))
    both = cur.join(old, "file_path", "full_outer")
    gone = F.col("c").isNull() if scope is None else F.col("c").isNull() | (F.col("o").isNotNull() & ~scope)
    moved = (F.abs(F.col("c_mtime") - F.col("o_mtime")) >= MTIME_TOLERANCE) & (F.col("c_sha") != F.col("o_sha"))
    status = F.when(gone, "deleted").when(F.col("o").isNull(), "new").when(moved, "modified")
    return both.select("file_path", status.alias("status")).where("status is not null")


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("n"))


def deleted_projects(indexed: DataFrame, configured: DataFrame) -> DataFrame:
    """Projects that files have and the settings have not."""
    have = indexed.where("project_name <> ''").select("project_name").distinct()
    return have.join(configured.select("project_name"), "project_name", "left_anti")
