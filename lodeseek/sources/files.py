"""File trees as tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Project
from ..functions.text import glob_regex, language_of

LISTED = "file_path string, mtime double, project_name string"


def listing(spark: SparkSession, project: Project) -> DataFrame:
    """(file_path, mtime, project_name) of a project's files, with its suffix and exclusion rules.

    The driver lists the folders below each root (about 200,000 files a second from a warm local disk); excluded
    folders are not entered. Patterns are tried on what is below a root, not on the root. Hidden files count.
    """
    globs = [re.compile(glob_regex(g)) for g in project.exclude_patterns]
    out = lambda p: any(g.match(p.replace("\\", "/")) for g in globs)
    wanted = {e.lower() for e in project.extensions}
    found = {}
    for root in project.source_paths:
        for folder, dirs, names in os.walk(root):
            dirs[:] = sorted(d for d in dirs if not out(os.path.join(folder, d)))
            for name in names:
                path = os.path.join(folder, name)
                if PurePath(name).suffix.lower() not in wanted or out(path):
                    continue
                try:
                    found[path] = os.stat(path).st_mtime
                except OSError:
                    continue
    return spark.createDataFrame([(p, m, project.name) for p, m in found.items()], LISTED)


def read_files(listed: DataFrame) -> DataFrame:
    """Adds content (UTF-8, malformed bytes replaced), sha256 of the bytes, and language. Unreadable files are empty."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for part in parts:
            texts, sums = [], []
            for path in part["file_path"]:
                try:
                    with open(path, "rb") as f:
                        raw = f.read()
                except OSError:
                    raw = b""
                texts.append(raw.decode("utf-8", "replace"))
                sums.append(hashlib.sha256(raw).hexdigest())
            yield part.assign(content=texts, sha256=sums)

    read = listed.select("file_path", "mtime", "project_name").mapInPandas(run, LISTED + ", content string, sha256 string")
    return read.withColumn("language", language_of(F.col("file_path")))


def document_files(docs: DataFrame) -> DataFrame:
    """A table of documents as if they were files: path, content, hash and times."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return docs.select(
        path.alias("file_path"),
        F.sha2("text", 256).alias("sha256"),
        (F.lit(1.7e9) + F.col("doc_id")).alias("mtime"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("indexed_at"),
        F.col("source").alias("project_name"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        F.col("doc_id"),
    )
