"""Continuous ingest: new and modified files from a stream into the store, batch by batch.

Streams do not see deletions; `CodeSearch.index` stays the authority for those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import mutations
from ..plans.session import CodeSearch


def upsert_batch(engine: CodeSearch, batch: DataFrame) -> None:
    """Puts the batch's files into all tables; of several rows of one file the latest counts. Repeatable."""
    files = mutations.latest(batch, "file_path", "mtime").withColumn("sha256", F.sha2("content", 256))
    files = engine.store.write("fresh", files.select("file_path", "mtime", "project_name", "content", "sha256", "language"))
    known = engine.files().select("file_path", F.col("sha256").alias("old"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("sha256"), "modified").otherwise("touched")
    changes = files.join(known, "file_path", "left").select("file_path", status.alias("status"), "project_name", "mtime")
    engine.apply(engine.store.write("changes", changes), files)


def ingest(stream: DataFrame, engine: CodeSearch, checkpoint: str) -> StreamingQuery:
    """stream: (file_path, mtime, project_name, content, language)."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, _: upsert_batch(engine, batch)).start()
