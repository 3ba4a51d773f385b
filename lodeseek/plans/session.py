"""The engine as one object: index projects, search, look up, report.

Tables are stored in buckets of their files' paths. An update reads the files that are new or whose modification time has
moved, and rewrites the buckets of those that changed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Settings
from ..functions.ids import point_id
from ..operators import ann, chunking, mutations, retrieval, stats
from ..operators.changes import MTIME_TOLERANCE, change_summary
from ..sources.files import listing, read_files
from ..sources.store import Store
from .embed import Embedder, HashedNgrams, embed_chunks
from .parse import parse_symbols

#: Buckets of a table.
BUCKETS = 256
CHANGES = "file_path string, status string, project_name string, mtime double"


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int").alias("bucket")


def one_of_each(chunks: DataFrame) -> DataFrame:
    """One row a chunk id: of several, that of the least specific kind, then the greatest name and text."""
    last = F.max_by(F.struct(*chunks.columns), F.struct(chunking.priority(F.col("symbol_type")), "symbol_name", "content")).alias("c")
    return chunks.groupBy("chunk_id").agg(last).select("c.*")


def chunk_files(files: DataFrame, settings: Settings) -> DataFrame:
    """Symbol chunks of files that have symbols, windows of the others; one row a chunk id."""
    symbols = parse_symbols(files)
    plain = files.join(symbols.select("file_path").distinct(), "file_path", "left_anti")
    both = chunking.symbol_chunks(symbols, settings.chunking).unionByName(chunking.sliding_chunks(plain, settings.chunking))
    return one_of_each(both)


class CodeSearch:
    """embedder: texts to vectors; scorer: query and content column to a score, for reranking."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings, embedder: Embedder | None = None, scorer: Callable[[str, Column], Column] = retrieval.overlap_score):
        self.spark, self.settings, self.store = spark, settings, Store(spark, folder)
        self.embedder, self.scorer = embedder or HashedNgrams(settings.vector_size), scorer

    # tables

    def files(self, only: list[int] | None = None) -> DataFrame:
        return self.store.read_buckets("files", schemas.FILES, only)

    def chunks(self, only: list[int] | None = None) -> DataFrame:
        return self.store.read_buckets("chunks", schemas.CHUNKS, only)

    def vectors(self) -> DataFrame:
        return self.store.read_buckets("vectors", schemas.VECTORS)

    def cache(self) -> DataFrame:
        return self.store.read_buckets("cache", schemas.CACHE)

    def postings(self) -> DataFrame:
        return self.store.read_buckets("postings", schemas.POSTINGS)

    def lengths(self) -> DataFrame:
        return self.store.read_buckets("lengths", schemas.LENGTHS)

    # indexing

    def detect(self) -> tuple[DataFrame, DataFrame]:
        """(file_path, status, project_name, mtime) of what changed, stored, and the read files among it.

        Only files that are new or whose modification time has moved are read. Status: new, modified, touched (moved
        time, same content) or deleted: gone from the disk, out of the project's paths or of a project that the
        settings have no more. Files without a project stay.
        """
        empty = self.spark.createDataFrame([], "file_path string, mtime double, project_name string")
        now = reduce(DataFrame.unionByName, [listing(self.spark, p) for p in self.settings.projects], empty)
        now = now.groupBy("file_path").agg(F.min(F.struct("project_name", "mtime")).alias("m")).select("file_path", "m.project_name", "m.mtime")
        known = self.files().select("file_path", F.col("mtime").alias("was"), F.col("sha256").alias("old"), F.col("project_name").alias("had"))
        both = self.store.write("listed", now.join(known, "file_path", "full_outer"))
        moved = F.col("was").isNull() | (F.abs(F.col("mtime") - F.col("was")) >= MTIME_TOLERANCE)
        fresh = read_files(both.where(F.col("mtime").isNotNull() & moved).select("file_path", "mtime", "project_name"))
        fresh = self.store.write("fresh", fresh)
        seen = fresh.select("file_path", "sha256").join(both, "file_path")
        status = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("sha256"), "modified").otherwise("touched")
        gone = both.where(F.col("mtime").isNull() & (F.col("had") != "")).select("file_path", F.lit("deleted").alias("status"), F.col("had").alias("project_name"), F.col("was").alias("mtime"))
        changes = seen.select("file_path", status.alias("status"), "project_name", "mtime").unionByName(gone)
        return self.store.write("changes", changes), fresh

    def index(self) -> DataFrame:
        """Brings all projects up to date; returns counts by status."""
        changes, fresh = self.detect()
        self.apply(changes, fresh)
        return change_summary(changes.where("status <> 'touched'"))

    def apply(self, changes: DataFrame, fresh: DataFrame) -> None:
        """Writes changes (CHANGES) into all tables, with the read files (file_path, mtime, project_name, content, sha256, language)."""
        only = sorted(r.bucket for r in changes.select(bucket_of(F.col("file_path"))).distinct().collect())  # BUCKETS rows at most
        if not only:
            return
        put = lambda name, df, *order: self.store.replace(name, df.withColumn("bucket", bucket_of(F.col("file_path"))), only, order)
        written = changes.where("status in ('new', 'modified')").select("file_path")
        rewritten = changes.where("status <> 'touched'").select("file_path")
        old = self.files(only)
        at = fresh.select("file_path", "sha256", "mtime", F.current_timestamp().alias("now"), "project_name").join(old.select("file_path", F.col("indexed_at").alias("was"), F.col("sha256").alias("old")), "file_path", "left")
        at = at.select("file_path", "sha256", "mtime", F.when(F.col("old") == F.col("sha256"), F.col("was")).otherwise(F.col("now")).alias("indexed_at"), "project_name")
        new_chunks = chunk_files(fresh.join(written, "file_path", "left_semi"), self.settings)
        put("chunks", mutations.delete(self.chunks(only), rewritten, "file_path").unionByName(new_chunks.select(*self.chunks(only).columns)), "file_path", "start_line")
        chunks = self.chunks(only)
        new = embed_chunks(chunks, self.cache(), self.embedder)
        self.store.replace("cache", new.withColumn("bucket", F.lit(max(self.store.buckets("cache"), default=-1) + 1)), [])
        columns = [c.strip().split(" ")[0] for c in schemas.VECTORS.split(", ")]
        put("vectors", chunks.join(self.cache(), "content_hash").withColumn("point_id", point_id(F.col("chunk_id"))).select("file_path", *columns))
        posted, lengths = retrieval.index_postings(chunks.withColumn("bucket", bucket_of(F.col("file_path"))))
        self.store.replace("postings", posted, only, ("token",))
        self.store.replace("lengths", lengths, only)
        put("files", mutations.delete(old, changes, "file_path").unionByName(at.select(*old.columns)))  # last: what is not in it is done again

    # search

    def search(self, query: str, top_k: int | None = None, language: str | None = None, symbol_type: str | None = None, project: str | None = None, mode: str = "any") -> DataFrame:
        """Hybrid search over the stored index, reranked if the settings say so."""
        s = self.settings.search
        filters = {k: v for k, v in (("language", language), ("symbol_type", symbol_type), ("project_name", project)) if v}
        vector = self.embedder([query])[0].tolist()
        found = retrieval.hybrid_search(self.chunks(), self.vectors(), self.postings(), self.lengths(), query, vector, top_k or s.top_k, s.alpha, filters, s.min_score, mode)
        return retrieval.rerank(found, query, s.rerank_top_k, self.scorer) if s.use_reranker else found

    def build_cells(self, cells: int = ann.CELLS) -> None:
        """Stores the vectors as they are now by cells, for `nearest`."""
        ann.build(self.store, self.vectors(), cells)

    def nearest(self, query: str, k: int = 20, probes: int = ann.CELLS // 2) -> DataFrame:
        """(chunk_id, score, rank) by vectors alone, from the nearest cells."""
        return ann.search(self.store, self.embedder([query])[0].tolist(), k, probes)

    def query_batch(self, queries: DataFrame) -> DataFrame:
        bags, figures = retrieval.bags_of_postings(self.postings(), self.lengths(), queries)
        return retrieval.query_batch(bags, figures, queries, self.settings.search.top_k)

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return self.chunks().where(F.col("chunk_id") == chunk_id).drop("content_hash", "project_name")

    def outline(self, path: str) -> DataFrame:
        """Symbols of a file; if no file has that path, of the first whose path holds it."""
        return outline(self.chunks(), self.files(), path)

    def stats(self) -> DataFrame:
        return stats.index_stats(self.files(), self.chunks())

    def project_stats(self) -> DataFrame:
        roots = [(r,) for p in self.settings.projects for r in p.source_paths]
        return stats.project_stats(self.spark.createDataFrame(roots, "source_path string"), self.files(), self.chunks())

    def status(self) -> DataFrame:
        return stats.status(self.files(), self.chunks(), self.vectors(), self.cache(), self.store.size())

    def collect_cache(self) -> DataFrame:
        """Takes out of the cache what no chunk uses."""
        kept = mutations.cache_gc(self.cache(), self.chunks()).withColumn("bucket", F.lit(0))
        self.store.replace("cache", kept, [*self.store.buckets("cache"), 0])
        return self.cache()


def outline(chunks: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """(type, name, line, namespace) by line of the file with that path, else of the first whose path holds it."""
    hits = files.select("file_path").where(F.contains("file_path", F.lit(path)))
    one = hits.orderBy(F.col("file_path") != path, "file_path").limit(1)
    rows = chunks.join(F.broadcast(one), "file_path")  # one row
    return rows.select(F.col("symbol_type").alias("type"), F.col("symbol_name").alias("name"), F.col("start_line").alias("line"), "namespace").orderBy("line", "name")
