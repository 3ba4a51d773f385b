"""Tables as versioned parquet: a new version is written, then the pointer moves; one writer at a time.

A table is written whole, or by buckets: then a version holds the buckets that changed, and its manifest says in which
version each bucket stands.
"""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Own folders by application, made only where the session names none.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else, on one machine only, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lodeseek-"))


class Store:
    """Named tables under a folder of any file system Spark can reach. The last two versions stay."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Finished versions, oldest first."""
        if not self._fs.exists(self._path(name)):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(name)))
        return sorted(int(n[2:]) for n in found if n.startswith("v=") and self._fs.exists(self._path(name, n, "_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The newest finished version; without one, an empty table of the schema."""
        found = self.versions(name)
        if not found:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(str(self._path(name, f"v={found[-1]}")))

    def write(self, name: str, df: DataFrame, partition: str | None = None) -> DataFrame:
        found = self.versions(name)
        version = (found[-1] if found else 0) + 1
        target = self._path(name, f"v={version}")
        self._fs.delete(target, True)
        writer = df.write.partitionBy(partition) if partition else df.write
        writer.parquet(str(target))
        for old in found[:-1]:
            self._fs.delete(self._path(name, f"v={old}"), True)
        return self.read(name)

    # tables by buckets

    def _manifests(self, name: str) -> list[int]:
        folder = self._path(name, "manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def _manifest(self, name: str, version: int) -> dict[int, int]:
        """Bucket to the version that holds it."""
        with_ = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self._fs.open(self._path(name, "manifests", f"{version}.json"))
        try:
            return {int(k): v for k, v in json.loads(with_.toString(stream, "UTF-8")).items()}
        finally:
            stream.close()

    def buckets(self, name: str) -> dict[int, int]:
        found = self._manifests(name)
        return self._manifest(name, found[-1]) if found else {}

    def read_buckets(self, name: str, schema: str, only: list[int] | None = None) -> DataFrame:
        """The newest state of these buckets (all: None); no others are read."""
        held = self.buckets(name)
        paths = [str(self._path(name, f"v={v}", f"bucket={b}")) for b, v in sorted(held.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, name: str, df: DataFrame, only: list[int], order: tuple[str, ...] = ()) -> None:
        """Puts the rows of df (with their `bucket`) in place of the given buckets, sorted by `order` within each."""
        found = self._manifests(name)
        version = (found[-1] if found else 0) + 1
        target = self._path(name, f"v={version}")
        self._fs.delete(target, True)
        dealt = df.repartition(max(1, len(only)), "bucket").sortWithinPartitions("bucket", *order)
        dealt.write.partitionBy("bucket").parquet(str(target))
        held = {b: v for b, v in (self._manifest(name, found[-1]) if found else {}).items() if b not in only}
        for s in self._fs.listStatus(target):
            if s.getPath().getName().startswith("bucket="):
                held[int(s.getPath().getName()[7:])] = version
        part = self._path(name, "manifests", f"{version}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        self._fs.rename(part, self._path(name, "manifests", f"{version}.json"))
        for old in found[:-1]:
            self._fs.delete(self._path(name, "manifests", f"{old}.json"), False)
        live = {*held.values(), version, *(self._manifest(name, found[-1]).values() if found else ())}
        for s in self._fs.listStatus(self._path(name)):  # versions that neither of the last two states needs
            n = s.getPath().getName()
            if n.startswith("v=") and int(n[2:]) not in live:
                self._fs.delete(s.getPath(), True)

    def size(self) -> int:
        """Bytes on disk."""
        return self._fs.getContentSummary(self._path()).getLength() if self._fs.exists(self._path()) else 0

    def reset(self) -> None:
        self._fs.delete(self._path(), True)
