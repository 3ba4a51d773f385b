"""Session helpers shared by the operators: tables, the shared folder, cutting of lineage, size figures."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Own shared folders by application, made only where the session names none.
_OWN: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else, on one machine only, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lodeseek-"))


def cut(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later work does not depend on lost executors.

    A narrow table (some numbers a row, where the corpus has texts) is written as three files a core at most. The files
    go when the session ends, or earlier through `forget`.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(3 * max(1, spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark)}/lodeseek-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodeseek_path = path
    return out


def numbered(df: DataFrame) -> DataFrame:
    """df with `__file` and `__row` (long), which name each stored row wherever it is read again.

    Rows of parquet files have their file and place in it; what else df may be is written to the shared folder first.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):  # each row is one row of a file
        plan = plan.children().head()
    if not (plan.nodeName() == "LogicalRelation" and plan.simpleString(25).endswith(" parquet") and _placed(df)):
        df = cut(df, "rows")
    return df.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def _placed(df: DataFrame) -> bool:
    try:
        return bool(df.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> Iterator[None]:
    """Within it, jobs hand texts to Python in smaller batches, so that a worker and Spark's buffers hold less at once.

    Small shuffled partitions are put together up to the advisory size, so that small tables are few files. These are
    settings of the session, put back at the end.
    """
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(size),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def forget(*frames: DataFrame) -> None:
    """Deletes what `cut` wrote for frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_lodeseek_path", None)
        if path:
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(c: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def crc_rest(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def prefix_sums(lens: Column, block: int = 256) -> Column:
    """Sum of all elements before each element of an array of ints, in-row, in blocks to stay near-linear."""
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / block).cast("int")), lambda c: F.slice(lens, c * block + 1, block)
    )
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sums = F.transform(chunks, total)
    inner = F.transform(
        chunks, lambda ch, c: F.transform(ch, lambda _, i: total(F.slice(sums, F.lit(1), c)) + total(F.slice(ch, F.lit(1), i)))
    )
    return F.when(F.size(lens) > 0, F.flatten(inner)).otherwise(F.array().cast("array<int>"))
