"""Corpus pipeline: five stages, each of which works on all that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import decontaminate, line_dedup, ngram_join, quality, sp_codec
from lodeseek.llm.common import cut, forget, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score under 0.7 go. Without a positive label none goes.

    Null and empty texts are scored as empty; equal texts go or stay together, repeated rows too, a score of 0.7 stays.
    An empty table gives no rows. Columns beyond those of `documents` are not carried.
    """
    docs = docs.select(*COLUMNS)
    return quality.keep(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicate lines go from the texts; a document of which only blanks stay goes, if lines were taken.

    Each row is a document of its own: of repeated rows one keeps the lines, and of lines that tie that of the least
    doc_id (a null one first). Null, empty and blank texts stay as they are. An empty table gives no rows.
    """
    out = line_dedup.dedup(docs.select(*COLUMNS))
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \n\r\t\x0b\x0c]"))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at 0.75, that of the least id stays.

    Documents without words are linked with none and stay, as do rows without id; of repeated rows one stays, of several
    texts under one id the least. An empty table gives no rows.
    """
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words running of a benchmark item go (all words of a shorter item).

    Null and empty texts stay, repeated rows go or stay together, an empty benchmark takes none.
    """
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids of every document left; null and empty texts have no tokens.

    Repeated rows give repeated results, an empty table none; of paths that tie, the longer last piece wins.
    """
    return sp_codec.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", tokens_stage),
]

#: SQL can express neither the classifier's fit nor the signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = cut(stage(spark, docs, sf_dir), name.split()[0])
        forget(docs)
        docs = after
    return docs
