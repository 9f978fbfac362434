"""A training-corpus pipeline: five of the corpus operators, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import mixing, quality, secrets, simhash
from logloom.llm._spark import table, written
from logloom.llm.queries import packed_pieces


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null and empty texts have no words, so they go; a row is judged by its own text, so null
    and repeated ids, and repeated rows, are each judged alike. An empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of the smallest id; of equal ids the first that was written, rows without an id
    last. Null, empty and wordless texts are one group. An empty table stays empty."""
    return simhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; n_chars follows. Null texts stay null, with a null n_chars; null ids and repeated rows stay as they are
    many. An empty table stays empty."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources occur more often, none less than once. Null sources are one source; null texts have no tokens and occur
    once. An empty table stays empty."""
    return mixing.mixed_documents(docs)


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, in windows that hold all sources in proportion. Null texts are their end id alone; null ids are kept; repeated rows
    are packed as often as they occur. An empty table gives no rows."""
    return packed_pieces(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("window_packing", window_packing),
]

ORACLE_SQL = None  # fingerprints, hashed n-grams and tokens have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and reread before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
