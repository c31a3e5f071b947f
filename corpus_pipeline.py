"""From raw documents to token ids: five stages, each judged on what the one before it kept.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and is written as Parquet and read again
before the next. All but the last keep the columns of ``docs``, whatever they are; documents are
dropped whole, never changed. The last adds the token ids, their number, and the decoded text.

A null text is an empty one; an empty table passes through; of repeated rows one stays. Texts are
read whole by every stage, whatever their length; the stages name their own columns apart from those
of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vakanz.llm import bpe, exact, leaks, omh, quality
from vakanz.llm.common import documents, staged
from vakanz.llm.queries import VOCABULARY


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field accepts."""
    return quality.accepted_documents(docs, documents(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return omh.kept_documents(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return leaks.clean_documents(docs, documents(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every document that is left."""
    rows = docs.select(docs["doc_id"], docs["text"])
    return bpe.round_trip(rows, VOCABULARY).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = (
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("bpe", to_tokens),
)

#: No stage but exact dedup can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
