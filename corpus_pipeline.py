"""From raw documents to token ids: language filter, exact and near dedup, mixing, piece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import exact, langid, mixing, neardup, sentpiece
from skein.llm.common import Scratch


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learnt on these documents: texts without letters go, and of those without a lang the ones in unknown scripts."""
    return langid.keep_known_languages(docs, langid.learn_model(docs, held_out=False))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup on a digest index: of equal texts the longest stays."""
    return exact.keep_first_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    return neardup.keep_one_of_each_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources interleaved to target weights; no document is dropped, the files and rows are in the mixed order."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with counts and whether decoding gives the text back."""
    return sentpiece.encode(docs)


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", without_copies),
    ("minhash_near_dedup", without_near_copies),
    ("source_mixing", mixed),
    ("piece_encoding", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
