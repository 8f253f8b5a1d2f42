"""Registered queries of the text operators: thin calls over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact, langid, mixing, neardup, quality, repeats, sentpiece, topk, toxicity, warc
from .common import table


def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_rows(spark, sf_dir)


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dup_groups(table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op7_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest_of_every_20th(table(spark, sf_dir, "embeddings"))


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentpiece.encode(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_toxicity_crf, op2_revisit_resolution, op3_pfair_mixing, op4_language_id, op5_minhash_near_dedup, op6_repeated_passages, op7_bradley_terry_quality, op8_dual_tree_top_k, op9_piece_encoding, op10_exact_dedup)
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_revisit_resolution": warc.ORACLE, "op8_dual_tree_top_k": topk.ORACLE, "op10_exact_dedup": exact.ORACLE}
