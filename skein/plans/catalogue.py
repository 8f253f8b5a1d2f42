"""All queries of the core library, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation_queries, feature_queries, graph_queries, io_queries, join_queries, markov_queries, name_queries, text_queries, trace_queries

MODULES = [markov_queries, text_queries, name_queries, join_queries, trace_queries, graph_queries, evaluation_queries, feature_queries, io_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.ORACLES
    return out
