"""State sequences, transition counts and transition probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def successive_pairs(seq: DataFrame, group: Sequence[str], state: str, order: Sequence[str]) -> DataFrame:
    """(group..., src, dst) for each two neighbours of a group's ordered states."""
    w = Window.partitionBy(*group).orderBy(*order)
    return seq.select(*group, F.col(state).alias("src"), F.lead(state).over(w).alias("dst")).where("dst IS NOT NULL")


def caller_pairs(tokens: DataFrame, group: Sequence[str], line: str, pos: str, state: str, keep: Sequence[str] | None = None) -> DataFrame:
    """(group..., src, dst) from call lines: the first kept state of a line calls each later one.

    States outside ``keep`` go before the caller is chosen, so a line whose caller is unknown is led
    by its first known callee.
    """
    if keep is not None:
        tokens = tokens.where(F.col(state).isin(*keep))
    w = Window.partitionBy(*group, line)
    first = F.min(F.struct(pos, state)).over(w)
    return tokens.select(*group, first[state].alias("src"), F.col(state).alias("dst"), (F.col(pos) == first[pos]).alias("_head")).where("NOT _head").drop("_head")


def transition_counts(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*group, "src", "dst").agg(F.count("*").alias("cnt"))


def transition_probabilities(counts: DataFrame, group: Sequence[str], digits: int | None = 6) -> DataFrame:
    """Counts with p, the share of the row's source; a source without transitions has no row."""
    total = F.sum("cnt").over(Window.partitionBy(*group, "src")).cast("double")
    p = F.col("cnt").cast("double") / total
    return counts.withColumn("p", F.round(p, digits) if digits is not None else p)


def transition_matrix(probabilities: DataFrame, group: Sequence[str], states: Sequence[str]) -> DataFrame:
    """One row per group, one column ``<src>To<dst>`` per pair of states in row-major order, 0 where absent.

    The pivot's values are fixed, so the plan is one aggregation without a pass to find them.
    """
    names = [f"{a}To{b}" for a in states for b in states]
    wide = probabilities.groupBy(*group).pivot("pair", names) if "pair" in probabilities.columns else probabilities.withColumn("pair", F.concat("src", F.lit("To"), "dst")).groupBy(*group).pivot("pair", names)
    return wide.agg(F.first("p")).na.fill(0.0, names)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without the named columns; names that are not there are ignored."""
    return df.drop(*names)
