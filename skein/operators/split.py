"""Train and test splits: date pivots per label, hash hold-outs and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.order import global_rank


def date_pivot(df: DataFrame, label: str, date: str, tie: str, numerator: int = 7, denominator: int = 10) -> DataFrame:
    """Adds ``pivot`` and ``part``: per label the date at place floor(n * 7 / 10) of its sorted dates; later dates are ``test``.

    The place is found from counts per date, so a label with most rows is no single sorted partition.
    """
    counts = df.groupBy(label, date).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(label)
    run = counts.withColumn("_run", F.sum("_c").over(w.orderBy(date))).withColumn("_n", F.sum("_c").over(w))
    pivot = run.where(F.col("_run") > F.expr(f"_n * {numerator} div {denominator}")).groupBy(label).agg(F.min(date).alias("pivot"))
    return df.join(pivot, label).withColumn("part", F.when(F.col(date) > F.col("pivot"), "test").otherwise("train"))


def date_pivot_or_random(df: DataFrame, label: str, date: str, key: str, seed: int = 388652140, replacement: bool = False) -> DataFrame:
    """As ``date_pivot``; a label with an empty side is split at random by hash, 70 % to train.

    With ``replacement``, a row trains if any of the label's draws hits it, so that about half do.
    """
    split = date_pivot(df, label, date, key)
    sides = split.groupBy(label).agg((F.count_distinct("part") < 2).alias("_one"))
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1e6
    share = F.lit(1 - 2.718281828459045**-0.7) if replacement else F.lit(0.7)
    return split.join(sides, label).withColumn("part", F.when(F.col("_one"), F.when(u < share, "train").otherwise("test")).otherwise(F.col("part"))).drop("_one")


def hold_outs(df: DataFrame, key: str, repeats: int = 10, test_share: float = 0.33, seed: int = 0) -> DataFrame:
    """``repeats`` copies with ``run`` and ``part``: a row's place by hash, the same at every partitioning."""
    runs = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    u = F.pmod(F.xxhash64(F.col(key), F.col("run"), F.lit(seed)), F.lit(1_000_000)) / 1e6
    return runs.withColumn("part", F.when(u < test_share, "test").otherwise("train"))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in a seeded order."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def k_folds(df: DataFrame, order: list[str], k: int = 10) -> DataFrame:
    """Adds ``fold``: contiguous parts of the ordered rows, the first n mod k of them one larger. ``hash_folds`` needs no order."""
    ranked = global_rank(df, [F.col(c) for c in order], "_r", "_n")
    small, large = F.expr(f"_n div {k}"), F.expr(f"_n % {k}")
    low = F.floor(F.col("_r") / (small + 1))
    high = large + F.floor((F.col("_r") - large * (small + 1)) / F.greatest(small, F.lit(1)))
    return ranked.withColumn("fold", F.when(F.col("_r") < large * (small + 1), low).otherwise(high).cast("int")).drop("_r", "_n")


def hash_folds(df: DataFrame, key: str, k: int = 10, seed: int = 0) -> DataFrame:
    """Adds ``fold`` by hash of the key: no shuffle."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))
