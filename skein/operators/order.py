"""Places and running sums over a total order of any size: ranges of it, sums per range, and a carry between them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.shared import saved


def _ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` in order, cut into ranges, with ``_range`` and the row's place in it, ``_at``.

    It is written once: range bounds come from samples, and all later steps must see the same ones.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = saved(ranged, "ranges")
    return kept.withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")


def _carried(ranged: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """One row per range, of which there are as many as tasks: what the ranges before it add up to (``_b_<name>``), and all (``_t_<name>``)."""
    each = ranged.groupBy("_range").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return each.select("_range", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"_b_{k}") for k in sums], *[F.sum(k).over(every).alias(f"_t_{k}") for k in sums])


def global_rank(df: DataFrame, order: Sequence[Column], name: str, total: str | None = None) -> DataFrame:
    """``df`` with its place in the order, from 0; rows that the order leaves equal get places one after the other. ``total``: also the number of rows."""
    ranged = _ranges(df, order)
    out = ranged.join(F.broadcast(_carried(ranged, {"n": F.lit(1)})), "_range").withColumn(name, F.col("_b_n") + F.col("_at"))
    return (out.withColumn(total, F.col("_t_n")) if total else out).drop("_range", "_at", "_b_n", "_t_n")


def running_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, str]) -> DataFrame:
    """``df`` with, for each ``column: name`` of ``sums``, the sum of the column up to and with each row, and the whole as ``<name>_all``."""
    ranged = _ranges(df, order)
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumns({f"_s_{c}": F.sum(c).over(inside) for c in sums})
    out = run.join(F.broadcast(_carried(ranged, {c: F.col(c) for c in sums})), "_range")
    out = out.withColumns({n: F.col(f"_b_{c}") + F.col(f"_s_{c}") for c, n in sums.items()} | {f"{n}_all": F.col(f"_t_{c}") for c, n in sums.items()})
    return out.select(*df.columns, *[x for n in sums.values() for x in (n, f"{n}_all")])
