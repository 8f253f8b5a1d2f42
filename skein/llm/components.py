"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups


def _near_min(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v) with m, the smallest of u and its v's; a node that a great part of the ``total`` pairs have stays in many tasks."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_groups(pairs, least, ["u"], "n", total).drop("n")


def components(links: DataFrame, scratch: Scratch, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(id, component): every id that occurs in ``links`` (a, b) and the smallest id reachable from it.

    Large-star links each node's larger neighbours to its smallest one, small-star its smaller ones;
    the two keep connectivity and the number of links never grows. A round whose links equal the last
    one's (count and two hash sums) ends it; each then is (id, component). All steps are grouped
    minima with map-side combine and equi joins; nothing is sent to the driver but three numbers.
    Nulls and self links are ignored; no links give no rows.
    """
    edges = scratch.save(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-0")
    before, total = None, edges.count()
    for k in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _near_min(both, 2 * total).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, f"{tag}-large")
        small = _near_min(large, large.count())
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = scratch.save(small, f"{tag}-{k + 1}")
        scratch.drop(f"{tag}-{k}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, total = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
