"""Grouped counts, merges of counts by priority, category buckets, distinct sets and sparse vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.order import global_rank


def callees_by_caller(edges: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(group..., caller, callees): callees in order, repeats kept."""
    return edges.groupBy(*group, "caller").agg(F.transform(F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, "callee"])))), lambda x: x["callee"]).alias("callees"))


def count_by(df: DataFrame, keys: Sequence[str], name: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def with_default_category(items: DataFrame, categories: DataFrame, key: str, category: str = "category", default: str = "NO_CATEGORY") -> DataFrame:
    """Left lookup in a small dimension; what it lacks gets the default bucket. Items whose key repeats there repeat too."""
    return items.join(categories, key, "left").withColumn(category, F.coalesce(category, F.lit(default)))


def merge_last_wins(parts: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Union of keyed values in which a later part replaces an earlier one: one grouped maximum by priority."""
    both = None
    for i, p in enumerate(parts):
        p = p.select(*keys, value, F.lit(i).alias("_p"))
        both = p if both is None else both.unionByName(p)
    return both.groupBy(*keys).agg(F.max_by(value, "_p").alias(value))


def reflection_counters(calls: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., counter, cnt): all reflective calls, those without a constant name, without a class, and with both."""
    name, cls = F.col("name").isNotNull(), F.col("class").isNotNull()
    wide = calls.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(~name).alias("non_constant"), F.count_if(name & ~cls).alias("no_class"), F.count_if(name & cls).alias("full"))
    return wide.select(*group, F.expr("stack(4, 'total', total, 'non_constant', non_constant, 'no_class', no_class, 'full', full) AS (counter, cnt)"))


def group_size_histogram(df: DataFrame, key: str) -> DataFrame:
    """(size, n_groups), by size."""
    return df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups")).orderBy("size")


def groups_by_size(df: DataFrame, key: str) -> DataFrame:
    """(cnt, key), the smallest groups first, ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("cnt")).orderBy("cnt", key)


def distinct_set(df: DataFrame, group: Sequence[str], value: str, name: str = "members") -> DataFrame:
    return df.groupBy(*group).agg(F.array_sort(F.collect_set(value)).alias(name))


def prefixed_constants(df: DataFrame, group: Sequence[str], value: str, prefix: str) -> DataFrame:
    """Distinct values with a prefix, one row each."""
    return df.where(F.col(value).startswith(prefix)).select(*group, value).distinct()


def feature_names(df: DataFrame, value: str, most: int = 100_000) -> list[str]:
    """Sorted distinct names, for use as pivot values; more than ``most``, too many for columns, are an error and none is dropped."""
    names = [r[0] for r in df.select(value).where(F.col(value).isNotNull()).distinct().orderBy(value).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} names of {value!r}: use sparse rows, or raise the limit")
    return names


def distinct_lines(df: DataFrame, group: Sequence[str], cls: str, line: str, user: Column) -> DataFrame:
    """Distinct (class, line) pairs of user code."""
    return df.where(user).groupBy(*group).agg(F.count_distinct(cls, line).alias("sloc"))


def flag_totals(df: DataFrame, group: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """One count per flag."""
    return df.groupBy(*group).agg(*[F.count_if(c).alias(k) for k, c in flags.items()])


def ratio(df: DataFrame, group: Sequence[str], hit: Column, name: str = "ratio") -> DataFrame:
    return df.groupBy(*group).agg(F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias(name))


def mean_and_failed(runs: DataFrame, attempted: DataFrame, key: str, seconds: str) -> tuple[DataFrame, DataFrame]:
    """(mean run time, attempted keys without a run)."""
    return runs.agg(F.avg(seconds).alias("mean_seconds"), F.count("*").alias("n")), attempted.join(runs, key, "left_anti")


def vocabulary(counts: DataFrame, feature: str = "feature") -> DataFrame:
    """(feature, index) in sorted order from 0: numbered by ranges, so no task sorts all names."""
    return global_rank(counts.select(feature).distinct(), [F.col(feature)], "index").withColumn("index", F.col("index").cast("int"))


def sparse_rows(counts: DataFrame, group: Sequence[str], vocab: DataFrame, feature: str = "feature", value: str = "cnt") -> DataFrame:
    """(group..., entries array<struct<index, value>>) by index: a sparse design matrix."""
    return counts.join(vocab, feature).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("index", F.col(value).cast("double").alias("value")))).alias("entries"))


def add_counts(table: DataFrame, counts: DataFrame, key: str, names: Sequence[str], binary: bool = False) -> DataFrame:
    """Rows of ``table`` that have counts, with one more column per name: count (or 0/1), 0 where absent."""
    wide = counts.groupBy(key).pivot("feature", list(names)).agg(F.sum("cnt"))
    out = table.join(wide, key)
    return out.withColumns({n: (F.coalesce(F.col(f"`{n}`"), F.lit(0)) > 0).cast("int") if binary else F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names})
