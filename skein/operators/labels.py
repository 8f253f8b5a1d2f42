"""Labels: resolution over several sources, conflicts, relabelling, dedup by name, class domains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCLUDED = ("MALICIOUS", "none")


def conflicting(labels: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label, in whatever order the sources are read."""
    return labels.groupBy(key).agg(F.count_distinct(label).alias("n_labels")).where("n_labels > 1")


def resolve(items: DataFrame, sources: Sequence[tuple[DataFrame, str, str]], default: str, name: str = "family") -> DataFrame:
    """The first source that knows an item gives its label; ``sources`` are (table, item key, label), keys unique."""
    out = items
    for i, (table, key, label) in enumerate(sources):
        out = out.join(table.select(F.col(key), F.col(label).alias(f"_l{i}")), key, "left")
    return out.withColumn(name, F.coalesce(*[F.col(f"_l{i}") for i in range(len(sources))], F.lit(default))).drop(*[f"_l{i}" for i in range(len(sources))])


def without_labels(df: DataFrame, label: str, excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    return df.where(~F.col(label).isin(*excluded))


def without_singletons(df: DataFrame, label: str, prefix: str = "SINGLETON") -> DataFrame:
    return df.where(~F.col(label).startswith(prefix))


def two_way(df: DataFrame, label: str, benign: str = "Benign", malware: str = "Malware") -> DataFrame:
    return df.withColumn(label, F.when(F.col(label) == benign, benign).otherwise(malware))


def merge_variants(df: DataFrame, label: str, names: Mapping[str, str]) -> DataFrame:
    """A label that contains a key of ``names`` becomes its canonical form."""
    c = F.col(label)
    return df.withColumn(label, F.coalesce(*[F.when(F.contains(c, F.lit(k)), F.lit(v)) for k, v in names.items()], c))


def class_domain(df: DataFrame, label: str) -> DataFrame:
    """One row: the sorted distinct labels."""
    return df.agg(F.array_sort(F.collect_set(label)).alias("domain"))


def constant_label(df: DataFrame, value: int, label: str = "label") -> DataFrame:
    return df.withColumn(label, F.lit(value))


def keep_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    w = Window.partitionBy(*keys).orderBy(*[c.desc() if last else c.asc() for c in cols])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_least_transformed(df: DataFrame, name: str) -> DataFrame:
    """Of the transformations of one hash the smallest; originals stand before all."""
    from skein.functions.text import hash_in_name, transformation_of

    marked = df.withColumn("_h", hash_in_name(F.col(name))).withColumn("_t", F.coalesce(transformation_of(F.col(name)), F.lit(-1)))
    return keep_ordered(marked, ["_h"], ["_t", name]).drop("_h", "_t")


def duplicates(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows after the first of their key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def not_done(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose results are not there yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of or beside its own."""
    return base.join(changes, list(keys), "left_anti").unionByName(changes)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right): sizes of the differences, repeats counted."""
    marked = a.exceptAll(b).agg(F.count("*").alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))  # one row each
    return marked
