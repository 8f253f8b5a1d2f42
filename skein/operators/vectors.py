"""Vector tables: projections, filters, means, dense and sparse forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_positions(df: DataFrame, positions: Sequence[int], column: str = "features") -> DataFrame:
    """The features at 1-based positions, in their order."""
    return df.withColumn(column, F.array(*[F.get(column, p - 1) for p in positions]))


def whitelist(values: DataFrame, names: DataFrame, items: DataFrame, item: str, name: str, value: str) -> DataFrame:
    """(item, name, value) for each item and listed name, 0 where it has none; the list is a small dimension."""
    grid = items.select(item).distinct().crossJoin(F.broadcast(names.select(name).distinct()))
    return grid.join(values, [item, name], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def vector_sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def without_zero_rows(df: DataFrame, column: str = "features", least: float = 5e-5) -> DataFrame:
    return df.where(vector_sum(F.col(column)) >= least)


def all_zero(c: Column) -> Column:
    """No element differs from 0."""
    return F.forall(c, lambda x: x == 0)


def signed_sum_zero(c: Column) -> Column:
    """The sum is 0, which opposite signs may make."""
    return vector_sum(c) == 0


def zero_benign(df: DataFrame, name: str, mark: str, column: str = "features") -> DataFrame:
    """(benign, malicious): all-zero rows whose name contains ``mark``, and the others."""
    zero = df.where(all_zero(F.col(column)))
    return zero.agg(F.count_if(F.contains(F.col(name), F.lit(mark))).alias("benign"), F.count_if(~F.contains(F.col(name), F.lit(mark))).alias("malicious"))


def mean_vectors(df: DataFrame, keys: Sequence[str], column: str = "features") -> DataFrame:
    """Element-wise mean over the rows of a key: averages per position with map-side combine, then put together."""
    long = df.select(*keys, F.posexplode(column).alias("_i", "_x"))
    means = long.groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(column))


def dense(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, vector_to_array(F.col(column)))


def to_vector(df: DataFrame, column: str = "features") -> DataFrame:
    return df.withColumn(column, array_to_vector(F.col(column)))


def entries_to_vector(df: DataFrame, size: int, column: str = "entries", name: str = "features") -> DataFrame:
    """ML vectors of ``size`` from (index, value) entries, 0 where there is none."""
    at = F.map_from_entries(F.transform(F.col(column), lambda e: F.struct(e["index"].cast("int").alias("i"), e["value"].cast("double").alias("v"))))
    return df.withColumn(name, array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0)))))


def drop_id_index_label(df: DataFrame, key: str, label: str):
    """(rows without the id and with an indexed label, the label's names)."""
    from pyspark.ml.feature import StringIndexer

    model = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    return model.transform(df).drop(key), model.labels
