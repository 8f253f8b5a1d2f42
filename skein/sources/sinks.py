"""Writers of the output formats; paths are folders, as Spark writes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key_value_lines(tokens: DataFrame, path: str, by_app: bool = True) -> None:
    """``Key_Value`` lines of (app, key, value), one folder per app."""
    out = tokens.select("app", F.concat_ws("_", "key", "value").alias("value"))
    (out.repartition("app").sortWithinPartitions("app", "value").write.mode("overwrite").partitionBy("app").text(path) if by_app else out.select("value").write.mode("overwrite").text(path))


def feature_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Wide rows with a header; arrays are not bracketed but spread by ``spread`` first."""
    df.write.mode(mode).option("header", True).csv(path)


def spread(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """An array column as named columns, placed where it stood."""
    return df.select(*[x for c in df.columns for x in ([F.get(c, i).alias(n) for i, n in enumerate(names)] if c == column else [F.col(c)])])


def by_year(df: DataFrame, path: str, collection: str, year: str = "year", mode: str = "append") -> None:
    """Rows appended under collection and year folders."""
    df.withColumn("collection", F.lit(collection)).repartition("collection", year).write.mode(mode).partitionBy("collection", year).parquet(path)


def by_archive_day(df: DataFrame, stamp: str, path: str) -> None:
    """Rows by the day of a ``YYYYMMDDhhmmss`` stamp."""
    df.withColumn("day", F.expr(f"cast({stamp} as bigint) div 1000000")).repartition("day").write.mode("overwrite").partitionBy("day").parquet(path)


def name_count_lines(counts: DataFrame, path: str) -> None:
    counts.select("app", F.concat_ws(",", "feature", F.col("cnt").cast("string")).alias("value")).repartition("app").write.mode("overwrite").partitionBy("app").text(path)


def arff_header(df: DataFrame, relation: str, nominal: dict[str, Sequence[str]]) -> list[str]:
    kinds = {f.name: "NUMERIC" if isinstance(f.dataType, T.NumericType) else "STRING" for f in df.schema.fields} | {c: "{" + ",".join(v) + "}" for c, v in nominal.items()}
    return [f"@RELATION {relation}", "", *[f"@ATTRIBUTE '{c}' {kinds[c]}" for c in df.columns], "", "@DATA"]


def arff_rows(df: DataFrame, nominal: dict[str, Sequence[str]], sparse: bool = False) -> DataFrame:
    """(value): the rows of an attribute-relation file, dense or sparse."""
    text = lambda f: F.concat(F.lit("'"), F.col(f"`{f.name}`").cast("string"), F.lit("'")) if isinstance(f.dataType, T.StringType) and f.name not in nominal else F.col(f"`{f.name}`").cast("string")
    if sparse:
        cells = [F.when(~is_left_out(f, nominal), F.concat(F.lit(f"{i} "), F.coalesce(text(f), F.lit("?")))) for i, f in enumerate(df.schema.fields)]
        body = F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))
    else:
        body = F.concat_ws(",", *[F.coalesce(text(f), F.lit("?")) for f in df.schema.fields])
    return df.select(body.alias("value"))


def is_left_out(f: T.StructField, nominal: dict[str, Sequence[str]]):
    """Whether a sparse row leaves the field out: numeric zeros and a nominal's first value."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.NumericType):
        return F.coalesce(c == 0, F.lit(False))
    return F.coalesce(c == nominal[f.name][0], F.lit(False)) if f.name in nominal else F.lit(False)


def write_arff(df: DataFrame, path: str, relation: str, nominal: dict[str, Sequence[str]], sparse: bool = False) -> None:
    """A folder: ``header.arff`` and the rows as part files, written in parallel. ``cat header.arff part-*`` is one attribute-relation file."""
    arff_rows(df, nominal, sparse).write.mode("overwrite").text(path)
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/header.arff")
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(("\n".join(arff_header(df, relation, nominal)) + "\n").encode()))
    out.close()


def report(df: DataFrame, path: str, mode: str = "append") -> None:
    """Tab-separated report rows."""
    df.write.mode(mode).option("sep", "\t").csv(path)


def metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def curve_points(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def status_log(df: DataFrame, path: str) -> None:
    """Ids with their status, appended."""
    df.select("id", "status").write.mode("append").json(path)


def family_manifest(files: DataFrame, families: DataFrame, key: str = "hash") -> DataFrame:
    """(path, target): where each file of a chosen family belongs; no file is copied."""
    return files.join(families, key).select("path", F.concat_ws("/", "family", F.regexp_extract("path", "([^/]*)$", 1)).alias("target"))


def table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Any exported object as Parquet."""
    df.write.mode(mode).parquet(path)
