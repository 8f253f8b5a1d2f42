"""Tables in the folder that all executors share: they cut the lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # application to the folder that stands in for an unset one


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, and in local mode only, one of the application's own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="skein-")
    return _LOCAL[app]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of it."""
    spark = df.sparkSession
    at = f"{shared(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
