"""Shared storage, null-safe inputs and small helpers of the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a kernel works on at once; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20


_LOCAL: dict[str, str] = {}  # application to the folder that stands in for an unset one


def shared_dir(spark: SparkSession) -> str:
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


#: Settings while a table is written: few rows in a Python worker at once, and shuffle files go when the table is there.
WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """``WRITING`` holds inside; afterwards the session has its own settings again."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    now = before["spark.sql.execution.arrow.maxRecordsPerBatch"]
    try:
        for k, v in WRITING.items():
            if not (k.endswith("maxRecordsPerBatch") and now and 0 < int(now) < int(v)):
                spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables of one run in the shared folder: they cut lineage and outlive lost executors. Nothing of them is in the catalogue."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a scan of it."""
        path = f"{self.root}/{name}"
        with writing(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """As ``save``, dealt by ``key`` once, so that later joins and groups by it need no shuffle of this table."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"skein_{uuid.uuid4().hex[:16]}"
        with writing(self.spark):
            df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", f"{self.root}/{name}").saveAsTable(table)
        return forget_table(self.spark, table)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget_table(spark: SparkSession, name: str) -> DataFrame:
    """A scan of an external table that is taken out of the catalogue: files and buckets are known to the scan."""
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


#: A group with more than this share of all rows is hot; there are fewer than 1 / HOT_SHARE such groups. Tables of no more than
#: HOT_LEAST rows have none: a task can hold them whole.
HOT_SHARE, HOT_LEAST = 1e-3, 20_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with their groups (one row for each value of ``keys``, ``size``: its rows of ``total``), hot groups apart.

    Hot groups are at most a thousand and are broadcast, so that their rows stay where they are; the others are merged.
    Both sides are read twice.
    """
    if total <= HOT_LEAST:
        return rows.hint("merge").join(groups, keys)
    hot = F.col(size) > total * HOT_SHARE
    few = groups.where(hot)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").hint("merge").join(groups.where(~hot), keys)
    return rows.join(F.broadcast(few), keys).unionByName(rest)


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return [x for x in (f"_skein{i}" for i in range(n + len(taken))) if x not in taken][:n]


def without_rows(docs: DataFrame, rows: DataFrame, gone: Column, scratch: Scratch) -> DataFrame:
    """``docs`` without the rows for which ``gone`` holds in ``rows`` (doc_id, text_key, ...), which has one row for each of theirs.

    Rows go by id and text. Where no id has two texts, the ids alone say the same, and are fewer bytes to send.
    """
    keys = ["doc_id", "text_key"]
    several = rows.groupBy("doc_id").agg((F.min("text_key") < F.max("text_key")).alias("several")).where("several")
    a, b = free_names(docs, 2)
    if several.isEmpty():
        out = scratch.save(rows.where(gone).select("doc_id").distinct(), "gone")
        return docs.withColumn(a, F.col("doc_id").cast("long")).join(out.withColumnRenamed("doc_id", b), F.col(a).eqNullSafe(F.col(b)), "left_anti").select(*docs.columns)
    out = scratch.save(rows.where(gone).select(*keys).distinct(), "gone").toDF(f"{a}g", f"{b}g")
    return keyed(docs, a, b).join(out, same_row(a, b), "left_anti").select(*docs.columns)


def keyed(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``docs`` with the id as ``a`` and a hash of the text as ``b``."""
    return docs.withColumns({a: F.col("doc_id").cast("long"), b: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})


def same_row(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(f"{a}g")) & (F.col(b) == F.col(f"{b}g"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string")) % mod


#: Tables that a worker process keeps from task to task; a kernel of another operator frees them.
WORKER_TABLES: dict = {}


def give_back_memory() -> None:
    """Return freed memory to the system: a worker process waits for its next task with little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_worker_tables() -> None:
    """Free what another operator's tasks left in this worker process."""
    if WORKER_TABLES:
        for held in WORKER_TABLES.values():
            held.free()
        WORKER_TABLES.clear()
        give_back_memory()


def lean(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map kernel that gives its memory back at the end of a task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from kernel(batches)
        finally:
            give_back_memory()

    return run


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``limit`` bytes; null counts as empty.

    One row that is longer than the limit is a slice of its own: texts are never cut.
    """
    free_worker_tables()
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, n + 1 + col.offset)[col.offset :].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and offs[-1] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
