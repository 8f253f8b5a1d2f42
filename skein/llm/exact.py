"""Exact dedup on a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, forget_table, free_names, join_groups, keyed, same_row, shared_dir, without_rows

SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, digest, n_cp): hash of the text, SHA-256 of the text without ASCII white space, its code points.

    Null and empty texts, and texts of white space alone, all have the digest of the empty string.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.unhex(F.sha2(F.regexp_replace(text, SPACE_CLASS, ""), 256)).alias("digest"),
        F.length(text).alias("n_cp"),
    )


def best_of_each(prints: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_cp, group_size): the row that stays (most code points, then smallest id, no id last) and the group's size.

    Map-side partial aggregation leaves at most one row per digest and task, so a digest that a third
    of all rows share is no hot key.
    """
    first = F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    return prints.groupBy("digest").agg(first.alias("b"), F.count("*").alias("group_size")).select("digest", F.col("b.id").alias("keep_id"), (-F.col("b.n")).alias("keep_cp"), "group_size")


class DigestIndex:
    """Digests seen so far, kept as a table that is bucketed and sorted by digest.

    ``append(batch)`` finds the digests that are new with a sort-merge anti join, for which the index
    needs no shuffle, and appends only these, as further sorted files of the same buckets. A digest
    that is in the index keeps the row that was indexed first, whatever later batches hold.
    The name of the table is the state: a later run opens the same index by name, or, where the catalogue did
    not outlive the session, by ``path`` and ``buckets``, from which it is registered again.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex[:12]}"
        if not re.fullmatch(r"\w+", self.name):
            raise ValueError("an index name has letters, digits and underscores only")
        self.path = path or f"{shared_dir(spark)}/index/{self.name}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        if self.spark.catalog.tableExists(self.name):
            return True
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return False
        self.spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet OPTIONS (path '{self.path}') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")
        return True

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, best: DataFrame) -> DataFrame:
        """Add ``best`` (digest, keep_id, group_size; digests unique) where new; return a table of the new rows."""
        fresh = best.select("digest", "keep_id", "group_size")
        if self.exists():
            fresh = fresh.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        fresh = Scratch(self.spark, "fresh").save(fresh.repartition(self.buckets, "digest"), "rows")
        fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        return fresh

    def forget(self) -> DataFrame:
        """The index as a scan, its table taken out of the catalogue; the files stay."""
        return forget_table(self.spark, self.name)


def _judged(docs: DataFrame, index: DigestIndex | None) -> DataFrame:
    """(doc_id, text_key, n_cp, digest, keep_id, group_size, kept) of each row."""
    scratch = Scratch(docs.sparkSession, "exact")
    prints = scratch.save(fingerprint(docs), "prints")
    best = scratch.save(best_of_each(prints), "best")
    held = index or DigestIndex(docs.sparkSession)
    held.append(best)
    known = (held.read() if index else held.forget()).select("digest", F.col("keep_id").alias("first_id"))
    owner = best.hint("merge").join(known, "digest").select("digest", F.col("first_id").alias("keep_id"), "keep_cp", "group_size", F.col("keep_id").eqNullSafe(F.col("first_id")).alias("here"))
    owner = scratch.save(owner, "owner")
    rows = join_groups(prints, owner, ["digest"], "group_size", prints.count())
    return rows.withColumn("kept", F.col("here") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp")))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (lower-case hex).

    Texts are equal when they are identical without ASCII white space; null counts as empty. Of equal
    texts in one batch the one with the most code points stays, ties to the smallest id; a missing id is larger than all.
    With an index from earlier batches, a digest that it has drops the whole group, and keep_id is the indexed id.
    Rows with one doc_id and different texts are judged each for itself; rows that agree in id and text are the same document
    and all are ``kept`` or not. Only doc_id and text are read, so extra columns cannot clash. An empty table gives no rows.
    """
    return _judged(docs, index).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) = doc_id AS kept, text_sha256
FROM n
"""


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with one row of each group of equal texts, the one that stays in ``exact_dedup``.

    Rows go by doc_id and text, so another text of the same id stays, and rows without an id take part. Of rows that
    agree in both one stays, whichever.
    """
    scratch = Scratch(docs.sparkSession, "exact-kept")
    rows = scratch.save(_judged(docs, None).select("doc_id", "text_key", "kept"), "rows")
    twice = scratch.save(rows.where("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
    left = without_rows(docs, rows, ~F.col("kept"), scratch)
    if twice.isEmpty():
        return left
    a, b = free_names(docs, 2)
    left, more = keyed(left, a, b), twice.toDF(f"{a}g", f"{b}g")
    one = left.join(more, same_row(a, b), "left_semi").dropDuplicates([a, b])
    return left.join(more, same_row(a, b), "left_anti").unionByName(one).select(*docs.columns)
