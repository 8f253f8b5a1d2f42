"""Not-modified captures resolved by an as-of join to the latest earlier full response of the same page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

# Query parameters that do not change a page, and header fields that a 304 may not replace.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
KEPT_FIELDS = ["content-encoding", "content-length", "content-location", "content-range", "content-type", "transfer-encoding"]
#: Rows of one page and time bucket that a task orders at once, about; and time buckets at most.
BUCKET_ROWS, MAX_BUCKETS = 20_000, 1000


def canonical_url(url: Column) -> Column:
    """Host (lower case; no user, default port, www. or m.), path without a last slash, other parameters sorted.

    Scheme and fragment go. Null stays null; a text without a host is taken as a path.
    """
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(whole, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), "^(www[0-9]*|m)\\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def _plain(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored fields, replaced and joined by those of a not-modified answer that it may change."""
    none = F.create_map().cast("map<string,string>")
    allowed = F.map_filter(F.coalesce(update, none), lambda k, v: ~k.isin(KEPT_FIELDS))
    old = F.map_filter(F.coalesce(stored, none), lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(old, allowed)


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Per not-modified capture: record_id, page, ts, refers_to, state, etag, last_modified, digest, headers.

    ``captures``: record_id long, url, ts long, kind ('response' or 'revisit'), etag, last_modified,
    digest (strings) and headers (map of lower-case fields). Full responses are ordered in a page by
    (ts, record_id); a revisit refers to the last that is strictly earlier in ts. Its validators are
    then checked: entity tags (weak ones by value) if it has one, else last-modified, else digest. States:
    ``resolved``, ``mismatch`` (a validator differs or is missing in the response), ``unverified`` (the
    revisit has no validator) and ``orphan`` (no earlier response, or no url or ts). Only resolved rows
    have refers_to, the response's digest and last-modified, and merged headers; the others keep their own.

    A page that holds a third of all captures is no single task: captures are dealt by (page, time
    bucket), the buckets being quantiles of all times; what earlier buckets leave open is one row per
    page and bucket, carried forward in a second, small window. Every revisit gives one row, repeated
    rows included. Rows of other kinds are passed over. Other columns are not read.
    """
    spark = captures.sparkSession
    scratch = Scratch(spark, "revisit")
    stored = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    rows = captures.where(F.col("kind").isin("response", "revisit")).select(canonical_url(F.col("url")).alias("page"), F.col("ts").cast("long").alias("ts"), F.col("record_id").cast("long").alias("record_id"), "kind", "etag", "last_modified", "digest", "headers")
    rows = scratch.save(rows, "rows")
    n = rows.count()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    cuts = sorted(set(rows.agg(F.percentile_approx("ts", [i / buckets for i in range(1, buckets)] or [1.0], 10 * MAX_BUCKETS).alias("c")).first()["c"] or [])) if buckets > 1 else []
    bucket = sum((F.col("ts") > c).cast("int") for c in cuts) if len(cuts) < 64 and cuts else F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("ts"))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    full = F.when(F.col("kind") == "response", stored)
    # at one ts no response is earlier than a revisit: the frame ends before the row's own ts
    here = Window.partitionBy("page", "bucket").orderBy(F.col("ts"), (F.col("kind") == "response").cast("int"), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.where("page IS NOT NULL AND ts IS NOT NULL").withColumn("found", F.last(full, True).over(here)).where("kind = 'revisit'")
    ends = rows.where("kind = 'response' AND page IS NOT NULL AND ts IS NOT NULL").groupBy("page", "bucket").agg(F.max_by(stored, F.struct("ts", "record_id")).alias("end"))
    slots = rows.where("page IS NOT NULL AND ts IS NOT NULL").select("page", "bucket").distinct().join(ends, ["page", "bucket"], "left")
    before = Window.partitionBy("page").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = scratch.save(slots.withColumn("carried", F.last("end", True).over(before)).where("carried IS NOT NULL").select("page", "bucket", "carried"), "carried")
    near = scratch.save(near, "near")
    dated = near.join(carried, ["page", "bucket"], "left").withColumn("of", F.coalesce("found", "carried")).drop("found", "carried", "bucket")
    undated = rows.where("kind = 'revisit' AND (page IS NULL OR ts IS NULL)").drop("bucket").withColumn("of", F.lit(None).cast(dated.schema["of"].dataType))
    both = dated.unionByName(undated)
    same = (
        F.when(F.col("etag").isNotNull(), F.coalesce(_plain(F.col("etag")) == _plain(F.col("of.etag")), F.lit(False)))
        .when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("of.last_modified"), F.lit(False)))
        .when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == F.col("of.digest"), F.lit(False)))
    )
    state = F.when(F.col("of").isNull(), "orphan").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    ok = F.col("state") == "resolved"
    return both.withColumn("state", state).select(
        "record_id", "page", "ts",
        F.when(ok, F.col("of.record_id")).alias("refers_to"), "state",
        F.when(ok, F.coalesce("etag", "of.etag")).otherwise(F.col("etag")).alias("etag"),
        F.when(ok, F.coalesce("last_modified", "of.last_modified")).otherwise(F.col("last_modified")).alias("last_modified"),
        F.when(ok, F.col("of.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(ok, merged_headers(F.col("of.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of crawled pages, which hold no revisits themselves: of every page a full response and a later check.

    Response: record 2 * page_id at ts 2 * page_id, tagged by the md5 of its html. Check: record 2 * page_id
    + 1; by length modulo 7 it comes 3 to 5003 later or (0) just before, and repeats the tag (weakly, plainly or
    wrongly), the date or the digest. Where addresses of two pages are one, a check meets the later page's response.
    """
    html = F.coalesce("html", F.lit(""))
    tag, size, day = F.md5(html), F.length(html), F.concat(F.lit("day-"), (F.length(html) % 365).cast("string"))
    base = pages.select("page_id", "url", tag.alias("tag"), size.alias("size"), day.alias("day"), (size % 7).alias("m"))
    none = F.lit(None).cast("string")
    response = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 2).alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), F.col("day").alias("last_modified"), F.col("tag").alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size").cast("string"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    check = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url",
        (F.col("page_id") * 2 + F.when(F.col("m") == 0, -1).otherwise(F.col("m") * 1000 - 999 + 2)).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(F.col("m") == 1, F.concat(F.lit("W/"), "tag")).when(F.col("m").isin(0, 2), F.col("tag")).when(F.col("m") == 3, F.lit("old")).alias("etag"),
        F.when(F.col("m") == 4, F.col("day")).otherwise(none).alias("last_modified"),
        F.when(F.col("m") == 5, F.col("tag")).otherwise(none).alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("date"), F.concat(F.lit("t"), F.col("page_id").cast("string"))).alias("headers"),
    )
    return response.unionByName(check)


def revisit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "page", "ts", "refers_to", "state", "etag", "last_modified", "digest", fields.alias("headers"))


ORACLE = """
WITH base AS (SELECT page_id, trim(regexp_replace(url, '#.*$', '')) AS u, md5(coalesce(html, '')) AS tag, length(coalesce(html, '')) AS size FROM pages),
rest AS (SELECT *, regexp_replace(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS r, size % 7 AS m, 'day-' || (size % 365) AS day FROM base),
parts AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^(www[0-9]*|m)\\.', '') AS host,
  regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(r, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS query FROM rest),
named AS (SELECT *, host || (CASE WHEN path = '' THEN '/' ELSE path END) || (CASE WHEN query = '' THEN '' ELSE '?' || query END) AS page FROM parts),
resp AS (SELECT page_id * 2 AS record_id, page, page_id * 2 AS ts, tag AS etag, day AS last_modified, tag AS digest, size FROM named),
chk AS (SELECT page_id * 2 + 1 AS record_id, page, page_id * 2 + (CASE WHEN m = 0 THEN -1 ELSE m * 1000 - 999 + 2 END) AS ts, page_id,
  CASE WHEN m = 1 THEN 'W/' || tag WHEN m IN (0, 2) THEN tag WHEN m = 3 THEN 'old' END AS etag, CASE WHEN m = 4 THEN day END AS last_modified, CASE WHEN m = 5 THEN tag END AS digest FROM named),
j AS (SELECT c.*, r.record_id AS rid, r.etag AS retag, r.last_modified AS rday, r.digest AS rdigest, r.size AS rsize FROM chk c ASOF LEFT JOIN resp r ON c.page = r.page AND c.ts > r.ts),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'orphan'
  WHEN etag IS NOT NULL THEN (CASE WHEN regexp_replace(etag, '^W/', '') = retag THEN 'resolved' ELSE 'mismatch' END)
  WHEN last_modified IS NOT NULL THEN (CASE WHEN last_modified = rday THEN 'resolved' ELSE 'mismatch' END)
  WHEN digest IS NOT NULL THEN (CASE WHEN digest = rdigest THEN 'resolved' ELSE 'mismatch' END) ELSE 'unverified' END AS state FROM j)
SELECT record_id, page, ts, CASE WHEN state = 'resolved' THEN rid END AS refers_to, state,
  CASE WHEN state = 'resolved' THEN coalesce(etag, retag) ELSE etag END AS etag,
  CASE WHEN state = 'resolved' THEN coalesce(last_modified, rday) ELSE last_modified END AS last_modified,
  CASE WHEN state = 'resolved' THEN rdigest ELSE digest END AS digest,
  'cache-control=max-age=600;content-length=' || (CASE WHEN state = 'resolved' THEN rsize || ';content-type=text/html' ELSE '0' END) || ';date=t' || page_id AS headers
FROM s
"""
