"""Counts by priority, set algebra, label resolution, dedup, comparison, vectors, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import counts, joins, labels, split, vectors

from ._tables import read


def feature_union_lastwins(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("v"))
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg((F.count("*") * 100).alias("v"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("v"))
    return counts.merge_last_wins([c, o, e], ["id"], "v")


def three_way_intersection(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return joins.keys_in_all([c, o, e], "id")


def intersect_vectors(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array(F.count("*").cast("double"), F.round(F.max("o_totalprice"), 2)).alias("features"))
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.array(F.count("*").cast("double")).alias("features"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array("c_acctbal").alias("features"))
    return joins.intersect_and_concat([o, e, c], ["id"]).select("id", F.round(vectors.vector_sum(F.col("features")), 2).alias("total"), F.size("features").cast("long").alias("width"))


def kinds_complete(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return counts.count_by(joins.with_all_kinds(e, "user_id", "event_type", 5), ["user_id"])


def label_histogram(spark, sf_dir):
    return counts.count_by(read(spark, sf_dir, "embeddings"), ["label"])


def group_size_histogram(spark, sf_dir):
    return counts.group_size_histogram(read(spark, sf_dir, "orders"), "o_custkey")


def groups_by_size(spark, sf_dir):
    return counts.groups_by_size(read(spark, sf_dir, "lineitem"), "l_suppkey")


def family_resolution(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5("text"), 1, 2).alias("k"), "lang")
    lab = read(spark, sf_dir, "labels")
    one = lab.where("toxic = 1").select("doc_id", F.lit("toxic").alias("f1"))
    two = lab.where("quality = 0").select("doc_id", F.lit("low").alias("f2"))
    three = d.where("lang = 'de'").groupBy("k").agg(F.lit("german-prefix").alias("f3"))
    return labels.resolve(d.drop("lang"), [(one, "doc_id", "f1"), (two, "doc_id", "f2"), (three, "k", "f3")], "MALICIOUS").select("doc_id", "family")


def label_conflicts(spark, sf_dir):
    return labels.conflicting(read(spark, sf_dir, "documents").select(F.md5("text").alias("key"), "source"), "key", "source")


def dedupe_first(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    return labels.keep_ordered(d, ["key"], ["doc_id"])


def dedupe_last(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    return labels.keep_ordered(d, ["key"], ["doc_id"], last=True)


def dedupe_min_variant(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("t"), F.length("text"), F.lit("_"), F.substring(F.md5("text"), 1, 2), F.lit(".apk")).alias("name"))
    return labels.keep_least_transformed(d, "name")


def duplicate_rows(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    return labels.duplicates(d, ["key"], "doc_id")


def semi_select(spark, sf_dir):
    small = read(spark, sf_dir, "part").where("p_size = 1").select("p_partkey")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.selected(rows, small, F.col("l_partkey"), "p_partkey")


def anti_difference(spark, sf_dir):
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return labels.not_done(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), done, "c_custkey")


def removed_transformed(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5("text"), 1, 3).alias("h"))
    table = d.select("doc_id", F.concat("h", F.lit(".apk")).alias("name"))
    changed = d.where("doc_id % 3 = 0").select(F.concat(F.lit("t1_"), "h", F.lit(".apk")).alias("name"))
    return joins.not_transformed(table, changed, "name")


def lookup_status(spark, sf_dir):
    top = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order")).withColumnRenamed("o_custkey", "c_custkey")
    return joins.lookup_status(read(spark, sf_dir, "customer").select("c_custkey"), top, "c_custkey", "last_order")


def first_match_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus").withColumn("ord", F.col("o_orderkey"))
    return joins.first_match(read(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], ["ord"]).select("c_custkey", "o_orderkey", "o_orderstatus")


def table_compare(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    return joins.compare_tables(a, b, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def substring_join(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    return joins.contains_join(d, "text", "doc_id", b, "phrase").select("doc_id", "item_id")


def set_upsert(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    new = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("v"))
    return labels.upsert(c, new, ["id"])


def set_difference_sizes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return labels.same_rows(e.select("user_id", "event_type"), e.where("value > 10").select("user_id", "event_type"))


def cross_combinations(spark, sf_dir):
    d = read(spark, sf_dir, "customer").select("c_custkey", F.split("c_mktsegment", "").alias("a"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("b"))
    return joins.combinations(d, ["a", "b"])


def class_domain(spark, sf_dir):
    return labels.class_domain(read(spark, sf_dir, "documents"), "source").select(F.array_join("domain", ",").alias("domain"))


def first_seen_partition(spark, sf_dir):
    from skein.functions.text import year_of

    first = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_seen"))
    out = joins.with_first_seen(read(spark, sf_dir, "customer").select("c_custkey"), first, "c_custkey", F.lit("1990-01-01"))
    return out.withColumn("year", year_of(F.col("first_seen")))


def date_pivot_split(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return split.date_pivot(o, "o_orderpriority", "day", "o_orderkey")


def k_fold_parts(spark, sf_dir):
    return split.k_folds(read(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], 10)


def mean_vectors(spark, sf_dir):
    m = vectors.mean_vectors(read(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("features")), ["label"])
    return m.select("label", F.posexplode("features").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("mean"))


def vector_average_concat(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    scaled = [e.withColumn("features", F.expr(f"transform(features, x -> x * {k}D)")) for k in (1.0, 2.0, 3.0, 6.0)]
    mean = joins.zip_vectors(scaled, "id").select("id", F.round(vectors.vector_sum(F.col("features")), 5).alias("mean_sum"))
    wide = joins.zip_vectors(scaled, "id", "concat").select("id", F.size("features").cast("long").alias("width"))
    return mean.join(wide, "id")


def index_projection(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return vectors.select_positions(e, [1, 2, 3, 10, 64]).select("vec_id", *[F.get("features", i).alias(f"f{i}") for i in range(5)])


def zero_row_filter(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 0)).alias("features"))
    return vectors.without_zero_rows(e).select("vec_id", vectors.all_zero(F.col("features")).alias("zero"), vectors.vector_sum(F.col("features")).alias("total"))


def whitelist_projection(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    values = e.groupBy("user_id", "event_type").agg(F.count("*").alias("cnt"))
    names = spark.createDataFrame([("click",), ("view",), ("absent",)], "event_type string")
    return vectors.whitelist(values, names, e, "user_id", "event_type", "cnt")


def sparse_matrix(spark, sf_dir):
    c = read(spark, sf_dir, "events").groupBy("user_id", F.concat("event_type", F.lit("@"), F.dayofmonth("ts")).alias("feature")).agg(F.count("*").alias("cnt"))
    rows = counts.sparse_rows(c, ["user_id"], counts.vocabulary(c))
    return rows.select("user_id", F.explode("entries").alias("e")).select("user_id", "e.index", "e.value")


def added_counts(spark, sf_dir):
    c = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("feature")).agg(F.count("*").alias("cnt"))
    return counts.add_counts(read(spark, sf_dir, "customer").select("c_custkey"), c, "c_custkey", ["click", "view"])


def reflection_counters(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select("user_id", F.when(F.col("value") > 20, F.col("event_type")).alias("name"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("class"))
    return counts.reflection_counters(calls, ["user_id"])


def callees_by_caller(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller"), "l_linenumber", F.col("l_partkey").cast("string").alias("callee"))
    return counts.callees_by_caller(e, [], ["l_linenumber", "callee"]).select("caller", F.array_join("callees", ",").alias("callees"))


def flag_totals(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    f = counts.flag_totals(e, ["event_type"], {"big": F.col("value") > 30, "odd": F.col("user_id") % 2 == 1})
    return f.join(counts.ratio(e, ["event_type"], F.col("value") > 30).withColumn("ratio", F.round("ratio", 6)), "event_type")


QUERIES = {f.__name__: f for f in (feature_union_lastwins, three_way_intersection, intersect_vectors, kinds_complete, label_histogram, group_size_histogram, groups_by_size, family_resolution, label_conflicts, dedupe_first, dedupe_last, dedupe_min_variant, duplicate_rows, semi_select, anti_difference, removed_transformed, lookup_status, first_match_join, table_compare, substring_join, set_upsert, set_difference_sizes, cross_combinations, class_domain, first_seen_partition, date_pivot_split, k_fold_parts, mean_vectors, vector_average_concat, index_projection, zero_row_filter, whitelist_projection, sparse_matrix, added_counts, reflection_counters, callees_by_caller, flag_totals)}
ORACLES = {
    "feature_union_lastwins": "SELECT id, arg_max(v, p) AS v FROM (SELECT c_custkey AS id, 0 AS v, 0 AS p FROM customer UNION ALL SELECT o_custkey, count(*), 1 FROM orders GROUP BY 1 UNION ALL SELECT user_id, count(*) * 100, 2 FROM events GROUP BY 1) GROUP BY id",
    "three_way_intersection": "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events",
    "intersect_vectors": "SELECT id, round(n + m + k + b, 2) AS total, CAST(4 AS BIGINT) AS width FROM (SELECT o_custkey AS id, count(*)::DOUBLE AS n, round(max(o_totalprice), 2) AS m FROM orders GROUP BY 1) JOIN (SELECT user_id AS id, count(*)::DOUBLE AS k FROM events GROUP BY 1) USING (id) JOIN (SELECT c_custkey AS id, c_acctbal AS b FROM customer) USING (id)",
    "kinds_complete": "SELECT user_id, count(*) AS cnt FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5",
    "label_histogram": "SELECT label, count(*) AS cnt FROM embeddings GROUP BY 1",
    "group_size_histogram": "SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM orders GROUP BY o_custkey) GROUP BY 1",
    "groups_by_size": "SELECT l_suppkey, count(*) AS cnt FROM lineitem GROUP BY 1",
    "family_resolution": """WITH d AS (SELECT doc_id, substr(md5(text), 1, 2) AS k, lang FROM documents)
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'low' WHEN d.k IN (SELECT k FROM d WHERE lang = 'de') THEN 'german-prefix' ELSE 'MALICIOUS' END AS family FROM d LEFT JOIN labels l USING (doc_id)""",
    "label_conflicts": "SELECT md5(text) AS key, count(DISTINCT source) AS n_labels FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "dedupe_first": "SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY 2",
    "dedupe_last": "SELECT max(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY 2",
    "dedupe_min_variant": "SELECT 't' || min(length(text)) || '_' || substr(md5(text), 1, 2) || '.apk' AS name FROM documents GROUP BY substr(md5(text), 1, 2)",
    "duplicate_rows": "SELECT doc_id, md5(text) AS key FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1",
    "semi_select": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)",
    "anti_difference": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "removed_transformed": "WITH d AS (SELECT doc_id, substr(md5(text), 1, 3) AS h FROM documents) SELECT doc_id, h || '.apk' AS name FROM d WHERE h NOT IN (SELECT h FROM d WHERE doc_id % 3 = 0)",
    "lookup_status": "SELECT c_custkey, max(o_orderkey) AS last_order, max(o_orderkey) IS NOT NULL AS matched FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "first_match_join": "SELECT c_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "table_compare": "SELECT o_orderkey, 'o_orderstatus' AS \"column\", o_orderstatus AS a, 'X' AS b FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority, NULL FROM orders WHERE o_orderkey % 7 = 0",
    "substring_join": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "set_upsert": "SELECT c_custkey AS id, coalesce(p, c_mktsegment) AS v FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "set_difference_sizes": "SELECT count(*) FILTER (WHERE NOT value > 10) AS only_left, CAST(0 AS BIGINT) AS only_right FROM events",
    "cross_combinations": "SELECT c_custkey, a, b FROM (SELECT c_custkey, unnest(string_split(c_mktsegment, '')) AS a FROM customer) JOIN (SELECT c_custkey AS k, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['x', 'y'] ELSE [NULL] END) AS b FROM customer) ON k = c_custkey",
    "class_domain": "SELECT string_agg(source, ',' ORDER BY source) AS domain FROM (SELECT DISTINCT source FROM documents)",
    "first_seen_partition": "SELECT c_custkey, coalesce(strftime(min(o_orderdate), '%Y-%m-%d'), '1990-01-01') AS first_seen, coalesce(strftime(min(o_orderdate), '%Y'), '1990') AS year FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "date_pivot_split": """WITH o AS (SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM o),
p AS (SELECT o_orderpriority, day AS "pivot" FROM r WHERE rn = n * 7 // 10 + 1) SELECT o_orderkey, o_orderpriority, day, "pivot", CASE WHEN day > "pivot" THEN 'test' ELSE 'train' END AS part FROM o JOIN p USING (o_orderpriority)""",
    "k_fold_parts": "SELECT doc_id, quality, CAST(ntile(10) OVER (ORDER BY doc_id) - 1 AS INT) AS fold FROM labels",
    "mean_vectors": "SELECT label, CAST(pos - 1 AS BIGINT) AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2",
    "vector_average_concat": "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE + x::DOUBLE * 2 + x::DOUBLE * 3 + x::DOUBLE * 6) / 4)), 5) AS mean_sum, CAST(4 * len(embedding) AS BIGINT) AS width FROM embeddings",
    "index_projection": "SELECT vec_id, embedding[1]::DOUBLE AS f0, embedding[2]::DOUBLE AS f1, embedding[3]::DOUBLE AS f2, embedding[10]::DOUBLE AS f3, embedding[64]::DOUBLE AS f4 FROM embeddings",
    "zero_row_filter": "SELECT vec_id, len(list_filter(v, lambda x: x <> 0)) = 0 AS zero, list_sum(v) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 0)) AS v FROM embeddings) WHERE list_sum(v) >= 5e-5",
    "whitelist_projection": "SELECT user_id, t AS event_type, count(*) FILTER (WHERE event_type = t) AS cnt FROM events, (VALUES ('click'), ('view'), ('absent')) v(t) GROUP BY 1, 2",
    "sparse_matrix": """WITH c AS (SELECT user_id, event_type || '@' || day(ts) AS feature, count(*) AS cnt FROM events GROUP BY 1, 2), v AS (SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS INT) AS index FROM (SELECT DISTINCT feature FROM c))
SELECT user_id, index, CAST(cnt AS DOUBLE) AS value FROM c JOIN v USING (feature)""",
    "added_counts": "SELECT c_custkey, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view FROM customer JOIN events ON user_id = c_custkey GROUP BY 1",
    "reflection_counters": """WITH w AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE NOT value > 20) AS non_constant, count(*) FILTER (WHERE value > 20 AND event_type = 'error') AS no_class, count(*) FILTER (WHERE value > 20 AND event_type <> 'error') AS "full" FROM events GROUP BY 1)
SELECT user_id, counter, cnt FROM (UNPIVOT w ON total, non_constant, no_class, "full" INTO NAME counter VALUE cnt)""",
    "callees_by_caller": "SELECT l_orderkey AS caller, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey::VARCHAR) AS callees FROM lineitem GROUP BY 1",
    "flag_totals": "SELECT event_type, count(*) FILTER (WHERE value > 30) AS big, count(*) FILTER (WHERE user_id % 2 = 1) AS odd, round(count(*) FILTER (WHERE value > 30)::DOUBLE / count(*), 6) AS ratio FROM events GROUP BY 1",
}
