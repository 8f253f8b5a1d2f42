"""Every reader and writer: tables are written in a format, read back, and compared with SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.operators import joins, reports
from skein.sources import readers, sinks

from ._tables import read, shared


def _at(spark, name):
    return f"{shared(spark)}/io-{name}-{uuid.uuid4().hex[:12]}"


def _written(spark, df, name):
    at = _at(spark, name)
    df.select("value").write.text(at)
    return at


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")


def _nations(spark, sf_dir):
    return read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def token_files(spark, sf_dir):
    at = _written(spark, read(spark, sf_dir, "customer").select(F.upper("c_mktsegment").alias("value")), "tokens")
    t = readers.token_files(spark, at).select(F.explode("tokens").alias("token")).where("token <> ''")
    return t.groupBy("token").agg(F.count("*").alias("cnt"))


def key_value_files(spark, sf_dir):
    at = _at(spark, "kv")
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("b"), F.col("p_size") % 5).alias("app"), F.lit("Type").alias("key"), F.translate("p_type", " ", "_").alias("value"))
    sinks.key_value_lines(p, at)
    return readers.key_value_tokens(spark, at).groupBy("key", "value").agg(F.count("*").alias("cnt"))


def call_graph_lines(spark, sf_dir):
    k = F.col("s_suppkey")
    lines = read(spark, sf_dir, "supplier").select(_text("<c", k % 9, ".K: void m", k, "(int)> ==> ['<d.E: int x", k % 4, "()>\\n', '<f.G: y z(", k % 3, ")>\\n']"))
    at = _written(spark, lines.union(lines.select(F.lit("noise ==> here"))), "calls")
    return readers.parse_call_line(readers.call_lines(spark, at)).select("caller", F.explode("callees").alias("callee"))


def raw_edges(spark, sf_dir):
    k = F.col("s_suppkey")
    dump = read(spark, sf_dir, "supplier").select(F.when(k % 2 == 0, _text("r0 = call in <a", k, "> ==> <b", k % 7, ">")).otherwise(_text("<a", k, "> ==> <x> ==> <b>")).alias("value"))
    return readers.parse_edge_dump(dump).select("caller", "callee")


def wide_csv(spark, sf_dir):
    at = _at(spark, "wide")
    p = read(spark, sf_dir, "part").select("p_partkey", F.array(_text("[", F.col("p_size")), _text(F.col("p_partkey") % 100, "]")).alias("f"))
    sinks.feature_csv(sinks.spread(p, "f", ["first", "second"]), at)
    return readers.wide_features(spark, at, "double")


def centrality_csv(spark, sf_dir):
    at = _at(spark, "centrality")
    e = read(spark, sf_dir, "embeddings").select(F.md5(F.col("vec_id").cast("string")).alias("sha256"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("f"), "label")
    sinks.feature_csv(sinks.spread(e, "f", ["a", "b", "c"]), at)
    c = readers.centrality_csv(spark, at)
    return c.select("sha256", *[F.get("features", i).alias(n) for i, n in enumerate("abc")], "label")


def gexf_graph(spark, sf_dir):
    n = _nations(spark, sf_dir)
    nodes = F.array_join(F.array_sort(F.collect_list(_text('<node id="', F.col("n_nationkey"), '" label="', F.col("n_name"), '"/>'))), "")
    edges = F.array_join(F.array_sort(F.collect_list(_text('<edge source="', F.col("n_nationkey"), '" target="r"/>'))), "")
    graph = n.groupBy("r_name").agg(nodes.alias("n"), edges.alias("e")).select(_text('<gexf xmlns="http://gexf.net/1.2"><graph><nodes>', F.col("n"), '<node id="r" label="', F.col("r_name"), '"/></nodes><edges>', F.col("e"), "</edges></graph></gexf>"))
    at = _at(spark, "gexf")
    graph.write.option("maxRecordsPerFile", 1).text(at)
    return readers.gexf_edges(spark, at).select("src", "dst")


def name_count_files(spark, sf_dir):
    at = _at(spark, "counts")
    c = read(spark, sf_dir, "events").groupBy(F.concat(F.lit("a"), F.col("user_id") % 4).alias("app"), F.concat(F.lit("x,"), "event_type").alias("feature")).agg(F.count("*").alias("cnt"))
    sinks.name_count_lines(c, at)
    return readers.name_counts(spark, at, "events").groupBy("kind", "feature").agg(F.sum("cnt").alias("cnt"))


def dated_vectors(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(_text(F.col("o_orderkey"), " ", F.date_format("o_orderdate", "yyyy-MM-dd"), "\t", F.col("o_custkey"), "  ", F.col("o_orderkey") % 7))
    v = readers.dated_vectors(readers.lines(spark, _written(spark, o, "vectors")), 4)
    return v.select("app", "date", F.get("features", 0).alias("f0"), F.get("features", 1).alias("f1"))


def label_maps(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.lit("f").alias("path"), F.col("o_orderkey").alias("line_no"), F.when(F.col("o_orderkey") % 11 == 0, F.lit("three words here")).otherwise(_text("C", F.col("o_custkey"), "\t", F.col("o_orderstatus"), " ")).alias("value"))
    keep = lambda how: readers.two_token_map(rows, ("id", how), keep=how).select("id", how)
    n = readers.two_token_map(rows, ("id", "label")).groupBy("id").agg(F.count("*").alias("n"))
    return keep("first").join(keep("last"), "id").join(n, "id")


def first_seen_lines(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, F.lit("two tokens")).otherwise(_text(F.col("o_orderkey"), " ", F.date_format("o_orderdate", "yyyy-MM-dd"), " 10:", F.col("o_custkey") % 60)).alias("value"))
    return readers.first_seen(readers.lines(spark, _written(spark, o, "seen")))


def catalogue_columns(spark, sf_dir):
    at = _at(spark, "catalogue")
    sinks.metrics(read(spark, sf_dir, "customer").select(F.upper(F.md5("c_name")).alias("sha256"), "c_acctbal", F.concat(F.lit(" "), F.md5("c_mktsegment")).alias("md5"), "c_nationkey"), at)
    return readers.catalogue(spark, at)


def id_lists(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 4 == 0, F.lit(" ")).otherwise(_text(" ID", F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, ".APK").otherwise(".txt"))).alias("value"))
    return readers.id_list(readers.lines(spark, _written(spark, p, "ids")))


def _manifest():
    k = F.col("n_nationkey")
    return _text(
        '<manifest xmlns:android="u" package="p.', k, '"><uses-permission android:name="android.permission.P', k % 4, '"/><uses-permission android:name="android.permission.P', k % 2, '"/><application><activity android:name=".A" android:exported="', (k % 2 == 0).cast("string"),
        '"><intent-filter><action android:name="android.intent.action.V', k % 5, '"/><action android:name="own.', k, '"/><category android:name="c', k % 3, '"/><data android:scheme="http"/></intent-filter></activity><receiver android:name="R"><intent-filter><action android:name="android.intent.action.V', k % 5, '"/></intent-filter></receiver></application></manifest>',
    )


def manifest_sets(spark, sf_dir):
    at = _at(spark, "manifests")
    read(spark, sf_dir, "nation").select(_manifest()).write.option("maxRecordsPerFile", 1).text(at)
    m = readers.manifests(spark, at)
    names = m.select("name", "package")
    need = readers.requested_permissions(m).select("name", F.array_join("permissions", " ").alias("permissions"))
    actions = readers.system_actions(m).groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("action")), " ").alias("actions"))
    return names.join(need, "name").join(actions, "name").drop("name")


def intent_filter_rows(spark, sf_dir):
    f = readers.intent_filters(read(spark, sf_dir, "nation").select("n_nationkey", _manifest()))
    return f.select("n_nationkey", "type", "component", "exported", *[F.array_join(c, " ").alias(c) for c in ("actions", "categories", "schemes")])


def arff_table(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("a"), "p_partkey").alias("name"), F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("double")).otherwise(0.0).alias("size"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_partkey") % 4).cast("double").alias("rest"), F.when(F.col("p_partkey") % 2 == 0, "Benign").otherwise("Evil").alias("class"))
    out = None
    for sparse in (False, True):
        at = _at(spark, "arff")
        sinks.write_arff(p, at, "parts", {"class": ["Benign", "Evil"]}, sparse)
        t = readers.arff(spark, at).withColumn("sparse", F.lit(sparse))
        out = t if out is None else out.unionByName(t)
    return out


def section_members(spark, sf_dir):
    """Sections of one file: a region, its nations, an empty line."""
    n = _nations(spark, sf_dir).select("r_regionkey", "r_name", "n_nationkey", "n_name")
    body = n.select((F.col("r_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("line_no"), F.concat(F.lit(" "), "n_name").alias("value"))
    heads = n.select("r_regionkey", "r_name").distinct()
    rows = body.union(heads.select(F.col("r_regionkey") * 1000, "r_name")).union(heads.select(F.col("r_regionkey") * 1000 + 999, F.lit("")))
    return readers.sectioned_list(rows.withColumn("path", F.lit("f")))


def source_sink_list(spark, sf_dir):
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(F.when(k % 3 == 0, F.lit("% a comment")).otherwise(_text("<a.B: c m", k, "(java.lang.String)> -> ", F.when(k % 2 == 0, "_SOURCE_").otherwise("_SINK_"))).alias("value"))
    return readers.sources_and_sinks(rows)


def method_category_list(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(_text("<m", F.col("p_partkey"), "> % ", F.col("p_type")))
    return readers.method_categories(rows)


def api_permissions(spark, sf_dir):
    """Calls with the permissions that they need, by a mapping list."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(_text("a.b.C", k, ".run([I,java.lang.String)V  ::  P.ONE", F.when(k % 2 == 0, ", P.TWO").otherwise("")))
    calls = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _text("<a.b.C", F.col("l_partkey"), ": V run(I[],java.lang.String)>").alias("signature"))
    return joins.with_permissions(calls, readers.permission_mapping(rows), "signature")


def inverted_permissions(spark, sf_dir):
    n = _nations(spark, sf_dir).groupBy("r_name").agg(F.array_sort(F.collect_list(F.array(F.lit("Cls"), F.concat(F.lit("M"), F.col("n_nationkey") % 7)))).alias("apis"))
    whole = n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r_name", "apis")))).alias("m")).select(F.to_json("m").alias("value"))
    return readers.inverted_json_map(whole)


def flow_log_rows(spark, sf_dir):
    """A log per region: an app, then a sink of each nation with two sources."""
    n = _nations(spark, sf_dir).select("r_name", "n_nationkey", "n_name")
    lines = n.select("r_name", F.explode(F.array(*[F.struct((F.col("n_nationkey") * 10 + i).alias("line_no"), v) for i, v in enumerate([_text("[main] INFO x.Y - Found a flow to sink ", F.col("n_name"), ", from the following sources:"), _text("[main] INFO x.Y - - one ", F.col("n_nationkey")), _text("- two"), _text("noise")], 1)])).alias("l"))
    heads = n.select("r_name").distinct().select("r_name", F.struct(F.lit(0).alias("line_no"), _text("[main] INFO x.Y - Analyzing file ", F.translate("r_name", " ", "_"), ".apk")).alias("l"))
    return readers.flow_log(lines.unionAll(heads).select(F.col("r_name").alias("path"), "l.line_no", "l.value"))


def run_times(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.explode(F.array(F.struct((F.col("s_suppkey") * 2).alias("line_no"), _text("processing app", F.col("s_suppkey"))), F.struct((F.col("s_suppkey") * 2 + 1).alias("line_no"), F.when(F.col("s_suppkey") % 3 > 0, _text("it ran for ", F.col("s_suppkey"), ".5 seconds")).otherwise("failed").alias("value")))).alias("l")).select(F.lit("f").alias("path"), "l.line_no", "l.value")
    return readers.runtime_log(s)


def status_log(spark, sf_dir):
    at = _at(spark, "status")
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "done").otherwise("failed").alias("status"))
    sinks.status_log(s, at)
    sinks.status_log(s.where("status = 'failed'"), at)
    return readers.json_records(spark, at, "id string, status string").groupBy("id", "status").agg(F.count("*").alias("n"))


def node_link_edges(spark, sf_dir):
    n = _nations(spark, sf_dir)
    ids = F.array_sort(F.collect_list("n_name"))
    links = F.transform("ids", lambda x, i: F.struct(i.cast("string").alias("source"), F.lit("0").alias("target")))
    g = n.groupBy("r_name").agg(ids.alias("ids")).select(F.to_json(F.struct(F.transform("ids", lambda x: F.struct(x.alias("id"))).alias("nodes"), links.alias("links"))).alias("value"))
    at = _at(spark, "nodelink")
    g.write.option("maxRecordsPerFile", 1).text(at)
    return readers.node_link_graph(spark, at).select("src", "dst")


def matrix_entries(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(_text(F.col("l_orderkey"), " ", F.col("l_linenumber"), " ", F.col("l_quantity").cast("double")))
    return readers.matrix_market(spark, _written(spark, lines.union(lines.limit(1).select(F.lit("%%MatrixMarket matrix coordinate real general"))), "matrix"))


def native_call_counts(spark, sf_dir):
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(_text("lib", k % 3).alias("name"), F.when(k % 4 == 0, _text("  8:\t00 \tmov r", k)).otherwise(_text("  8:\t00 \tbl\t1234 <f", k % 5, "@plt>")).alias("value"))
    return readers.native_calls(rows).groupBy("name", "call").agg(F.count("*").alias("n"))


def yearly_tables(spark, sf_dir):
    at, days = _at(spark, "years"), _at(spark, "days")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("year"), F.date_format(F.trunc("o_orderdate", "month"), "yyyyMMdd'101112'").alias("stamp"))
    sinks.by_year(o.drop("stamp"), at, "zoo", mode="overwrite")
    sinks.by_archive_day(o.drop("year"), "stamp", days)
    y = spark.read.parquet(at).select("o_orderkey", "collection", F.col("year").cast("string").alias("year"))
    return y.join(spark.read.parquet(days).select("o_orderkey", F.col("day").cast("string").alias("day")), "o_orderkey")


def report_rows(spark, sf_dir):
    """Report, metric and curve tables of the same rows, as they come back."""
    r = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))
    at = [_at(spark, x) for x in ("report", "metrics", "curve", "table")]
    sinks.report(r, at[0])
    sinks.metrics(r, at[1])
    sinks.curve_points(r, at[2])
    sinks.table(r, at[3])
    schema = "p_brand string, n long, size long"
    back = [spark.read.schema(schema).option("sep", "\t").csv(at[0]), spark.read.schema(schema).option("header", True).csv(at[1]), spark.read.parquet(at[2]), spark.read.parquet(at[3])]
    out = None
    for kind, b in zip(("report", "metrics", "curve", "table"), back, strict=True):
        b = b.withColumn("kind", F.lit(kind))
        out = b if out is None else out.unionByName(b)
    return out


def family_files(spark, sf_dir):
    files = read(spark, sf_dir, "part").select(_text("/apks/", F.col("p_brand"), "/", F.col("p_partkey"), ".apk").alias("path"), (F.col("p_partkey") % 10).alias("hash"))
    families = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("hash"), F.col("r_name").alias("family"))
    return sinks.family_manifest(files, families)


def file_listing(spark, sf_dir):
    """Files of known sizes, the smallest first, and their folder."""
    at = _at(spark, "files")
    read(spark, sf_dir, "nation").select(F.repeat(F.lit("x"), F.col("n_nationkey")).alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    files = readers.list_files(spark, at, ".txt")
    inside = readers.list_directories(files).count()
    return reports.by_size(files).select(F.col("length").cast("long").alias("length"), F.lit(inside).cast("long").alias("folders"))


QUERIES = {f.__name__: f for f in (token_files, key_value_files, call_graph_lines, raw_edges, wide_csv, centrality_csv, gexf_graph, name_count_files, dated_vectors, label_maps, first_seen_lines, catalogue_columns, id_lists, manifest_sets, intent_filter_rows, arff_table, section_members, source_sink_list, method_category_list, api_permissions, inverted_permissions, flow_log_rows, run_times, status_log, node_link_edges, matrix_entries, native_call_counts, yearly_tables, report_rows, family_files, file_listing)}
ORACLES = {
    "token_files": "SELECT lower(c_mktsegment) AS token, count(*) AS cnt FROM customer GROUP BY 1",
    "key_value_files": "SELECT 'Type' AS key, replace(p_type, ' ', '_') AS value, count(*) AS cnt FROM part GROUP BY 2",
    "call_graph_lines": "SELECT '<c' || (s_suppkey % 9) || '.K: void m' || s_suppkey || '(int)>' AS caller, unnest(['<d.E: int x' || (s_suppkey % 4) || '()>', '<f.G: y z(' || (s_suppkey % 3) || ')>']) AS callee FROM supplier",
    "raw_edges": "SELECT CASE WHEN s_suppkey % 2 = 0 THEN '<a' || s_suppkey || '>' ELSE '<a' || s_suppkey || '> ==> <x>' END AS caller, CASE WHEN s_suppkey % 2 = 0 THEN '<b' || (s_suppkey % 7) || '>' ELSE '<b>' END AS callee FROM supplier",
    "wide_csv": "SELECT p_size::DOUBLE AS \"first\", (p_partkey % 100)::DOUBLE AS \"second\" FROM part",
    "centrality_csv": "SELECT md5(vec_id::VARCHAR) AS sha256, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, CAST(label AS INT) AS label FROM embeddings",
    "gexf_graph": "SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey",
    "name_count_files": "SELECT 'events' AS kind, 'x,' || event_type AS feature, count(*) AS cnt FROM events GROUP BY 2",
    "dated_vectors": "SELECT o_orderkey::VARCHAR AS app, strftime(o_orderdate, '%Y-%m-%d') AS date, o_custkey::DOUBLE AS f0, (o_orderkey % 7)::DOUBLE AS f1 FROM orders",
    "label_maps": "SELECT 'c' || o_custkey AS id, lower(arg_min(o_orderstatus, o_orderkey)) AS \"first\", lower(arg_max(o_orderstatus, o_orderkey)) AS \"last\", count(*) AS n FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1",
    "first_seen_lines": "SELECT o_orderkey::VARCHAR AS key, strftime(o_orderdate, '%Y-%m-%d') AS first_seen, '10:' || (o_custkey % 60) AS time FROM orders WHERE o_orderkey % 5 <> 0",
    "catalogue_columns": "SELECT md5(c_name) AS sha256, md5(c_mktsegment) AS md5 FROM customer",
    "id_lists": "SELECT 'id' || p_partkey AS id FROM part WHERE p_partkey % 4 <> 0",
    "manifest_sets": "SELECT 'p.' || n_nationkey AS package, CASE WHEN n_nationkey % 4 = n_nationkey % 2 THEN 'android.permission.P' || (n_nationkey % 2) ELSE 'android.permission.P' || (n_nationkey % 2) || ' android.permission.P' || (n_nationkey % 4) END AS permissions, 'android.intent.action.V' || (n_nationkey % 5) AS actions FROM nation",
    "intent_filter_rows": """SELECT n_nationkey, 'activity' AS type, '.A' AS component, n_nationkey % 2 = 0 AS exported, 'android.intent.action.V' || (n_nationkey % 5) || ' own.' || n_nationkey AS actions, 'c' || (n_nationkey % 3) AS categories, 'http' AS schemes FROM nation
UNION ALL SELECT n_nationkey, 'receiver', 'R', true, 'android.intent.action.V' || (n_nationkey % 5), '', '' FROM nation""",
    "arff_table": "SELECT 'a' || p_partkey AS name, CASE WHEN p_size % 3 > 0 THEN p_size::DOUBLE ELSE 0.0::DOUBLE END AS size, CASE WHEN p_partkey % 9 > 0 THEN (p_partkey % 4)::DOUBLE END AS rest, CASE WHEN p_partkey % 2 = 0 THEN 'Benign' ELSE 'Evil' END AS class, sparse FROM part, (VALUES (true), (false)) t(sparse)",
    "section_members": "SELECT r_name AS category, n_name AS class FROM nation JOIN region ON n_regionkey = r_regionkey",
    "source_sink_list": "SELECT 'a.B: c m' || p_partkey || '(java.lang.String)' AS signature, CASE WHEN p_partkey % 2 = 0 THEN 'SOURCE' ELSE 'SINK' END AS kind FROM part WHERE p_partkey % 3 <> 0",
    "method_category_list": "SELECT '<m' || p_partkey || '>' AS method, p_type AS category FROM part",
    "api_permissions": "SELECT l_orderkey, l_linenumber, '<a.b.C' || l_partkey || ': V run(I[],java.lang.String)>' AS signature, unnest(CASE WHEN l_partkey % 6 = 0 THEN ['P.ONE', 'P.TWO'] ELSE ['P.ONE'] END) AS permission FROM lineitem WHERE l_partkey % 3 = 0",
    "inverted_permissions": "SELECT 'clsm' || (n_nationkey % 7) AS api, max(r_name) AS permission FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "flow_log_rows": "SELECT replace(r_name, ' ', '_') || '.apk' AS app, n_name AS sink, unnest(['one ' || n_nationkey, 'two']) AS source FROM nation JOIN region ON n_regionkey = r_regionkey",
    "run_times": "SELECT 'app' || s_suppkey AS app, s_suppkey + 0.5::DOUBLE AS seconds FROM supplier WHERE s_suppkey % 3 > 0",
    "status_log": "SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'done' ELSE 'failed' END AS status, CAST(1 + s_suppkey % 2 AS BIGINT) AS n FROM supplier",
    "node_link_edges": "SELECT n_name AS src, min(n_name) OVER (PARTITION BY n_regionkey) AS dst FROM nation",
    "matrix_entries": 'SELECT l_orderkey - 1 AS "row", CAST(l_linenumber - 1 AS BIGINT) AS col, l_quantity::DOUBLE AS value FROM lineitem',
    "native_call_counts": "SELECT 'lib' || (p_partkey % 3) AS name, 'f' || (p_partkey % 5) AS call, count(*) AS n FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1, 2",
    "yearly_tables": "SELECT o_orderkey, 'zoo' AS collection, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y%m') || '01' AS day FROM orders",
    "report_rows": "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size, kind FROM part, (VALUES ('report'), ('metrics'), ('curve'), ('table')) t(kind) GROUP BY p_brand, kind",
    "family_files": "SELECT '/apks/' || p_brand || '/' || p_partkey || '.apk' AS path, r_name || '/' || p_partkey || '.apk' AS target FROM part JOIN region ON p_partkey % 10 = r_regionkey",
    "file_listing": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS length, CAST(1 AS BIGINT) AS folders FROM nation",
}
