"""Feature vectors, flows on trees, call sites, categories, backward facts and small set operators, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import counts, graph, icc, joins, labels, models, reports, split, trace, vectors

from ._tables import read, shared

SOURCES = ["ACCOUNT_INFORMATION", "CALENDAR_INFORMATION", "LOCATION_INFORMATION", "NETWORK_INFORMATION", "SYSTEM_SETTINGS", "OTHER"]
SINKS = ["ACCOUNT_SETTINGS", "FILE", "LOG", "NETWORK", "SMS_MMS", "SYSTEM_SETTINGS", "OTHER"]
LIFECYCLES = ["Activity", "Application", "BroadcastReceiver", "ContentProvider", "Service"]
HANDLERS = ["APPLICATION_MANAGEMENT", "SYSTEM_STATUS", "LOCATION_STATUS", "HARDWARE_MANAGEMENT", "NETWORK_MANAGEMENT", "APP_BAR", "MEDIA_CONTROL", "VIEW", "WIDGET", "DIALOG", "OTHER"]


def _pick(key, values):
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def _long(df):
    return df.select("app", F.posexplode("features").alias("i", "value")).select("app", F.col("i").cast("long").alias("i"), "value")


def general_features(spark, sf_dir):
    """The 29 trace features of each supplier's parts, by place in the vector."""
    li = read(spark, sf_dir, "lineitem").withColumn("app", F.concat(F.lit("s"), F.col("l_suppkey") % 20))
    layer = lambda c: _pick(F.col(c), ["SDK", "3rdLib", "UserCode", "Unknown"])
    edges = li.groupBy("app", layer("l_partkey").alias("src_layer"), layer("l_orderkey").alias("dst_layer")).agg(F.count("*").alias("freq"))
    nodes = li.groupBy("app", layer("l_partkey").alias("layer"), (F.col("l_partkey") % 12).cast("string").alias("class"), F.col("l_partkey").cast("string").alias("method")).agg(F.count("*").alias("in_calls"))
    classes = li.groupBy("app", _pick(F.col("l_partkey"), ["Activity", "Service", "BroadcastReceiver", "ContentProvider", "Application"]).alias("type"), (F.col("l_partkey") % 30).cast("string").alias("class")).agg(F.count("*").alias("instances"))
    return _long(reports.general_features(edges, nodes, classes))


def security_features(spark, sf_dir):
    """The 86 shares of sensitive calls and callbacks of each app, by place in the vector."""
    k = F.col("l_partkey")
    li = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey") % 20).alias("app"), "l_partkey").agg(F.count("*").alias("calls"))
    role = _pick(k, ["source", "sink", "lifecycle", "handler", None])
    five = F.floor(k / 5).cast("long")
    category = F.when(role == "source", _pick(five, SOURCES)).when(role == "sink", _pick(five, SINKS)).when(role == "lifecycle", _pick(five, LIFECYCLES)).when(role == "handler", _pick(five, HANDLERS))
    return _long(reports.security_features(li.select("app", role.alias("role"), category.alias("category"), "calls", (five % 2 == 0).alias("linked"))))


def flow_rules(spark, sf_dir):
    """Flows by all four rules on a tree per user: a root, parents, event types, two calls an event."""
    n = F.row_number().over(_by_user())
    e = read(spark, sf_dir, "events").withColumn("n", n * 2).withColumn("parent", F.when(F.col("event_type").isin("click", "view"), "p0").when(F.col("event_type") == "error", "p2").otherwise("p1"))
    calls = e.select(F.concat(F.lit("u"), "user_id").alias("app"), F.lit("r").alias("caller"), F.col("parent").alias("callee"), F.col("n").alias("ts"))
    calls = calls.unionAll(e.select(F.concat(F.lit("u"), "user_id"), "parent", "event_type", F.col("n") + 1))
    edges = trace.edges(calls)
    pairs = edges.select("app").distinct().select("app", F.explode(F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("sink")) for a, b in (("click", "purchase"), ("error", "purchase"), ("click", "error"), ("click", "view"), ("p0", "click"))])).alias("p")).select("app", "p.source", "p.sink")
    out = None
    for rule in graph.RULES:
        r = graph.flow_counts(edges, pairs, rule).withColumn("rule", F.lit(rule))
        out = r if out is None else out.unionByName(r)
    return out


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("event_id")


def covered_call_sites(spark, sf_dir):
    """Part names as call sites, seen in the messages of their app or not."""
    sites = read(spark, sf_dir, "part").select((F.col("p_partkey") % 10).cast("string").alias("app"), F.concat(F.lit("m"), F.col("p_partkey") % 100).alias("method"), F.concat(F.lit("c"), F.col("p_size")).alias("callee"))
    p = read(spark, sf_dir, "part")
    intents = p.select((F.col("p_partkey") % 10).cast("string").alias("app"), (F.col("p_partkey") % 3 == 0).alias("incoming"), F.concat(F.lit("<x: m"), F.col("p_partkey") % 100, F.lit(">")).alias("caller"), F.concat(F.lit("call c"), "p_size", F.lit("()")).alias("callstmt"))
    return icc.covered_sites(sites, intents, True)


def taint_flow_categories(spark, sf_dir):
    flows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src"), F.col("p_partkey") % 9).alias("source"), F.when(F.col("p_partkey") % 4 == 0, "<android.net.uri: q>").otherwise(F.concat(F.lit("snk"), F.col("p_partkey") % 5)).alias("sink"))
    names = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return joins.taint_categories(flows, names.select(F.concat(F.lit("src"), "n_nationkey").alias("signature"), F.col("n_name").alias("category")).where("signature < 'src5'"), names.select(F.concat(F.lit("snk"), "n_nationkey").alias("signature"), F.col("n_name").alias("category")).where("signature < 'snk3'")).select("p_partkey", "source_category", "sink_category")


def listed_callees(spark, sf_dir):
    """Distinct listed callees per supplier and category, and the same callees as sets with their calls."""
    li = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("app"), F.col("l_partkey").alias("method"))
    listed = read(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("method"), F.col("p_size").alias("category"))
    n = joins.distinct_site_counts(li, listed, ["app"], "method", "category")
    nodes = li.groupBy("app", "method").agg(F.count("*").alias("in_calls"))
    return n.join(reports.categorised_nodes(nodes, listed, ["app"]).select("app", "category", F.size("methods").alias("methods"), "calls"), ["app", "category"])


def linked_ends(spark, sf_dir):
    """Sources with the first sink they reach, sinks with the first source that reaches them."""
    li = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select((F.col("l_suppkey") % 5).alias("app"), F.concat(F.lit("a"), F.col("l_partkey") % 30).alias("source"), F.concat(F.lit("b"), F.col("l_orderkey") % 30).alias("sink"), (F.col("l_orderkey") % 3 - 1).alias("n_flows"))
    a, b = reports.linked_pairs(li.select("app", "source").distinct(), li.select("app", "sink").distinct(), li)
    return a.select("app", F.col("source").alias("end"), F.col("first_sink").alias("other")).unionAll(b.select("app", "sink", "first_source"))


def _levels(spark, sf_dir):
    from .graph_queries import _levels

    return _levels(spark, sf_dir)


def component_types(spark, sf_dir):
    """Classes by the base class that they descend from; of two the one of lower order."""
    e = _levels(spark, sf_dir)
    bases = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("base"), F.col("r_name").alias("type"), F.col("r_regionkey").alias("ord"))
    sub = graph.subtypes(e.select(F.col("dst").alias("child"), F.col("src").alias("parent")))
    return graph.component_type(graph.nodes(e, []).select(F.col("node").alias("class")), sub, bases)


def reaching_definitions(spark, sf_dir):
    e = _levels(spark, sf_dir)
    return graph.backward_facts(e, e.select(F.col("dst").alias("node")).where("node LIKE 'z%'").distinct())


def constant_to_call(spark, sf_dir):
    """Constants beside the zero fact from which a reflective call's value is reached."""
    e = _levels(spark, sf_dir)
    zero = e.where("src LIKE 'r%'").select(F.lit("<<zero>>").alias("src"), F.col("src").alias("dst")).distinct()
    return graph.affecting_constants(e.union(zero), e.select(F.col("dst").alias("node")).where("node LIKE 'z%'").distinct())


def reflective_calls(spark, sf_dir):
    """Calls with the class that their local was last defined by, and counts of reflective members by kind."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("a"), F.col("user_id") % 30).alias("app"), F.col("event_type").alias("method"), F.lit("r0").alias("local"), F.col("event_id").alias("line"), "value")
    kind = F.when(F.col("value") > 30, "forName").when(F.col("value") > 20, "constant").when(F.col("value") > 10, "field").otherwise("newInstance")
    defs = e.select("app", "method", "local", kind.alias("kind"), F.concat(F.lit("C"), "line").alias("value"), "line")
    calls = e.where("line % 7 = 0").select("app", "method", "local", F.col("line").cast("string").alias("name"))
    uses = graph.reflective_uses(defs).groupBy("app").agg(F.sum("n").alias("members"))
    return graph.reflective_targets(calls, defs).join(uses, "app", "left").select("app", "method", "name", "class", "members")


def run_summary(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("app"))
    mean, failed = counts.mean_and_failed(s.where("app % 3 > 0").withColumn("seconds", F.col("app") * 0.5), s, "app", "seconds")
    return mean.crossJoin(failed.agg(F.count("*").alias("failed"))).select(F.round("mean_seconds", 6).alias("mean_seconds"), "n", "failed")  # one row each


def narrowest_edges(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % 40).alias("callee"), F.col("l_orderkey").alias("ts"))
    paths = trace.edges(li, []).groupBy("src").agg(F.collect_list(F.struct("src", "dst", "ts")).alias("path"))
    return paths.select("src", trace.narrowest(F.col("path")).cast("long").alias("least"))


def prefixed_names(spark, sf_dir):
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("app"), "p_type", "p_size", "p_brand")
    names = counts.feature_names(p, "p_brand")
    user = counts.distinct_lines(p, ["app"], "p_type", "p_size", F.col("p_type").startswith("S"))
    return counts.prefixed_constants(p, ["app"], "p_type", "S").groupBy("app").agg(F.count("*").alias("constants")).join(user, "app").withColumn("brands", F.lit(",".join(names)))


def zero_vectors(spark, sf_dir):
    """Rows by name whose rounded vectors are zero throughout or in sum, and the table's benign and other zero rows."""
    v = read(spark, sf_dir, "embeddings").select(F.concat(F.when(F.col("vec_id") % 2 == 0, "good").otherwise("bad"), "vec_id").alias("name"), F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x.cast("double") * 2, 0)).alias("features"))
    marked = v.select("name", vectors.all_zero(F.col("features")).alias("zero"), vectors.signed_sum_zero(F.col("features")).alias("sum_zero"))
    return marked.where("zero OR sum_zero").crossJoin(F.broadcast(vectors.zero_benign(v, "name", "good")))  # one row


def sparse_vectors(spark, sf_dir):
    """Counts as sparse vectors, read back densely; the label is a constant, then indexed."""
    c = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("cnt"))
    rows = counts.sparse_rows(c, ["user_id"], counts.vocabulary(c, "event_type"), "event_type")
    v = vectors.dense(vectors.entries_to_vector(rows, 5), "features")
    t = labels.constant_label(v, 1).withColumn("kind", F.when(F.col("user_id") % 3 == 0, "b").otherwise("a"))
    indexed, names = vectors.drop_id_index_label(t.withColumn("id", F.col("user_id")), "id", "kind")
    return indexed.select("user_id", F.posexplode("features").alias("i", "value"), "label", F.col("label_index").cast("int").alias("kind"), F.lit(",".join(names)).alias("kinds")).select("user_id", F.col("i").cast("long").alias("i"), "value", "label", "kind", "kinds")


def degree_ranks(spark, sf_dir):
    """Nodes by falling degree, over all and within their kind; a label order and a seeded order keep all rows."""
    from .trace_queries import node_degrees

    d = node_degrees(spark, sf_dir).withColumn("degree", F.col("in_degree") + F.col("out_degree")).withColumn("class", F.substring("node", 1, 1))
    r = reports.ranked_nodes(split.shuffled(reports.by_label(d), "node", 7), "degree").withColumnRenamed("rank", "place")
    return reports.ranked_nodes(r, "degree", ["class"]).select("node", "degree", "place", "rank")


def short_tokens_out(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select("doc_id", X.long_tokens(F.split("text", " ")).alias("tokens"))
    return words.select("doc_id", F.size("tokens").cast("long").alias("n"))


def block_sets(spark, sf_dir):
    """Sets of a customer's orders, united; nested lists, flattened."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.array("o_orderstatus", F.lit("x")).alias("states"), F.when(F.col("o_orderkey") % 3 > 0, F.array("o_orderpriority")).alias("kinds"))
    u = joins.united_sets(o, ["o_custkey"], ["states", "kinds"])
    nested = F.array(F.array(F.col("states"), F.col("kinds")), F.array(F.array(F.lit("end"))))
    return u.select("o_custkey", F.array_join("states", ",").alias("states"), F.array_join("kinds", ",").alias("kinds"), F.array_join(joins.flattened(nested, 3), ",").alias("flat"))


def content_digests(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.content_md5(F.encode(F.col("text"), "UTF-8")).alias("digest"), X.stripped_log(F.concat(F.lit("[main] INFO a.B - "), F.col("lang"))).alias("line"))


def folder_families(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("n"), "p_partkey").alias("name"), F.col("p_brand").alias("label"))
    families = p.where(F.col("label").isin("Brand#11", "Brand#22", "Brand#33")).select("name", F.concat(F.lit("fam"), F.substring("label", 7, 2)).alias("family"))
    return joins.family_folders(p.where("substring(name, 2, 1) IN ('1', '2')").select("name"), p, families, ["fam22", "Brand#44"])


def saved_model_labels(spark, sf_dir):
    """A tree, fitted without the test rows, written and read again: it gives the unlabelled rows the labels that it gave before."""
    v = vectors.to_vector(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") < 5).cast("double").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("features")))
    test = v.where("id % 10 = 0")
    at = f"{shared(spark)}/model-{uuid.uuid4().hex[:12]}"

    def fit(train):
        m = Pipeline(stages=[models.classifier("j48", depth=5)]).fit(train)
        models.save(m, at)
        return m

    first = models.train_test_difference(v, test, "id", fit).select("id", F.col("prediction").alias("first"))
    again = models.label_unlabelled(models.load(at), test.drop("label")).select("id", F.col("prediction").alias("again"), F.array_max(vector_to_array("probability")).alias("p"))
    return first.join(again, "id").select("id", (F.col("first") == F.col("again")).alias("same"), F.col("p").between(0.5, 1.0).alias("proper"))


def stream_windows(spark, sf_dir):
    """Event counts per day over the event files as a stream, after the last watermark; then the first event of each user and type."""
    from skein.streaming import monitors

    at = f"{shared(spark)}/windows-{uuid.uuid4().hex[:12]}"
    e = monitors.first_events(monitors.event_stream(spark, sf_dir, glob="events.parquet"), ["user_id", "event_type"], late="3650 days").select("user_id", "event_type")
    q = e.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    # the batch form of the windows: the stream's own keeps those that the watermark has not passed
    w = monitors.windowed_counts(spark.read.schema(monitors.EVENTS).parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    first = spark.read.schema(e.schema).parquet(f"{at}/rows").groupBy("event_type").agg(F.count("*").alias("users"))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n").join(first, "event_type")


_PCT = "coalesce(round_even(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 4), 0.0)"


def _of(values, key):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][{key} % {len(values)} + 1]"


def _cells():
    """SQL of the 86 shares, in order."""
    n = lambda c: f"count(*) FILTER (WHERE {c})"
    s = lambda c: f"coalesce(sum(calls) FILTER (WHERE {c}), 0)"
    p = lambda a, b: _PCT.format(a=a, b=b)
    out = [p(n("role = 'source'"), "count(*)"), p(n("role = 'sink'"), "count(*)"), p(s("role = 'source'"), "sum(calls)"), p(s("role = 'sink'"), "sum(calls)")]
    out += [p(n(f"role = '{r}' AND linked"), n(f"role = '{r}'")) for r in ("source", "sink")] + [p(s(f"role = '{r}' AND linked"), s(f"role = '{r}'")) for r in ("source", "sink")]
    for r, cats in (("source", SOURCES[:5]), ("sink", SINKS[:6])):
        for c in cats:
            for linked in ("", " AND linked"):
                out += [p(f(f"role = '{r}' AND cat = '{c}'{linked}"), f(f"role = '{r}'{linked}")) for f in (n, s)]
    out += [p(n("role = 'lifecycle'"), "count(*)"), p(n("role = 'handler'"), "count(*)"), p(s("role = 'lifecycle'"), "sum(calls)"), p(s("role = 'handler'"), "sum(calls)")]
    for r, cats in (("lifecycle", LIFECYCLES), ("handler", HANDLERS[:10])):
        for c in cats:
            out += [p(f(f"role = '{r}' AND cat = '{c}'"), f(f"role = '{r}'")) for f in (n, s)]
    return out


def _general():
    """SQL of the 29 shares, in order: a list per app of each kind, put together."""
    layers = ("UserCode", "3rdLib", "SDK")
    cell = lambda v, test, known: _PCT.format(a=f"coalesce({v} FILTER (WHERE {test}), 0)", b=f"{v} FILTER (WHERE {known})")
    matrix = [cell("sum(f)", f"a = '{x}' AND b = '{y}'", "a <> 'Unknown' AND b <> 'Unknown'") for x in ("SDK", "3rdLib", "UserCode") for y in ("SDK", "3rdLib", "UserCode")]
    by = lambda v: [cell(v, f"l = '{x}'", "l <> 'Unknown'") for x in layers]
    kinds = [cell(v, f"t = '{x}'", "t <> 'Application'") for v in ("count(*)", "sum(n)") for x in ("Activity", "Service", "BroadcastReceiver", "ContentProvider")]
    rows = lambda name, cells, table: f"{name} AS (SELECT app, [{', '.join(cells)}] AS {name}v FROM {table} GROUP BY 1)"
    return ", ".join([rows("q1", matrix, "e"), rows("q2", by("count(*)"), "c"), rows("q3", by("count(*)"), "m"), rows("q4", by("sum(n)"), "c"), rows("q5", by("sum(n)"), "m"), rows("q6", kinds, "k")])


_LAYERS = ["SDK", "3rdLib", "UserCode", "Unknown"]
_TREE = """WITH e AS (SELECT 'u' || user_id AS app, event_type AS t, CASE WHEN event_type IN ('click', 'view') THEN 'p0' WHEN event_type = 'error' THEN 'p2' ELSE 'p1' END AS p, 2 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT app, t AS node, p AS up, n + 1 AS ts FROM e UNION ALL SELECT app, p, 'r', n FROM e), x AS (SELECT *, row_number() OVER (PARTITION BY app, node ORDER BY ts) AS k FROM c), size AS (SELECT app, node, count(*) AS n, min(ts) AS first FROM c GROUP BY 1, 2),
pairs AS (SELECT app, source, sink FROM (SELECT DISTINCT app FROM e), (VALUES ('click', 'purchase'), ('error', 'purchase'), ('click', 'error'), ('click', 'view'), ('p0', 'click')) v(source, sink)),
far AS (SELECT p.app, p.source, p.sink, count(*) AS n FROM pairs p JOIN x a ON a.app = p.app AND a.node = p.source JOIN x b ON b.app = p.app AND b.node = p.sink AND b.k = a.k AND a.up <> b.up JOIN x f ON f.app = p.app AND f.node = a.up AND f.k = a.k AND f.ts = a.ts - 1 JOIN x g ON g.app = p.app AND g.node = b.up AND g.k = a.k AND g.ts = b.ts - 1 WHERE source <> 'p0' AND g.ts > a.ts GROUP BY 1, 2, 3),
near AS (SELECT p.app, p.source, p.sink, count(*) AS n FROM pairs p JOIN x a ON a.app = p.app AND a.node = p.source JOIN x b ON b.app = p.app AND b.node = p.sink AND b.k = a.k AND a.up = b.up AND b.ts > a.ts GROUP BY 1, 2, 3),
d AS (SELECT p.*, coalesce(far.n, near.n, 0) AS n FROM pairs p LEFT JOIN far USING (app, source, sink) LEFT JOIN near USING (app, source, sink)),
v AS (SELECT p.*, a.n AS na, a.first, b.n AS nb, (SELECT count(*) FROM c WHERE c.app = p.app AND c.node = p.sink AND c.ts > a.first) AS later FROM pairs p LEFT JOIN size a ON a.app = p.app AND a.node = source LEFT JOIN size b ON b.app = p.app AND b.node = sink)
"""
_L = """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 's' || s_suppkey, 'z' || (s_suppkey % 5) FROM supplier),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), walk AS (SELECT node AS start, node FROM nodes UNION SELECT w.start, e.dst FROM walk w JOIN e ON w.node = e.src)
"""
QUERIES = {f.__name__: f for f in (general_features, security_features, flow_rules, covered_call_sites, taint_flow_categories, listed_callees, linked_ends, component_types, reaching_definitions, constant_to_call, reflective_calls, run_summary, narrowest_edges, prefixed_names, zero_vectors, sparse_vectors, degree_ranks, short_tokens_out, block_sets, content_digests, folder_families, saved_model_labels, stream_windows)}
ORACLES = {
    "general_features": f"""WITH l AS (SELECT 's' || (l_suppkey % 20) AS app, l_partkey AS p, l_orderkey AS o FROM lineitem), e AS (SELECT app, {_of(_LAYERS, 'p')} AS a, {_of(_LAYERS, 'o')} AS b, count(*) AS f FROM l GROUP BY 1, 2, 3),
m AS (SELECT app, {_of(_LAYERS, 'p')} AS l, p % 12 AS c, p, count(*) AS n FROM l GROUP BY 1, 2, 3, 4), c AS (SELECT app, l, c, sum(n) AS n FROM m GROUP BY 1, 2, 3), k AS (SELECT app, {_of(['Activity', 'Service', 'BroadcastReceiver', 'ContentProvider', 'Application'], 'p')} AS t, p % 30 AS c, count(*) AS n FROM l GROUP BY 1, 2, 3),
{_general()}, f AS (SELECT app, q1v || q2v || q3v || q4v || q5v || q6v AS v FROM q1 JOIN q2 USING (app) JOIN q3 USING (app) JOIN q4 USING (app) JOIN q5 USING (app) JOIN q6 USING (app)) SELECT app, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS i, unnest(v) AS value FROM f""",
    "security_features": f"""WITH l AS (SELECT 's' || (l_suppkey % 20) AS app, l_partkey AS p, l_partkey // 5 AS q, count(*) AS calls FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, {_of(['source', 'sink', 'lifecycle', 'handler', None], 'p')} AS role, q % 2 = 0 AS linked FROM l),
c AS (SELECT *, CASE role WHEN 'source' THEN {_of(SOURCES, 'q')} WHEN 'sink' THEN {_of(SINKS, 'q')} WHEN 'lifecycle' THEN {_of(LIFECYCLES, 'q')} WHEN 'handler' THEN {_of(HANDLERS, 'q')} END AS cat FROM r),
f AS (SELECT app, [{', '.join(_cells())}] AS v FROM c GROUP BY 1) SELECT app, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS i, unnest(v) AS value FROM f""",
    "flow_rules": _TREE
    + """SELECT app, source, sink, 'default' AS rule, n AS n_flows FROM d UNION ALL SELECT app, source, sink, 'all', 4 * n FROM d
UNION ALL SELECT app, source, sink, 'callers', CASE WHEN source = 'p0' THEN coalesce(nb, 0) ELSE 0 END FROM v
UNION ALL SELECT app, source, sink, 'conservative', CASE WHEN source = 'p0' THEN coalesce(nb, 0) WHEN sink = 'view' OR na IS NULL OR nb IS NULL OR later = nb THEN 0 ELSE least(na, later) END FROM v""",
    "covered_call_sites": """WITH i AS (SELECT (p_partkey % 10)::VARCHAR AS app, '<x: m' || (p_partkey % 100) || '>' AS caller, 'call c' || p_size || '()' AS stmt FROM part WHERE p_partkey % 3 = 0), s AS (SELECT (p_partkey % 10)::VARCHAR AS app, 'm' || (p_partkey % 100) AS method, 'c' || p_size AS callee FROM part)
SELECT s.* FROM s WHERE EXISTS (SELECT 1 FROM i WHERE i.app = s.app AND contains(caller, method) AND contains(stmt, callee))""",
    "taint_flow_categories": """SELECT p_partkey, CASE WHEN p_partkey % 9 < 5 THEN (SELECT n_name FROM nation WHERE n_nationkey = p_partkey % 9) ELSE 'NO_SENSITIVE_SOURCE' END AS source_category,
CASE WHEN p_partkey % 4 = 0 THEN 'CONTENT_RESOLVER' WHEN p_partkey % 5 < 3 THEN (SELECT n_name FROM nation WHERE n_nationkey = p_partkey % 5) ELSE 'NO_SENSITIVE_SINK' END AS sink_category FROM part""",
    "listed_callees": "SELECT l_suppkey % 20 AS app, p_size AS category, count(DISTINCT l_partkey) AS n, CAST(count(DISTINCT l_partkey) AS INT) AS methods, count(*) AS calls FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10 GROUP BY 1, 2",
    "linked_ends": """WITH l AS (SELECT l_suppkey % 5 AS app, 'a' || (l_partkey % 30) AS source, 'b' || (l_orderkey % 30) AS sink FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 - 1 > 0) SELECT app, source AS "end", min(sink) AS other FROM l GROUP BY 1, 2 UNION ALL SELECT app, sink, min(source) FROM l GROUP BY 1, 2""",
    "component_types": _L + "SELECT node AS class, (SELECT arg_min(r_name, r_regionkey) FROM walk JOIN region ON start = 'r' || r_regionkey WHERE walk.node = nodes.node) AS type FROM nodes",
    "reaching_definitions": _L + "SELECT node AS use, start AS definition FROM walk WHERE node LIKE 'z%'",
    "constant_to_call": _L + "SELECT start AS constant, node AS call FROM walk WHERE start LIKE 'r%' AND node LIKE 'z%'",
    "reflective_calls": """WITH e AS (SELECT 'a' || (user_id % 30) AS app, event_type AS method, event_id AS line, value FROM events), d AS (SELECT app, method, 'C' || max(line) AS class FROM e WHERE value > 20 GROUP BY 1, 2), u AS (SELECT app, count(*) AS members FROM e WHERE NOT value > 20 GROUP BY 1)
SELECT app, method, line::VARCHAR AS name, class, members FROM e LEFT JOIN d USING (app, method) LEFT JOIN u USING (app) WHERE line % 7 = 0""",
    "run_summary": "SELECT round(avg(s_suppkey * 0.5::DOUBLE) FILTER (WHERE s_suppkey % 3 > 0), 6) AS mean_seconds, count(*) FILTER (WHERE s_suppkey % 3 > 0) AS n, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS failed FROM supplier",
    "narrowest_edges": "SELECT src, min(n) AS least FROM (SELECT l_suppkey AS src, l_partkey % 40 AS dst, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "prefixed_names": "SELECT p_partkey % 10 AS app, count(DISTINCT p_type) AS constants, count(DISTINCT (p_type, p_size)) AS sloc, (SELECT string_agg(b, ',' ORDER BY b) FROM (SELECT DISTINCT p_brand AS b FROM part)) AS brands FROM part WHERE starts_with(p_type, 'S') GROUP BY 1",
    "zero_vectors": """WITH v AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'good' ELSE 'bad' END || vec_id AS name, list_transform(embedding[1:4], lambda x: round(x::DOUBLE * 2, 0)) AS f FROM embeddings), m AS (SELECT name, len(list_filter(f, lambda x: x <> 0)) = 0 AS zero, list_sum(f) = 0 AS sum_zero FROM v)
SELECT *, (SELECT count(*) FROM m WHERE zero AND starts_with(name, 'good')) AS benign, (SELECT count(*) FROM m WHERE zero AND starts_with(name, 'bad')) AS malicious FROM m WHERE zero OR sum_zero""",
    "sparse_vectors": """WITH t AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS i FROM (SELECT DISTINCT event_type FROM events)), c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, i, coalesce(n, 0)::DOUBLE AS value, CAST(1 AS INT) AS label, CAST(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS kind, 'a,b' AS kinds FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN t LEFT JOIN c USING (user_id, event_type)""",
    "degree_ranks": """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || (l_partkey % 50) AS dst FROM lineitem), d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
SELECT node, degree, row_number() OVER (ORDER BY degree DESC, node) AS place, row_number() OVER (PARTITION BY node[1] ORDER BY degree DESC, node) AS rank FROM d""",
    "short_tokens_out": "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: length(x) > 1)) AS n FROM documents",
    "block_sets": """WITH u AS (SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus) || ['x'])), ',') AS states, coalesce(array_to_string(list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderkey % 3 > 0))), ','), '') AS kinds FROM orders GROUP BY 1)
SELECT *, states || ',' || CASE WHEN kinds = '' THEN '' ELSE kinds || ',' END || 'end' AS flat FROM u""",
    "content_digests": "SELECT doc_id, md5(text) AS digest, lang AS line FROM documents",
    "folder_families": """SELECT 'n' || p_partkey AS name, CASE WHEN p_brand IN ('Brand#11', 'Brand#33') THEN 'fam' || substr(p_brand, 7, 2) ELSE p_brand END AS label FROM part WHERE substr(p_partkey::VARCHAR, 1, 1) IN ('1', '2') AND p_brand NOT IN ('Brand#22', 'Brand#44')""",
    "saved_model_labels": "SELECT vec_id AS id, true AS same, true AS proper FROM embeddings WHERE vec_id % 10 = 0",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, (SELECT count(DISTINCT user_id) FROM events f WHERE f.event_type = e.event_type) AS users FROM events e GROUP BY 1, 2",
}
