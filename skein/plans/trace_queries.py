"""Edges, layers, messages, progress and as-of queries over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.text import percentage
from skein.operators import icc, joins, reports, trace

from ._tables import read


def _timed(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("ts"), "value")


def _pairs(spark, sf_dir):
    from skein.operators import markov

    e = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return markov.successive_pairs(e, ["user_id"], "event_type", ["ts", "event_id"])


def _layer(c):
    return F.when(c.isin("view", "click"), "SDK").when(c == "purchase", "3rdLib").when(c == "signup", "UserCode").otherwise("Unknown")


def edge_frequency(spark, sf_dir):
    calls = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), F.col("l_orderkey").alias("ts"))
    e = trace.ranked_edges(trace.edges(calls, []))
    return e.select("src", "dst", "freq", F.get("ts", 0).alias("first_ts"), F.element_at("ts", -1).alias("last_ts"))


def in_out_calls_plus1(spark, sf_dir):
    calls = _pairs(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("freq")).where("src <> 'signup'")
    nodes = read(spark, sf_dir, "events").select(F.col("event_type").alias("node")).distinct()
    return reports.total_calls(calls, nodes, [])


def node_degrees(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("dst"))
    return reports.degrees(e.distinct(), [])


def layer_matrix(spark, sf_dir):
    e = _pairs(spark, sf_dir).groupBy("user_id", "src", "dst").agg(F.count("*").alias("freq"))
    return reports.layer_matrix(e.withColumn("src_layer", _layer(F.col("src"))).withColumn("dst_layer", _layer(F.col("dst"))), ["user_id"])


def coverage_by_layer(spark, sf_dir):
    seen = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return reports.coverage(read(spark, sf_dir, "part"), seen, ["p_partkey"], ["p_brand"])


def layer_composition(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("user_id", _layer(F.col("event_type")).alias("layer")).agg(F.count("*").alias("n"))
    return reports.composition(n, ["user_id"], "n")


def instance_sums(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("in_calls")).withColumn("layer", _layer(F.col("event_type")))
    return reports.instance_sums(n, ["user_id"])


def component_distribution(spark, sf_dir):
    t = F.when(F.col("event_type") == "click", "Activity").when(F.col("event_type") == "view", "Service").when(F.col("event_type") == "error", "BroadcastReceiver").when(F.col("event_type") == "signup", "ContentProvider").otherwise("Other")
    c = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("app"), t.alias("type"), F.dayofmonth("ts").alias("class")).agg(F.count("*").alias("instances"))
    return reports.component_distribution(c, ["app"])


def category_shares(spark, sf_dir):
    return reports.share_table(read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("app"), F.col("event_type").alias("category")), ["app"])


def _intents(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    v = F.col("value")
    return e.select(
        (F.col("user_id") % 20).alias("app"), F.col("event_id").alias("ts"), (F.col("event_id") % 2 == 0).alias("incoming"), (v > 20).alias("external"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("Cmp"), F.dayofmonth("ts"))).otherwise("null").alias("Component"),
        F.col("event_type").alias("Action"), F.when(v > 10, "CAT").otherwise("cat").alias("Categories"), F.concat(F.lit("d"), F.dayofmonth("ts")).alias("DataString"),
        F.when(F.col("event_id") % 3 == 0, "x").otherwise("null").alias("Extras"), F.concat(F.lit("<c"), F.col("user_id"), F.lit(": m>")).alias("caller"),
    )


def icc_crosstab(spark, sf_dir):
    return icc.crosstab(_intents(spark, sf_dir).withColumn("DataString", F.when(F.col("ts") % 5 == 0, "null").otherwise(F.col("DataString"))))


def icc_features(spark, sf_dir):
    return icc.features(icc_crosstab(spark, sf_dir))


def icc_crosstab_cube(spark, sf_dir):
    i = _intents(spark, sf_dir)
    return i.cube("external", "incoming").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def icc_links(spark, sf_dir):
    return icc.links(icc.with_key(_intents(spark, sf_dir)).withColumn("link_key", F.lower(F.regexp_replace("link_key", "\u0001", "|"))))


def icc_link_counts(spark, sf_dir):
    return icc.link_counts(icc.with_key(_intents(spark, sf_dir))).groupBy("app").agg(F.sum("n_links").alias("n_links"), F.count("*").alias("n_keys"))


def icc_last_sender(spark, sf_dir):
    return icc.last_sender(icc.with_key(_intents(spark, sf_dir)))


def icc_calibrated(spark, sf_dir):
    return icc.calibrate(_intents(spark, sf_dir), ["c1: m", "<c2"]).select("app", "ts", "incoming", "external")


def inter_app_table(spark, sf_dir):
    return icc.inter_app_table(_intents(spark, sf_dir).withColumn("app", F.concat(F.lit("a"), F.col("app") % 4)))


def last_instance_parent(spark, sf_dir):
    return joins.last_instance(_timed(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id"], ["ts"], F.col("event_type") == "view", F.col("event_type") == "purchase", ["ts"])


def call_tree(spark, sf_dir):
    calls = _timed(spark, sf_dir).select(F.col("user_id").alias("app"), F.col("event_type").alias("callee"), "ts", F.when(F.col("value") > 10, "view").otherwise("click").alias("caller"))
    return joins.parents_by_name(calls)


def first_last_events(spark, sf_dir):
    return trace.first_and_last(_timed(spark, sf_dir), ["user_id", "event_type"])


def execute_after(spark, sf_dir):
    return trace.execute_after(_timed(spark, sf_dir), ["user_id"], "event_type")


def coverage_progress(spark, sf_dir):
    return trace.coverage_progress(_timed(spark, sf_dir), ["user_id"], "event_type", ["ts"], 5, 0.4)


def flow_alignment(spark, sf_dir):
    e = _timed(spark, sf_dir)
    a = trace.align_instances(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), ["user_id"])
    return a.select("user_id", F.col("k").cast("long").alias("k"), "a_ts", "b_ts", (F.col("b_ts") == F.col("a_ts") + 1).alias("next"))


def trace_events(spark, sf_dir):
    lines = _timed(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("app"), F.col("ts").alias("line_no"), F.when(F.col("event_type") == "error", "noise").otherwise(F.concat(F.lit("[ Event ] ["), "event_type", F.lit("] [e"), "ts", F.lit("]"))).alias("value"))
    return trace.events_from_log(lines)


def parsed_trace_calls(spark, sf_dir):
    lines = _timed(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("app"), F.col("ts").alias("line_no"), F.when(F.col("event_type") == "error", "noise").otherwise(F.concat(F.lit("<c: m"), F.col("ts") % 7, F.lit("> -> <"), "event_type", F.lit(">"))).alias("value"))
    calls, _ = trace.parse_trace(lines)
    return calls.select("app", "line_no", F.col("ts").cast("long").alias("ts"), "caller", "callee")


def percentages(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", percentage(F.col("p_size"), F.col("p_partkey") % 3).alias("share"))
    return p


QUERIES = {f.__name__: f for f in (edge_frequency, in_out_calls_plus1, node_degrees, layer_matrix, coverage_by_layer, layer_composition, instance_sums, component_distribution, category_shares, icc_crosstab, icc_features, icc_crosstab_cube, icc_links, icc_link_counts, icc_last_sender, icc_calibrated, inter_app_table, last_instance_parent, call_tree, first_last_events, execute_after, coverage_progress, flow_alignment, trace_events, parsed_trace_calls, percentages)}

_SEQ = "WITH seq AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), t AS (SELECT * FROM seq WHERE dst IS NOT NULL)"
_LAYER = "CASE WHEN {c} IN ('view', 'click') THEN 'SDK' WHEN {c} = 'purchase' THEN '3rdLib' WHEN {c} = 'signup' THEN 'UserCode' ELSE 'Unknown' END"
_PCT = "coalesce(round_even(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 4), 0.0)"
_I = """WITH i AS (SELECT user_id % 20 AS app, event_id AS ts, event_id % 2 = 0 AS incoming, value > 20 AS external, CASE WHEN event_type = 'click' THEN 'Cmp' || day(ts) ELSE 'null' END AS cmp, event_type AS action, CASE WHEN value > 10 THEN 'CAT' ELSE 'cat' END AS cat, 'd' || day(ts) AS data, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE 'null' END AS extras, '<c' || user_id || ': m>' AS caller FROM events),
k AS (SELECT *, CASE WHEN cmp <> 'null' THEN 'ex:' || lower(cmp) ELSE 'im:|' || lower(action) || '|' || lower(cat) || '|' || lower(data) END AS link_key FROM i)
"""
_CELLS = {f"{e}_{x}_{d}": f"{'' if e == 'ext' else 'NOT '}external AND cmp {'<>' if x == 'ex' else '='} 'null' AND {'' if d == 'inc' else 'NOT '}incoming" for e in ("int", "ext") for x in ("ex", "im") for d in ("inc", "out")}
_DATA = {"data_only": "ts % 5 <> 0 AND extras = 'null'", "extras_only": "ts % 5 = 0 AND extras <> 'null'", "data_both": "ts % 5 <> 0 AND extras <> 'null'"}
_CROSS = _I + ", x AS (SELECT app, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in {**_CELLS, **_DATA}.items()) + " FROM i GROUP BY 1) "
_TOTAL = " + ".join(_CELLS)


def _cells(group: str, layers=reports.LAYERS) -> str:
    return ", ".join(_PCT.format(a=f"coalesce(sum(freq) FILTER (WHERE a = '{a}' AND b = '{b}'), 0)", b="sum(freq)") + f' AS "{a}_{b}"' for a in layers for b in layers)


ORACLES = {
    "edge_frequency": "SELECT l_suppkey AS src, l_partkey AS dst, count(DISTINCT l_orderkey) AS freq, min(l_orderkey) AS first_ts, max(l_orderkey) AS last_ts FROM lineitem GROUP BY 1, 2",
    "in_out_calls_plus1": _SEQ + ", u AS (SELECT * FROM t WHERE src <> 'signup') SELECT n AS node, 1 + (SELECT count(*) FROM u WHERE dst = n) AS in_calls, 1 + (SELECT count(*) FROM u WHERE src = n) AS out_calls FROM (SELECT DISTINCT event_type AS n FROM events)",
    "node_degrees": "WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || (l_partkey % 50) AS dst FROM lineitem) SELECT src AS node, CAST(0 AS BIGINT) AS in_degree, count(*) AS out_degree FROM e GROUP BY 1 UNION ALL SELECT dst, count(*), 0 FROM e GROUP BY 1",
    "layer_matrix": _SEQ + f", l AS (SELECT user_id, {_LAYER.format(c='src')} AS a, {_LAYER.format(c='dst')} AS b, 1 AS freq FROM t) SELECT user_id, {_cells('user_id')} FROM l WHERE a <> 'Unknown' AND b <> 'Unknown' GROUP BY 1",
    "coverage_by_layer": "WITH h AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) SELECT p_brand, count(l_partkey) AS covered, count(*) AS total, " + _PCT.format(a="count(l_partkey)", b="count(*)") + " AS coverage FROM part LEFT JOIN h ON p_partkey = l_partkey GROUP BY 1",
    "layer_composition": f"SELECT user_id, " + ", ".join(_PCT.format(a=f"count(*) FILTER (WHERE l = '{x}')", b="count(*) FILTER (WHERE l <> 'Unknown')") + f' AS "{x}"' for x in reports.COMPOSED) + f" FROM (SELECT user_id, {_LAYER.format(c='event_type')} AS l FROM events) GROUP BY 1",
    "instance_sums": f"SELECT user_id, {_LAYER.format(c='event_type')} AS layer, count(*) AS instances FROM events GROUP BY 1, 2",
    "component_distribution": "WITH c AS (SELECT user_id % 10 AS app, CASE event_type WHEN 'click' THEN 'Activity' WHEN 'view' THEN 'Service' WHEN 'error' THEN 'BroadcastReceiver' WHEN 'signup' THEN 'ContentProvider' ELSE 'Other' END AS type, day(ts) AS class, count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT app, "
    + ", ".join(_PCT.format(a=f"count(*) FILTER (WHERE type = '{t}')", b="count(*)") + f" AS {t}" for t in reports.COMPONENTS) + ", " + ", ".join(_PCT.format(a=f"coalesce(sum(n) FILTER (WHERE type = '{t}'), 0)", b="sum(n)") + f" AS {t}_ins" for t in reports.COMPONENTS) + " FROM c WHERE type <> 'Other' GROUP BY 1",
    "category_shares": "SELECT app, category, n, " + _PCT.format(a="n", b="sum(n) OVER (PARTITION BY app)") + " AS share FROM (SELECT user_id % 10 AS app, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2)",
    "icc_crosstab": _CROSS + "SELECT * FROM x",
    "icc_features": _CROSS + "SELECT app, " + ", ".join(_PCT.format(a=f"{p}_inc + {p}_out", b=_TOTAL) + f" AS {p}" for p in ("int_ex", "int_im", "ext_ex", "ext_im")) + ", " + ", ".join(_PCT.format(a=d, b=_TOTAL) + f" AS {d}" for d in _DATA) + " FROM x",
    "icc_crosstab_cube": _I + "SELECT external, incoming, count(*) AS n, CAST(grouping(external) * 2 + grouping(incoming) AS BIGINT) AS level FROM i GROUP BY CUBE (external, incoming)",
    "icc_links": _I + "SELECT a.app, a.link_key, a.ts AS out_id, b.ts AS in_id FROM k a JOIN k b ON a.app = b.app AND a.link_key = b.link_key AND NOT a.incoming AND b.incoming",
    "icc_link_counts": _I + "SELECT app, CAST(sum(o * n) AS BIGINT) AS n_links, count(*) AS n_keys FROM (SELECT app, link_key, count(*) FILTER (WHERE NOT incoming) AS o, count(*) FILTER (WHERE incoming) AS n FROM k GROUP BY 1, 2) WHERE o > 0 AND n > 0 GROUP BY 1",
    "icc_last_sender": _I + "SELECT a.app, a.ts AS in_id, o AS out_id FROM k a JOIN (SELECT app, link_key, max(ts) AS o FROM k WHERE NOT incoming GROUP BY 1, 2) USING (app, link_key) WHERE incoming",
    "icc_calibrated": _I + """, m AS (SELECT *, lower(action) || '|' || lower(cat) || '|' || lower(data) AS c, (contains(caller, 'c1: m') OR contains('c1: m', caller) OR contains(caller, '<c2') OR contains('<c2', caller)) AS mine FROM i)
SELECT app, ts, incoming, CASE WHEN EXISTS (SELECT 1 FROM m o WHERE o.app = m.app AND o.c = m.c AND o.incoming <> m.incoming) THEN EXISTS (SELECT 1 FROM m o WHERE o.app = m.app AND o.c = m.c AND o.incoming <> m.incoming AND o.mine <> m.mine) ELSE external END AS external FROM m""",
    "inter_app_table": _I + ", g AS (SELECT 'a' || (app % 4) AS app, link_key, cmp <> 'null' AS ex, incoming, count(*) AS n FROM k GROUP BY 1, 2, 3, 4) SELECT o.app AS src_app, p.app AS dst_app, CAST(coalesce(sum(o.n * p.n) FILTER (WHERE o.ex), 0) AS BIGINT) AS link_ex, CAST(coalesce(sum(o.n * p.n) FILTER (WHERE NOT o.ex), 0) AS BIGINT) AS link_im FROM g o JOIN g p ON o.link_key = p.link_key AND NOT o.incoming AND p.incoming AND o.app <> p.app GROUP BY 1, 2",
    "last_instance_parent": "SELECT user_id, event_type, ts, parent_ts FROM (SELECT user_id, event_type, event_id AS ts, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_ts FROM events) WHERE event_type = 'purchase'",
    "call_tree": "WITH c AS (SELECT user_id AS app, event_type AS callee, event_id AS ts, CASE WHEN value > 10 THEN 'view' ELSE 'click' END AS caller FROM events) SELECT a.app, a.caller AS src, coalesce(b.ts, -1) AS src_ts, a.callee AS dst, a.ts AS dst_ts FROM c a ASOF LEFT JOIN c b ON a.app = b.app AND a.caller = b.callee AND a.ts > b.ts",
    "first_last_events": "SELECT user_id, event_type, min(event_id) AS first_ts, max(event_id) AS last_ts FROM events GROUP BY 1, 2",
    "execute_after": "SELECT user_id, event_type, 'first' AS kind, min(event_id) AS ts FROM events GROUP BY 1, 2 UNION ALL SELECT user_id, event_type, 'last', max(event_id) FROM events GROUP BY 1, 2",
    "coverage_progress": "WITH f AS (SELECT user_id, event_type, min(event_id) AS ts FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS covered FROM f) SELECT user_id, event_type, ts, covered, covered / 5.0::DOUBLE AS coverage FROM r WHERE floor(covered / 5.0::DOUBLE / 0.4::DOUBLE) > floor((covered - 1) / 5.0::DOUBLE / 0.4::DOUBLE)",
    "flow_alignment": "WITH r AS (SELECT user_id, event_type, event_id AS ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS k FROM events) SELECT a.user_id, a.k, a.ts AS a_ts, b.ts AS b_ts, b.ts = a.ts + 1 AS next FROM r a JOIN r b USING (user_id, k) WHERE a.event_type = 'view' AND b.event_type = 'purchase'",
    "trace_events": "SELECT 'u' || user_id AS app, event_id AS line_no, event_type AS type, 'e' || event_id AS name FROM events WHERE event_type <> 'error'",
    "parsed_trace_calls": "SELECT 'u' || user_id AS app, event_id AS line_no, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ts, 'c: m' || (event_id % 7) AS caller, event_type AS callee FROM events WHERE event_type <> 'error'",
    "percentages": "SELECT p_partkey, " + _PCT.format(a="p_size", b="p_partkey % 3") + " AS share FROM part",
}
