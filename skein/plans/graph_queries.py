"""Centralities, reachability and flows over event and trade graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import graph, trace

from ._tables import read


def _types(spark, sf_dir):
    """Each user's successive event types as an edge list of ten apps."""
    from .trace_queries import _pairs

    return _pairs(spark, sf_dir).select(F.concat(F.lit("app"), F.col("user_id") % 10).alias("app"), F.concat("src", F.col("user_id") % 3).alias("src"), F.concat("dst", (F.col("user_id") + 1) % 3).alias("dst")).distinct()


def _levels(spark, sf_dir):
    """An acyclic graph: regions to nations to a few suppliers."""
    n, s = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    a = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    b = s.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    c = s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("z"), F.col("s_suppkey") % 5).alias("dst"))
    return a.union(b).union(c)


def degree_centrality(spark, sf_dir):
    return graph.degree_centrality(_types(spark, sf_dir), digits=6)


def entry_nodes(spark, sf_dir):
    return graph.entries(_levels(spark, sf_dir), [])


def bfs_distance(spark, sf_dir):
    e = _levels(spark, sf_dir)
    return graph.distances(e, graph.entries(e, []))


def reachability(spark, sf_dir):
    e = _levels(spark, sf_dir)
    z = graph.nodes(e, []).where("node LIKE 'z%'")
    pairs = z.select(F.col("node").alias("src")).crossJoin(z.select(F.col("node").alias("dst")))  # 5 x 5
    return graph.common_ancestor_pairs(graph.closure(e), pairs)


def closeness(spark, sf_dir):
    e = _levels(spark, sf_dir)
    n = graph.nodes(e, [])
    return graph.closeness(graph.distances(e, n), n, digits=6)


def harmonic(spark, sf_dir):
    e = _levels(spark, sf_dir)
    n = graph.nodes(e, [])
    return graph.harmonic(graph.distances(e, n), n, digits=6)


def katz(spark, sf_dir):
    return graph.katz(_levels(spark, sf_dir).withColumn("app", F.lit("trade")), digits=6)


def call_sequences(spark, sf_dir):
    return graph.call_sequences(_levels(spark, sf_dir).withColumn("app", F.lit("trade")))


def bottom_up_order(spark, sf_dir):
    return graph.bottom_up_order(_levels(spark, sf_dir).withColumn("app", F.lit("trade")))


def reachable_methods(spark, sf_dir):
    e = _levels(spark, sf_dir)
    return graph.reachable_methods(e, graph.entries(e, []), [])


def neighbour_edges(spark, sf_dir):
    return graph.neighbours(_levels(spark, sf_dir), "R1")


def subtype_closure(spark, sf_dir):
    e = _levels(spark, sf_dir)
    return graph.subtypes(e.select(F.col("dst").alias("child"), F.col("src").alias("parent"))).where("ancestor <> node")


def _timed_edges(spark, sf_dir):
    from .trace_queries import _timed

    e = _timed(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("app"), F.col("event_type").alias("callee"), F.when(F.col("value") > 10, "view").otherwise("signup").alias("caller"), "ts")
    return trace.edges(e.where("caller <> callee"))


def _flow_pairs(e):
    return e.select("app").distinct().select("app", F.explode(F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("sink")) for a, b in (("click", "purchase"), ("error", "purchase"), ("click", "error"))])).alias("p")).select("app", "p.source", "p.sink")


def flow_counts(spark, sf_dir):
    e = _timed_edges(spark, sf_dir)
    out = None
    for rule in graph.RULES:
        r = graph.flow_counts(e, _flow_pairs(e), rule).withColumn("rule", F.lit(rule))
        out = r if out is None else out.unionByName(r)
    return out


def tree_flow_counts(spark, sf_dir):
    from .trace_queries import call_tree

    t = call_tree(spark, sf_dir).withColumn("app", F.concat(F.lit("u"), "app"))
    return graph.tree_flow_counts(t, _flow_pairs(t)).withColumn("rule", F.lit("instances")).unionByName(graph.tree_flow_counts(t, _flow_pairs(t), by_caller=True).withColumn("rule", F.lit("callers")))


def shortest_path_edges(spark, sf_dir):
    e = _levels(spark, sf_dir).withColumn("app", F.lit("trade"))
    p = e.where("src LIKE 'r%'").select("app", "src").distinct().crossJoin(e.where("dst LIKE 'z%'").select("dst").distinct())  # 5 x 5
    return graph.shortest_paths(e, p).select("app", "src", "dst", F.array_join("path", " ").alias("path"))


_L = """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 's' || s_suppkey, 'z' || (s_suppkey % 5) FROM supplier),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
walk AS (SELECT node AS start, node, 0 AS d FROM nodes UNION SELECT w.start, e.dst, w.d + 1 FROM walk w JOIN e ON w.node = e.src),
dist AS (SELECT start, node, min(d) AS d FROM walk GROUP BY 1, 2), entry AS (SELECT src AS node FROM e EXCEPT SELECT dst FROM e)
"""
_PATHS = """, path AS (SELECT src AS start, dst AS node, src || ' ' || dst AS p FROM e WHERE src LIKE 'r%' UNION SELECT start, e.dst, p || ' ' || e.dst FROM path JOIN e ON e.src = path.node)
"""
QUERIES = {f.__name__: f for f in (degree_centrality, entry_nodes, bfs_distance, reachability, closeness, harmonic, katz, call_sequences, bottom_up_order, reachable_methods, neighbour_edges, subtype_closure, flow_counts, tree_flow_counts, shortest_path_edges)}
ORACLES = {
    "degree_centrality": """WITH seq AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), e AS (SELECT DISTINCT 'app' || (user_id % 10) AS app, a || (user_id % 3) AS src, b || ((user_id + 1) % 3) AS dst FROM seq WHERE b IS NOT NULL),
d AS (SELECT app, node, count(*) AS d FROM (SELECT app, src AS node FROM e UNION ALL SELECT app, dst FROM e) GROUP BY 1, 2) SELECT app, node, round(d / (count(*) OVER (PARTITION BY app) - 1)::DOUBLE, 6) AS centrality FROM d""",
    "entry_nodes": _L + "SELECT node FROM entry",
    "bfs_distance": _L + "SELECT start, node, CAST(d AS INT) AS d FROM dist WHERE start IN (SELECT node FROM entry)",
    "reachability": _L + "SELECT a.node AS src, b.node AS dst, a.node = b.node OR EXISTS (SELECT 1 FROM dist x JOIN dist y ON x.start = y.start WHERE x.node = a.node AND y.node = b.node) AS reachable FROM nodes a, nodes b WHERE a.node LIKE 'z%' AND b.node LIKE 'z%'",
    "closeness": _L + ", c AS (SELECT node, sum(d) AS s, count(*) AS r FROM dist WHERE start <> node GROUP BY 1) SELECT node, round(coalesce(r::DOUBLE / s * r / ((SELECT count(*) FROM nodes) - 1), 0.0), 6) AS closeness FROM nodes LEFT JOIN c USING (node)",
    "harmonic": _L + ", c AS (SELECT node, sum(1.0::DOUBLE / d) AS h FROM dist WHERE start <> node GROUP BY 1) SELECT node, round(coalesce(h, 0.0), 6) AS harmonic FROM nodes LEFT JOIN c USING (node)",
    "reachable_methods": _L + "SELECT node, CAST(min(d) AS INT) AS depth FROM dist WHERE start IN (SELECT node FROM entry) GROUP BY 1",
    "neighbour_edges": _L + "SELECT src, dst FROM e WHERE lower(src) = 'r1'",
    "subtype_closure": _L + "SELECT start AS ancestor, node FROM dist WHERE start <> node",
    "shortest_path_edges": _L + _PATHS + "SELECT 'trade' AS app, start AS src, node AS dst, min(p) AS path FROM path WHERE node LIKE 'z%' GROUP BY start, node",
}
