"""Per-app ratio features of call traces: code layers, coverage, composition, sensitive calls, callbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import percentage
from skein.operators.order import global_rank

LAYERS = ["SDK", "3rdLib", "UserCode"]
COMPOSED = ["UserCode", "3rdLib", "SDK"]
COMPONENTS = ["Activity", "Service", "BroadcastReceiver", "ContentProvider"]
# The categories that security features are made of, in feature order.
SOURCE_CATEGORIES = ["ACCOUNT_INFORMATION", "CALENDAR_INFORMATION", "LOCATION_INFORMATION", "NETWORK_INFORMATION", "SYSTEM_SETTINGS"]
SINK_CATEGORIES = ["ACCOUNT_SETTINGS", "FILE", "LOG", "NETWORK", "SMS_MMS", "SYSTEM_SETTINGS"]
LIFECYCLE_TYPES = ["Activity", "Application", "BroadcastReceiver", "ContentProvider", "Service"]
HANDLER_CATEGORIES = ["APPLICATION_MANAGEMENT", "SYSTEM_STATUS", "LOCATION_STATUS", "HARDWARE_MANAGEMENT", "NETWORK_MANAGEMENT", "APP_BAR", "MEDIA_CONTROL", "VIEW", "WIDGET", "DIALOG"]


def total_calls(edges: DataFrame, nodes: DataFrame, group: Sequence[str] = ("app",)) -> DataFrame:
    """(group..., node, in_calls, out_calls): sums of frequencies, counted from 1, so a node without edges has 1."""
    side = lambda c, n: edges.groupBy(*group, F.col(c).alias("node")).agg(F.sum("freq").alias(n))
    out = nodes.join(side("dst", "_i"), [*group, "node"], "left").join(side("src", "_o"), [*group, "node"], "left")
    return out.select(*group, "node", (F.coalesce("_i", F.lit(0)) + 1).alias("in_calls"), (F.coalesce("_o", F.lit(0)) + 1).alias("out_calls"))


def degrees(edges: DataFrame, group: Sequence[str] = ("app",)) -> DataFrame:
    """(group..., node, in_degree, out_degree) of distinct neighbours."""
    both = edges.select(*group, F.col("src").alias("node"), F.col("dst").alias("_o"), F.lit(None).alias("_i")).unionByName(edges.select(*group, F.col("dst").alias("node"), F.lit(None).alias("_o"), F.col("src").alias("_i")))
    return both.groupBy(*group, "node").agg(F.count_distinct("_i").alias("in_degree"), F.count_distinct("_o").alias("out_degree"))


def coverage(all_items: DataFrame, covered: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., covered, total, coverage): distinct items seen among all."""
    hit = covered.select(*keys).distinct().withColumn("_hit", F.lit(1))
    joined = all_items.select(*dict.fromkeys([*keys, *by])).distinct().join(hit, list(keys), "left")
    out = joined.groupBy(*by).agg(F.count("_hit").alias("covered"), F.count("*").alias("total"))
    return out.withColumn("coverage", percentage(F.col("covered"), F.col("total")))


def instance_sums(nodes: DataFrame, group: Sequence[str], layer: str = "layer", calls: str = "in_calls") -> DataFrame:
    return nodes.groupBy(*group, layer).agg(F.sum(calls).alias("instances"))


def layer_matrix(edges: DataFrame, group: Sequence[str], src: str = "src_layer", dst: str = "dst_layer", weight: str = "freq", layers: Sequence[str] = LAYERS) -> DataFrame:
    """Nine shares of call frequency from layer to layer; edges of an unknown layer take no part."""
    known = edges.where(F.col(src).isin(*layers) & F.col(dst).isin(*layers))
    total = F.sum(weight)
    cell = lambda a, b: F.coalesce(F.sum(F.when((F.col(src) == a) & (F.col(dst) == b), F.col(weight))), F.lit(0))
    return known.groupBy(*group).agg(*[percentage(cell(a, b), total).alias(f"{a}_{b}") for a in layers for b in layers])


def composition(nodes: DataFrame, group: Sequence[str], value: str, layers: Sequence[str] = COMPOSED, prefix: str = "") -> DataFrame:
    """A layer's share of the summed value, one column per layer."""
    total = F.sum(F.when(F.col("layer").isin(*layers), F.col(value)))
    return nodes.groupBy(*group).agg(*[percentage(F.coalesce(F.sum(F.when(F.col("layer") == x, F.col(value))), F.lit(0)), total).alias(f"{prefix}{x}") for x in layers])


def component_distribution(classes: DataFrame, group: Sequence[str]) -> DataFrame:
    """Shares of the four component types by distinct classes and by instances; other types are in no total."""
    four = classes.where(F.col("type").isin(*COMPONENTS)).groupBy(*group, "type", "class").agg(F.sum("instances").alias("instances"))
    n, s = F.count("*"), F.sum("instances")
    parts = [percentage(F.count_if(F.col("type") == t), n).alias(t) for t in COMPONENTS]
    return four.groupBy(*group).agg(*parts, *[percentage(F.coalesce(F.sum(F.when(F.col("type") == t, F.col("instances"))), F.lit(0)), s).alias(f"{t}_ins") for t in COMPONENTS])


def general_features(edges: DataFrame, nodes: DataFrame, classes: DataFrame, app: str = "app") -> DataFrame:
    """(app, features): 29 shares: layer matrix, layers by classes, methods and their instances, components.

    edges: app, src_layer, dst_layer, freq. nodes: app, layer, class, method, in_calls. classes: app, type, class, instances.
    """
    by_class = nodes.groupBy(app, "layer", "class").agg(F.sum("in_calls").alias("ins"))
    parts = [
        layer_matrix(edges, [app]),
        composition(by_class.withColumn("one", F.lit(1)), [app], "one", prefix="cls_"),
        composition(nodes.withColumn("one", F.lit(1)), [app], "one", prefix="me_"),
        composition(by_class, [app], "ins", prefix="cls_ins_"),
        composition(nodes, [app], "in_calls", prefix="me_ins_"),
        component_distribution(classes, [app]),
    ]
    names = [c for p in parts for c in p.columns if c != app]
    out = nodes.select(app).distinct()
    for p in parts:
        out = out.join(p, app, "left")
    return out.select(app, F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for n in names]).alias("features"))


def share_table(items: DataFrame, group: Sequence[str], category: str = "category", value: str | None = None) -> DataFrame:
    """(group..., category, n, share of the group's total)."""
    n = F.count("*") if value is None else F.sum(value)
    c = items.groupBy(*group, category).agg(n.alias("n"))
    total = F.sum("n").over(Window.partitionBy(*group)) if group else F.sum("n").over(Window.partitionBy())
    return c.withColumn("share", percentage(F.col("n"), total))


def security_features(methods: DataFrame, app: str = "app") -> DataFrame:
    """(app, features): 86 shares of sensitive calls and callbacks.

    methods: app, role (``source``, ``sink``, ``lifecycle``, ``handler`` or null), category, calls, and linked:
    whether the source escapes or the sink is reached. One aggregation of conditional counts.
    """
    role = lambda r: F.col("role") == r
    n = lambda c: F.count_if(c)
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("calls"))), F.lit(0))
    one, linked = F.count("*"), F.col("linked")
    src, snk, lc, eh = role("source"), role("sink"), role("lifecycle"), role("handler")
    every = F.sum("calls")
    f = [percentage(n(src), one), percentage(n(snk), one), percentage(s(src), every), percentage(s(snk), every), percentage(n(src & linked), n(src)), percentage(n(snk & linked), n(snk)), percentage(s(src & linked), s(src)), percentage(s(snk & linked), s(snk))]
    for base, cats in ((src, SOURCE_CATEGORIES), (snk, SINK_CATEGORIES)):
        for c in cats:
            own = base & (F.col("category") == c)
            f += [percentage(n(own), n(base)), percentage(s(own), s(base)), percentage(n(own & linked), n(base & linked)), percentage(s(own & linked), s(base & linked))]
    f += [percentage(n(lc), one), percentage(n(eh), one), percentage(s(lc), every), percentage(s(eh), every)]
    for base, cats in ((lc, LIFECYCLE_TYPES), (eh, HANDLER_CATEGORIES)):
        for c in cats:
            own = base & (F.col("category") == c)
            f += [percentage(n(own), n(base)), percentage(s(own), s(base))]
    cols = [c.alias(f"f{i}") for i, c in enumerate(f)]
    return methods.groupBy(app).agg(*cols).select(app, F.array(*[F.col(f"f{i}") for i in range(len(f))]).alias("features"))


def categorised_nodes(nodes: DataFrame, categories: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., category, methods, calls) of call-graph nodes in a category map."""
    return nodes.join(categories, "method").groupBy(*group, "category").agg(F.array_sort(F.collect_set("method")).alias("methods"), F.sum("in_calls").alias("calls"))


def linked_pairs(sources: DataFrame, sinks: DataFrame, flows: DataFrame, group: Sequence[str] = ("app",)) -> tuple[DataFrame, DataFrame]:
    """(sources with the first sink they reach, sinks with the first source that reaches them), first by name."""
    hit = flows.where("n_flows > 0")
    a = sources.join(hit.groupBy(*group, "source").agg(F.min("sink").alias("first_sink")), [*group, "source"])
    b = sinks.join(hit.groupBy(*group, "sink").agg(F.min("source").alias("first_source")), [*group, "sink"])
    return a, b


def ranked_nodes(nodes: DataFrame, by: str, group: Sequence[str] = (), node: str = "node") -> DataFrame:
    """``nodes`` with ``rank`` from 1 by falling value of ``by`` (degree or instances), ties by name, within the group."""
    if group:
        return nodes.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(by), node)).cast("long"))
    return global_rank(nodes, [F.desc(by), F.asc(node)], "rank").withColumn("rank", F.col("rank") + 1)


def by_label(df: DataFrame, label: str = "class") -> DataFrame:
    """Rows in the order of their class label, within it by the other columns."""
    return df.orderBy(label, *[c for c in df.columns if c != label])


def by_size(files: DataFrame) -> DataFrame:
    """Files from the smallest, ties by path: the order in which work is handed out."""
    return files.orderBy("length", "path")
