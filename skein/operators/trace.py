"""Ordered traces: parsing of call and intent lines, time stamps, edges, progress and execute-after sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import trace_call

INTENT_FIELDS = ["Action", "Categories", "PackageName", "DataString", "DataURI", "Scheme", "Flags", "Extras", "Component", "Type"]
HEAD = r"^\[ Intent (sent|received) \]"


def parse_trace(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, intents) of trace lines (app, line_no, value).

    calls: app, line_no, ts, caller, callee. intents: app, line_no, ts, incoming, the record's fields (the text
    ``null`` where absent), caller, callstmt and callsite, the call on the line after the block. Calls
    and intents of an app share one time line from 0. A block ends before the next call or header; one
    of fewer than three lines is no intent. Gaps and islands in windows per app; no UDF.
    """
    w = Window.partitionBy("app").orderBy("line_no")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    call = trace_call(F.col("value"))
    rows = lines.withColumn("_call", call).withColumn("_head", F.regexp_extract("value", HEAD, 1)).withColumn("_block", F.sum((F.col("_head") != "").cast("int")).over(up))
    rows = rows.withColumn("_start", F.sum(((F.col("_head") != "") | F.col("_call").isNotNull()).cast("int")).over(up))
    head_row = F.first(F.col("_head")).over(Window.partitionBy("app", "_start").orderBy("line_no"))
    rows = rows.withColumn("_in", head_row != "")
    field = F.regexp_extract("value", r"^\s*([A-Za-z]+)\s*=", 1)
    text = F.trim(F.regexp_extract("value", r"^\s*[A-Za-z]+\s*=(.*)$", 1))
    blocks = rows.where("_in").groupBy("app", "_start").agg(F.min("line_no").alias("line_no"), F.max("_head").alias("_kind"), F.count("*").alias("_lines"), F.map_from_entries(F.array_distinct(F.filter(F.collect_list(F.struct(field.alias("k"), text.alias("v"))), lambda e: e["k"] != ""))).alias("f"))
    after = rows.where(F.col("_call").isNotNull()).select("app", (F.col("_start") - 1).alias("_start"), F.col("_call").alias("callsite"))
    get = lambda k: F.coalesce(F.try_element_at("f", F.lit(k)), F.lit("null"))
    intents = blocks.where("_lines >= 3").join(after, ["app", "_start"], "left").select("app", "line_no", (F.col("_kind") == "received").alias("incoming"), *[get(k).alias(k) for k in INTENT_FIELDS], get("caller").alias("caller"), get("callsite").alias("callstmt"), "callsite")
    calls = rows.where(F.col("_call").isNotNull()).select("app", "line_no", F.col("_call.caller").alias("caller"), F.col("_call.callee").alias("callee"))
    ticks = calls.select("app", "line_no").unionByName(intents.select("app", "line_no")).withColumn("ts", F.row_number().over(w) - 1)
    return calls.join(ticks, ["app", "line_no"]), intents.join(ticks, ["app", "line_no"])


def edges(calls: DataFrame, group: Sequence[str] = ("app",), src: str = "caller", dst: str = "callee") -> DataFrame:
    """(group..., src, dst, ts, freq): distinct time stamps of each edge, in order, and their number."""
    out = calls.groupBy(*group, F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.array_sort(F.collect_set("ts")).alias("ts"))
    return out.withColumn("freq", F.size("ts").cast("long"))


def ranked_edges(edge_table: DataFrame) -> DataFrame:
    """Rarest first, ties by name."""
    return edge_table.orderBy("freq", "src", "dst")


def first_and_last(events: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return events.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def execute_after(events: DataFrame, group: Sequence[str], method: str, ts: str = "ts") -> DataFrame:
    """(group..., method, kind, ts): first and last event of each method in order of time; equal times by method."""
    ends = first_and_last(events, [*group, method], ts)
    return ends.select(*group, method, F.explode(F.array(F.struct(F.lit("first").alias("kind"), F.col("first_ts").alias("ts")), F.struct(F.lit("last").alias("kind"), F.col("last_ts").alias("ts")))).alias("e")).select(*group, method, "e.kind", "e.ts")


def coverage_progress(events: DataFrame, group: Sequence[str], item: str, order: Sequence[str], total: int | Column, step: float = 0.01) -> DataFrame:
    """Rows at which distinct coverage enters a new step of ``step``: (group..., order..., covered, coverage).

    An item counts at its first event; a row is kept when floor(coverage / step) grows.
    """
    total = F.lit(total) if isinstance(total, int) else total
    first = events.groupBy(*group, item).agg(F.min(F.struct(*order)).alias("_o")).select(*group, item, *[F.col(f"_o.{c}").alias(c) for c in order])
    w = Window.partitionBy(*group).orderBy(*order, item)
    run = first.withColumn("covered", F.row_number().over(w).cast("long")).withColumn("coverage", F.try_divide(F.col("covered").cast("double"), total.cast("double")))
    level = F.floor(F.col("coverage") / step)
    return run.withColumn("_l", level).withColumn("_p", F.coalesce(F.lag("_l").over(w), F.lit(0))).where("_l > _p").drop("_l", "_p")


def align_instances(a: DataFrame, b: DataFrame, group: Sequence[str], ts: str = "ts") -> DataFrame:
    """(group..., k, a_ts, b_ts): k-th with k-th of two events' times, as far as both go."""
    lists = lambda d, n: d.groupBy(*group).agg(F.array_sort(F.collect_list(ts)).alias(n))
    both = lists(a, "_a").join(lists(b, "_b"), list(group))
    return both.select(*group, F.posexplode(F.slice(F.arrays_zip("_a", "_b"), 1, F.least(F.size("_a"), F.size("_b")))).alias("k", "p")).select(*group, "k", F.col("p._a").alias("a_ts"), F.col("p._b").alias("b_ts"))


def narrowest(path: Column) -> Column:
    """Smallest number of time stamps on a path of edges."""
    return F.array_min(F.transform(path, lambda e: F.size(e["ts"])))


def events_from_log(lines: DataFrame) -> DataFrame:
    """(app, line_no, type, name) of event lines ``[ Event ] [type] [name]``."""
    p = r"^\[ Event \]\s*\[([^\]]*)\]\s*\[([^\]]*)\]"
    return lines.where(F.col("value").rlike(p)).select("app", "line_no", F.regexp_extract("value", p, 1).alias("type"), F.regexp_extract("value", p, 2).alias("name"))


def merged_clock(local: Column, remote: Column) -> Column:
    """A Lamport clock after a message."""
    return F.greatest(local, remote) + 1
