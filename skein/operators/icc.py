"""Messages between components: links of senders and receivers, calibration, cross tables, ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.predicates import has_data, has_extras, in_list_either_way, is_explicit
from skein.functions.text import class_of, percentage

NAMES = [f"{a}_{b}_{c}" for a in ("int", "ext") for b in ("ex", "im") for c in ("inc", "out")]


def link_key(component: Column, action: Column, categories: Column, data: Column) -> Column:
    """What sender and receiver must agree on, any case: the component if explicit, else action, categories and data."""
    return F.when(is_explicit(component), F.concat(F.lit("ex:"), F.lower(component))).otherwise(F.concat_ws("\u0001", F.lit("im:"), F.lower(action), F.lower(categories), F.lower(data)))


def with_key(intents: DataFrame) -> DataFrame:
    return intents.withColumn("link_key", link_key(F.col("Component"), F.col("Action"), F.col("Categories"), F.col("DataString")))


def links(intents: DataFrame, group: Sequence[str] = ("app",), key: str = "link_key", id_col: str = "ts") -> DataFrame:
    """All pairs of a sent and a received message of one key: an equi join on the computed key."""
    sent = intents.where("NOT incoming").select(*group, key, F.col(id_col).alias("out_id"))
    got = intents.where("incoming").select(*group, key, F.col(id_col).alias("in_id"))
    return sent.join(got, [*group, key])


def link_counts(intents: DataFrame, group: Sequence[str] = ("app",), key: str = "link_key") -> DataFrame:
    """(group..., key, n_out, n_in, n_links) without making the pairs: products of counts."""
    c = intents.groupBy(*group, key).agg(F.count_if(~F.col("incoming")).alias("n_out"), F.count_if(F.col("incoming")).alias("n_in"))
    return c.where("n_out > 0 AND n_in > 0").withColumn("n_links", F.col("n_out") * F.col("n_in"))


def last_sender(intents: DataFrame, group: Sequence[str] = ("app",), key: str = "link_key", id_col: str = "ts") -> DataFrame:
    """Each received message with the last sent one of its key: the pair map keeps one entry per receiver."""
    last = intents.where("NOT incoming").groupBy(*group, key).agg(F.max(id_col).alias("out_id"))
    return intents.where("incoming").join(last, [*group, key]).select(*group, F.col(id_col).alias("in_id"), "out_id")


def calibrate(intents: DataFrame, own_classes: Sequence[str] = ()) -> DataFrame:
    """``external`` recomputed: a message whose action, categories and data were both sent and received is internal.

    With a class list it is external again when some pair has exactly one of its two callers in the list.
    """
    k = F.concat_ws("\u0001", F.lower("Action"), F.lower("Categories"), F.lower("DataString"))
    mine = in_list_either_way(F.col("caller"), F.array(*[F.lit(c) for c in own_classes])) if own_classes else F.lit(True)
    rows = intents.withColumn("_k", k).withColumn("_m", mine)
    w = Window.partitionBy("app", "_k")
    both = (F.max(F.col("incoming").cast("int")).over(w) == 1) & (F.min(F.col("incoming").cast("int")).over(w) == 0)
    other = lambda side: F.max(F.when(F.col("incoming") == side, (~F.col("_m")).cast("int"))).over(w)
    same = lambda side: F.max(F.when(F.col("incoming") == side, F.col("_m").cast("int"))).over(w)
    crossed = F.when(F.col("_m"), F.when(F.col("incoming"), other(False)).otherwise(other(True))).otherwise(F.when(F.col("incoming"), same(False)).otherwise(same(True))) == 1
    return rows.withColumn("external", F.when(both, crossed).otherwise(F.col("external"))).drop("_k", "_m")


def app_pairs(intents: DataFrame) -> DataFrame:
    """Messages sent in one app and received in another: (src_app, dst_app, explicit, n) by link key."""
    rows = with_key(intents).withColumn("explicit", is_explicit(F.col("Component")))
    sent = rows.where("NOT incoming").groupBy(F.col("app").alias("src_app"), "link_key", "explicit").agg(F.count("*").alias("_o"))
    got = rows.where("incoming").groupBy(F.col("app").alias("dst_app"), "link_key", "explicit").agg(F.count("*").alias("_i"))
    return sent.join(got, ["link_key", "explicit"]).where("src_app <> dst_app").groupBy("src_app", "dst_app", "explicit").agg(F.sum(F.col("_o") * F.col("_i")).alias("n"))


def inter_app_table(intents: DataFrame) -> DataFrame:
    """(src_app, dst_app, link_ex, link_im): one row per direction."""
    return app_pairs(intents).groupBy("src_app", "dst_app").agg(F.coalesce(F.sum(F.when(F.col("explicit"), F.col("n"))), F.lit(0)).alias("link_ex"), F.coalesce(F.sum(F.when(~F.col("explicit"), F.col("n"))), F.lit(0)).alias("link_im"))


def crosstab(intents: DataFrame, group: Sequence[str] = ("app",), exclusive: bool = True) -> DataFrame:
    """Counts by external, explicit and direction, and of messages with data, extras and both.

    With ``exclusive`` data and extras count alone only; else both count wherever they occur.
    """
    ex, ext, inc = is_explicit(F.col("Component")), F.col("external"), F.col("incoming")
    d, x = has_data(F.col("DataString")), has_extras(F.col("Extras"))
    cells = {f"{'ext' if e else 'int'}_{'ex' if p else 'im'}_{'inc' if i else 'out'}": (ext == e) & (ex == p) & (inc == i) for e in (False, True) for p in (True, False) for i in (True, False)}
    data = {"data_only": d & ~x, "extras_only": x & ~d, "data_both": d & x} if exclusive else {"data": d, "extras": x, "data_both": d & x}
    return intents.groupBy(*group).agg(*[F.count_if(c).alias(k) for k, c in {**cells, **data}.items()])


def features(crosstab_rows: DataFrame, group: Sequence[str] = ("app",)) -> DataFrame:
    """Seven shares of all messages: internal and external, explicit and implicit, then the three of data."""
    total = sum((F.col(n) for n in NAMES), F.lit(0))
    pair = lambda a: F.col(f"{a}_inc") + F.col(f"{a}_out")
    parts = {"int_ex": pair("int_ex"), "int_im": pair("int_im"), "ext_ex": pair("ext_ex"), "ext_im": pair("ext_im"), "data_only": F.col("data_only"), "extras_only": F.col("extras_only"), "data_both": F.col("data_both")}
    return crosstab_rows.select(*group, *[percentage(c, total).alias(k) for k, c in parts.items()])


def covered_sites(sites: DataFrame, intents: DataFrame, direction: bool) -> DataFrame:
    """Static call sites (app, method, callee) that some message of the direction was seen at: an existence join per app."""
    seen = intents.where(F.col("incoming") == direction).select("app", F.col("caller").alias("_c"), F.col("callstmt").alias("_s"))
    return sites.join(seen, (sites["app"] == seen["app"]) & F.contains(seen["_c"], sites["method"]) & F.contains(seen["_s"], sites["callee"]), "left_semi")


def call_edges(intents: DataFrame, matched: DataFrame) -> DataFrame:
    """(app, caller, callee, ts) of matched messages: the sender's caller to the receiver's, else its call site's source."""
    who = F.when(F.col("caller") != "null", F.col("caller")).otherwise(F.col("callsite.caller"))
    named = intents.select("app", "ts", F.regexp_replace(who, "^<|>$", "").alias("_who"))
    out = named.select("app", F.col("ts").alias("out_id"), F.col("_who").alias("caller"))
    got = named.select("app", F.col("ts").alias("in_id"), F.col("_who").alias("callee"))
    return matched.join(out, ["app", "out_id"]).join(got, ["app", "in_id"]).where("caller IS NOT NULL AND callee IS NOT NULL").select("app", "caller", "callee", F.col("in_id").alias("ts"))


def sender_class(intents: DataFrame) -> DataFrame:
    return intents.withColumn("class", class_of(F.regexp_extract("caller", "(<.*)", 1)))
