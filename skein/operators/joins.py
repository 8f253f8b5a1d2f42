"""Key joins: intersections with vector concatenation, exclusions, lookups, table comparison, substring matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersect_and_concat(tables: Sequence[DataFrame], keys: Sequence[str], features: str = "features") -> DataFrame:
    """Keys that all tables have, with their vectors end to end."""
    out = tables[0].withColumnRenamed(features, "_f0")
    for i, t in enumerate(tables[1:], 1):
        out = out.join(t.withColumnRenamed(features, f"_f{i}"), list(keys))
    return out.select(*keys, F.concat(*[F.col(f"_f{i}") for i in range(len(tables))]).alias(features))


def keys_in_all(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct keys that occur in every table: semi joins, so that no table's repeats multiply."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.join(t, key, "left_semi")
    return out


def with_all_kinds(counts: DataFrame, key: str, kind: str, n: int) -> DataFrame:
    """Rows of the keys that have all ``n`` kinds: one aggregation and a semi join."""
    full = counts.groupBy(key).agg(F.count_distinct(kind).alias("_k")).where(F.col("_k") == n).select(key)
    return counts.join(full, key, "left_semi")


def with_first_seen(vectors: DataFrame, dates: DataFrame, key: str, default: Column, date: str = "first_seen") -> DataFrame:
    return vectors.join(dates, key, "left").withColumn(date, F.coalesce(F.col(date), default))


def without(df: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(excluded, list(keys), "left_anti")


def selected(df: DataFrame, chosen: DataFrame, key: Column, chosen_key: str) -> DataFrame:
    return df.withColumn("_k", key).join(chosen.select(F.col(chosen_key).alias("_k")), "_k", "left_semi").drop("_k")


def not_transformed(table: DataFrame, transformed: DataFrame, name: str) -> DataFrame:
    """Rows whose hash does not occur in ``transformed`` under a ``t<n>_<hash>.apk`` name."""
    from skein.functions.text import hash_in_name

    gone = transformed.select(hash_in_name(F.col(name)).alias("_k")).distinct()
    return table.withColumn("_k", hash_in_name(F.col(name))).join(gone, "_k", "left_anti").drop("_k")


def first_match(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Inner join in which only the first right row of a key, by ``order``, takes part."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return left.join(right.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", *[o for o in order if o in left.columns and o not in keys]), list(keys))


def lookup_status(ids: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """ids with value and ``matched``."""
    return ids.join(table.select(key, value), key, "left").withColumn("matched", F.col(value).isNotNull())


def compare_tables(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, a, b) of the values that differ between two tables, as texts; null equals null."""
    left = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("string").alias("a"), F.col(f"b_{c}").cast("string").alias("b")) for c in columns])
    return left.join(right, key).select(key, F.explode(F.filter(pairs, lambda p: ~p["a"].eqNullSafe(p["b"]))).alias("d")).select(key, "d.column", "d.a", "d.b")


#: Words of a phrase by which substring matches are looked for, at most.
PROBE_WORDS = 3


def contains_join(texts: DataFrame, text: str, key: str, phrases: DataFrame, phrase: str, probe_words: int = PROBE_WORDS) -> DataFrame:
    """(texts..., phrases...) pairs in which the text contains the phrase, by an equi join on word runs and an exact test.

    The inner words of a phrase are whole words of a text that holds it; its second to ``probe_words`` + 1st, or as many as there are,
    name its bucket. Only keys and hashes of runs are exploded, texts come back for the candidates. A phrase of one or two words has
    no inner word and is tested against all texts; where there are such, this is one more pass. ``key`` names a text.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    p = phrases.withColumn("_w", words(F.col(phrase))).withColumn("_n", F.least(F.size("_w") - 2, F.lit(probe_words)))
    p = p.withColumn("_probe", F.xxhash64(F.array_join(F.expr("slice(_w, 2, greatest(_n, 0))"), " "))).drop("_w")
    sizes = [r["_n"] for r in p.select("_n").distinct().collect()]  # at most probe_words + 2 numbers
    w = words(F.col(text))
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))
    out = None
    for n in sorted(s for s in sizes if s > 0):
        found = texts.select(F.col(key).alias("_key"), F.explode(F.array_distinct(runs(n))).alias("_probe")).join(p.where(F.col("_n") == n), "_probe").drop("_probe", "_n")
        hits = texts.join(found, F.col(key) == F.col("_key")).drop("_key").where(F.contains(F.col(text), F.col(phrase)))
        out = hits if out is None else out.unionByName(hits)
    if out is None or min(sizes) <= 0:
        rest = texts.join(p.where("_n <= 0").drop("_probe", "_n"), F.contains(F.col(text), F.col(phrase)))
        out = rest if out is None else out.unionByName(rest)
    return out


def family_folders(folders: DataFrame, table: DataFrame, families: DataFrame, ignored: Sequence[str], name: str = "name") -> DataFrame:
    """Rows of ``table`` that a folder holds, relabelled by family; ignored families go, unknown names keep their label."""
    both = table.join(folders.select(name).distinct(), name, "left_semi").join(families, name, "left")
    return both.withColumn("label", F.coalesce("family", "label")).drop("family").where(~F.col("label").isin(*ignored))


def combinations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each choice of one element of each array; an empty array gives a null."""
    for c in columns:
        df = df.withColumn(c, F.explode_outer(c))
    return df


def zip_vectors(tables: Sequence[DataFrame], key: str, how: str = "average") -> DataFrame:
    """Average or concatenation of several tables' vectors by key; labels that differ between tables fail the query."""
    from skein.functions.text import average_vectors, concat_vectors

    out = tables[0].select(key, F.col("features").alias("_f0"), "label")
    for i, t in enumerate(tables[1:], 1):
        out = out.join(t.select(key, F.col("features").alias(f"_f{i}"), F.col("label").alias(f"_l{i}")), key)
    same = F.lit(True)
    for i in range(1, len(tables)):
        same = same & (F.col("label") == F.col(f"_l{i}"))
    vectors = [F.col(f"_f{i}") for i in range(len(tables))]
    combined = average_vectors(*vectors) if how == "average" else concat_vectors(*vectors)
    return out.select(key, F.when(same, combined).otherwise(F.raise_error(F.lit("labels differ between tables")).cast("array<double>")).alias("features"), "label")


def last_instance(events: DataFrame, group: Sequence[str], order: Sequence[str], is_parent: Column, is_child: Column, take: Sequence[str]) -> DataFrame:
    """As-of: each child with the latest earlier parent's columns (``parent_<c>``), null where there is none."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumns({f"parent_{c}": F.last(F.when(is_parent, F.col(c)), True).over(w) for c in take}).where(is_child)


def parents_by_name(calls: DataFrame, app: str = "app") -> DataFrame:
    """Call-tree edges: the parent is the latest earlier instance of the caller, whoever called it.

    Instances (callee, ts) and uses (caller, ts) are put on one time line per method; a use takes the
    last instance before it. A caller without one is a root instance at ts -1.
    """
    defs = calls.select(app, F.col("callee").alias("method"), "ts", F.lit(1).alias("_use"), F.lit(None).cast("string").alias("callee"))
    uses = calls.select(app, F.col("caller").alias("method"), "ts", F.lit(0).alias("_use"), "callee")
    w = Window.partitionBy(app, "method").orderBy("ts", "_use").rowsBetween(Window.unboundedPreceding, -1)
    both = defs.unionByName(uses).withColumn("src_ts", F.last(F.when(F.col("_use") == 1, F.col("ts")), True).over(w)).where("_use = 0")
    return both.select(app, F.col("method").alias("src"), F.coalesce("src_ts", F.lit(-1)).alias("src_ts"), F.col("callee").alias("dst"), F.col("ts").alias("dst_ts"))


def distinct_site_counts(sites: DataFrame, listed: DataFrame, group: Sequence[str], key: str, category: str) -> DataFrame:
    """Distinct listed callees per group and category."""
    return sites.join(listed.select(key, category), key).groupBy(*group, category).agg(F.count_distinct(key).alias("n"))


def taint_categories(flows: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(…, source_category, sink_category) of flows; providers have a category of their own, others a default."""
    out = flows.join(sources.select(F.col("signature").alias("source"), F.col("category").alias("_s")), "source", "left").join(sinks.select(F.col("signature").alias("sink"), F.col("category").alias("_k")), "sink", "left")
    named = lambda c, sig, default: F.coalesce(F.col(c), F.when(F.contains(F.col(sig), F.lit("android.net.uri")), "CONTENT_RESOLVER"), F.lit(default))
    return out.withColumn("source_category", named("_s", "source", "NO_SENSITIVE_SOURCE")).withColumn("sink_category", named("_k", "sink", "NO_SENSITIVE_SINK")).drop("_s", "_k")


def with_permissions(calls: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Calls with each permission that the mapping (key, permission) gives them; calls that need none go."""
    return calls.join(mapping.select(key, "permission").distinct(), key)


def united_sets(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The union of array columns over the rows of a group: sorted distinct elements; nulls count as empty.

    Elements are made distinct before they meet, so a group of any number of rows keeps its elements only.
    """
    out = None
    for c in columns:
        part = df.select(*group, F.explode_outer(c).alias("_x")).groupBy(*group).agg(F.array_sort(F.collect_set("_x")).alias(c))
        out = part if out is None else out.join(part, list(group))
    return out


def flattened(nested: Column, depth: int) -> Column:
    """An array of arrays, ``depth`` levels deep, as one array in order; null parts go."""
    for _ in range(depth - 1):
        nested = F.flatten(F.filter(nested, lambda x: x.isNotNull()))
    return nested
