"""Scans: text, CSV, XML and table files to DataFrames of documented schemas.

``lines`` numbers the lines of each file in file order, so that order-dependent formats can be parsed
with windows over (path, line_no); files are split only between files there, as their order matters.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAME = "regexp_extract(path, '([^/]*)$', 1)"


def list_files(spark: SparkSession, path: str | list[str], extension: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, length, modified) of files, sorted by path; an extension may be given with or without its dot."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extension:
        reader = reader.option("pathGlobFilter", f"*.{extension.lstrip('.')}")
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")


def list_directories(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory")).distinct().orderBy("directory")


def documents(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, name, value): each file one row."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value")


def lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, name, line_no from 0, value): the lines of small files, in order."""
    return documents(spark, path, glob).select("path", "name", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def token_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(app, tokens): each file's lines as its tokens, lower case, a last empty one included."""
    return documents(spark, path, glob).select(F.col("name").alias("app"), F.split(F.lower("value"), "\n").alias("tokens"))


def key_value_tokens(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(app, key, value) of ``Key_Value`` lines; the key ends at the first underscore."""
    return lines(spark, path, glob).where("value <> ''").select(F.col("name").alias("app"), F.substring_index("value", "_", 1).alias("key"), F.expr("substring(value, instr(value, '_') + 1)").alias("value"))


def call_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(app, line_no, value): lines of call-graph texts that begin a signature."""
    return lines(spark, path).where(F.col("value").rlike("^<['a-zA-Z]")).select(F.regexp_replace("name", "[.]txt$", "").alias("app"), "line_no", "value")


def parse_call_line(df: DataFrame, column: str = "value") -> DataFrame:
    """Adds caller and callees of ``<caller> ==> ['<callee>\\n', ...]``."""
    text = F.col(column)
    callees = F.filter(F.transform(F.split(F.regexp_extract(text, r"^.* ==> \[?(.*?)\]?$", 1), r"', *'"), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(\\n)+", ""), "^'|'$", ""))), lambda c: c != "")
    return df.withColumn("caller", F.regexp_extract(text, r"^(.*) ==> ", 1)).withColumn("callees", callees)


def parse_edge_dump(df: DataFrame, column: str = "value") -> DataFrame:
    """(…, caller, callee) of raw edge lines: cut at the last arrow; what follows `` in `` on the left is its caller."""
    left = F.regexp_extract(column, "^(.*) ==> ", 1)
    caller = F.when(F.instr(left, " in ") > 0, F.regexp_extract(left, "^.* in (.*)$", 1)).otherwise(left)
    return df.withColumn("caller", F.trim(caller)).withColumn("callee", F.trim(F.regexp_extract(column, "^.* ==> (.*)$", 1))).where("caller <> '' AND callee <> ''")


def wide_features(spark: SparkSession, path: str | list[str], kind: str = "float") -> DataFrame:
    """CSV with a header: the first column dropped, all others as ``kind``; square brackets of old files are stripped."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.regexp_replace(F.col(f"`{c}`"), r"[\[\]]", "").cast(kind).alias(c) for c in raw.columns[1:]])


def centrality_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(sha256, features array<double>, label int) of CSV rows ``id, values..., label``."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col(f"`{raw.columns[0]}`").alias("sha256"), F.array(*[F.col(f"`{c}`").cast("double") for c in raw.columns[1:-1]]).alias("features"), F.col(f"`{raw.columns[-1]}`").cast("double").cast("int").alias("label"))


def gexf_edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(app, src, dst) of graph files in XML: node labels where given, else ids."""
    return documents(spark, path).select(F.regexp_replace("name", "[.]gexf$", "").alias("app"), F.explode(F.arrays_zip(F.expr("xpath(regexp_replace(value, ' xmlns=\"[^\"]*\"', ''), '//edge/@source')").alias("s"), F.expr("xpath(regexp_replace(value, ' xmlns=\"[^\"]*\"', ''), '//edge/@target')").alias("t"))).alias("e"), F.map_from_arrays(F.expr("xpath(regexp_replace(value, ' xmlns=\"[^\"]*\"', ''), '//node/@id')"), F.expr("xpath(regexp_replace(value, ' xmlns=\"[^\"]*\"', ''), '//node/@label')")).alias("names")).select("app", F.coalesce(F.try_element_at("names", F.col("e.s")), F.col("e.s")).alias("src"), F.coalesce(F.try_element_at("names", F.col("e.t")), F.col("e.t")).alias("dst"))


def name_counts(spark: SparkSession, path: str | list[str], kind: str, unreadable: str = "unreadable_name") -> DataFrame:
    """(app, kind, feature, cnt) of ``name,count`` files; the name row is passed over, an undecodable name gets one token."""
    cut = F.regexp_extract("value", r"^(.*),\s*(\d+)\s*$", 1)
    return lines(spark, path).where(F.col("value").rlike(r",\s*\d+\s*$")).select(F.regexp_extract("name", r"^([^_.]*)", 1).alias("app"), F.lit(kind).alias("kind"), F.when(F.contains(cut, F.lit("�")), unreadable).otherwise(cut).alias("feature"), F.regexp_extract("value", r"(\d+)\s*$", 1).cast("long").alias("cnt")).where("feature <> 'apk_name'")


def dated_vectors(df: DataFrame, width: int, column: str = "value") -> DataFrame:
    """(app, date, features): white-space rows of exactly ``width`` tokens; another width is an error at run time."""
    t = F.split(F.trim(F.col(column)), r"\s+")
    checked = df.where(F.trim(F.col(column)) != "").withColumn("_t", F.when(F.size(t) == width, t).otherwise(F.raise_error(F.concat(F.lit(f"expected {width} tokens, got "), F.size(t).cast("string"), F.lit(": "), F.substring(F.col(column), 1, 80))).cast("array<string>")))
    return checked.select(F.get("_t", 0).alias("app"), F.get("_t", 1).alias("date"), F.transform(F.slice("_t", 3, width), lambda x: x.cast("double")).alias("features"))


GENERAL, ICC, SECURITY = 31, 9, 88


def two_token_map(df: DataFrame, names: tuple[str, str] = ("key", "value"), column: str = "value", keep: str = "all", lower: bool = True) -> DataFrame:
    """Lines of exactly two tokens; with ``keep`` ``last`` or ``first``, one line per key by (path, line_no)."""
    t = F.split(F.trim(F.col(column)), r"\s+")
    low = F.lower if lower else (lambda c: c)
    out = df.where(F.size(t) == 2).withColumn(names[0], low(F.get(t, 0))).withColumn(names[1], low(F.get(t, 1)))
    if keep == "all":
        return out
    order = [F.desc(c) if keep == "last" else F.asc(c) for c in ("path", "line_no")]
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(names[0]).orderBy(*order))).where("_n = 1").drop("_n")


def first_seen(df: DataFrame, column: str = "value") -> DataFrame:
    """(key, first_seen, time) of three-token lines; others are passed over."""
    t = F.split(F.trim(F.col(column)), r"\s+")
    return df.where(F.size(t) == 3).select(F.get(t, 0).alias("key"), F.get(t, 1).alias("first_seen"), F.get(t, 2).alias("time"))


def catalogue(spark: SparkSession, path: str | list[str], columns: Sequence[str] = ("sha256", "md5")) -> DataFrame:
    """Named columns of a wide CSV, lower case; only these are read."""
    return spark.read.option("header", True).csv(path).select(*[F.lower(F.trim(F.col(c))).alias(c) for c in columns])


def id_list(df: DataFrame, column: str = "value") -> DataFrame:
    """(id): one per line, lower case, without a file suffix."""
    return df.select(F.lower(F.regexp_replace(F.trim(F.col(column)), "(?i)[.](apk|txt)$", "")).alias("id")).where("id <> ''")


def xml_attributes(df: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """Adds one array per XPath, e.g. ``{"permissions": "//uses-permission/@name"}``; name-space prefixes are cut first."""
    plain = F.regexp_replace(F.regexp_replace(F.col(column), r"\s+xmlns:[\w]+=\"[^\"]*\"", ""), r"(\s)[a-zA-Z]+:([a-zA-Z]+=)", "$1$2")
    return df.withColumns({k: F.xpath(plain, F.lit(p)) for k, p in paths.items()})


MANIFEST_PATHS = {"activities": "//activity/@name", "services": "//service/@name", "receivers": "//receiver/@name", "providers": "//provider/@name", "permissions": "//uses-permission/@name", "hardware": "//uses-feature/@name", "actions": "//intent-filter/action/@name", "package": "/manifest/@package"}


def manifests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, value, one array per manifest set)."""
    return xml_attributes(documents(spark, path), "value", MANIFEST_PATHS).withColumn("package", F.get("package", 0))


def requested_permissions(manifest: DataFrame) -> DataFrame:
    return manifest.select("name", F.array_sort(F.array_distinct("permissions")).alias("permissions"))


def system_actions(manifest: DataFrame, prefix: str = "android.intent.action") -> DataFrame:
    """(name, action): distinct declared actions with a prefix."""
    return manifest.select("name", F.explode(F.array_distinct("actions")).alias("action")).where(F.col("action").startswith(prefix))


def intent_filters(df: DataFrame, column: str = "value") -> DataFrame:
    """(…, type, component, exported, actions, categories, schemes) of a manifest's components that have filters.

    A component is exported when it says so, or says nothing and has a filter.
    """
    out = None
    for kind in ("activity", "service", "receiver", "provider"):
        schema = "array<struct<_name:string,_exported:string,`intent-filter`:array<struct<action:array<struct<_name:string>>,category:array<struct<_name:string>>,data:array<struct<_scheme:string>>>>>>"
        plain = F.regexp_replace(F.regexp_replace(F.col(column), r"\s+xmlns:[\w]+=\"[^\"]*\"", ""), r"(\s)[a-zA-Z]+:([a-zA-Z]+=)", "$1$2")
        whole = F.from_xml(plain, f"application struct<{kind}:{schema}>", {"rowTag": "manifest"})
        part = df.withColumn("_c", F.explode(whole[f"application"][kind])).withColumn("_f", F.explode("_c.intent-filter"))
        names = lambda c: F.coalesce(F.transform(F.col(f"_f.{c}"), lambda x: x["_name"]), F.array().cast("array<string>"))
        part = part.withColumn("type", F.lit(kind)).withColumn("component", F.col("_c._name")).withColumn("exported", F.coalesce(F.col("_c._exported") == "true", F.lit(True))).withColumn("actions", names("action")).withColumn("categories", names("category")).withColumn("schemes", F.coalesce(F.transform("_f.data", lambda x: x["_scheme"]), F.array().cast("array<string>"))).drop("_c", "_f")
        out = part if out is None else out.unionByName(part)
    return out


_ATTRIBUTE = r"(?i)@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)"


def arff(spark: SparkSession, path: str) -> DataFrame:
    """A table of an attribute-relation file, or of a folder of a header file and part files: types by the header, ``?`` is null, sparse rows have 0 elsewhere.

    The header, one line per column, goes to the driver; rows are read in parallel, in any order.
    """
    rows = spark.read.text(path)
    head = rows.where(F.lower(F.substring("value", 1, 10)) == "@attribute").withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").collect()
    names = [(m[1].strip("'\""), m[2]) for r in head if (m := re.match(_ATTRIBUTE, r["value"]))]
    data = rows.where(~F.trim("value").startswith("@") & ~F.trim("value").startswith("%") & (F.trim("value") != ""))
    sparse = F.trim("value").startswith("{")
    entries = F.filter(F.split(F.regexp_replace("value", r"[{}]", ""), r"\s*,\s*"), lambda x: x != "")
    table = F.map_from_arrays(F.transform(entries, lambda e: F.substring_index(F.trim(e), " ", 1)), F.transform(entries, lambda e: F.regexp_replace(F.trim(e), r"^\S+\s+", "")))
    dense = F.split("value", r"\s*,\s*(?=(?:[^']*'[^']*')*[^']*$)")
    cols = []
    for i, (name, kind) in enumerate(names):
        numeric = bool(re.match("(?i)numeric|real|integer", kind))
        zero = "0" if numeric else (kind.strip("{} ").split(",")[0].strip() if kind.startswith("{") else "")
        raw = F.when(sparse, F.coalesce(F.try_element_at(table, F.lit(str(i))), F.lit(zero))).otherwise(F.trim(F.get(dense, i)))
        raw = F.nullif(F.regexp_replace(raw, "^'|'$", ""), F.lit("?"))
        cols.append((raw.cast("double") if numeric else raw).alias(name))
    return data.select(*cols)


def fill_down(df: DataFrame, is_header: Column, value: str, partition: Sequence[str] = ("path",), order: str = "line_no", header: str = "section") -> DataFrame:
    """Adds the last header at or before each row and drops header rows."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    flagged = df.withColumn("_h", is_header)
    return flagged.withColumn(header, F.last(F.when(F.col("_h"), F.col(value)), True).over(w)).where(~F.col("_h")).drop("_h")


def sectioned_list(rows: DataFrame) -> DataFrame:
    """(category, class): members follow their section's header; a header follows an empty line or is the first."""
    w = Window.partitionBy("path").orderBy("line_no")
    marked = rows.withColumn("_head", F.coalesce(F.trim(F.lag("value").over(w)) == "", F.lit(True)) & (F.trim("value") != ""))
    return fill_down(marked, F.col("_head"), "value", header="category").where("trim(value) <> ''").select(F.trim("category").alias("category"), F.trim("value").alias("class"))


def sources_and_sinks(rows: DataFrame) -> DataFrame:
    """(signature, kind) of ``<signature> -> _SOURCE_`` lines."""
    return rows.where(F.col("value").rlike(r" -> _(SOURCE|SINK)_\s*$")).select(F.regexp_extract("value", r"<([^>]*(?:<init>)?[^>]*)>", 1).alias("signature"), F.regexp_extract("value", r"_(SOURCE|SINK)_\s*$", 1).alias("kind"))


def method_categories(rows: DataFrame) -> DataFrame:
    """(method, category) of ``method%category`` lines."""
    return rows.where(F.contains(F.col("value"), F.lit("%"))).select(F.trim(F.split_part("value", F.lit("%"), F.lit(1))).alias("method"), F.trim(F.split_part("value", F.lit("%"), F.lit(2))).alias("category"))


def permission_mapping(rows: DataFrame) -> DataFrame:
    """(signature, permission) of ``class.method(params)return :: permission`` lines, parameters written canonically."""
    from skein.functions.text import array_signature

    p = r"^(\S+)\.([^.(\s]+)\(([^)]*)\)(\S*)\s+::\s+(.*)$"
    g = [F.regexp_extract("value", p, i) for i in range(1, 6)]
    return rows.where(F.col("value").rlike(p)).select(F.concat(F.lit("<"), g[0], F.lit(": "), g[3], F.lit(" "), g[1], F.lit("("), array_signature(g[2]), F.lit(")>")).alias("signature"), F.explode(F.split(g[4], r"\s*,\s*")).alias("permission"))


def inverted_json_map(rows: DataFrame, column: str = "value") -> DataFrame:
    """(api, permission): a JSON object of permission to list of ``[class, method]``, turned round; of one api the last permission stays."""
    parsed = rows.select(F.posexplode(F.map_entries(F.from_json(column, "map<string,array<array<string>>>"))).alias("i", "e")).select("i", F.col("e.key").alias("permission"), F.posexplode("e.value").alias("j", "pair"))
    return parsed.groupBy(F.lower(F.array_join("pair", "")).alias("api")).agg(F.max_by("permission", F.struct("i", "j")).alias("permission"))


def flow_log(rows: DataFrame) -> DataFrame:
    """(app, sink, source) of data-flow logs: the app's and the sink's line stand before the sources'."""
    from skein.functions.text import stripped_log

    line = stripped_log(F.col("value"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    app = F.last(F.expr("nullif(regexp_extract(_l, '(?i)analy[sz]ing (?:file )?(\\\\S+)', 1), '')"), True).over(w)
    sink = F.last(F.expr("nullif(regexp_extract(_l, '(?i)found a flow to sink (.*?)(?:, from the following sources:)?$', 1), '')"), True).over(w)
    return rows.withColumn("_l", line).withColumn("app", app).withColumn("sink", sink).where(F.col("_l").rlike("^- ")).select("app", "sink", F.regexp_replace("_l", "^- ", "").alias("source"))


def runtime_log(rows: DataFrame) -> DataFrame:
    """(app, seconds): the last started app of each ``... ran for <n> seconds`` line."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    app = F.last(F.expr("nullif(regexp_extract(value, '(?i)(?:processing|analy[sz]ing) (\\\\S+)', 1), '')"), True).over(w)
    return rows.withColumn("app", app).where(F.col("value").rlike(r"(?i)ran for [0-9.]+ ?s")).select("app", F.regexp_extract("value", r"(?i)ran for ([0-9.]+)", 1).cast("double").alias("seconds"))


def json_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def node_link_graph(spark: SparkSession, path: str) -> DataFrame:
    """(app, src, dst) of node-link JSON files, links by node position or id."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("app"), F.from_json("value", "struct<nodes:array<struct<id:string>>,links:array<struct<source:string,target:string>>>").alias("g"))
    named = lambda c: F.coalesce(F.try_element_at(F.transform("g.nodes", lambda x: x["id"]), F.expr(f"try_cast({c} AS int)") + 1), F.col(c))
    return raw.select("app", "g", F.explode("g.links").alias("l")).select("app", named("l.source").alias("src"), named("l.target").alias("dst"))


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of coordinate files, positions from 0."""
    t = F.split(F.trim("value"), r"\s+")
    body = spark.read.text(path).where(~F.col("value").startswith("%"))
    return body.where((F.size(t) == 3) & F.get(t, 2).rlike(r"[.eE-]|^\d+$")).select((F.get(t, 0).cast("long") - 1).alias("row"), (F.get(t, 1).cast("long") - 1).alias("col"), F.get(t, 2).cast("double").alias("value"))


def native_calls(rows: DataFrame) -> DataFrame:
    """(name, call) of disassembly lines that branch to an external symbol."""
    p = r".*\s+(b\S*)\s+.*<(.+)(@|\+)(.*)>.*"
    return rows.where(F.col("value").rlike(p)).select("name", F.regexp_extract("value", p, 2).alias("call"))
