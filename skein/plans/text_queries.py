"""Name abstraction, token counts, addresses, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import predicates as P
from skein.functions import text as X
from skein.operators import counts, labels
from skein.sources import readers

from ._tables import read

PREFIXES = ["www.", "blog.", "m.", "tion", "th"]
HOST = "regexp_extract(url, '//([^/:?#]+)', 1)"
LEVELS = [["blog", "m", "www"], ["ththre", "tionsh", "therha", "tiontion"], ["example"], ["com", "org", "net"]]
KNOWN = ["blog.ththre.example", "m.tionsh.example", "www.therha", "m", "blog"]


def state_abstraction(spark, sf_dir):
    host = F.regexp_extract("url", "//([^/:?#]+)", 1)
    return read(spark, sf_dir, "pages").select("page_id", X.first_prefix(host, PREFIXES, X.obfuscation_class(host)).alias("state"), X.obfuscation_class_strict(host).alias("older"), X.url_domain(F.col("url")).alias("domain"))


def package_states(spark, sf_dir):
    host = F.regexp_extract("url", "//([^/:?#]+)", 1)
    return read(spark, sf_dir, "pages").select("page_id", X.package_walk(host, LEVELS, KNOWN).alias("state"))


def token_counts(spark, sf_dir):
    words = F.explode(F.split(F.lower("text"), " "))
    return counts.count_by(read(spark, sf_dir, "documents").select("lang", words.alias("token")).where(F.col("token").startswith("th")), ["lang", "token"])


def xml_attr_extract(spark, sf_dir):
    links = read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return counts.count_by(links, ["href"])


def default_bucket_counts(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_type", "p_size")
    kinds = parts.where("p_size < 10").select("p_type").distinct().withColumn("category", F.concat(F.lit("small "), F.substring("p_type", 1, 3)))
    return counts.count_by(counts.with_default_category(parts.where("p_size < 30"), kinds.where(~F.col("p_type").startswith("S")), "p_type"), ["category"])


def fill_down_sections(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    return readers.fill_down(rows, F.col("role") == "system", "h", ["conv_id"], "turn", "section").select("conv_id", "turn", "role", "section")


def api_predicates(spark, sf_dir):
    host = F.regexp_extract("url", "//([^/:?#]+)", 1)
    p = read(spark, sf_dir, "pages")
    layer = P.code_layer(host, F.lit("example.com"), "^(blog|m)[.].*$")
    either = P.in_list_either_way(host, F.array(F.lit("example.org"), F.lit("blog.ththre.example.com.extra")))
    return p.select("page_id", layer.alias("layer"), either.alias("listed"), P.mentions_any(F.col("html"), ["track(", "onReceive"]).alias("mentions"), X.qualified_component(F.split_part(host, F.lit("."), F.lit(1)), F.lit("pkg")).alias("component"))


def name_parts(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("t"), F.col("p_partkey") % 7, F.lit("_"), F.md5("p_name"), F.lit(".apk")).alias("name"))
    cut = X.base_and_extension(F.col("name"))
    return p.select("p_partkey", X.hash_in_name(F.col("name")).alias("hash"), X.transformation_of(F.col("name")).alias("variant"), cut["base"].alias("base"), cut["extension"].alias("extension"), X.without_suffix(F.upper("name")).alias("plain"), X.array_signature(F.lit("[I,[[Ljava.lang.String,J")).alias("params"))


def ascii_names(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n")).where("n >= 20")
    return words.select(X.ascii_name(F.col("w"), F.col("n")).alias("feature"), "n")


def label_changes(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"))
    d = labels.merge_variants(labels.without_singletons(d, "label", "src19"), "label", {"src1": "group-one", "src2": "group-two"})
    return labels.two_way(labels.without_labels(d, "label", ["src3"]).withColumn("family", F.col("label")), "label", "group-one")


_H = "regexp_extract(url, '//([^/:?#]+)', 1)"
_PARTS = f"string_split({_H}, '.')"
_SHORT = f"len(list_filter({_PARTS}, lambda p: length(p) < 3))"
_CLASS = f"CASE WHEN {_SHORT} >= len({_PARTS}) / 2.0 THEN 'obfuscated' ELSE 'selfdefined' END"
_PREFIX = "CASE " + " ".join(f"WHEN starts_with({_H}, '{p}') THEN '{p}'" for p in PREFIXES) + f" ELSE {_CLASS} END"
_DEPTH = "CASE " + " ".join(f"WHEN len(h) < {i + 1} OR NOT coalesce(list_contains({LEVELS[i]!r}, h[{i + 1}]), false) THEN {i}" for i in range(4)) + " ELSE 4 END"
QUERIES = {f.__name__: f for f in (state_abstraction, package_states, token_counts, xml_attr_extract, default_bucket_counts, fill_down_sections, api_predicates, name_parts, ascii_names, label_changes)}
ORACLES = {
    "state_abstraction": f"SELECT page_id, {_PREFIX} AS state, CASE WHEN {_SHORT} > len({_PARTS}) / 2.0 THEN 'obfuscated' ELSE 'self-defined' END AS older, nullif(regexp_extract(regexp_extract(url, '(?i)https?://([\\da-z.-]+\\.[a-z.]{{2,6}}|[\\d.]+)[^''\"]*', 0), '(?i)https?://([^/:]*)', 1), '') AS domain FROM pages",
    "package_states": f"""WITH p AS (SELECT page_id, {_H} AS host, {_PARTS} AS h FROM pages), d AS (SELECT *, {_DEPTH} AS depth FROM p), w AS (SELECT *, array_to_string(h[1:depth], '.') AS pkg FROM d)
SELECT page_id, CASE WHEN depth = 0 THEN CASE WHEN len(list_filter(h, lambda p: length(p) < 3)) >= len(h) / 2.0 THEN 'obfuscated' ELSE 'selfdefined' END WHEN depth < len(h) AND list_contains({KNOWN!r}, pkg) THEN pkg END AS state FROM w""",
    "token_counts": "SELECT lang, token, count(*) AS cnt FROM (SELECT lang, unnest(string_split(lower(text), ' ')) AS token FROM documents) WHERE starts_with(token, 'th') GROUP BY ALL",
    "xml_attr_extract": """SELECT href, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY href""",
    "default_bucket_counts": """WITH k AS (SELECT DISTINCT p_type, 'small ' || substr(p_type, 1, 3) AS category FROM part WHERE p_size < 10 AND NOT starts_with(p_type, 'S'))
SELECT coalesce(category, 'NO_CATEGORY') AS category, count(*) AS cnt FROM part LEFT JOIN k USING (p_type) WHERE p_size < 30 GROUP BY 1""",
    "fill_down_sections": """SELECT conv_id, turn, role, section FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'system' THEN md5(coalesce(text, '')) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations) WHERE role <> 'system'""",
    "api_predicates": f"""SELECT page_id, CASE WHEN h = '' THEN 'Unknown' WHEN contains(h, 'example.com') THEN 'UserCode' WHEN regexp_matches(h, '^(blog|m)[.].*$') THEN 'SDK' ELSE '3rdLib' END AS layer,
(contains(h, 'example.org') OR contains('example.org', h) OR contains(h, 'blog.ththre.example.com.extra') OR contains('blog.ththre.example.com.extra', h)) AS listed, (contains(html, 'track(') OR contains(html, 'onReceive')) AS mentions, 'pkg.' || string_split(h, '.')[1] AS component FROM (SELECT page_id, html, {_H} AS h FROM pages)""",
    "name_parts": """SELECT p_partkey, md5(p_name) AS hash, CAST(p_partkey % 7 AS INT) AS variant, 't' || (p_partkey % 7) || '_' || md5(p_name) AS base, 'apk' AS extension, 't' || (p_partkey % 7) || '_' || md5(p_name) AS plain, 'I[],Ljava.lang.String[][],J' AS params FROM part""",
    "ascii_names": "SELECT CASE WHEN regexp_matches(w, '[^\\x00-\\x7F]') THEN 'feature_' || n ELSE w END AS feature, n FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w HAVING count(*) >= 20)",
    "label_changes": """SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 'group-one' ELSE 'Malware' END AS label, CASE WHEN contains(source, 'src1') THEN 'group-one' WHEN contains(source, 'src2') THEN 'group-two' ELSE source END AS family FROM documents WHERE NOT starts_with(source, 'src19') AND source <> 'src3'""",
}
