"""Scalar text functions on columns: names, signatures, prefixes, addresses, percentages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# One part of an IP address, and the pattern of a host name.
_OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IP_PATTERN = rf"\b({_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET})\b"
HOST_PATTERN = r"^(?=.{4,253}$)((?:(?!-)[a-zA-Z0-9-]{1,63}(?<!-)\.)+[a-zA-Z]{2,63})$"


def _iri_pattern() -> str:
    """The grammar of RFC 3987 for a whole, lower-case IRI, composed of its rules."""
    planes = "".join(rf"\x{{{p}0000}}-\x{{{p}FFFD}}" for p in "123456789ABCD")
    high = rf"\x{{A0}}-\x{{D7FF}}\x{{F900}}-\x{{FDCF}}\x{{FDF0}}-\x{{FFEF}}{planes}\x{{E1000}}-\x{{EFFFD}}"
    private = r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}"
    kept = rf"-a-z0-9._~{high}!$&'()*+,;="  # unreserved marks and delimiters
    run = lambda more: rf"[{kept}{more}]*(?:%[0-9a-f]{{2}}[{kept}{more}]*)*"  # noqa: E731  any number, none included
    some = rf"(?:%[0-9a-f]{{2}}|[{kept}:@]){run(':@/')}"
    octet, h16 = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])", "[0-9a-f]{1,4}"
    v4 = rf"{octet}(?:\.{octet}){{3}}"
    low32 = rf"(?:{h16}:{h16}|{v4})"
    # groups before the gap, which may be missing, and groups after it; two, where there are three after it, or none
    before = [h16, f"{h16}:{h16}", *[f"(?:{h16}:){{0,{n}}}{h16}" for n in (2, 3, 4, 5, 6)]]
    after = [*[f"(?:{h16}:){{{n}}}{low32}" for n in (4, 3, 2, 1)], low32, h16, ""]
    v6 = [f"(?:{h16}:){{6}}{low32}", f"::(?:{h16}:){{5}}{low32}", *[f"(?:{x})?::{y}" for x, y in zip(before, after, strict=True)]]
    literal = rf"\[(?:{'|'.join(v6)}|v[0-9a-f]+[-a-z0-9._~!$&'()*+,;=:]+)\]"
    authority = rf"(?:{run(':')}@)?(?:{literal}|{v4}|{run('@')})(?::[0-9]*)?"
    path = rf"(?://{authority}(?:/{run(':@/')})?|/(?:{some})?|{some}|)"
    return rf"^([a-z][-a-z0-9+.]*:{path}(?:\?{run(':@/?' + private)})?(?:#{run(':@/?')})?)$"


IRI_PATTERN = _iri_pattern()
#: A web address as the survey's Q5 means it, and with the blank of its braces as text, so that only numeric hosts and those that spell it match.
URL_PATTERN = r"(?i)https?://([\da-z.-]+\.[a-z.]{2,6}|[\d.]+)[^'\"]*"
LITERAL_URL_PATTERN = r"(?i)https?://([\da-z.-]+\.[a-z.]\{2, 6\}|[\d.]+)[^'\"]*"
_DOMAIN = r"(?i)https?://([^/:\\]*)"


def nonempty(c: Column) -> Column:
    """Null instead of an empty match."""
    return F.when(c != "", c)


def first_prefix(s: Column, prefixes: Sequence[str], default: Column | None = None) -> Column:
    """The first of ``prefixes`` that ``s`` starts with, in list order; else ``default``."""
    hit = F.element_at(F.filter(F.array(*[F.lit(p) for p in prefixes]), lambda p: s.startswith(p)), 1) if len(prefixes) > 64 else F.coalesce(*[F.when(s.startswith(p), F.lit(p)) for p in prefixes])
    return hit if default is None else F.coalesce(hit, default)


def first_prefix_or_null(s: Column, prefixes: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(s.startswith(p), F.lit(p)) for p in prefixes])


def obfuscation_class(s: Column, short: int = 3) -> Column:
    """``obfuscated`` when at least half of the dotted parts are shorter than ``short``, else ``selfdefined``."""
    parts = F.split(s, "[.]")
    few = F.size(F.filter(parts, lambda p: F.length(p) < short))
    return F.when(few >= F.size(parts) / 2.0, "obfuscated").otherwise("selfdefined")


def obfuscation_class_strict(s: Column, short: int = 3) -> Column:
    """The older rule: more than half, and the spelling ``self-defined``."""
    parts = F.split(s, "[.]")
    return F.when(F.size(F.filter(parts, lambda p: F.length(p) < short)) > F.size(parts) / 2.0, "obfuscated").otherwise("self-defined")


def legacy_state(s: Column, packages: Sequence[str]) -> Column:
    """Older abstraction: inner classes by dots, test packages dropped (null), later packages of the list first."""
    name = F.regexp_replace(s, "[$]", ".")
    hit = first_prefix_or_null(name, list(reversed(packages)))
    return F.when(~name.startswith("junit."), F.coalesce(hit, obfuscation_class_strict(name)))


def renamed(s: Column, names: Mapping[str, str]) -> Column:
    """Short names from a dictionary; a name that is not in it stays."""
    if not names:
        return s
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, s), s)


def package_walk(call: Column, names_at: Sequence[Sequence[str]], known: Sequence[str]) -> Column:
    """Package of a dotted call by position sets: parts are taken while each is known at its place.

    Any combination of known parts is walked, so the result may be no package: then, and when all parts
    match (a full match keeps its last dot), the state is in no list and is null. No part: by obfuscation class.
    """
    parts = F.split(call, "[.]")
    sets = F.array(*[F.array(*[F.lit(x) for x in level]).cast("array<string>") for level in names_at])
    fits = F.transform(parts, lambda x, i: F.coalesce(F.array_contains(F.get(sets, i), x), F.lit(False)))
    bad = F.array_position(fits, False)
    depth = F.when(bad == 0, F.size(parts)).otherwise(bad - 1).cast("int")
    package = F.array_join(F.slice(parts, 1, depth), ".")
    return F.when(depth == 0, obfuscation_class(call)).when((bad != 0) & package.isin(*known), package)


def call_tokens(line: Column) -> Column:
    """Cleaned class tokens of a call-graph line: parameters cut, list marks stripped, empties and commas dropped."""
    parts = F.split(F.regexp_replace(line, r"\\n", "\n"), "\n| ==> ")
    clean = F.transform(parts, lambda p: F.trim(F.translate(F.regexp_replace(F.split_part(p, F.lit("("), F.lit(1)), r"^[\s,\[\]'\"]+", ""), "[]'\\", "")))
    return F.filter(clean, lambda p: (p != "") & (p != ","))


def long_tokens(tokens: Column, least: int = 2) -> Column:
    """The tokens of at least ``least`` characters."""
    return F.filter(tokens, lambda t: F.length(t) >= least)


def trace_call(line: Column) -> Column:
    """Struct (caller, callee) of ``<caller> -> <callee>``; null when there is no arrow."""
    parts = F.split(line, " -> ")
    bare = lambda c: F.regexp_replace(F.trim(c), "^<|>$", "")
    return F.when(F.size(parts) == 2, F.struct(bare(F.get(parts, 0)).alias("caller"), bare(F.get(parts, 1)).alias("callee")))


def class_of(signature: Column) -> Column:
    """Class of a method signature: what stands before the first colon, without the opening mark."""
    return F.regexp_replace(F.substring_index(signature, ":", 1), "^<", "")


def percentage(part: Column, total: Column) -> Column:
    """part / total to four places, half to even; 0 where the total is 0."""
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), total.cast("double")), 4), F.lit(0.0))


def url_domain(text: Column, literal: bool = False) -> Column:
    """What follows the scheme of the first web address, up to a slash, colon or backslash; null without an address.

    ``literal`` keeps the pattern's braces as text.
    """
    found = F.regexp_extract(text, LITERAL_URL_PATTERN if literal else URL_PATTERN, 0)
    return nonempty(F.regexp_extract(found, _DOMAIN, 1))


def net_address(text: Column) -> Column:
    """Struct (kind, address): the first IP anywhere, else a text that is a host name, else a text that is an IRI; else null."""
    found = [(k, nonempty(F.regexp_extract(text, p, 1))) for k, p in (("ip", IP_PATTERN), ("host", HOST_PATTERN), ("iri", IRI_PATTERN))]
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("kind"), c.alias("address"))) for k, c in found])


def hash_in_name(name: Column, suffix: str = "apk") -> Column:
    """The run of letters and digits before ``.suffix``; a ``t<n>_`` prefix is no part of it."""
    return nonempty(F.regexp_extract(name, rf"([0-9a-zA-Z]+)\.{suffix}", 1))


def transformation_of(name: Column) -> Column:
    """n of ``t<n>_<hash>.apk``; null for an original."""
    return nonempty(F.regexp_extract(name, r"^t([0-9]+)_", 1)).cast("int")


def qualified_component(name: Column, package: Column) -> Column:
    """``.X`` and ``X`` are in the package; a dotted name stands."""
    return F.when(name.startswith("."), F.concat(package, name)).when(F.instr(name, ".") > 0, name).otherwise(F.concat(package, F.lit("."), name))


def year_of(date: Column, default: str | None = None) -> Column:
    y = F.get(F.split(date.cast("string"), "-"), 0)
    return y if default is None else F.coalesce(y, F.lit(default))


def without_suffix(name: Column, suffix: str = ".apk") -> Column:
    return F.lower(F.regexp_replace(F.trim(name), f"(?i){suffix.replace('.', '[.]')}$", ""))


def ascii_name(name: Column, index: Column, prefix: str = "feature_") -> Column:
    """Names with other than ASCII characters are replaced by a numbered one."""
    return F.when(name.rlike(r"[^\x00-\x7F]"), F.concat(F.lit(prefix), index.cast("string"))).otherwise(name)


def instruction_api(instruction: Column) -> Column:
    """Struct (class, method) of an invoked platform API in an instruction text; null when there is none."""
    cls, method = F.regexp_extract(instruction, r"L(android[^;]*);->([^(]*)", 1), F.regexp_extract(instruction, r"L(android[^;]*);->([^(]*)", 2)
    return F.when(cls != "", F.struct(F.regexp_replace(cls, "/", ".").alias("class"), method.alias("method")))


def array_signature(params: Column) -> Column:
    """Canonical parameter list: ``[X`` is written ``X[]``."""
    one = lambda p: F.concat(F.regexp_replace(p, r"^\[+", ""), F.repeat(F.lit("[]"), F.length(F.regexp_extract(p, r"^(\[*)", 1))))
    return F.array_join(F.transform(F.split(params, ","), lambda p: one(F.trim(p))), ",")


def base_and_extension(name: Column) -> Column:
    """Struct (base, extension), cut at the last dot; a name without one has an empty extension."""
    cut = F.regexp_extract(name, r"^(.*)\.([^.]*)$", 1)
    return F.struct(F.when(F.instr(name, ".") > 0, cut).otherwise(name).alias("base"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("extension"))


def joined_categories(categories: Column) -> Column:
    """Categories in the records' own spelling: from the second on, each is followed by a semicolon."""
    return F.concat(F.coalesce(F.get(categories, F.lit(0)), F.lit("")), F.array_join(F.transform(F.slice(categories, 2, 1 << 30), lambda c: F.concat(c, F.lit(";"))), ""))


def stripped_log(line: Column) -> Column:
    """A log line without its thread, level and logger head."""
    return F.trim(F.regexp_replace(line, r"^(?:\[[^\]]*\]\s*|(?:TRACE|DEBUG|INFO|WARN|ERROR)\s+|[\w.]+\s+-\s+)+", ""))


def content_md5(content: Column) -> Column:
    return F.md5(content)


def average_vectors(*vectors: Column) -> Column:
    """Element-wise mean of equally long arrays."""
    total = vectors[0]
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda a, b: a + b)
    return F.transform(total, lambda x: x / F.lit(float(len(vectors))))


def concat_vectors(*vectors: Column) -> Column:
    return F.concat(*vectors)
