"""Near-duplicate groups by b-bit MinHash: bands, packed low bits, bit counts, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import Scratch, join_groups, lean, text_slices, without_rows
from .components import components

#: Minima whose low bits are kept; bands and the minima of each (the first BANDS * ROWS); low bits kept of one.
HASHES, BANDS, ROWS, BITS = 256, 32, 4, 4
#: Word shingles, and the similarity in hundredths at which documents are linked.
SHINGLE, PERCENT = 5, 75
#: Standard errors that an estimate may fall short by before a candidate is let go (3.4e-6, as the bands' miss).
SLACK = 4.5
#: Classes of one band above which its pairs are dealt to several tasks.
BAND_ROWS = 2000

_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(4)
_BAND = _rng.integers(0, 1 << 62, (BANDS, ROWS), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def pack_low_bits(minima: np.ndarray) -> np.ndarray:
    """(rows, HASHES) minima to (rows, HASHES * BITS / 64) int64: the low bits of each, side by side."""
    per = 64 // BITS
    low = (minima & np.uint64((1 << BITS) - 1)).reshape(len(minima), -1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch):
                words, _, _, first = tk.word_hashes(buf, offs)
                sh, bounds = tk.shingle_hashes(words, first, SHINGLE)
                n = np.zeros(hi - lo, np.int64)
                own, other = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                full = np.flatnonzero(np.diff(bounds))
                for i in full:
                    part = np.unique(sh[bounds[i] : bounds[i + 1]])
                    n[i], own[i], other[i] = len(part), part.sum(dtype=np.uint64), tk.mix(part ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                least = np.zeros((len(full), HASHES), np.uint64)
                if len(full):
                    at, work = bounds[:-1][full], np.empty_like(sh)
                    for k in range(HASHES):
                        np.multiply(sh, _A[k], out=work)
                        work += _B[k]
                        least[:, k] = np.minimum.reduceat(work, at)
                least = tk.mix(least)
                bands = tk.mix((least[:, : BANDS * ROWS].reshape(len(full), BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                sig = pack_low_bits(least)

                def lists(rows: np.ndarray, full=full, size=hi - lo) -> pa.Array:
                    width = np.zeros(size, np.int32)
                    width[full] = rows.shape[1]
                    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(width)]).astype(np.int32), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))

                keys = [batch.column(i).slice(lo, hi - lo) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(n), pa.array(own.view(np.int64)), pa.array(other.view(np.int64)), lists(sig), lists(bands)], ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "sig", "bands"])


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): rows go by their id and a hash of their text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles (distinct), two 64-bit sums that name its set, the packed signature, band keys."""
    return _keyed(docs).mapInArrow(lean(_signatures), "doc_id long, text_key long, n_shingles long, set_a long, set_b long, sig array<long>, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch):
                words, _, _, first = tk.word_hashes(buf, offs)
                sh, bounds = tk.shingle_hashes(words, first, SHINGLE)
                parts = [np.unique(sh[bounds[i] : bounds[i + 1]]) for i in range(hi - lo)]
                ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                keys = [batch.column(i).slice(lo, hi - lo) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts).view(np.int64)))], ["id0", "text_key", "members"])


def _id0(doc_id: str) -> Column:
    """An id for equi joins: a missing one is the smallest number."""
    return F.coalesce(doc_id, F.lit(-(1 << 63)))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, members): the full set of 64-bit shingle hashes of the rows that ``wanted`` (cls, id0, text_key) names, one each."""
    rows = _keyed(docs).select(_id0("doc_id").alias("id0"), "text_key", "text").join(wanted.select("id0"), "id0", "left_semi")
    sets = rows.mapInArrow(lean(_sets), "id0 long, text_key long, members array<long>").dropDuplicates(["id0", "text_key"])
    return sets.hint("merge").join(wanted, ["id0", "text_key"]).select("cls", "members")


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures: the share of equal low bits, corrected for chance collisions."""
    fold = {4: "1229782938247303441", 2: "6148914691236517205", 1: "-1"}[BITS]
    # a field is zero only where all its bits agree; the folded bit counts the fields that differ
    terms = []
    for i in range(HASHES * BITS // 64):
        x = f"({a}[{i}] ^ {b}[{i}])"
        ored = {4: f"({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3))", 2: f"({x} | shiftrightunsigned({x}, 1))", 1: x}[BITS]
        terms.append(f"bit_count({ored} & {fold}L)")
    chance = 2.0**-BITS
    return F.expr(f"(({HASHES} - ({' + '.join(terms)})) / {float(HASHES)}D - {chance}D) / {1 - chance}D")


def _floor() -> float:
    """An estimate below this lets a candidate go."""
    p = PERCENT / 100
    hit = p + (1 - p) * 2.0**-BITS
    return p - SLACK * (hit * (1 - hit) / HASHES) ** 0.5 / (1 - 2.0**-BITS)


def _likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimate is not far below the threshold."""
    side = lambda x: sigs.select(F.col("cls").alias(x), F.col("sig").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    return both.where(_sizes("na", "nb")).where(estimate("sa", "sb") >= _floor()).select("a", "b")


def _sizes(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= PERCENT * union."""
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("members").alias(f"m{x}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("ma", "mb")).cast("long").alias("i"), (F.size("ma") + F.size("mb")).cast("long").alias("n"))
    return both.where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * PERCENT).select("a", "b")


def _shared_sizes(sets: DataFrame) -> DataFrame:
    """(cls, c): how many members of each set are in another set too: no intersection can be larger."""
    counts = sets.select("cls", F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("k"), F.min("cls").alias("cls"))
    own = counts.where("k = 1").groupBy("cls").agg(F.count("*").alias("own"))
    return sets.select("cls", F.size("members").alias("size")).hint("merge").join(own, "cls", "left").select("cls", (F.col("size") - F.coalesce("own", F.lit(0))).alias("c"))


def _judged(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of each row."""
    one_set = ["n_shingles", "set_a", "set_b"]
    all_sigs = scratch.save(signatures(docs), "sigs")
    some = all_sigs.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    names = some.groupBy(*one_set).agg(first.alias("r"), F.count("*").alias("n_rows"))
    # numbers follow the classes' smallest ids: the first of a group of copies is the likeliest to be like all of them
    names = names.select(*one_set, F.col("r.doc_id").alias("rep_id"), F.col("r.text_key").alias("rep_key"), "n_rows").orderBy(F.asc_nulls_last("rep_id"), "rep_key")
    names = scratch.save(names.withColumn("cls", F.monotonically_increasing_id()), "names")
    reps = names.select("cls", *one_set, "rep_id", F.col("rep_key").alias("text_key"))
    heads = some.hint("merge").join(reps, [*one_set, "text_key"]).where(F.col("doc_id").eqNullSafe(F.col("rep_id")))
    sigs = scratch.save(heads.dropDuplicates(["cls"]).select("cls", "n_shingles", "sig", "bands"), "classes")

    keyed = scratch.save(sigs.select("cls", F.explode("bands").alias("band")), "keyed")
    buckets = keyed.groupBy("band").agg(F.min("cls").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head")
    members = scratch.save(keyed.hint("merge").join(buckets, "band"), "members")
    scratch.drop("keyed")
    star = members.where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct()
    star = scratch.save(_likely(star, sigs), "star")
    needed = star.select("a").union(star.select("b")).distinct().withColumnRenamed("a", "cls")

    def sets_of(classes: DataFrame, name: str) -> DataFrame:
        wanted = classes.hint("merge").join(names, "cls").select("cls", _id0("rep_id").alias("id0"), F.col("rep_key").alias("text_key"))
        return scratch.save(shingle_sets(docs, scratch.save(wanted, f"{name}-wanted")), name)

    sets = sets_of(needed, "sets")
    links = scratch.save(_confirmed(star, sets), "links")
    first = components(links, scratch, "first")

    label = F.coalesce("component", "cls").alias("label")
    tagged = scratch.save(members.select("band", "cls").hint("merge").join(first.withColumnRenamed("id", "cls"), "cls", "left").select("band", "cls", label), "tagged")
    mixed = tagged.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("band")
    open_rows = scratch.save(tagged.hint("merge").join(mixed, "band", "left_semi"), "open")
    linked = first
    if not open_rows.isEmpty():
        open_ids = open_rows.select("cls").distinct()
        more = sets_of(open_ids.hint("merge").join(needed, "cls", "left_anti"), "more")
        open_sets = sets.hint("merge").join(open_ids, "cls", "left_semi").unionByName(more)
        sharing = _shared_sizes(open_sets).hint("merge").join(sigs.select("cls", "sig", "bands", F.col("n_shingles").alias("n")), "cls")
        # a class can only have links if enough of its set is shared at all
        able = scratch.save(sharing.where(F.col("c") * 100 >= F.col("n") * PERCENT), "able")
        open_rows = open_rows.hint("merge").join(able.select("cls"), "cls", "left_semi")
        # the pairs of a large band are dealt by salts of one side
        large = open_rows.groupBy("band").agg(F.ceil(F.count("*") / F.lit(BAND_ROWS)).cast("int").alias("salts")).where("salts > 1")
        dealt = open_rows.join(large, "band", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        dealt = scratch.save(dealt.hint("merge").join(able, "cls"), "dealt")
        side = lambda x, salt: dealt.select("band", salt.alias("salt"), F.col("cls").alias(x), F.col("label").alias(f"l{x}"), F.col("sig").alias(f"s{x}"), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"), F.col("bands").alias(f"b{x}"))
        x, y = side("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), side("b", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))
        once = F.element_at(F.array_intersect("ba", "bb"), 1) == x.band  # a pair is met in the first band that it shares
        enough = F.least("ca", "cb") * (100 + PERCENT) >= (F.col("na") + F.col("nb")) * PERCENT
        rest = x.hint("merge").join(y, (x.band == y.band) & (x.salt == y.salt) & (F.col("la") < F.col("lb")) & enough & (estimate("sa", "sb") >= _floor()) & once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = scratch.save(rest.hint("merge").join(star, ["a", "b"], "left_anti"), "rest")
        scratch.drop("members", "tagged", "open", "dealt", "able")
        late = scratch.save(_confirmed(rest, sets.unionByName(more)), "late")
        scratch.drop("sets", "more")
        linked = components(late.unionByName(first.select(F.col("id").alias("a"), F.col("component").alias("b"))), scratch, "all")
    # a component is named by the smallest id of its classes
    classes = scratch.save(names.hint("merge").join(linked.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "labelled")
    least = classes.groupBy("component").agg(F.min("rep_id").alias("component_id"), F.count("*").alias("n_classes"))
    groups = join_groups(classes, least, ["component"], "n_classes", names.count())
    groups = scratch.save(groups.select(*one_set, "component_id", "n_rows"), "groups")
    keys = ["doc_id", "text_key", "n_shingles"]
    rows = join_groups(some.select("doc_id", "text_key", *one_set), groups, one_set, "n_rows", some.count()).select(*keys, "component_id")
    alone = all_sigs.where("n_shingles = 0").select(*keys, F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dup_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest linked id), kept (doc_id = component_id).

    1. Rows with the same set are one class, with a number of its own (a grouped minimum finds its smallest id).
    2. Classes that share a band key are candidates. In each bucket every class is held against the
       bucket's smallest number, not against all others: first by bit counts, then by full sets.
    3. Components of the links give labels. A bucket whose classes have one label needs no more. In
       the others every pair of classes with different labels is a candidate, so that no link
       between components is missed. What a set shares with any other set of these buckets bounds
       its intersections; pairs that this bound and the bit counts leave are confirmed on full sets. Large buckets are salted.
    4. Components over all confirmed links.

    With 32 bands of 4 minima a pair at the threshold shares no band with probability 5e-6 (less above).
    Sets hold 64-bit shingle hashes; a false equality has probability below 1e-12 a pair. Null and
    empty texts have n_shingles 0 and are linked with nothing. Rows that repeat a doc_id are each judged by their own
    text. Rows without a doc_id take part as if their ids were larger than all: a component without any id has none. Other
    columns are not read. An empty table gives no rows.
    """
    return _judged(docs, Scratch(docs.sparkSession, "neardup")).drop("text_key")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) without the rows that are linked to a document of smaller id.

    Rows go by doc_id and text: of an id with two texts only a linked one can go. Rows without an id go where a document with
    an id is linked to them.
    """
    scratch = Scratch(docs.sparkSession, "neardup-kept")
    rows = scratch.save(_judged(docs, scratch).select("doc_id", "text_key", "kept"), "rows")
    return without_rows(docs, rows, ~F.col("kept"), scratch)
