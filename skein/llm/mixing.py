"""Mixing sources to target weights by Pfair scheduling: windows per block, earliest deadline first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Units (code points) of a block, slots of one period of a schedule that has periods.
BLOCK, PERIOD = 100_000, 4096
#: Documents of one source whose running sums a task makes at once, about.
CHUNK_ROWS = 2000
#: Rows of the schedule that the driver holds at once.
PLAN_ROWS = 1 << 18
NO_SOURCE = "(none)"


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots of a period for each weight: largest remainders, at least one; they add up to ``period``."""
    if not weights:
        return {}
    if len(weights) > period or min(weights.values()) < 0:
        raise ValueError(f"weights must be for at most {period} sources, a slot each, and none below 0")
    total = sum(weights.values()) or 1.0
    free = period - len(weights)
    exact = {s: 1 + free * w / total for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def whole_numbers(weights: Sequence[float]) -> list[int]:
    """Integers in exactly the proportions of ``weights``."""
    ratios = [float(w).as_integer_ratio() for w in weights]
    scale = max((d for _, d in ratios), default=1)  # powers of two
    return [n * (scale // d) for n, d in ratios]


def slots(weights: Sequence[int], blocks: Sequence[int], t: int = 0) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) of all ``blocks`` of each source by earliest deadline first, ties by source.

    Block j of a source with the share w = weight / sum of weights has the window [floor(j / w), ceil((j + 1) / w)),
    in integers and so exact. As the shares add up to 1, every block runs in its window: until a source ends, it is less
    than one block away from w t after any number t of slots. Sources of weight 0 have no windows: they come after the
    others, with equal weights. Only sources with a second block are ever in the heaps.
    """
    total = sum(weights)
    if not total:
        weights, total = [1] * len(blocks), len(blocks)
    some = [i for i, w in enumerate(weights) if w]
    due = np.fromiter((min(-(-total // weights[i]), 2**62) for i in some), np.int64, len(some))
    fresh = iter(np.argsort(due, kind="stable"))
    head = next(fresh, None)
    waiting: list[tuple[int, int, int]] = []
    ready: list[tuple[int, int, int]] = []
    begun, last = t, t - 1
    while True:
        while waiting and waiting[0][0] <= t - begun:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[i]), i, j))
        if head is not None and (not ready or (due[head], some[head]) < ready[0][:2]):
            i, j, head = some[head], 0, next(fresh, None)
        elif ready:
            _, i, j = heapq.heappop(ready)
        elif waiting:
            t = begun + waiting[0][0]
            continue
        else:
            break
        yield i, j, (last := t)
        t += 1
        if j + 1 < blocks[i]:
            heapq.heappush(waiting, ((j + 1) * total // weights[i], i, j + 1))
    rest = [i for i, w in enumerate(weights) if not w]
    for k, j, t in slots([1] * len(rest), [blocks[i] for i in rest], last + 1) if rest else ():
        yield rest[k], j, t


def schedule(parts: dict[str, int], period: int = PERIOD) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of one period of whole slots; blocks count from 0."""
    names = sorted(parts)
    counts = [parts[s] for s in names]
    return [(names[i], j, t, j * period // counts[i], -(-(j + 1) * period // counts[i])) for i, j, t in slots(counts, counts)]


def default_weights(sizes: dict[str, int]) -> dict[str, float]:
    """Square roots of the sources' sizes: small sources are seen more often than their share."""
    return {s: math.sqrt(n) for s, n in sizes.items()}


def _plan(scratch: Scratch, names: pa.Array, weights: Sequence[int], blocks: Sequence[int]) -> DataFrame:
    """The schedule as a table (source, block, slot), written ``PLAN_ROWS`` rows at a time."""
    spark, paths, run = scratch.spark, [], slots(weights, blocks)
    while rows := list(islice(run, PLAN_ROWS)):
        i, j, t = (np.fromiter((r[k] for r in rows), np.int64, len(rows)) for k in range(3))
        part = pa.table({"source": names.take(pa.array(i)), "block": j, "slot": t})
        scratch.save(spark.createDataFrame(part), f"plan{len(paths)}")
        paths.append(f"{scratch.root}/plan{len(paths)}")
    schema = "source string, block long, slot long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int | None = None, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, source, size, block, slot, start: its place in the interleaved order.

    In a source, documents follow each other by a hash of their id; ``start`` is the running size before
    one, ``block`` = start div ``block``. Blocks get the slots of one exact schedule over the whole input (``slots``). The order is (slot,
    start, doc_id). All documents are placed: when a source has ended, its slots stay empty and the others keep their
    proportions. Without ``weights`` the square roots of the sizes are used; a source that
    ``weights`` lacks gets weight 0: it comes after the weighted ones. With a ``period``, weights are first rounded to
    whole slots of it, at least one each (``shares``), and the schedule repeats with it.

    Rows that repeat a doc_id count once (smallest source, largest size). A null source is ``(none)``, a
    null or empty text has size 0; neither is dropped. Rows without a doc_id are. Only doc_id, source and text are read. A source with a third of
    all documents is summed in chunks of its hash order: sums per chunk, then running sums over chunks,
    then inside each chunk, so no task holds a source. A chunk has the slots of its blocks beside its sum.
    The driver makes the schedule, one step a block, and holds names and sizes of the sources, of which any number may be.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("size"))
    rows = scratch.save(rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("size").alias("size")), "rows")
    found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("k")).toArrow().sort_by("source").combine_chunks()
    names, n, most = found["source"], found["n"].to_numpy(), max(found["k"].to_numpy(), default=1)
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    given = [float(weights.get(s, 0.0)) for s in names.to_pylist()] if weights is not None else list(default_weights(dict(zip(names.to_pylist(), n.tolist(), strict=True))).values())
    if not all(0 <= w < math.inf for w in given):
        raise ValueError("weights must be finite and none below 0")
    if period is not None:
        given = list(shares(dict(zip(names.to_pylist(), given, strict=True)), period).values())
    plan = _plan(scratch, names, whole_numbers(given), (n // block + 1).tolist())
    bits = min(40, max(0, math.ceil(math.log2(most / CHUNK_ROWS))))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    chunk = F.shiftright(order, 64 - bits) if bits else F.lit(0)
    rows = rows.withColumn("order", order).withColumn("chunk", chunk.cast("long"))
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "chunk", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    base = base.select("source", "chunk", "base", F.explode(F.expr(f"sequence(base div {block}, (base + n) div {block})")).alias("block")).join(plan, ["source", "block"])
    base = base.groupBy("source", "chunk", "base").agg(F.array_sort(F.collect_list(F.struct("block", "slot"))).alias("slots"))
    base = scratch.save(base.select("source", "chunk", "base", F.col("slots.slot").alias("slots")), "base")
    inside = Window.partitionBy("source", "chunk").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["source", "chunk"]).withColumn("start", F.col("start") + F.col("base"))
    placed = placed.withColumn("block", F.expr(f"start div {block}"))
    slot = F.get("slots", (F.col("block") - F.expr(f"base div {block}")).cast("int"))
    return placed.select("doc_id", "source", "size", "block", slot.alias("slot"), "start")


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs``, all rows and columns, in the mixed order: files by range of slots, rows in order inside."""
    spark = docs.sparkSession
    free = [f"_mix{i}" for i in range(len(docs.columns) + 3) if f"_mix{i}" not in docs.columns]
    key, slot, start = free[:3]
    plan = Scratch(spark, "mixed").save(mix(docs, weights).select(F.col("doc_id").alias(key), F.col("slot").alias(slot), F.col("start").alias(start)), "plan")
    out = docs.join(plan, docs.doc_id.cast("long") == plan[key], "left")
    return out.repartitionByRange(slot, start).sortWithinPartitions(slot, start, key).select(*docs.columns)
