"""Exact top-k by inner product: a dual-tree search over cover trees of queries and data."""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of one data tree and of one query tree at most, about; vectors of a leaf; pivots that vectors are put next to each other by.
DATA_BLOCK, QUERY_BLOCK, LEAF, PIVOTS = 8192, 512, 64, 64
#: Data blocks whose summaries one task holds; query trees that one task holds beside a data tree.
CELL_BLOCKS, TREES_EACH = 4096, 64
SCALE, TOP, QUERY_EVERY = 64, 20, 20
_LEAST = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


class Numbers:
    """How whole components of at most ``largest`` are stored, and how their inner products stay exact.

    Below 2**53 a sum of products is exact in floating point, below 2**63 in 64-bit integers; beyond, Python's
    integers are used and scores end at the limits of a 64-bit integer.
    """

    def __init__(self, largest: float, width: int):
        self.width = width
        self.store = np.dtype(next((t for t in (np.int16, np.int32) if largest < np.iinfo(t).max), np.int64))
        size = int(min(largest, 2.0**63)) ** 2 * max(width, 1)
        self.kind = np.float64 if size < 1 << 53 else np.int64 if size < 1 << 63 else object
        #: Relative error of distances and bounds.
        self.error = 1e-12 if self.kind is np.float64 else 1e-6

    def rows(self, packed: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(packed.to_pylist()), self.store).reshape(len(packed), self.width)

    def scores(self, q: np.ndarray, d: np.ndarray) -> np.ndarray:
        s = q.astype(self.kind) @ d.astype(self.kind).T
        if self.kind is object:
            s = np.clip(s, _LEAST + 1, _MOST)
        return s.astype(np.int64)


class CoverTree:
    """A cover tree over a block's vectors, down to buckets of about ``LEAF`` rows.

    Centres are taken farthest first. The net of level l holds the centres that were farther than 2**l from all
    before them, so nets are nested, centres of a net are more than 2**l apart, and every row is within 2**l of the net.
    A centre below it hangs on its nearest centre of the next net up, at most 2**(l + 1) away. Nodes are
    (centre, level), a centre's own node one level down among its children; chains without other children are one
    node. The rows hang as buckets on the nearest centre of all. Nodes are ranges ``lo``, ``hi`` of the reordered rows with the exact ``radius``.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, numbers: Numbers, leaf: int = LEAF):
        f = x.astype(np.float64)
        sq = (f * f).sum(1)

        def far(c: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
            return np.sqrt(np.maximum(sq[rows] + sq[c] - 2 * (f[rows] @ f[c]), 0))

        at, gap, best, near = [0], [math.inf], far(0), np.zeros(len(ids), np.int64)
        while len(at) < len(ids) // leaf:
            new = int(best.argmax())
            if best[new] <= 0:
                break
            d = far(new)
            closer = d < best
            near[closer], best = len(at), np.minimum(best, d)
            at.append(new)
            gap.append(float(d[at[:-1]].min()))
        self.centres = np.array(at)
        levels = np.ceil(np.log2(np.array(gap[1:]))).astype(int) - 1  # gap > 2**level
        top = int(levels.max(initial=-1)) + 1
        self.level_of = np.concatenate([[top], np.minimum.accumulate(levels)]) if len(levels) else np.array([top])
        hanging: list[dict[int, list[int]]] = [{} for _ in at]
        self.parent = np.zeros(len(at), np.int64)
        for j in range(1, len(at)):
            net = int((self.level_of > self.level_of[j]).sum())  # nets are beginnings of the order
            self.parent[j] = int(far(at[j], self.centres[:net]).argmin())
            hanging[self.parent[j]].setdefault(int(self.level_of[j]) + 1, []).append(j)
        bucket = np.argsort(near, kind="stable")
        ends = np.cumsum(np.bincount(near, minlength=len(at)))
        self.children, self.node_level, spans, centre, order = [], [], [], [], []

        def build(j: int, below: list[int]) -> int:
            """The node of centre j at the first of its levels ``below`` at which others hang on it."""
            k, lo = len(centre), len(order)
            centre.append(at[j])
            self.children.append([])
            spans.append((lo, lo))
            self.node_level.append(below[0] if below else None)
            if below:
                self.children[k] = [build(j, below[1:]), *[build(i, sorted(hanging[i], reverse=True)) for i in hanging[j][below[0]]]]
            else:
                order.extend(bucket[ends[j - 1] if j else 0 : ends[j]].tolist())
            spans[k] = (lo, len(order))
            return k

        build(0, sorted(hanging[0], reverse=True))
        order = np.array(order, np.int64)
        self.lo, self.hi = np.array(spans).T
        slack = 1 + numbers.error, numbers.error * math.sqrt(float(sq.max(initial=0)))
        self.radius = np.array([far(c, order[a:b]).max(initial=0) for c, (a, b) in zip(centre, spans, strict=True)]) * slack[0] + (slack[1] if numbers.kind is not np.float64 else 0)
        self.ids, self.x, self.centre, self.numbers = ids[order], x[order], x[centre], numbers
        self.norm = np.sqrt((self.centre.astype(np.float64) ** 2).sum(1))


class Search:
    """Running top-k of a query tree; ``add`` searches one more data tree."""

    def __init__(self, queries: CoverTree, k: int, worst: tuple[np.ndarray, np.ndarray] | None = None):
        self.q, self.k = queries, k
        self.row, self.score, self.of = (np.zeros(0, np.int64) for _ in range(3))
        # the k-th best answer of each query, or a bound of it: its score and id
        self.worst, self.edge = (np.full(len(queries.ids), x) for x in (_LEAST, _MOST)) if worst is None else (x.copy() for x in worst)
        self.mine = queries.x.astype(queries.numbers.kind)
        self.centre = queries.centre.astype(np.float64)
        self.tested = 0

    def bounds(self, a: list[int] | int, d: CoverTree, b: list[int] | int) -> np.ndarray:
        """No inner product between the balls of the nodes ``a`` of the queries and ``b`` of the data, one of them a single node, is larger."""
        q = self.q
        dot = self.centre[a] @ d.centre[b].astype(np.float64).T
        wide = (q.norm[a] + q.radius[a]) * (d.norm[b] + d.radius[b])
        return dot + q.norm[a] * d.radius[b] + d.norm[b] * q.radius[a] + q.radius[a] * d.radius[b] + 4 * q.numbers.error * wide

    def needed(self, a: int) -> float:
        """Worst k-th score of a query group; bounds below it cannot help, an equal score may win by its id."""
        return float(self.worst[self.q.lo[a] : self.q.hi[a]].min())

    def add(self, d: CoverTree) -> None:
        """Best bounds first; a pair of nodes whose bound is below the worst k-th score of its queries is cut off."""
        q, other = self.q, d.x.astype(d.numbers.kind)
        heap = [(-float(self.bounds(0, d, 0)), 0, 0)]
        while heap:
            bound, a, b = heapq.heappop(heap)
            if -bound < self.needed(a):
                continue
            split_q, split_d = q.children[a], d.children[b]
            if not split_q and not split_d:
                self.leaves(a, d, b, other)
            elif split_q and (not split_d or q.radius[a] > d.radius[b]):
                for c, u in zip(split_q, self.bounds(split_q, d, b).tolist(), strict=True):
                    if u >= self.needed(c):
                        heapq.heappush(heap, (-u, c, b))
            else:
                least = self.needed(a)
                for c, u in zip(split_d, self.bounds(a, d, split_d).tolist(), strict=True):
                    if u >= least:
                        heapq.heappush(heap, (-u, a, c))

    def leaves(self, a: int, d: CoverTree, b: int, other: np.ndarray) -> None:
        q, k = self.q, self.k
        lo, hi = q.lo[a], q.hi[a]
        for at in range(d.lo[b], d.hi[b], 8 * LEAF):
            end = min(d.hi[b], at + 8 * LEAF)
            s = q.numbers.scores(self.mine[lo:hi], other[at:end])
            self.tested += s.size
            ids, worst = d.ids[None, at:end], self.worst[lo:hi, None]
            r, c = np.nonzero(((s > worst) | ((s == worst) & (ids < self.edge[lo:hi, None]))) & (q.ids[lo:hi, None] != ids))
            if not len(r):
                continue
            mine = (self.row >= lo) & (self.row < hi)
            row = np.concatenate([self.row[mine], r + lo])
            score = np.concatenate([self.score[mine], s[r, c]])
            of = np.concatenate([self.of[mine], d.ids[at:end][c]])
            o = np.lexsort((of, -score, row))
            row, score, of = row[o], score[o], of[o]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            top, full = rank < k, rank == k - 1
            on, s_k, of_k = row[full], score[full], of[full]
            better = (s_k > self.worst[on]) | ((s_k == self.worst[on]) & (of_k < self.edge[on]))
            self.worst[on[better]], self.edge[on[better]] = s_k[better], of_k[better]
            self.row, self.score, self.of = np.concatenate([self.row[~mine], row[top]]), np.concatenate([self.score[~mine], score[top]]), np.concatenate([self.of[~mine], of[top]])

    def found(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.q.ids[self.row], "vec_id": self.of, "score": self.score})


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): components floor(scale * value) as whole doubles; vectors null or with null or non-finite components go."""
    v = F.col("embedding")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("x"))


def _packed(rows: DataFrame, numbers: Numbers) -> DataFrame:
    """(vec_id, x): components as bytes of the narrowest type, shorter vectors filled up with zeros."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            size = col.value_lengths().to_numpy()
            out = np.zeros((len(batch), numbers.width))
            out[np.arange(numbers.width) < size[:, None]] = col.flatten().to_numpy()
            out = np.clip(out, -(2.0**63), 2.0**63 - 1024).astype(numbers.store)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in out], pa.binary())], ["vec_id", "x"])

    one = rows.mapInArrow(kernel, "vec_id long, x binary")
    return one.groupBy("vec_id").agg(F.min("x").alias("x"))


def _pivots(rows: DataFrame, numbers: Numbers) -> np.ndarray:
    """Farthest-first pivots of a bounded sample: they only shape the blocks, not the result."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(32 * PIVOTS).toArrow()
    x = numbers.rows(some["x"]).astype(np.float64)
    at, best = [0], ((x - x[0]) ** 2).sum(1)
    while len(at) < min(PIVOTS, max(1, len(x) // 32)) and best.max() > 0:
        at.append(int(best.argmax()))
        best = np.minimum(best, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def _trees(rows: DataFrame, n: int, size: int, pivots: np.ndarray, numbers: Numbers) -> DataFrame:
    """(block, tree, centre, radius): cover trees of about ``size`` vectors each, vectors of one pivot next to each other.

    Blocks are ranges of (pivot, hash of the id), so they are even, and a vector that a third of all rows have fills several.
    """
    half = (pivots**2).sum(1) / 2

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = (numbers.rows(batch.column(1)).astype(np.float64) @ pivots.T - half).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], ["vec_id", "x", "pivot"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), numbers.rows(b.column(1))) for b in batches if len(b)]
        if parts:
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            t = CoverTree(ids[order], x[order], numbers)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(t, 5)], pa.binary()), pa.array([t.centre[0].tobytes()], pa.binary()), pa.array([float(t.radius[0])])], ["block", "tree", "centre", "radius"])

    near = rows.mapInArrow(assign, "vec_id long, x binary, pivot int")
    ranged = near.repartitionByRange(max(1, -(-n // size)), "pivot", F.xxhash64("vec_id"), "vec_id")
    return ranged.mapInArrow(build, "block long, tree binary, centre binary, radius double")


def _with_cells(q: DataFrame, d: DataFrame, cells: int) -> DataFrame:
    """Each query tree beside the summaries of a cell of at most about ``CELL_BLOCKS`` data blocks, cell by cell."""
    held = d.groupBy((F.col("block") % cells).alias("cell")).agg(F.collect_list(F.struct("block", "centre", "radius")).alias("blocks"))
    asked = q.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    return asked.join(held, "cell")


def _chosen(numbers: Numbers, seed: bool):
    """Per query tree and cell: the data blocks to search. ``seed``: the one with the nearest centre; else those in whose ball an answer may lie."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q: CoverTree = pickle.loads(r["tree"])
                names = np.array([b["block"] for b in r["blocks"]])
                centre = np.stack([np.frombuffer(b["centre"], numbers.store) for b in r["blocks"]]).astype(np.float64)
                radius = np.array([b["radius"] for b in r["blocks"]])
                if seed:
                    dot = centre @ q.centre[0].astype(np.float64)
                    i = np.lexsort((names, -dot))[:1]
                    out, strength = names[i], dot[i]
                else:
                    (worst, _), first = pickle.loads(r["worst"]), r["seed"]
                    x = q.x.astype(np.float64)
                    norm, far = np.sqrt((x * x).sum(1)), np.sqrt((centre * centre).sum(1)) + radius
                    bound = x @ centre.T + norm[:, None] * radius + 4 * numbers.error * norm[:, None] * far
                    strength = np.where(bound >= worst[:, None], bound, -np.inf).max(0)
                    i = np.flatnonzero((strength > -np.inf) & (names != first))
                    out, strength = names[i], strength[i]
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(out), pa.int64()), pa.array(out, pa.int64()), pa.array(strength, pa.float64()), *([] if seed else [pa.array([r["tree"]] * len(out), pa.binary()), pa.array([r["worst"]] * len(out), pa.binary())])], ["q_block", "block", "strength", "q_tree", "worst"][: 3 if seed else 5])

    return kernel


def _seeded(k: int):
    def kernel(trees: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        """First search of each query tree: what it found, and the k-th scores that the others must reach."""
        rows = []
        for tree in trees["tree"].iloc[:1]:
            d = pickle.loads(tree)
            for r in pairs.itertuples():
                s = Search(pickle.loads(r.q_tree), k)
                s.add(d)
                rows.append((r.q_block, r.q_tree, pickle.dumps((s.worst, s.edge), 5), r.block, pickle.dumps(s.found(), 5)))
        return pd.DataFrame(rows, columns=["block", "tree", "worst", "seed", "found"])

    return kernel


def _searched(k: int):
    def kernel(trees: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("query_id", "vec_id", "score")})]
        for tree in trees["tree"].iloc[:1]:
            d = pickle.loads(tree)
            for r in pairs.itertuples():
                s = Search(pickle.loads(r.q_tree), k, pickle.loads(r.worst))
                s.add(d)
                out.append(s.found())
        return pd.concat(out)

    return kernel


def top_k(queries: DataFrame, data: DataFrame, k: int = TOP, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Per query: query_id, rank (from 1), vec_id, score: its k largest inner products, ties to the smaller vec_id.

    Both sides are ``whole_vectors``; shorter ones count as filled up with zeros. A row is never its own query's answer.
    Fewer than k candidates give all of them; empty inputs give no rows. Repeated rows of a vec_id count once, the one of
    smallest bytes. Scores are exact; those beyond 64 bits end at the limits (``Numbers``).

    1. Cover trees of even blocks of near vectors, on both sides.
    2. Each query tree is searched against the data tree with the nearest centre: its k-th scores are lower bounds.
    3. The summaries (centre, radius) of the data blocks, in cells of ``CELL_BLOCKS``, meet the query trees by an equi
       join on the cell; blocks in whose ball no query's k-th score can be reached are let go here.
    4. Query trees are sent to the data blocks that are left, ``TREES_EACH`` to a task at most, and searched
       by pairs of nodes. Data trees are sent once to each such task; the best k of all are ranked with a limit before the shuffle.
    """
    spark = data.sparkSession
    scratch = Scratch(spark, "topk")
    result = "query_id long, rank int, vec_id long, score long"
    size = lambda t: t.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest")).first()
    of_q, of_d = size(queries), size(data)
    if not of_q["n"] or not of_d["n"]:
        return spark.createDataFrame([], result)
    numbers = Numbers(max(of_q["largest"], of_d["largest"]), max(of_q["width"], of_d["width"]))
    data = scratch.save(_packed(data, numbers), "data")
    pivots = _pivots(data, numbers)
    # enough blocks for all cores
    cores = spark.sparkContext.defaultParallelism
    d = scratch.save(_trees(data, of_d["n"], max(1024, min(data_block, -(-of_d["n"] // (2 * cores)))), pivots, numbers), "d-trees")
    q = scratch.save(_trees(_packed(queries, numbers), of_q["n"], max(64, min(query_block, -(-of_q["n"] // (2 * cores)))), pivots, numbers), "q-trees")
    n_d, n_q = d.count(), q.count()
    cells, salts = -(-n_d // CELL_BLOCKS), -(-n_q // TREES_EACH)
    salt = F.pmod(F.xxhash64("q_block"), F.lit(salts)).cast("int").alias("salt")

    def meet(pairs: DataFrame, kernel, schema: str) -> DataFrame:
        """Data trees beside the query trees that are sent to them."""
        wanted = pairs.select(F.col("block").alias("block"), F.col("salt").alias("salt")).distinct()
        return d.select("block", "tree").join(wanted, "block").groupBy("block", "salt").cogroup(pairs.groupBy("block", "salt")).applyInPandas(kernel, schema)

    pairs = _with_cells(q.select("block", "tree"), d, cells).mapInArrow(_chosen(numbers, True), "q_block long, block long, strength double")
    pairs = pairs.groupBy("q_block").agg(F.max(F.struct("strength", "block")).alias("s")).select("q_block", F.col("s.block").alias("block"))
    pairs = scratch.save(pairs.join(q.select(F.col("block").alias("q_block"), F.col("tree").alias("q_tree")), "q_block").select("q_block", "block", "q_tree", salt), "seeds")
    seeded = scratch.save(meet(pairs, _seeded(k), "block long, tree binary, worst binary, seed long, found binary"), "seeded")
    rest = _with_cells(seeded.select("block", "tree", "worst", "seed"), d, cells).mapInArrow(_chosen(numbers, False), "q_block long, block long, strength double, q_tree binary, worst binary")
    rest = scratch.save(rest.select("q_block", "block", "q_tree", "worst", salt), "pairs")
    later = meet(rest, _searched(k), "query_id long, vec_id long, score long")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pandas(pickle.loads(found), preserve_index=False)

    both = seeded.select("found").mapInArrow(unpacked, "query_id long, vec_id long, score long").unionByName(later)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_of_every_20th(vectors: DataFrame) -> DataFrame:
    """The rows whose id is divisible by 20 are the stated query set, all rows are candidates."""
    rows = whole_vectors(vectors)
    return top_k(rows.where(F.col("vec_id") % QUERY_EVERY == 0), rows)


ORACLE = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
