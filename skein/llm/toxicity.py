"""Toxic spans by a linear-chain conditional random field; its marginals make document scores and offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learn
from . import textkernel as tk
from .common import Scratch, crc_mod, lean, text_slices
from .sequence import forward_backward, marginals, runs

#: Labelled rows of each class that the field is learnt from at most, whole texts each.
LEARN_ROWS = 800
SIZE = 1 << 20
#: A view labels tokens of toxic rows when its odds ratio over rows is at least this, in this many
#: toxic rows and this share of them.
SEED_ODDS, SEED_ROWS, SEED_SHARE = 20.0, 3, 0.025

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True


#: What a token shows of itself: the whole word, its first 3, 4 and 5 bytes, its last 4.
VIEWS = 5


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, start, end, first token of each row): runs of letters, digits and non-ASCII bytes, lower-cased.

    Buckets are (views, tokens): word, beginnings and ending, hashed apart from each other.
    """
    if not len(buf):
        z = np.zeros(0, np.int64)
        return np.zeros((VIEWS, 0), np.int32), z, z, np.zeros(len(offs), np.int64)
    inside = _TOKEN[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    inner = offs[:-1][np.diff(offs) > 0]
    before[inner] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    out = np.empty((VIEWS, len(starts)), np.int32)
    with np.errstate(over="ignore"):
        prefix = tk.prefix_hash(buf, lower=True)
        cuts = [(starts, ends), *[(starts, np.minimum(starts + k, ends)) for k in (3, 4, 5)], (np.maximum(ends - 4, starts), ends)]
        for i, (a, b) in enumerate(cuts):
            out[i] = (tk.mix(tk.span_hash(prefix, a, b) + np.uint64(i)) >> np.uint64(64 - 20)).astype(np.int32)
    return out, starts, ends, np.searchsorted(starts, offs)


class Field:
    """Weights: each token's views, the words beside it, a bias and 2 x 2 transitions; states clean, toxic."""

    def __init__(self) -> None:
        self.word, self.left, self.right = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)
        self.bias, self.trans, self.head = 0.0, np.zeros((2, 2)), np.array([-2.0, 0.0, 0.0, 0.0])

    def odds(self, seen: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = self.word[seen[0]].astype(np.float64) + self.bias
        for view in seen[1:]:
            out += self.word[view]
        if len(out) > 1:
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            same = row[1:] == row[:-1]
            out[1:] += np.where(same, self.left[seen[0, :-1]], 0)
            out[:-1] += np.where(same, self.right[seen[0, 1:]], 0)
        return out

    def gradient(self, seen: np.ndarray, first: np.ndarray, want: np.ndarray) -> dict[str, np.ndarray]:
        """Of the log likelihood of the token states ``want`` (0 or 1): what they show less what the field expects, for each weight."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        same, word = row[1:] == row[:-1], seen[0]
        shown = np.bincount(want[:-1][same].astype(int) * 2 + want[1:][same].astype(int), minlength=4).reshape(2, 2).astype(float)
        odds = self.odds(seen, first)
        p, ahead, behind = forward_backward(odds, first, self.trans)
        d = want - p
        # expected transitions from the two messages and the potentials
        a, b = ahead[:-1][same], (odds[1:] + behind[1:])[same]
        logits = np.stack([self.trans[0, 0] + 0 * a, self.trans[0, 1] + b, self.trans[1, 0] + a, self.trans[1, 1] + a + b])
        logits -= logits.max(0)
        q = np.exp(logits)
        joint = (q / q.sum(0)).sum(1).reshape(2, 2)
        return {"word": sum(np.bincount(view, d, SIZE) for view in seen), "left": np.bincount(word[:-1][same], d[1:][same], SIZE), "right": np.bincount(word[1:][same], d[:-1][same], SIZE), "bias": d.sum(), "trans": shown - joint}

    @staticmethod
    def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Features of a document's marginals: 1, chance of any toxic token, log1p of their expected number, density."""
        n = np.diff(first)
        total = np.concatenate([[0.0], np.cumsum(p)])
        clear = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))])
        s, c = total[first[1:]] - total[first[:-1]], clear[first[1:]] - clear[first[:-1]]
        return np.stack([np.ones(len(n)), 1 - np.exp(c), np.log1p(s), np.sqrt(s / np.maximum(n, 1))], 1)

    def scores(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(p, first) @ self.head, -30, 30)))

    @staticmethod
    def fit(texts: pa.Table, rounds: int = 25, rate: float = 0.5, ridge: float = 5e-4) -> Field:
        """Conditional maximum likelihood by AdaGrad on the token labels that row labels and seed words give."""
        f, parts = Field(), []
        for batch in texts.combine_chunks().to_batches():
            y = np.array(batch.column("toxic").to_pylist(), np.int64)
            for lo, hi, buf, offs in text_slices(batch):
                seen, _, _, first = tokens(buf, offs)
                parts.append((seen, first, y[lo:hi]))
        if not parts or not sum(w.shape[1] for w, _, _ in parts):
            return f
        seen = np.concatenate([w for w, _, _ in parts], axis=1)
        sizes = np.concatenate([np.diff(x) for _, x, _ in parts])
        labels = [v for _, _, v in parts]
        del parts
        first, y = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(labels)
        row = np.repeat(np.arange(len(sizes)), sizes)
        bad, good = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
        for view in seen:
            met = np.unique(row * SIZE + view)
            has, of = met % SIZE, y[met // SIZE]
            bad += np.bincount(has[of == 1], minlength=SIZE)
            good += np.bincount(has[of == 0], minlength=SIZE)
        nb, ng = max(1, (y == 1).sum()), max(1, (y == 0).sum())
        ratio = ((bad + 0.5) / (nb - bad + 0.5)) / ((good + 0.5) / (ng - good + 0.5))
        seed = (ratio >= SEED_ODDS) & (bad >= max(SEED_ROWS, SEED_SHARE * nb))
        want = (seed[seen].any(0) & (y[row] == 1)).astype(np.float64)
        if not want.any():
            return f
        g2 = {k: np.full(np.shape(getattr(f, k)), 1e-6) for k in ("word", "left", "right", "bias", "trans")}
        f.bias = -4.0
        for _ in range(rounds):
            for k, g in f.gradient(seen, first, want).items():
                g = g - ridge * np.asarray(getattr(f, k)) * len(y)
                g2[k] = g2[k] + g * g
                step = rate * g / np.sqrt(g2[k])
                setattr(f, k, (getattr(f, k) + step).astype(np.float32) if np.ndim(step) == 1 else getattr(f, k) + step)
        p = marginals(f.odds(seen, first), first, f.trans)
        f.head = learn.logistic(Field.summary(p, first), y.astype(float), ridge=0.1)
        return f


def learn_field(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Field:
    """Learn from rows whose crc32(doc_id) mod 4 is not 2: at most ``rows`` of each class, whole texts.

    The two classes' shares are restored in the document scores by a shift of the intercept.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_mod("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = []
    for k in (0, 1):
        some = docs.select("doc_id", "text").join(F.broadcast(known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)), "doc_id")
        parts.append(some.dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id"))
    f = Field.fit(pa.concat_tables(parts))
    if all(n.get(k) for k in (0, 1)) and all(len(p) for p in parts):
        f.head[0] += np.log(n[1] / n[0]) - np.log(len(parts[1]) / len(parts[0]))
    return f


def tag(docs: DataFrame, field: Field, spans: bool = False) -> DataFrame:
    """Per document: doc_id, score, n_toxic (tokens with marginal 0.5 or more), and with ``spans`` their byte offsets.

    Every token of the whole text takes part. Null and empty texts get the score of a text without
    toxic tokens. Only doc_id and text are read; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Field = held.value
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offs in text_slices(batch, limit=2 << 20):
                seen, starts, ends, first = tokens(buf, offs)
                p = marginals(f.odds(seen, first), first, f.trans)
                size = hi - lo
                hit = p >= 0.5
                row = np.repeat(np.arange(size), np.diff(first))
                cols = [ids.slice(lo, size), pa.array(f.scores(p, first)), pa.array(np.bincount(row[hit], minlength=size).astype(np.int64))]
                if spans:
                    r, a, b = runs(hit.astype(np.int8), first)
                    out = [[] for _ in range(size)]
                    for i, x, y in zip(r.tolist(), a.tolist(), b.tolist(), strict=True):
                        out[i].append({"start": int(starts[x] - offs[i]), "end": int(ends[y - 1] - offs[i])})
                    cols.append(pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "n_toxic", "spans"][: len(cols)])

    schema = "doc_id long, score double, n_toxic long" + ", spans array<struct<start:long,end:long>>" * spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(kernel), schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn on the rows that are not held out, then score all: doc_id, held_out, score, predicted, n_toxic, spans."""
    out = Scratch(docs.sparkSession, "toxicity").save(tag(docs, learn_field(docs, labels), spans=True), "tagged")
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_toxic", "spans")
