"""Document quality by Bradley-Terry ranking: logistic loss on feature differences of preference pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learn
from . import textkernel as tk
from .common import Scratch, crc_mod, lean, text_slices

#: Labelled rows of each class that the ranking is learnt from at most, and preference pairs of one document.
LEARN_ROWS, PAIRS_EACH = 2000, 20
#: Share of the documents that the quantile threshold lets go.
DROP_SHARE = 0.25

_UPPER, _LOWERC, _DIGIT, _PUNCT, _SYMBOL, _HIGH = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = _LOWERC[97:123] = _DIGIT[48:58] = _HIGH[128:] = True
_PUNCT[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = True
_SYMBOL[33:127] = ~(_UPPER | _LOWERC | _DIGIT | _PUNCT)[33:127]
NAMES = ["one", "log_words", "word_bytes", "long_words", "short_words", "upper", "digit", "punct", "symbol", "high", "bang", "bar", "odd_end", "caps_words", "new_words", "new_triples", "line_words", "new_lines", "lone_lines", "end_stops", "inner_caps", "tags"]


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Shape and repetition measures of whole texts, one row each; an empty text has zeros and the constant."""
    rows = len(offs) - 1
    out = np.zeros((rows, len(NAMES)))
    out[:, 0] = 1
    if not len(buf):
        return out
    with np.errstate(over="ignore"):
        words, starts, ends, first = tk.word_hashes(buf, offs)
        triples, bounds = tk.shingle_hashes(words, first, 3)
    size = np.maximum(np.diff(offs), 1)
    n = np.diff(first)
    n1 = np.maximum(n, 1)

    def by_byte(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag)])
        return c[offs[1:]] - c[offs[:-1]]

    def by_word(value: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(value)])
        return c[first[1:]] - c[first[:-1]]

    long = ends - starts
    upper = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    caps = upper[ends] - upper[starts]
    last = buf[np.maximum(ends - 1, 0)]
    letters = np.concatenate([[0], np.cumsum(_UPPER[buf] | _LOWERC[buf] | _HIGH[buf])])
    lone = letters[ends] == letters[starts]
    out[:, 1] = np.log1p(n)
    out[:, 2] = by_word(long) / n1
    out[:, 3], out[:, 4] = by_word(long > 12) / n1, by_word(long < 4) / n1
    for k, t in ((5, _UPPER), (6, _DIGIT), (7, _PUNCT), (8, _SYMBOL), (9, _HIGH)):
        out[:, k] = np.sqrt(by_byte(t[buf]) / size)
    out[:, 10] = np.sqrt(by_byte(buf == 33) / n1)
    out[:, 11] = np.sqrt(by_word(lone) / n1)
    out[:, 12] = np.sqrt(by_word(_SYMBOL[last]) / n1)
    out[:, 13] = by_word((caps >= 2) & (caps * 2 >= long)) / n1
    breaks = buf == 10
    lines = by_byte(breaks) + 1
    out[:, 16] = np.log1p(n / lines)
    out[:, 19] = by_word((last == 46) | (last == 63) | (last == 33)) / n1
    out[:, 20] = by_word((caps >= 1) & ~_UPPER[buf[starts]] if len(starts) else np.zeros(0)) / n1
    out[:, 21] = np.sqrt(by_byte((buf == 60) | (buf == 62) | (buf == 123) | (buf == 125)) / size)
    prefix = tk.prefix_hash(buf)
    cut = np.flatnonzero(breaks)
    for i in np.flatnonzero(n):
        w = words[first[i] : first[i + 1]]
        out[i, 14] = len(np.unique(w)) / len(w)
        t = triples[bounds[i] : bounds[i + 1]]
        out[i, 15] = len(np.unique(t)) / len(t)
        c = cut[np.searchsorted(cut, offs[i]) : np.searchsorted(cut, offs[i + 1])]
        a, b = np.concatenate([[offs[i]], c + 1]), np.concatenate([c, [offs[i + 1]]])
        with np.errstate(over="ignore"):
            h = tk.span_hash(prefix, a, b)
        out[i, 17] = len(np.unique(h)) / len(h)
        out[i, 18] = (b - a < 20).mean()
    return out


class Ranking:
    """A linear strength per document: strength = (features - mean) / scale . weights; score = sigmoid(a strength + b)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, curve: tuple[float, float]):
        self.mean, self.scale, self.weights, self.curve = mean, scale, weights, curve

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z / 3], 1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.strength(x) + b, -30, 30)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Ranking:
        """Each label-1 row is preferred to PAIRS_EACH label-0 rows; the pairs' logistic loss gives the weights.

        The strength's curve is then fitted to the labels, so that scores are shares of label 1.
        With one class only, or no rows, every score is that class's share.
        """
        mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
        r = Ranking(mean, scale, np.zeros(2 * len(NAMES)), (0.0, 0.0))
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            r.curve = (0.0, float(np.log((len(good) + 0.5) / (len(bad) + 0.5))))
            return r
        rng = np.random.default_rng(11)
        won = np.repeat(good, PAIRS_EACH)
        lost = rng.choice(bad, len(won))
        z = r.basis(x)
        r.weights = learn.logistic(z[won] - z[lost], np.ones(len(won)), ridge=ridge * PAIRS_EACH)
        s = r.strength(x)
        at, width = s.mean(), s.std() + 1e-9
        a, b = learn.logistic(np.stack([(s - at) / width, np.ones(len(s))], 1), y.astype(float), ridge=1e-2)
        r.curve = (float(a / width), float(b - a * at / width))
        return r


def _text_features(docs: DataFrame) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch):
                x = features(buf, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(kernel), "doc_id long, x array<double>")


def learn_ranking(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Ranking:
    """Learn from rows whose crc32(doc_id) mod 5 is not 0, at most ``rows`` of each class; features of whole texts."""
    known = labels.where(F.col("quality").isin(0, 1) & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    xs, ys = [], []
    for k in (0, 1):
        ids = known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")
        got = _text_features(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")).dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
        xs.append(np.array(got["x"].to_pylist(), float).reshape(len(got), len(NAMES)))
        ys.append(np.full(len(got), k))
    r = Ranking.fit(np.concatenate(xs), np.concatenate(ys))
    if all(n.get(k) for k in (0, 1)) and all(len(v) for v in ys):
        a, b = r.curve
        r.curve = (a, b + float(np.log(n[1] / n[0]) - np.log(len(ys[1]) / len(ys[0]))))
    return r


def rank(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """Per document: doc_id, strength, score. Null and empty texts are ranked by their (zero) features.

    Only doc_id and text are read; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranking)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch):
                x = features(buf, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(held.value.strength(x)), pa.array(held.value.scores(x))], ["doc_id", "strength", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(kernel), "doc_id long, strength double, score double")


def keep_above_quantile(ranked: DataFrame, share: float = DROP_SHARE) -> DataFrame:
    """``ranked`` (a table that is there to be read twice) with ``kept``: whether the score reaches the quantile below which ``share`` of the rows lie.

    The cut is one number, from a quantile sketch (relative rank error 1e-4); ties with it stay. No rows give none.
    """
    cut = ranked.agg(F.percentile_approx("score", F.lit(share), 10000)).first()[0]
    return ranked.withColumn("kept", F.col("score") >= F.lit(cut).cast("double"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, share: float = DROP_SHARE) -> DataFrame:
    """Learn on the rows that are not held out, then score all: doc_id, held_out, score, predicted, strength, kept.

    ``kept``: the score reaches the quantile of all scores below which ``share`` of them lie.
    """
    ranked = Scratch(docs.sparkSession, "quality").save(rank(docs, learn_ranking(docs, labels)), "ranked")
    out = keep_above_quantile(ranked, share)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "strength", "kept")
