"""Language spans: script ranges narrow the candidates, Viterbi over per-word scores labels the words."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import learn
from . import textkernel as tk
from .common import Scratch, crc_mod, lean, text_slices
from .sequence import runs, viterbi

#: Rows that the model is learnt from, whole texts each; languages with fewer rows among them have this many more, if there are.
LEARN_ROWS, LANGUAGE_ROWS = 4000, 20
#: Share of a language's letters from which on it uses a script.
USES = 0.01
#: Share of a document's words from which on its predicted language stands against a given one.
SURE = 0.9
#: Cost of a change of language, in nats.
PENALTY = 15.0
SIZE = 1 << 17

# First and last code point of the scripts told apart.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)],
}


@lru_cache(1)
def script_table() -> np.ndarray:
    """Per code point: 0 no letter, 1 a letter of another script, 2.. the scripts in order."""
    out = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), np.uint8, 0x110000)
    for i, spans in enumerate(SCRIPTS.values()):
        for a, b in spans:
            out[a : b + 1] = np.where(out[a : b + 1] > 0, i + 2, 0)
    return out


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of each character's first byte, its code point) of valid UTF-8."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at].astype(np.int32)
    cp = lead.copy()
    pad = np.concatenate([buf, np.zeros(3, np.uint8)])
    two = lead >= 0xC0
    if two.any():
        i, b = at[two], lead[two]
        n1, n2, n3 = (pad[i + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
        cp[two] = np.where(b < 0xE0, (b & 0x1F) << 6 | n1, np.where(b < 0xF0, (b & 0x0F) << 12 | n1 << 6 | n2, (b & 7) << 18 | n1 << 12 | n2 << 6 | n3))
    return at, np.minimum(cp, 0x10FFFF)


def _grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the lower-cased three bytes about each byte, and whether the byte is in a word.

    Bytes outside words, and beyond a text's ends, count as a space.
    """
    gap = tk.SPACES[buf]
    low = np.where(gap, np.uint8(32), tk.LOWER[buf]).astype(np.uint32)
    prev, nxt = np.full(len(buf), 32, np.uint32), np.full(len(buf), 32, np.uint32)
    prev[1:], nxt[:-1] = low[:-1], low[1:]
    inner = offs[:-1][np.diff(offs) > 0]
    prev[inner] = 32
    nxt[inner[inner > 0] - 1] = 32
    code = prev << np.uint32(16) | low << np.uint32(8) | nxt
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 17), ~gap


class Model:
    """Gram scores per language, scripts that languages use, and what makes a language a mixed document's own.

    ``known``: scripts that any known language uses. ``frame``: weights of a language's share of the bytes, of opening and of closing the document.
    """

    def __init__(self, langs: list[str], table: np.ndarray, uses: np.ndarray):
        self.langs, self.table, self.uses, self.frame = langs, table, uses, np.array([1.0, 0.0, 0.0])
        self.known = uses.any(0)

    @staticmethod
    def fit(texts: pa.Table) -> Model:
        """Gram log probabilities for each language (add one half), centred over the languages."""
        langs = sorted(set(texts["lang"].to_pylist())) or ["und"]
        number = {x: i for i, x in enumerate(langs)}
        counts, letters = np.zeros((SIZE, len(langs))), np.zeros((len(langs), len(SCRIPTS) + 2))
        for batch in texts.combine_chunks().to_batches():
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi, buf, offs in text_slices(batch):
                if not len(buf):
                    continue
                gram, inside = _grams(buf, offs)
                row = np.repeat(np.arange(hi - lo), np.diff(offs))
                at, cp = code_points(buf)
                kind = script_table()[cp]
                for k in range(len(langs)):
                    mine = own[lo:hi][row] == k
                    counts[:, k] += np.bincount(gram[inside & mine], minlength=SIZE)
                    letters[k] += np.bincount(kind[mine[at]], minlength=letters.shape[1])
        logp = np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * SIZE)
        letters[:, 0] = 0
        uses = letters >= USES * np.maximum(letters.sum(1, keepdims=True), 1)
        m = Model(langs, np.ascontiguousarray((logp - logp.mean(1, keepdims=True)).astype(np.float32)), uses)
        better = []
        for batch in texts.combine_chunks().to_batches():
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi, buf, offs in text_slices(batch):
                shown, _ = m.document_views(*m.label(buf, offs, PENALTY)[:4])
                mine = shown[np.arange(hi - lo), own[lo:hi]]
                mixed = (shown[:, :, 0] > 0).sum(1) > 1
                for k in range(len(langs)):
                    better.append((mine - shown[:, k])[mixed & (own[lo:hi] != k) & (shown[:, k, 0] > 0)])
        better = np.concatenate(better) if better else np.zeros((0, 3))
        if len(better):
            m.frame = np.maximum(learn.logistic(better, np.ones(len(better)), ridge=0.5), 0)
            m.frame /= m.frame.sum() or 1.0
        return m

    def document_views(self, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, languages, 3): share of the labelled bytes, opens, closes; and the labelled bytes of each row."""
        size, k = len(first) - 1, len(self.langs)
        row = np.repeat(np.arange(size), np.diff(first))
        ok = np.flatnonzero(best >= 0)
        cover = np.bincount(row[ok] * k + best[ok], (ends - starts)[ok], size * k).reshape(size, k)
        total = cover.sum(1)
        out = np.zeros((size, k, 3))
        out[:, :, 0] = cover / np.maximum(total, 1)[:, None]
        if not len(ok):
            return out, total
        rows, at = np.unique(row[ok], return_index=True)
        out[rows, best[ok[at]], 1] = 1
        last = np.append(at[1:], len(ok)) - 1
        out[rows, best[ok[last]], 2] = 1
        return out, total

    def label(self, buf: np.ndarray, offs: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first word of each row, language of each word or -1 without a letter, foreign letters).

        The last: each row's share of letters whose script no known language uses.
        """
        starts, ends, first = tk.word_spans(buf, offs)
        if not len(starts):
            return starts, ends, first, np.zeros(0, np.int64), np.zeros(len(offs) - 1)
        gram, _ = _grams(buf, offs)
        sums = np.zeros((len(buf) + 1, len(self.langs)))
        for k in range(len(self.langs)):
            np.cumsum(self.table[gram, k], out=sums[1:, k], dtype=np.float64)
        scores = sums[ends] - sums[starts]
        at, cp = code_points(buf)
        kind = script_table()[cp]
        is_letter = np.zeros(len(buf) + 1, np.int64)
        is_letter[at + 1] = kind > 0
        is_letter = np.cumsum(is_letter)
        may = np.ones(scores.shape, bool)
        for s in range(1, len(SCRIPTS) + 2):
            # words that hold a letter of a script are left to the languages that use it
            if not self.uses[:, s].all() and (hit := at[kind == s]).size:
                word = np.searchsorted(starts, hit, "right") - 1
                may[np.ix_(np.unique(word[word >= 0]), np.flatnonzero(~self.uses[:, s]))] = False
        # a word that this leaves to none says nothing: its neighbours decide
        none = ~may.any(1)
        scores[none], may[none] = 0.0, True
        scores[~may] = -np.inf
        best = viterbi(scores, first, penalty)
        best[is_letter[ends] == is_letter[starts]] = -1
        foreign = np.zeros(len(buf) + 1, np.int64)
        foreign[at + 1] = ~(self.known[kind] | (kind == 0))
        foreign = np.cumsum(foreign)
        all_, odd = (c[offs[1:]] - c[offs[:-1]] for c in (is_letter, foreign))
        return starts, ends, first, best, odd / np.maximum(all_, 1)


def learn_model(docs: DataFrame, rows: int = LEARN_ROWS, held_out: bool = True) -> Model:
    """Learn from text and non-null lang, by hash of doc_id; every language has rows in the sample.

    ``held_out``: the held-out quarter is left out. Without it, only languages that are rare in the sample take rows from there.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    learnt = known.where(crc_mod("doc_id", 4) != 2)
    common = learn.sample(learnt, ["text", "lang"], rows)
    counts = Counter(common["lang"].to_pylist())
    enough = [x for x, n in counts.items() if n >= LANGUAGE_ROWS]
    rare = (learnt if held_out else known).where(~F.col("lang").isin(enough)) if enough else learnt if held_out else known
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rare.select("lang", "doc_id").distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= LANGUAGE_ROWS).select("doc_id").distinct()
    more = rare.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "lang").dropDuplicates(["doc_id", "lang"]).toArrow()
    seen = pa.chunked_array([common["doc_id"].combine_chunks()])
    more = more.filter(pc.invert(pc.is_in(more["doc_id"], value_set=seen.combine_chunks())))
    return Model.fit(pa.concat_tables([common, more.cast(common.schema)]).sort_by([("doc_id", "ascending"), ("lang", "ascending")]))


def scripts_in_use(docs: DataFrame) -> np.ndarray:
    """Which kinds of ``script_table`` any language writes, by all rows with a lang; all False without such rows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(SCRIPTS) + 2
        for batch in batches:
            langs, number = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
            letters = np.zeros((len(langs), width), np.int64)
            for lo, hi, buf, offs in text_slices(batch):
                if len(buf):
                    at, cp = code_points(buf)
                    row = np.searchsorted(offs, at, "right") - 1
                    letters += np.bincount(number[lo:hi][row] * width + script_table()[cp], minlength=letters.size).reshape(letters.shape)
            yield pa.RecordBatch.from_arrays([pa.array(langs.repeat(width), pa.string()), pa.array(np.tile(np.arange(width, dtype=np.int32), len(langs))), pa.array(letters.ravel())], ["lang", "kind", "n"])

    rows = docs.where("lang IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(lean(kernel), "lang string, kind int, n long").where("kind > 0").groupBy("lang", "kind").agg(F.sum("n").alias("n"))
    share = F.col("n") >= USES * F.sum("n").over(Window.partitionBy("lang"))
    out = np.zeros(len(SCRIPTS) + 2, bool)
    out[[r["kind"] for r in sums.where("n > 0").withColumn("_used", share).where("_used").select("kind").distinct().collect()]] = True
    return out


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """Per document: doc_id, lang_pred, score, n_langs, and with ``spans`` (start, end, lang) by byte.

    lang_pred is chosen among the languages of the spans by share of the bytes, opening and closing the
    document, as weighed on the learnt rows (ties: first by name); score is its share of the bytes of
    words with a letter. Null, empty and letterless texts are ``und`` with score 0.
    Only doc_id and text are read. An empty table gives no rows; a model without rows says ``und``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offs in text_slices(batch):
                starts, ends, first, best, _ = m.label(buf, offs, penalty)
                size = hi - lo
                shown, total = m.document_views(starts, ends, first, best)
                strength = np.where(shown[:, :, 0] > 0, shown @ m.frame, -1)
                top = np.where(total > 0, strength.argmax(1), len(m.langs))
                score = np.where(total > 0, shown[np.arange(size), np.minimum(top, len(m.langs) - 1), 0], 0.0)
                cols = [ids.slice(lo, size), pa.array(names[top], pa.string()), pa.array(score), pa.array((shown[:, :, 0] > 0).sum(1).astype(np.int32))]
                if spans:
                    r, a, b = runs(best + 1, first)
                    out = [[] for _ in range(size)]
                    for i, x, y in zip(r.tolist(), a.tolist(), b.tolist(), strict=True):
                        out[i].append({"start": int(starts[x] - offs[i]), "end": int(ends[y - 1] - offs[i]), "lang": m.langs[best[x]]})
                    cols.append(pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "n_langs", "spans"][: len(cols)])

    schema = "doc_id long, lang_pred string, score double, n_langs int" + ", spans array<struct<start:long,end:long,lang:string>>" * spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(kernel), schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn on the documents that are not held out, then predict all: doc_id, held_out, lang_pred, score, n_langs."""
    out = Scratch(docs.sparkSession, "languages").save(identify(docs, learn_model(docs)), "identified")
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "n_langs")


def keep_known_languages(docs: DataFrame, model: Model, penalty: float = PENALTY, sure: float = SURE) -> DataFrame:
    """``docs`` (all columns) without those rejected; ``lang`` is the identified language.

    Rejected: null, empty and letterless texts, and texts without a lang most of whose letters are of scripts that no
    language of ``docs`` or of the model uses; if none uses any, no text goes by its script. A null lang is filled in with the prediction; a lang is
    replaced by it where the predicted language has a share of at least ``sure``. Two passes over the rows,
    the first for the scripts of the labelled ones; only its sums are shuffled.
    """
    model = copy(model)
    model.known = model.known | scripts_in_use(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        names = np.array(m.langs, object)
        for batch in batches:
            at = batch.schema.get_field_index("lang")
            for lo, hi, buf, offs in text_slices(batch):
                starts, ends, first, best, foreign = m.label(buf, offs, penalty)
                shown, total = m.document_views(starts, ends, first, best)
                top = np.where(shown[:, :, 0] > 0, shown @ m.frame, -1).argmax(1)
                share = shown[np.arange(hi - lo), top, 0]
                part = batch.slice(lo, hi - lo)
                lang = part.column(at)
                given = pc.is_valid(lang).to_numpy(zero_copy_only=False)
                clear = (foreign <= 0.5) | (not m.known.any()) | given
                learnt = m.langs != ["und"]
                part = part.set_column(at, batch.schema.field(at), pc.if_else(pa.array((share >= sure) & learnt | ~given), pa.array(names[top], lang.type), lang))
                yield part.filter(pa.array((total > 0) & clear))

    return Scratch(docs.sparkSession, "languages").save(docs.mapInArrow(lean(kernel), docs.schema), "kept")
