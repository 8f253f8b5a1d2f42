"""Piece encoding and decoding: a max-plus scan over chunk transfer matrices, backtraced chunk by chunk.

The vocabulary's merges rank pieces by score. A sequence of pieces is the encoding of its text exactly
when every two neighbours, joined and encoded, come out as these two pieces. So encoding is a path
problem: nodes are piece ends, a step is allowed (weight: the piece's score) or not (minus infinity),
and the best path by max-plus algebra, the only one with finite weight, is the encoding.

* Pieces never reach over a unit break (a run of spaces after other text, or a character that no piece
  holds), so whole units are solved once and remembered.
* A text over ``CHUNK`` characters is cut at fixed offsets. The state at a cut is the piece that covers
  or ends at it. Each chunk gives a matrix from its left states to its right states; matrices combine
  associatively; given the states at its two cuts, each chunk finds its own pieces alone.
"""

from __future__ import annotations

import itertools
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_TABLES, Scratch, free_worker_tables, lean

#: Where the public vocabulary file lies, unless given.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of one chunk; longer texts are cut.
CHUNK = 32_768
#: Chunks whose pieces are found and sent on at once.
CHUNKS_AT_ONCE = 16
#: Units, their characters, and neighbour tests, that a worker remembers before it starts anew.
MEMORY, MEMORY_CHARS, TESTS = 1 << 18, 1 << 23, 1 << 18
SPACE = "▁"
_HASH_BASE = 0x9E3779B97F4A7C15 | 1
NO_PATH = -math.inf


def _proto(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of one protocol-buffer message."""

    def number(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[i]
            i, out, shift = i + 1, out | (b & 127) << shift, shift + 7
            if b < 128:
                return out, i

    i = 0
    while i < len(data):
        key, i = number(i)
        kind = key & 7
        if kind == 0:
            value, i = number(i)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, i = number(i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


@dataclass
class Vocabulary:
    """Pieces with ids and scores, byte ids, and the solver's memory of units and neighbour tests."""

    ids: dict[str, int]
    scores: dict[str, float]
    pieces: list[str]
    byte_ids: list[int]
    unk: int
    units: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)
    fits: dict[int, bool] = field(default_factory=dict, repr=False)

    @staticmethod
    def load(path: str = MODEL_PATH) -> Vocabulary:
        """Read a model file. Identity normalisation with a leading space and byte fallback is what is supported."""
        pieces, scores, kinds, rules = [], [], [], {}
        for number, value in _proto(Path(path).read_bytes()):
            if number == 1:
                entry = dict(_proto(value))
                pieces.append(entry[1].decode())
                scores.append(float(np.frombuffer(entry.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(entry.get(3, 1))
            elif number == 3:
                rules = dict(_proto(value))
            elif number == 2 and dict(_proto(value)).get(3) != 2:
                raise ValueError("the model does not rank merges")
        if rules.get(2) or rules.get(4, 1) or not rules.get(3, 1) or 4 in kinds:
            raise ValueError("only identity normalisation with a leading space and no user-defined pieces is supported")
        ids = {p: i for i, p in enumerate(pieces) if kinds[i] == 1}
        by_byte = {p: i for i, p in enumerate(pieces) if kinds[i] == 6}
        if len(by_byte) != 256:
            raise ValueError("the model has no byte fallback")
        return Vocabulary(ids, {p: scores[i] for p, i in ids.items()}, pieces, [by_byte[f"<0x{b:02X}>"] for b in range(256)], kinds.index(2))

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.ids), default=1)
        self.alphabet = {c for p in self.ids for c in p}
        mark = r"\x00-/:-@\[-`{-\x7f"
        # a unit ends where an ASCII mark follows a character after which no piece goes on with one
        odd = "".join(sorted({re.escape(c) for p in self.ids for c in re.findall(f"([^{mark}{SPACE}])[{mark}]", p)}))
        body = f"(?:[^{mark}{SPACE}{odd}]+|[{odd}][{mark}]*)+" if odd else f"[^{mark}{SPACE}]+"
        self.pattern = f"{SPACE}*[{mark}]*{body}|{SPACE}*[{mark}]+|{SPACE}+"

        self.single = all(c in self.ids for c in self.alphabet)
        self.root = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"units": {}, "fits": {}, "root": None}

    def trie(self) -> dict:
        """Pieces by character; a piece's id lies under the empty string."""
        if self.root is None:
            self.root = {}
            for p, i in self.ids.items():
                node = self.root
                for c in p:
                    node = node.setdefault(c, {})
                node[""] = i
        return self.root

    # neighbours

    def merged(self, text: str) -> list[str]:
        """Encode a short text by its definition: join the best-scored neighbours, leftmost of equals first."""
        parts = list(text)
        while True:
            best, at = NO_PATH, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fit(self, a: str, b: str) -> bool:
        """Whether pieces a and b may stand side by side; with an empty a, whether b alone encodes as itself."""
        key = (self.ids.get(a, -1) + 1) * 65536 + self.ids.get(b, -1)
        if (a and a not in self.ids) or b not in self.ids:
            return self.merged(a + b) == ([a, b] if a else [b])
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > TESTS:
                self.fits.clear()
            got = self.fits[key] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def whole(self, piece: str) -> bool:
        """Whether a piece alone encodes as itself."""
        return self.fit("", piece)

    def weight(self, piece: str) -> float:
        return self.scores.get(piece, 0.0)

    # paths inside a unit

    def reach(self, text: str, start: int, before: str, end: int) -> dict[int, tuple[str, int]]:
        """From ``start``, after piece ``before`` ("" after a break): per reachable position up to ``end``, the piece that ends there and its start."""
        last: dict[int, tuple[str, int]] = {start: (before, -1)}
        root = self.trie()
        for q in range(start, end):
            if q not in last:
                continue
            node = root
            for p in range(q + 1, end + 1):
                node = node.get(text[p - 1]) if node is not None else None
                if node is None and p > q + 1:
                    break
                piece = text[q:p]
                if p not in last and (p == q + 1 or "" in node) and self.fit(last[q][0], piece):
                    last[p] = (piece, q)
        return last

    def solve(self, text: str) -> list[str]:
        """Pieces of a text without a break inside."""
        if self.single and self.alphabet.issuperset(text):
            return [self.pieces[i] for i in self.solve_ids(text)]
        return self.trace(self.reach(text, 0, "", len(text)), len(text))

    def solve_ids(self, text: str) -> list[int]:
        """Their ids, walked in the trie; for texts whose characters all are pieces.

        Depth first, the longest piece first. A position that was reached needs no second visit: what leads to it is
        the encoding of the text before it, and there is only one.
        """
        n, fits, root, pieces, longest = len(text), self.fits, self.trie(), self.pieces, self.longest
        seen = bytearray(n + 1)
        out, back = [], []
        q = base = 0
        while q < n:
            node, found = root, []
            for p, c in enumerate(text[q : q + longest], q + 1):
                node = node.get(c)
                if node is None:
                    break
                at = node.get("")
                if at is not None and not seen[p]:
                    found.append((at, p))
            while True:
                while found:
                    at, p = found.pop()
                    ok = fits.get(base + at)
                    if ok is None:
                        ok = self.fit(pieces[out[-1]] if out else "", pieces[at])
                    if ok and not seen[p]:
                        break
                else:  # a dead end
                    found, q = back.pop()
                    out.pop()
                    base = (out[-1] + 1) * 65536 if out else 0
                    continue
                break
            seen[p] = 1
            back.append((found, q))
            out.append(at)
            q, base = p, (at + 1) * 65536
        return out

    @staticmethod
    def trace(last: dict[int, tuple[str, int]], end: int) -> list[str]:
        out = []
        while last[end][1] >= 0:
            out.append(last[end][0])
            end = last[end][1]
        return out[::-1]

    def unit(self, text: str) -> tuple[str, ...]:
        """Pieces of a text between two breaks."""
        got = self.units.get(text)
        if got is None:
            if len(self.units) > MEMORY // 8:
                self.units.clear()
            got = self.units[text] = tuple(self.solve(text))
        return got

    def breaks(self, text: str) -> list[int]:
        """Positions that no piece reaches over: before spaces after other text, and about unknown characters."""
        out = [m.start() + 1 for m in re.finditer(f"[^{SPACE}]{SPACE}", text)]
        if odd := {c for c in set(text) if c not in self.alphabet}:
            for i, c in enumerate(text):
                if c in odd:
                    out += [i, i + 1]
            out = sorted(set(out))
        return out

    # states at cuts and chunks between them

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that cover or end at ``cut``; [(cut, cut)] alone where a break is."""
        lo, hi = max(0, cut - self.longest - 1), min(len(text), cut + self.longest + 1)
        if cut in (0, len(text)) or cut - lo in self.breaks(text[lo:hi]):
            return [(cut, cut)]
        out = []
        for a in range(max(0, cut - self.longest), cut):
            for b in range(cut, min(len(text), a + self.longest) + 1):
                if b - a == 1 or (text[a:b] in self.ids and self.whole(text[a:b])):
                    out.append((a, b))
        return out

    def chunk(self, text: str, lo: int, hi: int) -> Chunk:
        return Chunk(self, text, lo, hi)

    def encode_pieces(self, text: str) -> list[str]:
        """All pieces of an escaped text, without cuts."""
        at = [0, *[b for b in self.breaks(text) if 0 < b < len(text)], len(text)]
        return [p for a, b in itertools.pairwise(at) for p in self.unit(text[a:b])] if text else []

    def to_ids(self, pieces: list[str] | tuple[str, ...]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte_ids[b] for b in p.encode()]
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.to_ids(self.encode_pieces(escape(text)))

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids: pieces joined, spaces restored, the leading one dropped; broken bytes become U+FFFD."""
        byte = {i: b for b, i in enumerate(self.byte_ids)}
        raw = b"".join(bytes([byte[i]]) if i in byte else self.pieces[i].replace(SPACE, " ").encode() for i in ids)
        return raw.decode("utf-8", "replace").removeprefix(" ")


class Chunk:
    """The part of a text from ``lo`` to ``hi``; a piece belongs to the chunk that it starts in."""

    def __init__(self, v: Vocabulary, text: str, lo: int, hi: int):
        self.v, self.text, self.lo, self.hi = v, text, lo, hi
        self.entry, self.exit = v.states(text, lo), v.states(text, hi)
        # the first and the last break of the chunk, looked for in growing windows from its ends
        self.inner = sorted({b for b in (self._edge(True), self._edge(False)) if b is not None})

    def _edge(self, first: bool) -> int | None:
        """The chunk's first or last break: the text's own start and end count as breaks."""
        lo, hi = self.lo, self.hi
        if (first and lo == 0) or (not first and hi == len(self.text)):
            return lo if first else hi
        width = 64
        while True:
            a, b = (lo, min(hi, lo + width)) if first else (max(lo, hi - width), hi)
            off = max(0, a - 1)
            found = [x + off for x in self.v.breaks(self.text[off : b + 1]) if a <= x + off <= b]
            found += [0] * (a == 0) + [b] * (b == len(self.text))
            if found or (a, b) == (lo, hi):
                return (min(found) if first else max(found)) if found else None
            width *= 4

    def middle(self) -> list[str]:
        """Pieces between the first and the last break."""
        return self.v.encode_pieces(self.text[self.inner[0] : self.inner[-1]])

    def _last(self, state: tuple[int, int]) -> tuple[int, str]:
        return state[1], self.text[state[0] : state[1]]

    def _to_exit(self, last: dict[int, tuple[str, int]], state: tuple[int, int]) -> list[str] | None:
        a, b = state
        if a == b:
            return self.v.trace(last, a) if a in last else None
        if a < self.lo:  # one piece covers the whole chunk
            return [] if last.get(b, ("", 0))[1] == -1 and last[b][0] == self.text[a:b] else None
        if a not in last:
            return None
        prev, piece = last[a][0], self.text[a:b]
        if self.v.fit(prev, piece):
            return [*self.v.trace(last, a), piece]
        return None

    def path(self, i: int, j: int) -> list[str] | None:
        """Pieces from entry state i to exit state j, or None."""
        found = self.parts(i, j)
        return None if found is None else [*found[0], *self.middle(), *found[1]] if self.inner else found[0]

    def parts(self, i: int, j: int) -> tuple[list[str], list[str]] | None:
        """Pieces before the first break and after the last one."""
        start, before = self._last(self.entry[i])
        if not self.inner:
            all_ = self._to_exit(self.v.reach(self.text, start, before, self.hi), self.exit[j])
            return None if all_ is None else (all_, [])
        head: list[str] = []
        if self.inner[0] > self.lo:
            last = self.v.reach(self.text, start, before, self.inner[0])
            if self.inner[0] not in last:
                return None
            head = self.v.trace(last, self.inner[0])
        end = self.inner[-1]
        if end == self.hi:
            return head, []
        tail = self._to_exit(self.v.reach(self.text, end, "", self.hi), self.exit[j])
        return None if tail is None else (head, tail)

    def matrix(self) -> np.ndarray:
        """Best weight from each entry state to each exit state. A break inside makes it an outer sum of head and tail.

        What lies between the first and the last break is the same for all pairs of states; its weight is left out.
        """
        out = np.full((len(self.entry), len(self.exit)), NO_PATH)
        total = lambda pieces: sum(map(self.v.weight, pieces))
        if not self.inner:
            for i, s in enumerate(self.entry):
                start, before = self._last(s)
                last = self.v.reach(self.text, start, before, self.hi)
                for j, t in enumerate(self.exit):
                    if (p := self._to_exit(last, t)) is not None:
                        out[i, j] = total(p)
            return out
        head = np.zeros(len(self.entry))
        if self.inner[0] > self.lo:
            for i, s in enumerate(self.entry):
                start, before = self._last(s)
                last = self.v.reach(self.text, start, before, self.inner[0])
                head[i] = total(self.v.trace(last, self.inner[0])) if self.inner[0] in last else NO_PATH
        tail = np.zeros(len(self.exit))
        if self.inner[-1] < self.hi:
            last = self.v.reach(self.text, self.inner[-1], "", self.hi)
            for j, t in enumerate(self.exit):
                p = self._to_exit(last, t)
                tail[j] = NO_PATH if p is None else total(p)
        return head[:, None] + tail[None, :]


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a x b)[i, j] = max over k of a[i, k] + b[k, j]: associative."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """State index at each of the len + 1 cuts on the best path, by tree scan of prefixes and suffixes."""
    n = len(matrices)

    def scan(items: list, op) -> list:
        """Inclusive prefix products, pairs first: log depth."""
        if len(items) == 1:
            return items
        halves = scan([op(items[i], items[i + 1]) for i in range(0, len(items) - 1, 2)], op)
        out = [items[0]]
        for i in range(1, len(items)):
            out.append(halves[i // 2] if i % 2 else op(halves[i // 2 - 1], items[i]))
        return out

    ahead = scan(matrices, maxplus)
    behind = scan(matrices[::-1], lambda a, b: maxplus(b, a))[::-1]
    out = [0]
    for k in range(1, n):
        out.append(int((ahead[k - 1].max(0) + behind[k].max(1)).argmax()))
    return [*out, 0]


def escape(text: str | None) -> str:
    """Spaces as the vocabulary writes them, one more in front; an empty or null text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def ids_hash(ids: np.ndarray) -> int:
    """Order-sensitive hash: sum of (id + 1) * base**position modulo 2**64; parts combine by their lengths."""
    with np.errstate(over="ignore"):
        return int(((ids.astype(np.uint64) + np.uint64(1)) * powers(len(ids))[: len(ids)]).sum(dtype=np.uint64)) if len(ids) else 0


_POW = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) <= n:
        with np.errstate(over="ignore"):
            _POW = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(1 << max(16, n.bit_length()), _HASH_BASE, np.uint64)]))
    return _POW


class UnitTable:
    """Numbers the distinct units met, with token counts and hashes, for whole-array work on documents."""

    def __init__(self, v: Vocabulary, keep_ids: bool = False):
        self.v, self.split, self.keep_ids = v, re.compile(v.pattern), keep_ids
        self.byte = {i: b for b, i in enumerate(v.byte_ids)}
        self.base = [pow(_HASH_BASE, k, 1 << 64) for k in range(4 * 64)]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.met = np.zeros(0, np.int64)
        self.count, self.hash, self.fallback, self.same, self.flat = array("I"), array("Q"), array("I"), array("B"), array("i")

    def add(self, unit: str) -> int:
        """Encode a new unit, and decode it again to see that its text comes back."""
        v = self.v
        fallback = 0
        if v.single and v.alphabet.issuperset(unit):
            ids = v.solve_ids(unit)
            back = "".join([v.pieces[i] for i in ids])
        else:
            ids = v.to_ids(v.encode_pieces(unit))
            fallback = sum(i in self.byte for i in ids)
            back = b"".join(bytes([self.byte[i]]) if i in self.byte else v.pieces[i].encode() for i in ids).decode("utf-8", "replace")
        if self.keep_ids:
            self.flat.extend(ids)
        base = self.base if len(ids) <= len(self.base) else [pow(_HASH_BASE, k, 1 << 64) for k in range(len(ids))]
        self.count.append(len(ids))
        self.hash.append(sum([(i + 1) * b for i, b in zip(ids, base, strict=False)]) % (1 << 64))
        self.fallback.append(fallback)
        self.same.append(back == unit)
        self.number[unit] = len(self.count) - 1
        self.chars += len(unit)
        return len(self.count) - 1

    def free(self) -> None:
        """Let go what the worker's vocabulary has gathered too."""
        self.clear()
        self.v.root = None
        self.v.fits.clear()
        self.v.units.clear()

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Views; they must be gone before a unit is added."""
        return np.frombuffer(self.count, np.uint32), np.frombuffer(self.hash, np.uint64), np.frombuffer(self.fallback, np.uint32), np.frombuffer(self.same, np.uint8)

    def forget(self) -> None:
        """Keep the units that were met most, at most half of them."""
        least = int(np.partition(self.met, -(len(self.met) // 2))[-(len(self.met) // 2)])
        keep = np.flatnonzero(self.met > max(1, least))
        flat = self.ids_of(keep) if self.keep_ids else ()
        old = [np.array(x)[keep] for x in self.arrays()]
        place = dict(zip(keep.tolist(), range(len(keep)), strict=True))
        number = {u: place[k] for u, k in self.number.items() if k in place}
        self.clear()
        self.number, self.chars = number, sum(map(len, number))
        for x, values in zip((self.count, self.hash, self.fallback, self.same), old, strict=True):
            x.frombytes(values.tobytes())
        self.flat.extend(int(i) for i in flat)

    def ids_of(self, at: np.ndarray) -> np.ndarray:
        """The ids of a sequence of unit numbers."""
        n = np.array(self.count, np.int64)
        begin = np.cumsum(n) - n
        k = n[at]
        flat = np.array(self.flat, np.int32)
        return flat[np.repeat(begin[at] - (np.cumsum(k) - k), k) + np.arange(k.sum())]

    def encode(self, texts: list[str]) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
        """Per text: (tokens, byte tokens, hash, whether decoding gives the text back, unit numbers)."""
        for text, (n, b, h, same, at) in zip(texts, self.encode_escaped(map(escape, texts)), strict=True):
            yield n, b, h, same and SPACE not in text, at

    def encode_escaped(self, texts: Iterable[str]) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
        if len(self.number) > MEMORY or self.chars > MEMORY_CHARS:
            self.forget()
        numbers = []
        for text in texts:
            units = self.split.findall(text)
            at = list(map(self.number.get, units))
            i = -1
            for _ in range(at.count(None)):
                i = at.index(None, i + 1)
                k = self.number.get(units[i])
                at[i] = self.add(units[i]) if k is None else k
            numbers.append(np.array(at, np.int64))
        if numbers:
            now = np.bincount(np.concatenate(numbers), minlength=len(self.count))
            now[: len(self.met)] += self.met
            self.met = now
        count, hashes, fallback, same = self.arrays()
        for at in numbers:
            n = count[at].astype(np.int64)
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            with np.errstate(over="ignore"):
                h = int((hashes[at] * powers(total)[ends - n]).sum(dtype=np.uint64))
            yield total, int(fallback[at].sum()), h, bool(same[at].all()), at
        del count, hashes, fallback, same


_OUT = "doc_id long, n_tokens long, n_byte_tokens long, ids_hash long, round_trip boolean"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _short(held, ids: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = unit_table(held.value, ids)
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                got = list(t.encode([x or "" for x in batch.column(1).to_pylist()]))
                n, b, h, same, at = zip(*got, strict=True)
                cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array([_signed(x) for x in h], pa.int64()), pa.array(same, pa.bool_())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(t.ids_of(np.concatenate(at)))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_byte_tokens", "ids_hash", "round_trip", "ids"][: len(cols)])

    return kernel


def _cut(longest: int, chunk: int):
    pad = 2 * longest + 4

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                plain, text = SPACE not in text, escape(text)
                for k, lo in enumerate(range(0, len(text), chunk)):
                    a, hi = max(0, lo - pad), min(len(text), lo + chunk)
                    yield pd.DataFrame({"row": [row], "doc_id": [doc], "k": [k], "part": [text[a : hi + pad]], "lo": [lo - a], "hi": [hi - a], "plain": [plain]})

    return kernel


def _in_context(v: Vocabulary, r) -> Chunk:
    """The chunk of a row. Contexts are longer than states look, so cut-off ends are never taken for the text's own."""
    return v.chunk(r.part, r.lo, r.hi)


def _matrices(held):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                m = _in_context(held.value, r).matrix()
                out.append((r.row, r.k, m.shape[0], m.shape[1], m.ravel().tolist()))
            yield pd.DataFrame(out, columns=["row", "k", "n", "m", "w"])

    return kernel


def _scan(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("k")
    at = boundary_states([np.array(r.w, float).reshape(r.n, r.m) for r in group.itertuples()])
    return pd.DataFrame({"row": group["row"], "k": group["k"], "i": at[:-1], "j": at[1:]})


def unit_table(v: Vocabulary, keep_ids: bool) -> UnitTable:
    """The worker's table of units, kept from task to task."""
    key = (hash((tuple(v.pieces), tuple(v.scores.values()))), keep_ids)
    if key not in WORKER_TABLES:
        free_worker_tables()
        WORKER_TABLES[key] = UnitTable(v, keep_ids)
    return WORKER_TABLES[key]


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few chunks at once: a batch of a thousand, with their ids, takes hundreds of MB."""
    for batch in batches:
        for lo in range(0, len(batch), CHUNKS_AT_ONCE):
            yield batch.slice(lo, CHUNKS_AT_ONCE)


def _backtrace(held, ids: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        t = unit_table(v, ids)
        byte = t.byte
        for batch in _few(batches):
            out = []
            for r in batch.select(["part", "lo", "hi", "plain", "i", "j"]).to_pandas().itertuples():
                c = _in_context(v, r)
                head, tail = c.parts(r.i, r.j)
                lo, hi = (c.inner[0], c.inner[-1]) if c.inner else (0, 0)
                n, b, h, same, at = next(t.encode_escaped([r.part[lo:hi]]))
                sides = [v.to_ids(head), v.to_ids(tail)]
                # the pieces that start here spell the text from the end of the entry piece to that of the exit piece
                a, z = c.entry[r.i][1], max(c.exit[r.j][1], c.entry[r.i][1])
                spelt = [b"".join(bytes([byte[i]]) if i in byte else v.pieces[i].encode() for i in x).decode("utf-8", "replace") for x in sides]
                same = same and r.plain and spelt[0] + r.part[lo:hi] + spelt[1] == r.part[a:z]
                total = n_all = 0
                for x, m in ((ids_hash(np.array(sides[0], np.int64)), len(sides[0])), (h, n), (ids_hash(np.array(sides[1], np.int64)), len(sides[1]))):
                    total, n_all = (total + x * pow(_HASH_BASE, n_all, 1 << 64)) % (1 << 64), n_all + m
                out.append((n_all, b + sum(i in byte for x in sides for i in x), _signed(total), bool(same), np.concatenate([sides[0], t.ids_of(at), sides[1]]).astype(np.int32) if ids else None))
            n, b, h, same, lists = zip(*out, strict=True)
            cols = [batch.column(x) for x in ("row", "doc_id", "k")]
            cols += [pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array(h, pa.int64()), pa.array(same, pa.bool_()), pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "k", "n", "b", "h", "same", "ids"])

    return kernel


def _join(ids: bool):
    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        h = length = 0
        for n, part in zip(group["n"], group["h"], strict=True):
            h = (h + (int(part) % (1 << 64)) * pow(_HASH_BASE, length, 1 << 64)) % (1 << 64)
            length += int(n)
        out = {"row": group["row"].iloc[0], "doc_id": group["doc_id"].iloc[0], "n_tokens": length, "n_byte_tokens": int(group["b"].sum()), "ids_hash": _signed(h), "round_trip": bool(group["same"].all())}
        if ids:
            out["ids"] = np.concatenate([np.asarray(x, np.int32) for x in group["ids"]])
        return pd.DataFrame([out])

    return kernel


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, ids: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Per row: doc_id, n_tokens, n_byte_tokens, ids_hash, round_trip (decoding gives the text back), and ``ids``.

    Null and empty texts have no tokens and round-trip. A text that holds the vocabulary's own space
    mark decodes with spaces instead, so its round_trip is false. Rows that repeat a doc_id are encoded
    each for itself; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    v = vocabulary or Vocabulary.load()
    if chunk < 4 * v.longest:
        raise ValueError("a chunk must be longer than four of the longest pieces")
    held = spark.sparkContext.broadcast(v)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    short = base.where(F.length(F.coalesce("text", F.lit(""))) < chunk).mapInArrow(lean(_short(held, ids)), _OUT + ", ids array<int>" * ids)

    scratch = Scratch(spark, "pieces")
    giant = base.where(F.length("text") >= chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = giant.mapInPandas(lean(_cut(v.longest, chunk)), "row long, doc_id long, k int, part string, lo int, hi int, plain boolean")
    parts = scratch.save(parts.repartition("row", "k"), "parts")
    matrices = parts.mapInPandas(lean(_matrices(held)), "row long, k int, n int, m int, w array<double>")
    states = scratch.save(matrices.groupBy("row").applyInPandas(_scan, "row long, k int, i int, j int"), "states")
    solved = parts.join(states, ["row", "k"]).mapInArrow(lean(_backtrace(held, ids)), "row long, doc_id long, k int, n long, b long, h long, same boolean, ids array<int>")
    whole = solved.groupBy("row").applyInPandas(_join(ids), "row long, " + _OUT + ", ids array<int>" * ids).drop("row")
    return scratch.save(short.unionByName(whole), "encoded")


def decode(tokens: DataFrame, vocabulary: Vocabulary | None = None, ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of rows with lists of ids; null and empty lists give empty texts."""
    held = tokens.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [held.value.decode([int(i) for i in x] if x is not None else []) for x in batch["ids"]]})

    return tokens.select("doc_id", F.col(ids_col).alias("ids")).mapInPandas(lean(kernel), "doc_id long, text string")

