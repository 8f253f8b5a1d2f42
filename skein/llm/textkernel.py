"""Vectorised word and hash kernels over UTF-8 bytes (numpy; no loop over words)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
#: Bytes that separate words: space and the five ASCII controls from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


@lru_cache(8)
def byte_values(lower: bool) -> np.ndarray:
    v = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    return v[LOWER] if lower else v


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n, _BASE, _U)]))
        down = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n, _BASE_INV, _U)]))
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` + 1 of them."""
    size = 1 << max(21, int(n).bit_length())
    # what a very long text needs is not kept
    return _powers(size) if size == 1 << 21 else _powers.__wrapped__(size)


def prefix_hash(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """C with C[j] - C[i] = sum of value(byte) * base**position over [i, j), modulo 2**64."""
    out = np.empty(len(buf) + 1, _U)
    out[0] = 0
    np.cumsum(byte_values(lower)[buf] * powers(len(buf))[0][: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, equal for equal bytes wherever they stand."""
    down = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each row (rows + 1 entries)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    gap = SPACES[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = True, gap[1:]
    inner = offs[:-1][np.diff(offs) > 0]
    before[inner] = True
    after[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, starts, ends, first word of each row)."""
    starts, ends, first = word_spans(buf, offs)
    return span_hash(prefix_hash(buf, lower), starts, ends), starts, ends, first


_STEP = np.random.default_rng(77).integers(0, 1 << 62, 8, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of a row, and the first of each row.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    total = int(bounds[-1])
    if not total:
        return np.zeros(0, _U), bounds
    row = np.repeat(np.arange(len(n)), counts)
    at = first[:-1][row] + (np.arange(total) - bounds[:-1][row])
    left = np.minimum(n[row], size)
    out = left.astype(_U) * _U(0xA24BAED4963EE407)
    for j in range(size):
        ok = left > j
        out += np.where(ok, words[np.where(ok, at + j, 0)], _U(0)) * _STEP[j]
    return mix(out), bounds
