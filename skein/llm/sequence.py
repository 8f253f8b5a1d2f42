"""Dynamic programmes over rows of unequal length, one numpy step per position for all rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def steps(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row order by falling length, start of each in that order, rows still running at each position)."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    falling = n[order]
    longest = int(falling[0]) if len(falling) else 0
    running = np.searchsorted(-falling, -np.arange(longest), "left")
    return order, first[:-1][order], running


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each item; ``scores`` is (items, labels) and a change of label costs ``penalty``.

    Ties keep the label, then prefer the smaller one. Rows are independent.
    """
    labels = scores.shape[1]
    _, starts, running = steps(first)
    back = np.zeros((len(scores), labels), np.uint8 if labels < 256 else np.uint16)
    out = np.zeros(len(scores), np.int64)
    if not len(running):
        return out
    keep = np.arange(labels)
    v = scores[starts[: running[0]]].astype(np.float64)
    last = np.zeros((len(starts), labels))
    for t in range(1, len(running)):
        k = running[t]
        if k < len(v):
            last[k : len(v)] = v[k:]
            v = v[:k]
        top = v.argmax(1)
        change = v[np.arange(k), top] - penalty
        moved = v < change[:, None]
        at = starts[:k] + t
        back[at] = np.where(moved, top[:, None], keep)
        v = np.where(moved, change[:, None], v) + scores[at]
    last[: len(v)] = v
    now = last.argmax(1)
    for t in range(len(running) - 1, -1, -1):
        k = running[t]
        at = starts[:k] + t
        out[at] = now[:k]
        now[:k] = back[at, now[:k]]
    return out


def marginals(odds: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(state 1) of each item of a two-state chain by forward-backward.

    ``odds``: log odds that an item alone gives to state 1; ``trans``: 2 x 2 log potentials (from, to).
    Messages are kept as log odds, so no length under- or overflows.
    """
    return forward_backward(odds, first, trans)[0]


def forward_backward(odds: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, forward log odds with the item, backward log odds without it)."""
    _, starts, running = steps(first)
    ahead, behind = np.array(odds, np.float64), np.zeros(len(odds))
    e = np.exp(trans)
    with np.errstate(over="ignore"):
        for t in range(1, len(running)):
            at = starts[: running[t]] + t
            r = np.exp(np.clip(ahead[at - 1], -60, 60))
            ahead[at] += np.log((e[0, 1] + e[1, 1] * r) / (e[0, 0] + e[1, 0] * r))
        for t in range(len(running) - 2, -1, -1):
            at = starts[: running[t + 1]] + t
            r = np.exp(np.clip(behind[at + 1] + odds[at + 1], -60, 60))
            behind[at] = np.log((e[1, 0] + e[1, 1] * r) / (e[0, 0] + e[0, 1] * r))
        return 1 / (1 + np.exp(-np.clip(ahead + behind, -60, 60))), ahead, behind


def runs(flags: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first item, end item) arrays of the maximal runs of equal nonzero flags within rows."""
    if not len(flags):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.empty(len(flags), bool)
    edge[0], edge[1:] = True, flags[1:] != flags[:-1]
    edge[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(edge)
    end = np.append(at[1:], len(flags))
    ok = flags[at] != 0
    at, end = at[ok], end[ok]
    return np.searchsorted(first, at, "right") - 1, at, end
