"""Matches of whole samples: literals, and for each match how many literals go before it, its length and distance.

A match is of ``LEAST`` samples or more. Earlier places of every run of that many samples are found at once by a
sort of their hashes; the parse is greedy and steps from match to match. Copies may overlap what they make.
"""

from __future__ import annotations

import numpy as np

LEAST = 4


def _earlier(v: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier one with the same LEAST samples, or -1."""
    n = len(v) - LEAST + 1
    if n < 2:
        return np.full(max(n, 0), -1)
    h = np.zeros(n, np.uint64)
    for j in range(LEAST):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + v[j : j + n].astype(np.uint64)
    order = np.argsort(h, kind="stable")
    out = np.full(n, -1)
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    at, before = order[same + 1], order[same]
    ok = np.all([v[at + j] == v[before + j] for j in range(LEAST)], axis=0)
    out[at[ok]] = before[ok]
    return out


def _length(v: np.ndarray, at: int, before: int) -> int:
    """How many samples from ``at`` on are those from ``before`` on."""
    size, step = LEAST, 64
    while at + size < len(v):
        end = min(size + step, len(v) - at)
        differs = np.flatnonzero(v[at + size : at + end] != v[before + size : before + end])
        if len(differs):
            return size + int(differs[0])
        size, step = end, 4 * step
    return size


def parse(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Literals, and rows (literals before, length, distance) of the matches."""
    before = _earlier(v)
    starts = np.flatnonzero(before >= 0)
    rows, literals, at, k = [], [], 0, 0
    while True:
        k = int(np.searchsorted(starts, at))
        if k == len(starts):
            break
        i = int(starts[k])
        size = _length(v, i, int(before[i]))
        literals.append(v[at:i])
        rows.append((i - at, size, i - int(before[i])))
        at = i + size
    return np.concatenate([*literals, v[at:]]), np.array(rows, np.uint32).reshape(-1, 3)


def join(literals: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` samples again; rows that do not fit are refused."""
    sizes = rows.astype(np.int64)
    if len(literals) + sizes[:, 1].sum() != n or sizes[:, 0].sum() > len(literals):
        raise ValueError("matches do not fit the samples")
    out, at, used = np.empty(n, literals.dtype), 0, 0
    for run, size, back in sizes.tolist():
        out[at : at + run] = literals[used : used + run]
        at, used = at + run, used + run
        if not 0 < back <= at:
            raise ValueError("a match reaches before the samples")
        out[at : at + size] = np.resize(out[at - back : at], size) if back < size else out[at - back : at - back + size]
        at += size
    out[at:] = literals[used:]
    return out
