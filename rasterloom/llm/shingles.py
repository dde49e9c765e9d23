"""Sets of hashed word shingles, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9FB21C651E98DF25
_LOT = 1 << 18
_powers: dict[str, np.ndarray] = {}
BLANKS = (9, 10, 11, 12, 13, 32)


def _tables(n: int) -> dict[str, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        rng = np.random.default_rng(4)
        values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        values[65:91] = values[97:123]  # A-Z as a-z
        _powers["byte"], _powers["blank"] = values, np.isin(np.arange(256), BLANKS)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of data, which must end with a blank."""
    t = _tables(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(t["byte"][data] * t["up"][: len(data)], out=h[1:])
    blank = np.concatenate([[True], t["blank"][data]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edge[::2], edge[1::2]
    return first, _mix((h[last] - h[first]) * t["down"][first])


def _long(text: bytes) -> np.ndarray:
    """Word hashes of a text of any length, read in parts that end at a blank where there is one."""
    out, at = [], 0
    while at < len(text):
        to = min(at + _LOT, len(text))
        while to < len(text) and text[to - 1] not in BLANKS:
            to += 1
        out.append(_words(np.frombuffer(text[at:to] + b" ", np.uint8))[1])
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles of k words as sorted hashes; with fewer words the whole sequence as one."""
    out, a = [], 0
    data = [t.encode() for t in texts]
    while a < len(data):
        b, size = a, 0
        while b < len(data) and (b == a or size + len(data[b]) < _LOT):
            size, b = size + len(data[b]) + 1, b + 1
        if b == a + 1:
            per = [_long(data[a])]
        else:
            first, w = _words(np.frombuffer(b" ".join(data[a:b]) + b" ", np.uint8))
            ends = np.cumsum([len(x) + 1 for x in data[a:b]])
            per = np.split(w, np.searchsorted(first, ends[:-1]))
        for w in per:
            if not len(w):
                out.append(w)
                continue
            s, n = np.full(max(1, len(w) - k + 1), min(len(w), k), np.uint64), len(w)
            for j in range(min(k, n)):
                s = _mix(s * np.uint64(_BASE) + w[j : j + len(s)])
            out.append(np.unique(s))
        a = b
    return out
