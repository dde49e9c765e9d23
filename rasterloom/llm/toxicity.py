"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

Every word enters as two kinds of input, both learned from the labels: *word inputs* (smoothed log odds
of the word among toxic texts, and how often it was seen) and *character inputs* (the largest and the
mean log odds of its runs of five characters, with marks at both ends, so that unseen forms of a known
stem are recognised). A GRU reads a window of words in both directions, attention pools its states, and
a logistic unit scores the window. Windows overlap by half and cover the whole text; a text's score is
that of its highest window (its label holds if any part is toxic), and training goes through that
window. For training rows the statistics leave out the row itself, so they look as on unseen texts.

Words are runs of bytes other than ASCII white space and punctuation, in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import table, tidy

_BITS = 18
_BASE = 0xD6E8FEB86659FD93
_PIECE = 1 << 18
INPUTS = 4
PAD = np.array([0, -2, 0, 0], np.float32)
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> dict[str, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        rng = np.random.default_rng(9)
        values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        marks = [c for c in range(128) if not chr(c).isalnum()]
        values[marks] = values[32]
        _powers["byte"], _powers["mark"] = values, np.isin(np.arange(256), marks)
    return _powers


def _slots(h: np.ndarray, start: np.ndarray, end: np.ndarray, down: np.ndarray) -> np.ndarray:
    return _mixed((h[end] - h[start]) * down[start])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - _BITS)).astype(np.int32)


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(number, part) in lots of about a megabyte; long texts are cut after a blank, or inside a word of that length."""
    lot, size = [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t) or not at:
            to = len(t)
            if to - at > _PIECE:
                blank = max(t.rfind(" ", at, at + _PIECE), t.rfind("\n", at, at + _PIECE))
                to = blank + 1 if blank > at else at + _PIECE
            lot.append((i, t[at:to]))
            size, at = size + to - at, max(to, 1)
            if size >= _PIECE:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


def split(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In lots: each word's text, its slot, the slots of all runs of five bytes, and each word's first and last run (2 columns; empty if they are equal)."""
    for lot in _pieces(texts):
        part = [f" {t.lower()} ".encode("utf-8", "replace") for _, t in lot]
        data = np.frombuffer(b"".join(part) + b"      ", np.uint8)
        t = _tables(len(data) + 1)
        h = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(t["byte"][data] * t["up"][: len(data)], out=h[1:])
        mark = t["mark"][data]
        edge = np.flatnonzero(mark[1:] != mark[:-1]) + 1
        first, last = edge[::2], edge[1::2]
        size = np.array([len(p) for p in part])
        of = np.array([i for i, _ in lot])[np.searchsorted(np.cumsum(size), first, "right")]
        grams = _mixed((h[5:-1] - h[:-6]) * t["down"][: len(h) - 6])
        runs = np.stack([first - 1, np.maximum(last - 3, first - 1)], 1)
        yield of, _slots(h, first, last, t["down"]), grams, runs


class Statistics:
    """Rows and toxic rows in which a word, and a run of five characters, occurs."""

    def __init__(self) -> None:
        self.counts = {k: np.zeros((2, 1 << _BITS), np.float32) for k in ("word", "gram")}
        self.rate = 0.1
        self._ready = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def fit(self, texts: list[str], y: np.ndarray) -> None:
        for (kind, of), slots in self._seen(texts):
            self.counts[kind][0, slots] += 1
            self.counts[kind][1, slots] += y[of]
        self.rate = float((y.sum() + 1) / (len(y) + 2))

    @staticmethod
    def _seen(texts: list[str]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
        for i, t in enumerate(texts):
            got = {"word": [], "gram": []}
            for _, words, grams, runs in split([t]):
                inside = np.zeros(len(grams) + 1, np.int32)
                np.add.at(inside, runs[:, 0], 1)
                np.add.at(inside, runs[:, 1], -1)
                got["word"].append(np.unique(words))
                got["gram"].append(np.unique(grams[np.cumsum(inside)[:-1] > 0]))
            for kind, slots in got.items():
                yield (kind, i), np.unique(np.concatenate(slots))

    def odds(self, kind: str, slots: np.ndarray | slice = slice(None), own: np.ndarray | int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Log odds against the base rate, and the log of the rows seen; own: labels to leave out once."""
        n, t = self.counts[kind][:, slots]
        n, t = np.maximum(n - (own >= 0), 0), np.maximum(t - (own > 0), 0)
        p = np.clip((t + 4 * self.rate) / (n + 4), 1e-3, 1 - 1e-3)
        return (np.log(p / (1 - p)) - np.log(self.rate / (1 - self.rate))).astype(np.float32), (np.log1p(n) - 2).astype(np.float32)

    def inputs(self, texts: list[str], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """INPUTS rows by words, and the number of words of each text."""
        if self._ready is None:
            self._ready = (*self.odds("word"), self.odds("gram")[0])
        out, count = [np.zeros((INPUTS, 0), np.float32)], np.zeros(len(texts), np.int64)
        for of, words, grams, runs in split(texts):
            count += np.bincount(of, minlength=len(texts))
            if not len(of):
                continue
            if own is None:
                o, n, g = self._ready[0][words], self._ready[1][words], self._ready[2][grams]
            else:
                o, n = self.odds("word", words, own[of])
                inside = np.full(len(grams), -1)
                number = np.cumsum(np.bincount(runs[:, 0], minlength=len(grams))) - 1
                inside = own[of[np.clip(number, 0, len(of) - 1)]]
                g = self.odds("gram", grams, inside)[0]
            some = runs[:, 1] > runs[:, 0]
            x = np.zeros((INPUTS, len(of)), np.float32)
            x[0], x[1] = o, n
            if some.any():
                ends = runs[some].ravel()
                x[2, some] = np.maximum.reduceat(g, ends)[::2]
                x[3, some] = np.add.reduceat(g, ends)[::2] / (runs[some, 1] - runs[some, 0])
            out.append(x)
        return np.concatenate(out, 1), count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Two GRUs of ``hidden`` units, attention with one query, one logistic output; windows are columns."""

    def __init__(self, hidden: int = 6, seed: int = 7) -> None:
        r, h = np.random.default_rng(seed), hidden
        self.h, p = h, {}
        for d in "fb":
            p[f"w{d}"], p[f"u{d}"], p[f"c{d}"] = r.normal(0, 0.4, (3 * h, INPUTS)), r.normal(0, 0.3, (3 * h, h)), np.zeros((3 * h, 1))
        p["a"], p["o"], p["q"] = r.normal(0, 0.5, 2 * h), r.normal(0, 0.5, 2 * h), np.array([-1.0])
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _read(self, x: np.ndarray, d: str, out: np.ndarray, keep: bool) -> list:
        """Fills out with the states of one direction; x: words, inputs, windows."""
        w, u, c, h = self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"c{d}"], self.h
        s, notes = np.zeros((h, x.shape[2]), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g, i = u @ s, w @ x[t]
            i += c
            zr = i[: 2 * h]
            zr += g[: 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            un, n = g[2 * h :], zr[h:] * g[2 * h :]
            n += i[2 * h :]
            np.tanh(n, out=n)
            if keep:
                notes.append((t, s, zr[:h], zr[h:], n, un))
            s = s - n
            s *= zr[:h]
            s += n
            out[t] = s
        return notes

    def logits(self, x: np.ndarray, real: np.ndarray, keep: bool = False):
        """x: words, inputs, windows; real: words, windows (False: past the end)."""
        h = self.h
        states = np.empty((len(x), 2 * h, x.shape[2]), np.float32)
        nf, nb = self._read(x, "f", states[:, :h], keep), self._read(x, "b", states[:, h:], keep)
        e = np.where(real, np.einsum("h,thb->tb", self.p["a"], states), -30.0).astype(np.float32)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        v = np.einsum("tb,thb->hb", w, states)
        out = self.p["o"] @ v + self.p["q"][0]
        return (out, (x, real, states, w, v, nf, nb)) if keep else out

    def gradients(self, memo: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
        """Of a loss whose derivative by the logits is d."""
        x, real, states, w, v, nf, nb = memo
        h, g = self.h, {}
        g["o"], g["q"] = v @ d, np.array([d.sum()])
        dv = self.p["o"][:, None] * d
        dw = np.einsum("thb,hb->tb", states, dv)
        de = w * (dw - (w * dw).sum(0)) * real
        g["a"] = np.einsum("tb,thb->h", de, states)
        ds = w[:, None] * dv + de[:, None] * self.p["a"][None, :, None]
        for k, notes in (("f", nf), ("b", nb)):
            part = ds[:, :h] if k == "f" else ds[:, h:]
            u, back = self.p[f"u{k}"], np.zeros((h, x.shape[2]), np.float32)
            gw, gu, gc = (np.zeros_like(self.p[f"{n}{k}"]) for n in "wuc")
            for t, s, z, r, n, un in reversed(notes):
                back = back + part[t]
                dz, dn = back * (s - n) * z * (1 - z), back * (1 - z) * (1 - n * n)
                dr = dn * un * r * (1 - r)
                dx, du = np.concatenate([dz, dr, dn]), np.concatenate([dz, dr, dn * r])
                gw += dx @ x[t].T
                gu += du @ s.T
                gc += dx.sum(1, keepdims=True)
                back = back * z + u.T @ du
            g |= {f"w{k}": gw, f"u{k}": gu, f"c{k}": gc}
        return g


def windows(count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``count`` words, one after another: each window's text, first word and number of words.

    Windows start half a window apart and cover all words; a text without words has one empty window.
    """
    step = size // 2
    k = np.maximum(1, -(-(count - size) // step) + 1)
    of = np.repeat(np.arange(len(count)), k)
    j = (np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)) * step
    return of, (np.cumsum(count) - count)[of] + j, np.minimum(size, count[of] - j)


def _columns(x: np.ndarray, start: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the windows (words, inputs, windows) and which are real; the last column of x is padding."""
    t = np.arange(size)[:, None]
    real = t < n
    got = x[:, np.where(real, start + t, x.shape[1] - 1)]
    real[0] = True
    return np.ascontiguousarray(got.transpose(1, 0, 2)), real


class Model:
    """A fitted scorer: statistics, network, window length."""

    def __init__(self, statistics: Statistics, network: Network, size: int) -> None:
        self.s, self.net, self.size = statistics, network, size

    def logits(self, x: np.ndarray, start: np.ndarray, n: np.ndarray, batch: int = 1024) -> np.ndarray:
        x = np.hstack([x, PAD[:, None]])
        # Short windows first, so that a batch has no more words than its longest window.
        order, out = np.argsort(n, kind="stable"), np.empty(len(n), np.float32)
        for a in range(0, len(n), batch):
            k = order[a : a + batch]
            out[k] = self.net.logits(*_columns(x, start[k], n[k], max(1, int(n[k].max()))))
        return out

    def scores(self, texts: list[str], lot: int = 1 << 20) -> np.ndarray:
        """The highest window's score of each text, empty texts too."""
        out, a = np.full(len(texts), -np.inf, np.float32), 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size < lot):
                size, b = size + len(texts[b]), b + 1
            x, count = self.s.inputs(texts[a:b])
            of, start, n = windows(count, self.size)
            np.maximum.at(out, a + of, self.logits(x, start, n))
            a = b
        return _sigmoid(out.astype(float))


def fit(texts: list[str], labels: list[int], size: int = 48, epochs: int = 10, least: int = 30000, hidden: int = 6, seed: int = 7) -> Model:
    """Trains a model on the driver; the caller bounds the number of texts.

    There are ``epochs`` passes, and more where there are few texts: at least ``least`` texts are shown.
    """
    y = np.array(labels, np.float32)
    net, stats = Network(hidden, seed), Statistics()
    model = Model(stats, net, size)
    if not len(y) or y.min() == y.max():
        # Nothing to learn from: every text gets the base rate.
        net.p["o"][:] = 0
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        net.p["q"][:] = np.log(max(p, 1e-3) / max(1 - p, 1e-3))
        return model
    stats.fit(texts, y)
    x, count = stats.inputs(texts, y.astype(int))
    of, start, n = windows(count, size)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    stops = np.append(first[1:], len(of))
    padded = np.hstack([x, PAD[:, None]])
    r, t = np.random.default_rng(seed), 0
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    for epoch in range(max(epochs, least // len(y))):
        # The highest window of each text; the first time, the one with the most telling word.
        telling = np.append(x[0] + x[2], -9)
        score = model.logits(x, start, n) if epoch else np.array([telling[a : a + max(1, k)].max() for a, k in zip(start, n, strict=True)])
        best = np.array([a + int(np.argmax(score[a:b])) for a, b in zip(first, stops, strict=True)])
        order = r.permutation(len(best))
        for a in range(0, len(order), 64):
            k = order[a : a + 64]
            out, memo = net.logits(*_columns(padded, start[best[k]], n[best[k]], size), keep=True)
            d = ((_sigmoid(out) - y[k]) * weight[k] / len(k)).astype(np.float32)
            t += 1
            for name, g in net.gradients(memo, d).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                net.p[name] = (net.p[name] - 0.02 * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return model


def fit_rows(docs: DataFrame, labels: DataFrame, most: int = 4000, **more) -> Model:
    """Fits on the ``most`` labelled texts of lowest id hash among rows not held out (see ``held_out``).

    The bound is on rows, each whole. A document with several labels counts as toxic if any says so.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.where(~held_out("doc_id")).orderBy(F.xxhash64(F.lit("toxic"), F.col("doc_id")), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", "t"]).orderBy("doc_id", "t").limit(most).collect()
    return fit([r.t for r in rows], [r.y for r in rows], **more)


def held_out(id_: str):
    """crc32 of the id as text, modulo 5, is 0 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_rows(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of docs and ``score``, from 0 to 1. Null texts count as empty; equal texts score alike.

    A column of docs by that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy("toxicity", lambda b: (pd.Series(shared.value.scores(texts.tolist())) for texts in b))(batches)

    return docs.withColumn(score, scored(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def op3(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_rows(docs, labels)
    out = score_rows(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
