"""Removal of repeated byte strings by a depth-limited radix order of suffixes.

The suffixes of all texts are ordered only through their first ``threshold`` bytes, most significant
digit first; suffixes that still tie after the last digit are exactly the repeated windows. The digits:

1. the *anchor*: the smallest hashed k-gram of the window (rightmost of equals), a function of the
   window's bytes alone. Neighbouring windows share their anchor, so a run of them is one row.
   Anchors that occur once end there.
2. the *span*: all bytes under a run. Anchors with one distinct span that occurs twice or more are
   done: every window of the run repeats.
3. for anchors with several spans, the windows themselves, by their place relative to the anchor and
   then ``digit`` bytes at a time; each pass keeps only the suffixes that still tie. An anchor with up
   to ``spans_in_memory`` distinct spans is ordered inside a task, in a bucket of many anchors; beyond
   that its windows become rows that Spark counts by key, so no anchor has to fit in a task.

Hashes have 64 bits, and strings count as equal when anchor and span or window agree (128 bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Cuts, parts, text_key, tidy

_BASE = 0x9E3779B97F4A7C15
_BATCH = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the 256 bytes, and n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        rng = np.random.default_rng(20)
        _powers["byte"] = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["byte"], _powers["up"], _powers["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _prefix(data: np.ndarray) -> np.ndarray:
    byte, up, _ = _tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * up[: len(data)], out=out[1:])
    return out


def _runs(data: np.ndarray, end: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, number, anchor's place, anchor and span hashes.

    ``end`` has for each byte where its text ends; no window crosses an end.
    """
    if len(data) < threshold:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    down, h = _tables(len(data) + 1)[2], _prefix(data)
    grams = _mix((h[gram:] - h[:-gram]) * down[: len(h) - gram])
    low = np.uint64((1 << 24) - 1)
    key = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    width, w = threshold - gram + 1, 1
    while 2 * w <= width:
        key, w = np.minimum(key[:-w], key[w:]), 2 * w
    if w < width:
        key = np.minimum(key[: len(key) - (width - w)], key[width - w :])
    anchor = (low - (key & low)).astype(np.int64)
    fits = np.arange(len(anchor)) + threshold <= end[: len(anchor)]
    cut = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(fits & np.concatenate([[True], cut | ~fits[:-1]]))
    last = np.flatnonzero(fits & np.concatenate([cut | ~fits[1:], [True]]))
    span = _mix((h[last + threshold] - h[first]) * down[first] + (last - first).astype(np.uint64))
    return first, last - first + 1, anchor[first], grams[anchor[first]], span


def _pieces(texts: list[bytes], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' bytes in batches of about a quarter of a MB: bytes, where each byte's text ends, and for the
    parts in the batch the text's number, the part's start in the batch and in its text.

    A text longer than a batch comes in parts that overlap by threshold - 1 bytes.
    """
    todo = [(i, at) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - threshold + 1), _BATCH)]
    batch: list[tuple[int, int]] = []
    size = 0
    for k, (i, at) in enumerate(todo):
        batch.append((i, at))
        size += min(len(texts[i]) - at, _BATCH + threshold - 1)
        if size >= _BATCH or k + 1 == len(todo):
            part = [texts[j][a : a + _BATCH + threshold - 1] for j, a in batch]
            n = np.array([len(p) for p in part])
            start = np.cumsum(n) - n
            yield np.frombuffer(b"".join(part), np.uint8), np.repeat(start + n, n), start, np.array(batch)
            batch, size = [], 0


def _run_rows(threshold: int, gram: int):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t.encode() for t in f.pop("t")]
            k1, k2 = f["k1"].to_numpy(), f["k2"].to_numpy()
            for data, end, start, of in _pieces(texts, threshold):
                first, n, anchor, a, s = _runs(data, end, threshold, gram)
                part = np.searchsorted(start, first, "right") - 1
                doc, at = of[part, 0], of[part, 1] - start[part]
                yield pd.DataFrame({"k1": k1[doc], "k2": k2[doc], "a": a.astype(np.int64), "s": s.astype(np.int64), "p": first + at, "n": n.astype(np.int32), "o": (anchor - first).astype(np.int32)})

    return rows


def _span_rows(threshold: int):
    """Bytes of the named runs of each text."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text, want in zip(f["t"], f["want"], strict=True):
                data = text.encode()
                out += [(w["a"], w["s"], w["c"], w["o"], w["n"], data[w["p"] : w["p"] + w["n"] + threshold - 1]) for w in want]
            yield pd.DataFrame(out, columns=["a", "s", "c", "o", "n", "span"])

    return rows


def _window_keys(f: pd.DataFrame, threshold: int, digit: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All windows of the spans in f: row, number in its run, and the digits, the first one of anchor and place."""
    n = f["n"].to_numpy().astype(np.int64)
    spans = f["span"].tolist()
    size = np.array([len(x) for x in spans])
    start = np.cumsum(size) - size
    h = _prefix(np.frombuffer(b"".join(spans), np.uint8))
    row = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at, place = start[row] + j, f["o"].to_numpy().astype(np.int64)[row] - j
    down = _tables(len(h))[2]
    digits = [_mix(f["a"].to_numpy().view(np.uint64)[row] + place.astype(np.uint64) * np.uint64(_BASE))]
    for d in range(0, threshold, digit):
        e = min(d + digit, threshold)
        digits.append(_mix((h[at + e] - h[at + d]) * down[at + d]))
    return row, j, digits


def _tied(digits: list[np.ndarray], sure: np.ndarray) -> np.ndarray:
    """Radix passes, most significant digit first: which suffixes tie with another after the last digit.

    sure: suffixes known to occur twice or more by themselves.
    """
    live = np.arange(len(digits[0]))
    group = np.zeros(len(live), np.uint64)
    for d in digits:
        key = _mix(group * np.uint64(_BASE) + d[live])
        _, group, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = (count[group] > 1) | sure[live]
        live, group = live[keep], group[keep].astype(np.uint64)
    out = np.zeros(len(digits[0]), bool)
    out[live] = True
    return out


def _intervals(f: pd.DataFrame, row: np.ndarray, j: np.ndarray, hit: np.ndarray) -> pd.DataFrame:
    """Per span the maximal runs of hit windows, as first window (within the run) and number."""
    at = np.flatnonzero(hit)
    if not len(at):
        return pd.DataFrame({"a": [], "s": [], "j": [], "m": []}).astype("int64")
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])])
    b = np.flatnonzero(new)
    m = np.diff(np.append(b, len(at)))
    return pd.DataFrame({"a": f["a"].to_numpy()[row[at[b]]], "s": f["s"].to_numpy()[row[at[b]]], "j": j[at[b]], "m": m})


def _bucket(threshold: int, digit: int):
    def order(f: pd.DataFrame) -> pd.DataFrame:
        row, j, digits = _window_keys(f, threshold, digit)
        return _intervals(f, row, j, _tied(digits, f["c"].to_numpy()[row] > 1))

    return order


def _as_rows(threshold: int, digit: int):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 2000):
                g = f.iloc[at : at + 2000].reset_index(drop=True)
                row, j, digits = _window_keys(g, threshold, digit)
                key = digits[0]
                for d in digits[1:]:
                    key = _mix(key * np.uint64(_BASE) + d)
                yield pd.DataFrame({"a": g["a"].to_numpy()[row], "s": g["s"].to_numpy()[row], "c": g["c"].to_numpy()[row], "j": j, "key": key.view(np.int64)})

    return rows


def repeated_windows(docs: DataFrame, text: str = "text", threshold: int = 200, gram: int = 40, digit: int = 50, spans_in_memory: int = 20000) -> DataFrame:
    """Per distinct text (k1, k2 of common.text_key), the set ``runs`` of structs (p, n): n windows of
    ``threshold`` bytes from byte p on, each of which also starts somewhere else.

    Null texts count as empty; texts under ``threshold`` bytes have no window.
    """
    spark = docs.sparkSession
    cut = Cuts(spark)
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    keyed = docs.select(*text_key(t), t.alias("t")).where(F.octet_length("t") >= threshold)
    runs, at_runs = cut.cut(keyed.mapInPandas(tidy("suffix", _run_rows(threshold, gram)), "k1 long, k2 long, a long, s long, p long, n int, o int"))
    shared = cut(runs.groupBy("a").agg(F.count("*").alias("c"), (F.min("s") != F.max("s")).alias("multi")).where("c > 1").select("a", "multi"))
    found = cut(runs.join(shared, "a"))
    cut.drop(at_runs)
    done = found.where("not multi").select("k1", "k2", "p", "n")
    open_ = found.where("multi")
    spans = open_.groupBy("a", "s").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "p", "n", "o")).alias("r"))
    want = spans.select("r.k1", "r.k2", F.struct("a", "s", "c", F.col("r.p").alias("p"), F.col("r.n").alias("n"), F.col("r.o").alias("o")).alias("w"))
    want = want.groupBy("k1", "k2").agg(F.collect_list("w").alias("want"))
    # One copy of a text gives the bytes; a text with many copies is cut down before it meets them.
    one = keyed.join(want, ["k1", "k2"]).select("k1", "k2", "t", "want")
    bytes_ = one.mapInPandas(tidy("suffix", _span_rows(threshold)), "a long, s long, c long, o int, n int, span binary")
    bytes_ = cut(bytes_.groupBy("a", "s").agg(*(F.first(x).alias(x) for x in ("c", "o", "n", "span"))))
    size = bytes_.groupBy("a").agg(F.count("*").alias("g"))
    n = bytes_.count()
    hot = size.where(F.col("g") > spans_in_memory).select("a")
    some_hot = n > spans_in_memory and hot.limit(1).count() > 0
    cold = bytes_.join(hot, "a", "left_anti") if some_hot else bytes_
    hits = cold.withColumn("b", F.pmod(F.xxhash64("a"), F.lit(max(1, n // 20000, min(parts(spark), n // 500)))))
    hits = hits.groupBy("b").applyInPandas(lambda f: _bucket(threshold, digit)(f), "a long, s long, j long, m long")
    if some_hot:
        windows = cut(bytes_.join(hot, "a", "left_semi").mapInPandas(tidy("suffix", _as_rows(threshold, digit)), "a long, s long, c long, j long, key long"))
        again = windows.groupBy("a", "key").agg(F.sum("c").alias("all")).where(F.col("all") > 1).select("a", "key")
        hits = hits.unionByName(windows.join(again, ["a", "key"]).select("a", "s", "j", F.lit(1).cast("long").alias("m")))
    hits = cut(hits)
    part = open_.join(hits, ["a", "s"]).select("k1", "k2", (F.col("p") + F.col("j")).alias("p"), F.col("m").cast("int").alias("n"))
    return cut(done.unionByName(part).groupBy("k1", "k2").agg(F.collect_set(F.struct("p", "n")).alias("runs")))


def _remove(threshold: int):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text, runs in zip(f["t"], f["runs"], strict=True):
                data, kept, removed, spans, at = text.encode(), [], [], 0, 0
                for p, n in sorted((r["p"], r["n"]) for r in (runs if runs is not None else ())):
                    b, e = p, p + n + threshold - 1
                    if removed and b <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], e)
                    else:
                        removed.append([b, e])
                for b, e in removed:
                    kept.append(data[at:b])
                    at = e
                kept.append(data[at:])
                left = b"".join(kept)
                spans = len(removed)
                out.append((len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest(), [{"start": b, "end": e} for b, e in removed], left.decode("utf-8", "ignore")))
            g = f.drop(columns=["t", "runs"])
            for k, name in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text")):
                g[name] = [x[k] for x in out]
            yield g

    return rows


def remove_repeats(docs: DataFrame, text: str = "text", threshold: int = 200, gram: int = 40, keep: tuple[str, ...] = ("doc_id",), **more) -> DataFrame:
    """Each row's ``keep`` columns with n_bytes, n_removed, n_spans, kept_sha256, spans (byte starts and
    ends of the maximal removed runs) and kept_text (what is left; bytes of a character that was cut
    through are left out of it, but count in the hash).

    Every byte under a ``threshold``-byte string that also starts elsewhere goes, the first occurrence
    too. Nulls count as empty texts; equal rows give equal rows; an empty table gives an empty one. Other
    columns of ``docs`` are not looked at, so their names can't clash.
    """
    runs = repeated_windows(docs, text, threshold, gram, **more)
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(*(docs[c].alias(f"_{c}") for c in keep), *text_key(t), t.alias("t"))
    rows = rows.join(runs, ["k1", "k2"], "left").select(*(F.col(f"_{c}").alias(c) for c in keep), "t", "runs")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInPandas(tidy("suffix", _remove(threshold)), f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept_text string")


def op1(spark, sf_dir: str) -> DataFrame:
    from rasterloom.llm.common import table

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
