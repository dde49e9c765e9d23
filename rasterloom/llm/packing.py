"""Packing into sequences of a fixed length by minimum bin slack.

Only the numbers of pieces by length matter to the packing, and there are at most ``size`` lengths, so
the driver works on a table that does not grow with the rows: for each bin it takes the longest length
left, finds the fullest sum that other lengths can add by bitset dynamic programming, and removes that
combination, as many times at once as the numbers allow. The resulting table of places (length, ranks
from-to, bin, offset) is bounded by the lengths too, and each task gives its pieces their places by it.
Ranks within a length come from counts by task and length, added up by Spark.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property
from operator import itemgetter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.llm.common import Cuts, kept, table, tidy


def fullest(lengths: list[int], count: dict[int, int], room: int) -> list[int]:
    """Lengths (descending, each used up to its count) whose sum is the largest possible up to room.

    Bit j of a mask says that a sum of j can be reached; the masks before each length give the way back.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        if n > room:
            continue
        left, k = min(count[n], room // n), 1
        while left:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & full
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, []
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            used += [n] * k
            at -= n * k
    return used


def pack_counts(count: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) of the bins that take ``count`` pieces by length."""
    left = {n: c for n, c in count.items() if c > 0}
    out = []
    while left:
        lengths = sorted(left, reverse=True)
        first = lengths[0]
        left[first] -= 1
        bin_ = [first, *fullest([n for n in lengths if left[n]], left, size - first)] if first < size else [first]
        left[first] += 1
        times = min(left[n] // bin_.count(n) for n in set(bin_))
        for n in set(bin_):
            left[n] -= times * bin_.count(n)
            if not left[n]:
                del left[n]
        out.append((times, bin_))
    return out


def places(bins: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Rows by length and rank: from ``rank`` on, ``per`` pieces a bin go to bins from ``bin`` on, from ``offset`` on."""
    rows, used, first = [], {}, 0
    for times, lengths in bins:
        offset = 0
        for n in dict.fromkeys(lengths):
            per = lengths.count(n)
            rows.append((n, used.get(n, 0), per, first, offset))
            used[n] = used.get(n, 0) + per * times
            offset += n * per
        first += times
    rows.sort()
    return dict(zip(("length", "rank", "per", "bin", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def _place(at: dict[str, np.ndarray]):
    key = (at["length"] << 44) | at["rank"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, rank = f["length"].to_numpy(np.int64), f["rank"].to_numpy(np.int64)
            k = np.searchsorted(key, (n << 44) | rank, "right") - 1
            r = rank - at["rank"][k]
            g = f.drop(columns=["rank"])
            g["sequence_id"] = at["bin"][k] + r // at["per"][k]
            g["offset"] = at["offset"][k] + r % at["per"][k] * n
            yield g

    return run


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """The columns of pieces (with ``length``, 1 to size) and sequence_id, offset. Replaces columns so named."""
    cut = Cuts(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset", "rank")
    names = pieces.columns
    held = cut(pieces.select(F.struct(*names).alias("r"), F.col("length").cast("long").alias("length"), F.spark_partition_id().alias("part")))
    by = held.groupBy("length", "part").agg(F.count("*").alias("c"))
    before = by.withColumn("base", F.coalesce(F.sum("c").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    count = {r.length: r.c for r in by.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    at = places(pack_counts(count, size))
    ranked = held.withColumn("i", F.row_number().over(W.partitionBy("length", "part").orderBy(F.monotonically_increasing_id())))
    ranked = ranked.join(before.drop("c"), ["length", "part"]).select("r.*", (F.col("base") + F.col("i") - 1).alias("rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInPandas(_place(at), f"{kinds}, sequence_id long, offset long")


def _of(category: str) -> str:
    """The characters of a Unicode category among those that ``Encoder.plain`` takes, for a pattern's class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == category)


#: How the tokenizer's file splits lower-cased text before merging: letters, single digits, other runs.
_PARTS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_of('L')}]+|[{_of('N')}]|[^\s{_of('L')}{_of('N')}]+"


class Encoder:
    """Texts to packed ids, each with the end id.

    The tokenizer never joins anything across white space, nor across its own split of a word, so the ids
    of the parts are kept for reuse; texts get the ids that the tokenizer gives. Words with characters
    outside Latin, or with a special token's marks, go to the tokenizer whole.
    """

    def __init__(self, path: str, end: int, most: int = 1_000_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole, self.end, self.most = lambda: Tokenizer.from_file(path), np.uint32(end).tobytes(), most
        # For parts that are split, in lower case and of Latin characters, so that normalisation changes nothing.
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = re.compile(_PARTS).findall
        self.plain = re.compile("[\\t\\n\\r -~\u00a1-\u012f\u0131-\u024f]*").fullmatch
        self.parts: dict[str, bytes] = {}

    @cached_property
    def t(self):
        """The tokenizer as it is, for words that are not split here; many corpora never need it."""
        return self.whole()

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _split(self, text: str) -> tuple[list[str], dict[str, bytes]]:
        """A text's parts, and ids of words that are their own part (marked by a leading blank)."""
        if "<|" not in text and self.plain(text):
            return self.split(text.lower()), {}
        out, whole = [], {}
        # str.split also takes four control characters for white space, which the tokenizer does not.
        for w in text.split(" ") if _CONTROL(text) else text.split():
            if "<|" not in w and self.plain(w):
                out += self.split(w.lower())
            else:
                out.append(" " + w)
                whole[" " + w] = b""
        if whole:
            whole.update(zip(whole, self._ids(self.t, [w[1:] for w in whole]), strict=True))
        return out, whole

    def __call__(self, texts: list[str], lot: int = 1 << 21) -> Iterator[bytes]:
        a = 0
        while a < len(texts):
            b, size, lists = a, 0, []
            while b < len(texts) and size < lot:
                lists.append(self._split(texts[b]))
                size, b = size + len(texts[b]), b + 1
            if len(self.parts) > self.most:
                self.parts.clear()
            for _, whole in lists:
                self.parts.update(whole)
            new = list(set().union(*(parts for parts, _ in lists)).difference(self.parts))
            self.parts.update(zip(new, self._ids(self.merges, new), strict=True))
            for parts, _ in lists:
                # One call looks up all parts; of a single one it would give no tuple.
                got = itemgetter(*parts)(self.parts) if len(parts) > 1 else [self.parts[x] for x in parts]
                yield b"".join(got) + self.end
            a = b


_CONTROL = re.compile("[\x1c-\x1f]").search


def _encoder(path: str, end: int) -> Encoder:
    """The worker's encoder: Python workers serve several tasks, and what one has learned of words serves the next."""
    return kept("packing", (path, end), lambda: Encoder(path, end))


def _pieces(path: str, end: int, size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path, end)
        for f in frames:
            out = {"i": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for i, ids in enumerate(encode(list(f["t"]))):
                for p in range(0, len(ids), 4 * size):
                    part = ids[p : p + 4 * size]
                    for k, v in zip(out, (i, p // (4 * size), p // 4, len(part) // 4, crc32(part)), strict=True):
                        out[k].append(v)
            g = pd.DataFrame(out)
            g.insert(0, "r", f["r"].to_numpy()[g.pop("i").to_numpy(int)])
            yield g

    return run


def pieces_of(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", size: int = 4096, end: int = 1) -> DataFrame:
    """``key``, piece, start, length, ids_crc32 of each document's ids; only documents over ``size`` are cut.

    A null or empty text has the end id alone.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("r"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    got = rows.mapInPandas(tidy("packing", _pieces(path, end, size)), f"r {kind}, piece int, start long, length long, ids_crc32 long")
    return got.withColumnRenamed("r", key)


def op6(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(pieces_of(docs, path or public_tokenizers.path("word_bpe_49k.json")), 4096)
