"""Bin tables: a value is a bin and an offset from the bin's lower end.

Tables are cut per tile in three steps: count the values, group them into bins of about equal counts, then
merge neighbouring bins where that costs fewer bits. Counting is a grouped aggregate; a tile's distinct
values, never more than its samples, are what the other steps see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits a sample that one bin, or a bin for each value, may cost more than the best table.
WORTH = 0.1


@dataclass(frozen=True)
class Table:
    """Sorted lower ends, the lowest not over any value, and bits of the offsets from them."""

    lowers: tuple[int, ...]
    bits: tuple[int, ...]

    def find(self, v: np.ndarray) -> np.ndarray:
        return (np.searchsorted(np.array(self.lowers, np.uint64), v.astype(np.uint64), "right") - 1).astype(np.uint8)

    def join(self, which: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Values again; refuses a bin that is not in the table, or an offset over its bits."""
        if (which >= len(self.lowers)).any():
            raise ValueError("no such bin")
        bits = np.array(self.bits, np.uint64)[which]
        most = np.where(bits == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
        if (off.astype(np.uint64) > most).any():
            raise ValueError("an offset does not fit its bin")
        return np.array(self.lowers, np.uint64)[which].astype(off.dtype) + off


def powers(size: int) -> Table:
    """Bins by bit length, for samples of a size."""
    return Table((0, *(1 << b for b in range(8 * size))), (0, *range(8 * size)))


def fine(values: np.ndarray, counts: np.ndarray, log: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowers, uppers, counts) of at most 2^log bins of sorted distinct values.

    A bin ends with the value that holds its last place, places being shared out evenly. Values are never
    divided: one that crosses ends goes where its middle lies, and closes the bin that is open before it;
    with none open, it is a bin of its own.
    """
    if not len(values):
        return values, values, counts
    after = np.cumsum(counts, dtype=np.int64)
    n, k = int(after[-1]), 1 << log
    of = lambda place: place * k // n
    end = lambda b: -(-(b + 1) * n // k)
    ends: list[int] = []  # a bin holds the values up to here
    i, opened, free = 0, 0, 0
    while i < len(values):
        before = int(after[i]) - int(counts[i])
        goal = end(of(before))
        j = int(np.searchsorted(after, goal))
        if goal == n:
            ends.append(len(values))
            break
        b = of(int(after[j]) - int(counts[j]) + int(counts[j]) // 2)
        if b > free:
            if j > opened:
                ends.append(j)
                opened, free = j, b
            else:
                b -= 1
        if int(after[j]) >= end(b):
            ends.append(j + 1)
            opened, free = j + 1, b + 1
        i = j + 1
    stop = np.array(ends, np.int64)
    first = np.concatenate([[0], stop[:-1]]).astype(np.int64)
    total = np.concatenate([[0], after])
    return values[first], values[stop - 1], total[stop] - total[first]


def _length(x: np.ndarray) -> np.ndarray:
    return np.array([int(v).bit_length() for v in np.atleast_1d(x)], np.int64)


def merge(lowers: np.ndarray, uppers: np.ndarray, counts: np.ndarray, meta: float, most: int = 255) -> Table:
    """The table of least bits over all ways to join neighbouring bins.

    A bin costs ``meta`` bits, and each of its samples the bits of its share and of an offset. A single bin,
    else the given bins where each holds one value, is taken where that costs less than 0.1 bit a sample
    over the least. Bins beyond ``most`` join the last.
    """
    n = len(lowers)
    if not n:
        return Table((0,), (0,))
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    lo, hi = [int(x) for x in lowers], [int(x) for x in uppers]
    cost = lambda c, bits: meta + (np.log2(total[-1]) - np.log2(c) + bits) * c
    best, source = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    for i in range(1, n + 1):
        bits = np.array([(hi[i - 1] - x).bit_length() for x in lo[:i]])
        each = (best[:i] + cost(total[i] - total[:i], bits))[::-1]
        source[i], best[i] = i - 1 - int(each.argmin()), each.min()
    allowed = best[n] + WORTH * total[-1]
    if cost(total[-1], (hi[-1] - lo[0]).bit_length()) < allowed:
        starts = [0]
    elif lo == hi and sum(cost(float(c), 0) for c in counts) < allowed:
        starts = list(range(n))
    else:
        starts, i = [], n
        while i:
            i = int(source[i])
            starts.insert(0, i)
    starts = starts[:most]
    stops = [*starts[1:], n]
    return Table(tuple(lo[s] for s in starts), tuple((hi[e - 1] - lo[s]).bit_length() for s, e in zip(starts, stops, strict=True)))


def pack(v: np.ndarray, table: Table) -> tuple[np.ndarray, bytes]:
    """(bins, offsets) with each offset in its bin's bits, low bits first."""
    which = table.find(v)
    off = v.astype(np.uint64) - np.array(table.lowers, np.uint64)[which]
    bits = np.array(table.bits, np.int64)[which]
    kept = np.arange(64) < bits[:, None]
    flat = np.unpackbits(np.ascontiguousarray(off.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return which, np.packbits(flat[kept], bitorder="little").tobytes()


def unpack(which: np.ndarray, packed: bytes, table: Table, size: int) -> np.ndarray:
    """Values again; refuses bins that are not in the table and bytes that end too early."""
    if (which >= len(table.lowers)).any() or max(table.bits) > 8 * size:
        raise ValueError("no such bin")
    bits = np.array(table.bits, np.int64)[which]
    if (int(bits.sum()) + 7) // 8 > len(packed):
        raise ValueError("packed offsets end too early")
    flat = np.zeros((len(which), 64), np.uint8)
    flat[np.arange(64) < bits[:, None]] = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[: int(bits.sum())]
    off = np.packbits(flat, axis=1, bitorder="little").view("<u8").reshape(-1)
    return (np.array(table.lowers, np.uint64)[which] + off).astype(f"u{size}")


def _counted(px: DataFrame) -> DataFrame:
    return px.groupBy("tile", "v").agg(F.count("*").alias("c"))


def histogram(px: DataFrame, log: int) -> DataFrame:
    """(tile, bin, lower, upper, c): bins of about equal counts per tile."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("v")
        lo, hi, c = fine(f["v"].to_numpy(), f["c"].to_numpy(), log)
        return pd.DataFrame({"tile": f["tile"].iloc[0], "bin": np.arange(len(lo)), "lower": lo, "upper": hi, "c": c})

    return _counted(px).groupBy("tile").applyInPandas(run, "tile long, bin long, lower long, upper long, c long")


def tables(px: DataFrame, log: int, meta: float) -> DataFrame:
    """(tile, bin, lower, bits): each tile's merged table."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("v")
        t = merge(*fine(f["v"].to_numpy(), f["c"].to_numpy(), log), meta)
        return pd.DataFrame({"tile": f["tile"].iloc[0], "bin": np.arange(len(t.lowers)), "lower": t.lowers, "bits": t.bits})

    return _counted(px).groupBy("tile").applyInPandas(run, "tile long, bin long, lower long, bits int")


def packed_tiles(tiles: DataFrame, log: int, meta: float) -> DataFrame:
    """(tile, width, size, lowers, bits, bins, packed) of tiles, each by its own table."""

    def run(frames):
        for f in frames:
            rows = []
            for t, e, w, data in zip(f["tile"], f["elt"], f["width"], f["data"], strict=True):
                v = np.frombuffer(data, f"<u{e}")
                values, counts = np.unique(v, return_counts=True)
                table = merge(*fine(values, counts, log), meta)
                which, packed = pack(v, table)
                signed = np.array(table.lowers, np.uint64).view(np.int64).tolist()
                rows.append((t, w, e, signed, list(table.bits), which.tobytes(), packed))
            yield pd.DataFrame(rows, columns=["tile", "width", "size", "lowers", "bits", "bins", "packed"])

    return tiles.mapInPandas(run, "tile long, width long, size int, lowers array<long>, bits array<int>, bins binary, packed binary")


def unpacked_tiles(packed: DataFrame) -> DataFrame:
    """Tiles again: (tile, width, data)."""

    def run(frames):
        for f in frames:
            data = []
            for size, lowers, bits, which, p in zip(f["size"], f["lowers"], f["bits"], f["bins"], f["packed"], strict=True):
                table = Table(tuple(np.array(lowers, np.int64).view(np.uint64).tolist()), tuple(int(b) for b in bits))
                data.append(unpack(np.frombuffer(which, np.uint8), p, table, int(size)).tobytes())
            yield pd.DataFrame({"tile": f["tile"], "width": f["width"], "data": data})

    return packed.mapInPandas(run, "tile long, width long, data binary")
