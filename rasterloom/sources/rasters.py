"""Rasters as rows (tile, y, x, v), from any table with a dense key, and as one row per tile."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.types import BY_NAME, NUMPY, half_bits


def pixels(df: DataFrame, key: str, value: Column, width: int, rows: int) -> DataFrame:
    """Row-major samples of tiles of width x rows, by a key that counts from 0."""
    if width < 1 or rows < 1:
        raise ValueError("width and rows have to be 1 or more")
    k = F.col(key)
    return df.select(F.floor(k / (width * rows)).alias("tile"), F.floor(k % (width * rows) / width).alias("y"), (k % width).alias("x"), value.alias("v"))


def u16(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return pixels(o, "o_orderkey", F.floor("o_totalprice").cast("long").bitwiseAND(F.lit(65535)), 100, 15)


def cents(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return pixels(o, "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long"), 100, 15)


def skewed(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return pixels(o, "o_orderkey", (F.col("o_totalprice") > 490000).cast("long"), 100, 15)


def scene(spark: SparkSession, d: str) -> DataFrame:
    """All orders as one raster of width 300, for the noise curve."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.lit(0).cast("long").alias("tile"), F.floor(F.col("o_orderkey") / 300).alias("y"), (F.col("o_orderkey") % 300).alias("x"), F.floor("o_totalprice").cast("long").alias("v"))


def f64(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark.read.parquet(f"{d}/events.parquet"), "event_id", F.col("value"), 50, 20)


def classes(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("click", "error", "purchase", "signup", "view")))
    kind = F.array_position(names, F.col("event_type")).cast("long")
    return pixels(spark.read.parquet(f"{d}/events.parquet"), "event_id", kind, 50, 20)


def holed(spark: SparkSession, d: str) -> DataFrame:
    """Event values with the sentinel -9999 where the event is an error."""
    v = F.when(F.col("event_type") == "error", F.lit(-9999.0)).otherwise(F.col("value"))
    return pixels(spark.read.parquet(f"{d}/events.parquet"), "event_id", v, 50, 20)


def noisy(spark: SparkSession, d: str) -> DataFrame:
    """A raster of width 150, ten pixels from each order: a ramp with noise of variance 100 + signal."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    k = F.col("o_orderkey") * 10 + F.col("i")
    signal = F.lit(500.0) + 20 * (F.floor(k / 150) % 100)
    share = (F.col("c") * (F.col("i") + 1) * 7919) % 1000 / F.lit(1000.0) - F.lit(0.5)
    return o.select(F.lit(0).cast("long").alias("tile"), F.floor(k / 150).alias("y"), (k % 150).alias("x"), F.floor(signal + F.sqrt(signal + 100) * share * F.lit(3.4641016151377544)).cast("long").alias("v"))


def lanes(spark: SparkSession, d: str) -> DataFrame:
    """Two lanes (k, v) interleaved: prices at even places, customers at odd ones."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.explode(F.array(F.struct((F.col("o_orderkey") * 2).alias("k"), F.col("o_totalprice").alias("v")), F.struct((F.col("o_orderkey") * 2 + 1).alias("k"), F.col("o_custkey").cast("double").alias("v")))).alias("e")).select("e.*")


def cells(px: DataFrame, rows: int, columns: int, rim: int, dtype: str) -> DataFrame:
    """Pixels by cells of rows x columns, each with the first rim rows and columns of the next ones: (tile, cy, cx, at, v).

    A row holds what one batch has of a cell: row-major places in it (4 bytes each) and samples, as bytes. So far
    fewer rows are moved than there are pixels where a raster's neighbours are read together.
    """
    high, wide = rows + rim, columns + rim
    if rim > min(rows, columns) or high * wide > 2**32:
        raise ValueError("cells are smaller than their rim, or too large")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, y, x, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "y", "x", "v"))
            v = _samples(v, dtype)
            for dy, dx in product((0, 1) if rim else (0,), repeat=2):
                cy, cx = y // rows - dy, x // columns - dx
                ly, lx = y - cy * rows, x - cx * columns
                k = np.flatnonzero((cy >= 0) & (cx >= 0) & (ly < high) & (lx < wide))
                if not len(k):
                    continue
                k = k[np.lexsort((cx[k], cy[k], t[k]))]
                key = [c[k] for c in (t, cy, cx)]
                at, data = (ly[k] * wide + lx[k]).astype("<u4"), v[k]
                starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in key], axis=0)])
                ends = [*starts[1:], len(k)]
                packed = [pa.array([c[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()) for c in (at, data)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[starts]) for c in key), *packed], ["tile", "cy", "cx", "at", "v"])

    return px.select(*(F.col(c).cast("long").alias(c) for c in ("tile", "y", "x")), "v").mapInArrow(run, "tile long, cy long, cx long, at binary, v binary")


def _samples(v: np.ndarray, dtype: str) -> np.ndarray:
    return half_bits(v) if dtype == "f16" else v.astype(np.dtype(NUMPY[dtype]).newbyteorder("<"))


def to_tiles(px: DataFrame, dtype: str) -> DataFrame:
    """One row per tile: (tile, dtype, elt, width, n, data), data little-endian and row-major.

    A tile is a unit of work, held whole by one task. Its pixels have to be there once each, up to its last row,
    which may be short; a tile with a missing or repeated one is refused.
    """
    kind = BY_NAME[dtype]

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x"], kind="stable")
        width = int(f["x"].max()) + 1
        if (f["y"].to_numpy() * width + f["x"].to_numpy() != np.arange(len(f))).any():
            raise ValueError(f"tile {f['tile'].iloc[0]} has a missing or repeated pixel")
        data = _samples(f["v"].to_numpy(), dtype)
        return pd.DataFrame({"tile": [f["tile"].iloc[0]], "dtype": [kind.code], "elt": [kind.size], "width": [width], "n": [len(f)], "data": [data.tobytes()]})

    return px.groupBy("tile").applyInPandas(pack, "tile long, dtype int, elt int, width long, n long, data binary")


def to_strips(px: DataFrame, dtype: str, width: int, rows: int) -> DataFrame:
    """As ``to_tiles``, for rasters too large for one task: each strip of so many rows is a tile, tile * 2^32 + strip.

    Pixels are refused as there, over the whole raster: a missing strip is missing pixels.
    """
    kind, most = BY_NAME[dtype], rows * width
    sizes = px.groupBy("tile").agg(F.count("*").alias("pixels"), F.max(F.col("y") * width + F.col("x")).alias("last"))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        tile, strip, cx, pixels, last = (int(f[c].iloc[0]) for c in ("tile", "cy", "cx", "pixels", "last"))
        at, n = np.frombuffer(b"".join(f["at"]), "<u4"), min(most, last + 1 - strip * most)
        if cx or pixels != last + 1 or len(at) != n or (np.bincount(at, minlength=n) != 1).any():
            raise ValueError(f"tile {tile} has a missing or repeated pixel")
        samples = np.frombuffer(b"".join(f["v"]), f"<u{kind.size}")
        data = np.empty_like(samples)
        data[at] = samples
        return pd.DataFrame({"tile": [(tile << 32) + strip], "dtype": [kind.code], "elt": [kind.size], "width": [width], "n": [n], "data": [data.tobytes()]})

    strips = cells(px, rows, width, 0, dtype).join(F.broadcast(sizes), "tile")  # one row a raster
    return strips.groupBy("tile", "cy", "cx").applyInPandas(pack, "tile long, dtype int, elt int, width long, n long, data binary")


def from_strips(px: DataFrame, rows: int) -> DataFrame:
    """The pixels of rasters from those of their strips."""
    strip = F.col("tile").bitwiseAND(F.lit(2**32 - 1))
    return px.select(F.shiftright("tile", 32).alias("tile"), (F.col("y") + strip * rows).alias("y"), "x", "v")


def from_tiles(tiles: DataFrame, dtype: str) -> DataFrame:
    """The pixels of tiles; unsigned 64-bit values beyond a long are refused."""
    whole = BY_NAME[dtype].integer

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By Arrow: by way of pandas a NaN would come out as a null.
        for b in batches:
            for t, w, data in zip(*(b.column(c).to_pylist() for c in ("tile", "width", "data")), strict=True):
                v = np.frombuffer(data, np.dtype(NUMPY[dtype]).newbyteorder("<"))
                if dtype == "u64" and (v >> np.uint64(63)).any():
                    raise ValueError(f"tile {t} has values beyond a long")
                k = np.arange(len(v))
                columns = [np.full(len(v), t), k // w, k % w, v.astype(np.int64 if whole else np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tile", "y", "x", "v"])

    return tiles.select("tile", "width", "data").mapInArrow(unpack, f"tile long, y long, x long, v {'long' if whole else 'double'}")
