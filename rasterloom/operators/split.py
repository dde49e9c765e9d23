"""Lossless splits of one stream into two, holes, byte lanes and routing."""

from __future__ import annotations

from collections.abc import Iterator

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def deinterleave(df: DataFrame) -> DataFrame:
    """(lane, i, v) of (k, v): even places to lane 0, odd ones to lane 1."""
    return df.select((F.col("k") % 2).alias("lane"), F.floor(F.col("k") / 2).alias("i"), "v")


def interleave(df: DataFrame) -> DataFrame:
    return df.select((F.col("i") * 2 + F.col("lane")).alias("k"), "v")


def intmult(v: Column, base: int) -> tuple[Column, Column]:
    if base < 2:
        raise ValueError("base has to be 2 or more")
    return ((v - v % base) / base).cast("long"), v % base


def bit_length(v: Column) -> Column:
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(v))).cast("long")


def binoffset(v: Column) -> tuple[Column, Column]:
    """Bit length and the value without its top bit."""
    b = bit_length(v)
    return b, F.when(v == 0, F.lit(0)).otherwise(v - F.call_function("shiftleft", F.lit(1).cast("long"), (b - 1).cast("int"))).cast("long")


def binoffset_join(bin_: Column, offset: Column) -> Column:
    """lower[bin] + offset; null where the offset does not fit its bin."""
    lower = F.when(bin_ == 0, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (bin_ - 1).cast("int"))).cast("long")
    return F.when((offset < F.greatest(lower, F.lit(1))) & (bin_ >= 0), lower + offset)


def by_table(df: DataFrame, lowers: list[int]) -> DataFrame:
    """Adds bin and offset by a sorted table of lower ends, that is an array in the expression."""
    t = F.array(*(F.lit(x).cast("long") for x in sorted(lowers)))
    b = F.size(F.filter(t, lambda x: x <= F.col("v"))) - 1
    return df.withColumn("bin", b.cast("long")).withColumn("offset", F.col("v") - F.get(t, b))


def order_key(u: np.ndarray) -> np.ndarray:
    """Float patterns to integers in the values' order."""
    top = np.array(1, u.dtype) << np.array(8 * u.dtype.itemsize - 1, u.dtype)
    return np.where(u & top, ~u, u ^ top)


def from_order_key(k: np.ndarray) -> np.ndarray:
    top = np.array(1, k.dtype) << np.array(8 * k.dtype.itemsize - 1, k.dtype)
    return np.where(k & top, k ^ top, ~k)


def floatquant(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """High bits of the order key, and its low k bits, turned for negatives."""
    key = order_key(x.view(f"u{x.dtype.itemsize}"))
    low = (np.array(1, key.dtype) << np.array(k, key.dtype)) - 1
    return key >> k, np.where(np.signbit(x), low - (key & low), key & low)


def floatquant_join(high: np.ndarray, low: np.ndarray, k: int, dtype: str) -> np.ndarray:
    if (low >> k).any():
        raise ValueError("a low part is over its bits")
    one = (np.array(1, high.dtype) << np.array(k, high.dtype)) - 1
    top = np.array(1, high.dtype) << np.array(8 * high.dtype.itemsize - 1, high.dtype)
    negative = ((high << k) & top) == 0
    return from_order_key((high << k) | np.where(negative, one - low, low)).view(dtype)


def floatmult(x: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Multiples of base as floats, and the distance in order keys between x and the multiple, wrapping."""
    b = x.dtype.type(base)
    t = x * (x.dtype.type(1) / b)
    m = np.where(np.isfinite(x), np.copysign(np.floor(np.abs(t) + x.dtype.type(0.5)), t), 0).astype(x.dtype)
    u = f"u{x.dtype.itemsize}"
    return m, order_key(x.view(u)) - order_key((m * b).view(u))


def floatmult_join(m: np.ndarray, off: np.ndarray, base: float) -> np.ndarray:
    u = off.dtype
    return from_order_key(order_key((m * m.dtype.type(base)).view(u)) + off).view(m.dtype)


def float_round_trip(px: DataFrame, how: str, parameter: float) -> DataFrame:
    """Splits values (float64) and joins them again; also gives both parts as longs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = f["v"].to_numpy(np.float64)
            if how == "floatquant":
                a, b = floatquant(x, int(parameter))
                back = floatquant_join(a, b, int(parameter), "f8")
                a = a.view(np.int64)
            else:
                a, b = floatmult(x, parameter)
                back = floatmult_join(a, b, parameter)
                a = a.astype(np.int64)
            yield f.assign(primary=a, secondary=b.view(np.int64), v=back)

    return px.mapInPandas(run, "tile long, y long, x long, v double, primary long, secondary long")


def mark(px: DataFrame, sentinel: float | None) -> DataFrame:
    """Adds ``valid``: not the sentinel's bits (0.0 is not -0.0), or not NaN where there is none; infinities are values."""
    hole = F.isnan("v") if sentinel is None else (F.col("v") == F.lit(sentinel))
    if sentinel == 0 and px.schema["v"].dataType.typeName() in ("float", "double"):
        hole &= (F.col("v").cast("string") == "-0.0") == F.lit(math.copysign(1.0, sentinel) < 0)
    return px.withColumn("valid", ~hole)


def fill(marked: DataFrame) -> DataFrame:
    """Holes take the last valid sample of their row, else the filled one above, else 0."""
    d = marked.repartition("tile").withColumn("g", F.when(F.col("valid"), F.col("v")))
    row = W.partitionBy("tile", "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    column = W.partitionBy("tile", "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("g", F.last("g", True).over(row)).withColumn("g", F.last("g", True).over(column))
    return d.select("tile", "y", "x", F.coalesce("g", F.lit(0.0)).alias("v"), "valid")


def restore(filled: DataFrame, pattern: float) -> DataFrame:
    return filled.select("tile", "y", "x", F.when(F.col("valid"), F.col("v")).otherwise(F.lit(pattern)).alias("v"))


def wire_code(marked: DataFrame, elt: int) -> DataFrame:
    """Per tile: 1 restore, 2 all valid, 3 all hole; and the bytes of its header."""
    d = marked.groupBy("tile").agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("long")).alias("valid"))
    code = F.when(F.col("valid") == F.col("n"), 2).when(F.col("valid") == 0, 3).otherwise(1)
    return d.select("tile", "n", "valid", code.alias("code"), F.when(code == 2, 1).when(code == 3, 9 + elt).otherwise(1 + elt).alias("header_bytes"))


def byte_lanes(df: DataFrame, keys: list[str], v: Column, size: int) -> DataFrame:
    """Little-endian byte planes: keys, lane, b."""
    e = F.array(*(F.struct(F.lit(i).alias("lane"), F.shiftright(v, 8 * i).bitwiseAND(F.lit(255)).alias("b")) for i in range(size)))
    return df.select(*keys, F.explode(e).alias("e")).select(*keys, "e.lane", "e.b")


def entropy(df: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Per keys: samples and order-0 bits per sample."""
    c = df.groupBy(*keys, symbol).agg(F.count("*").alias("c"))
    t = c.groupBy(*keys).agg(F.sum("c").alias("samples"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return t.select(*keys, "samples", F.round(F.log2("samples") - F.col("s") / F.col("samples"), 6).alias("bits"))


def route(px: DataFrame) -> DataFrame:
    """Per tile the dominant class's share and the arm it takes: constant, field_lz or entropy."""
    c = px.groupBy("tile", "v").agg(F.count("*").alias("c")).groupBy("tile").agg(F.max("c").alias("hits"), F.sum("c").alias("n"))
    arm = F.when(F.col("hits") == F.col("n"), "constant").when(F.col("hits") > F.lit(0.95) * F.col("n"), "field_lz").otherwise("entropy")
    return c.select("tile", "n", "hits", arm.alias("arm"))
