"""Spatial predictors on unsigned patterns modulo 2^(8 size): residuals of causal neighbours, and back.

Encoding takes all neighbours from one window by (tile, row-major place). Decoding by prefix sums uses
windows too; the recurrences that a sum can't express run per tile, by anti-diagonals or rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.functions.types import UNSIGNED, modulus


def _mod(c: Column, size: int) -> Column:
    return c.bitwiseAND(F.lit(modulus(size) - 1))


def neighbours(px: DataFrame, width: int) -> DataFrame:
    """Adds w, n, nw, ne, nn; 0 beyond the edges. One shuffle and one sort, whatever is asked for."""
    w = W.partitionBy("tile").orderBy("k")
    d = px.withColumn("k", F.col("y") * width + F.col("x"))
    lag = lambda by, ok: F.when(ok, F.lag("v", by).over(w)).otherwise(F.lit(0))
    x, y = F.col("x"), F.col("y")
    d = d.withColumns({"w": lag(1, x > 0), "n": lag(width, y > 0), "nw": lag(width + 1, (x > 0) & (y > 0)), "ne": lag(width - 1, (y > 0) & (x < width - 1)) if width > 1 else F.lit(0), "nn": lag(2 * width, y > 1)})
    return d.drop("k")


def _clamped() -> Column:
    lo, hi = F.least("w", "n"), F.greatest("w", "n")
    return F.when(F.col("nw") >= hi, lo).when(F.col("nw") <= lo, hi).otherwise(F.col("w") + F.col("n") - F.col("nw"))


def fixed(c: tuple[int, int, int, int], shift: int) -> Column:
    """W plus a rounded, shifted sum of coefficients times N, NW, NE and NN."""
    s = F.col("n") * c[0] + F.col("nw") * c[1] + F.col("ne") * c[2] + F.col("nn") * c[3]
    return F.col("w") + F.shiftright(s + ((1 << (shift - 1)) if shift else 0), shift)


PREDICTIONS = {
    "delta_w": lambda: F.col("w"),
    "delta_n": lambda: F.col("n"),
    "planar": lambda: F.col("w") + F.col("n") - F.col("nw"),
    "med": _clamped,
    "average": lambda: F.shiftright(F.col("w") + F.col("n"), 1),
}


def encode(px: DataFrame, name: str, width: int, size: int = 2, coefficients: tuple = (1, -1, 0, 0), shift: int = 0) -> DataFrame:
    """(tile, y, x, r): residuals of a predictor. v has to be an unsigned pattern of ``size`` bytes (below 8)."""
    if name == "id":
        return px.select("tile", "y", "x", F.col("v").alias("r"))
    if name == "delta_1d":
        w = W.partitionBy("tile").orderBy("y", "x")
        return px.select("tile", "y", "x", _mod(F.col("v") - F.coalesce(F.lag("v").over(w), F.lit(0)), size).alias("r"))
    p = fixed(coefficients, shift) if name == "wp_static" else PREDICTIONS[name]()
    return neighbours(px, width).select("tile", "y", "x", _mod(F.col("v") - p, size).alias("r"))


def decode_by_sums(res: DataFrame, name: str, size: int = 2) -> DataFrame:
    """(tile, y, x, v) of delta_w, delta_n, planar and delta_1d residuals, by running sums."""
    row = W.partitionBy("tile", "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    column = W.partitionBy("tile", "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    d = res.repartition("tile")
    if name == "delta_1d":
        d = d.withColumn("v", F.sum("r").over(W.partitionBy("tile").orderBy("y", "x").rowsBetween(W.unboundedPreceding, 0)))
    elif name == "planar":
        d = d.withColumn("v", _mod(F.sum("r").over(row), size)).withColumn("v", F.sum("v").over(column))
    else:
        d = d.withColumn("v", F.sum("r").over(row if name == "delta_w" else column))
    return d.select("tile", "y", "x", _mod(F.col("v"), size).alias("v"))


def weighted(n: np.ndarray, nw: np.ndarray, ne: np.ndarray, nn: np.ndarray, c: tuple, shift: int) -> np.ndarray:
    """What ``fixed`` adds to W, in wrapping 64-bit sums with an arithmetic shift, as patterns of n's type."""
    half = np.int64((1 << (shift - 1)) if shift else 0)
    total = sum(np.int64(k) * x.astype(np.int64) for k, x in zip(c, (n, nw, ne, nn), strict=True)) + half
    return (total >> np.int64(shift)).astype(n.dtype)


def around(v: np.ndarray) -> tuple[np.ndarray, ...]:
    """W, N, NW, NE and NN of a (rows, width) block; 0 beyond the edges."""
    p = np.pad(v, ((2, 0), (1, 1)))
    return p[2:, :-2], p[1:-1, 1:-1], p[1:-1, :-2], p[1:-1, 2:], p[:-2, 1:-1]


def _plane_cost(z: np.ndarray) -> float:
    planes = z.reshape(-1).view(np.uint8).reshape(-1, z.itemsize)
    counts = (np.bincount(planes[:, i], minlength=256) for i in range(z.itemsize))
    return float(sum(-(c[c > 0] * np.log2(c[c > 0] / len(planes))).sum() for c in counts))


def train_block(v: np.ndarray) -> tuple[tuple[int, int, int, int], int]:
    """(coefficients, shift) for one tile of any sample size, by the rules of ``train``.

    Wide samples are scaled by their largest neighbour before the sums, and the solution has to be 0.3 %
    smaller than planar's residuals there.
    """
    wide, best, least = v.itemsize > 2, ((1, -1, 0, 0), 0), None
    if v.shape[0] < 3 or v.shape[1] < 3:
        return best
    w, *near = around(v)
    inner = [x[2:, 1:-1].reshape(-1).astype(np.float64) for x in near]
    t = v[2:, 1:-1].reshape(-1).astype(np.float64) - w[2:, 1:-1].reshape(-1).astype(np.float64)
    if wide:
        top = max(float(x.max()) for x in inner) or 1.0
        inner, t = [x / top for x in inner], t / top
    names = ["n", "nw", "ne", "nn"]
    row = {f"{names[i]}_{names[j]}": inner[i] @ inner[j] for i in range(4) for j in range(i, 4)}
    row |= {f"{names[i]}_t": inner[i] @ t for i in range(4)}
    for *c, shift in candidates(row):
        r = v - (w + weighted(*near, tuple(c), shift))
        one, top_bit = r.dtype.type(1), r.dtype.type(8 * r.itemsize - 1)
        cost = _plane_cost(np.ascontiguousarray((r << one) ^ (np.zeros_like(r) - (r >> top_bit))))
        if least is None or cost < least * (1 - 0.003 * (wide and best[1] == 0 and best[0] == (1, -1, 0, 0))):
            best, least = (tuple(c), shift), cost
    return best


def decode_block(r: np.ndarray, name: str, coefficients: tuple = (1, -1, 0, 0), shift: int = 0) -> np.ndarray:
    """A tile's samples (rows, width) from med, average or wp_static residuals, in wrapping arithmetic.

    med and average go by anti-diagonals: W, N and NW of a sample lie on the two before it. wp_static goes
    by rows: what the rows above add is known, and W is a running sum.
    """
    h, w = r.shape
    if name == "wp_static":
        out = np.zeros((h + 2, w + 2), r.dtype)
        for y in range(h):
            add = weighted(out[y + 1, 1:-1], out[y + 1, :-2], out[y + 1, 2:], out[y, 1:-1], coefficients, shift)
            out[y + 2, 1:-1] = np.cumsum(r[y] + add, dtype=r.dtype)
        return out[2:, 1:-1]
    v = np.zeros((h + 1, w + 1), r.dtype)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        a, b, c = v[y + 1, x], v[y, x + 1], v[y, x]
        if name == "med":
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            p = np.where(c >= hi, lo, np.where(c <= lo, hi, a + b - c))
        else:
            p = (a >> 1) + (b >> 1) + (a & b & 1)
        v[y + 1, x + 1] = r[y, x] + p
    return v[1:, 1:]


def decode_by_tiles(res: DataFrame, name: str, size: int = 2, coefficients: tuple = (1, -1, 0, 0), shift: int = 0) -> DataFrame:
    def tile(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x"], kind="stable")
        w = int(f["x"].max()) + 1
        r = f["r"].to_numpy().astype(UNSIGNED[size]).reshape(-1, w)
        return f.drop(columns="r").assign(v=decode_block(r, name, coefficients, shift).ravel().astype(np.int64))

    return res.groupBy("tile").applyInPandas(tile, "tile long, y long, x long, v long")


def zigzag(r: Column, size: int) -> Column:
    """Unsigned pattern to zigzag order of the signed value it stands for."""
    half = modulus(size) // 2
    return F.when(r < half, r * 2).otherwise((modulus(size) - r) * 2 - 1)


def unzigzag(z: Column, size: int) -> Column:
    return _mod(F.when(z % 2 == 0, F.shiftright(z, 1)).otherwise(-F.shiftright(z + 1, 1)), size)


def normal_equations(px: DataFrame, width: int) -> DataFrame:
    """Per tile the sums of products of N, NW, NE, NN and s - W over interior samples, exact."""
    rows = W.partitionBy("tile")
    d = neighbours(px, width).withColumn("t", F.col("v") - F.col("w")).withColumn("h", F.max("y").over(rows))
    d = d.where((F.col("y") >= 2) & (F.col("x") >= 1) & (F.col("x") < width - 1))
    f = ["n", "nw", "ne", "nn"]
    sums = {f"{a}_{b}": F.sum(F.col(a) * F.col(b)) for i, a in enumerate(f) for b in [*f[i:], "t"]}
    return d.groupBy("tile").agg(F.count("*").alias("samples"), *(c.alias(k) for k, c in sums.items()))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Ridge solution of the normal equations; None where a pivot is below 1e-12."""
    a = a + np.eye(len(a)) * (1e-6 * np.trace(a) / len(a) + 1e-9)
    m = np.hstack([a, b[:, None]])
    for i in range(len(a)):
        p = i + int(np.abs(m[i:, i]).argmax())
        if abs(m[p, i]) < 1e-12:
            return None
        m[[i, p]] = m[[p, i]]
        for j in range(i + 1, len(a)):
            m[j] -= m[i] * (m[j, i] / m[i, i])
    x = np.zeros(len(a))
    for i in range(len(a) - 1, -1, -1):
        x[i] = (m[i, -1] - m[i, i + 1 : -1] @ x[i + 1 :]) / m[i, i]
    return x


def candidates(row: dict) -> list[tuple[int, int, int, int, int]]:
    """(coefficients, shift) of planar and of the solution at shifts 0 to 8, where they fit in 16 bits."""
    f = ["n", "nw", "ne", "nn"]
    get = lambda i, j: float(row[f"{f[min(i, j)]}_{f[max(i, j)]}"])
    out = [(1, -1, 0, 0, 0)]
    x = solve(np.array([[get(i, j) for j in range(4)] for i in range(4)]), np.array([float(row[f"{k}_t"]) for k in f]))
    for shift in range(9) if x is not None else ():
        c = [int(np.copysign(np.floor(abs(v) * 2.0**shift + 0.5), v)) for v in x]
        if all(-32768 <= v <= 32767 for v in c):
            out.append((*c, shift))
    return out


def plane_bits(df: DataFrame, keys: list[str], z: Column, planes: int) -> DataFrame:
    """Sum over byte planes of order-0 bits of z, per keys."""
    lanes = F.array(*(F.struct(F.lit(i).alias("plane"), F.shiftright(z, 8 * i).bitwiseAND(F.lit(255)).alias("b")) for i in range(planes)))
    c = df.select(*keys, F.explode(lanes).alias("e")).groupBy(*keys, "e.plane", "e.b").count()
    n = F.sum("count").over(W.partitionBy(*keys, "plane"))
    return c.withColumn("p", F.col("count") / n).groupBy(*keys).agg(F.sum(-F.col("count") * F.log2("p")).alias("bits"))


def train(px: DataFrame, width: int, size: int = 2) -> DataFrame:
    """Per tile the best candidate: (tile, shift, c_n, c_nw, c_ne, c_nn, bits). For 1 and 2 byte samples.

    The candidates of all tiles are scored in one pass; ties go to the earlier one. Tiles without interior
    samples take planar.
    """
    from rasterloom.functions.types import modulus as m

    def propose(frames):
        for f in frames:
            rows = [(r["tile"], i, *c) for r in f.to_dict("records") for i, c in enumerate(candidates(r))]
            yield pd.DataFrame(rows, columns=["tile", "cand", "c_n", "c_nw", "c_ne", "c_nn", "shift"])

    shape = "tile long, cand int, c_n int, c_nw int, c_ne int, c_nn int, shift int"
    some = normal_equations(px, width).mapInPandas(propose, shape)
    none = px.select("tile").distinct().join(some, "tile", "left_anti").select("tile", *(F.lit(v).alias(c) for c, v in (("cand", 0), ("c_n", 1), ("c_nw", -1), ("c_ne", 0), ("c_nn", 0), ("shift", 0))))
    cand = some.unionByName(none)
    d = neighbours(px, width).join(cand, "tile")
    s = F.col("n") * F.col("c_n") + F.col("nw") * F.col("c_nw") + F.col("ne") * F.col("c_ne") + F.col("nn") * F.col("c_nn")
    half = F.when(F.col("shift") > 0, F.pow(F.lit(2.0), F.col("shift") - 1).cast("long")).otherwise(F.lit(0))
    k = F.call_function("shiftright", s + half, F.col("shift"))
    d = d.withColumn("r", (F.col("v") - F.col("w") - k).bitwiseAND(F.lit(m(size) - 1)))
    keys = ["tile", "cand", "c_n", "c_nw", "c_ne", "c_nn", "shift"]
    bits = plane_bits(d, keys, zigzag(F.col("r"), size), 2)
    best = bits.groupBy("tile").agg(F.min(F.struct(F.round("bits", 6).alias("bits"), "cand", "shift", "c_n", "c_nw", "c_ne", "c_nn")).alias("b"))
    return best.select("tile", "b.shift", "b.c_n", "b.c_nw", "b.c_ne", "b.c_nn", "b.bits")
