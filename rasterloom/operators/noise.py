"""Sensor noise curve sigma^2 = a + b x, fitted blind over a product."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.sources import rasters

# Block side, bins, least blocks in a bin, least bins, quantile, bias of the quantile.
BLOCK, BINS, PER_BIN, LEAST_BINS, QUANTILE, BIAS = 8, 24, 12, 4, 0.10, 0.624732
#: Side of the cells that blocks are cut in.
SIDE = 32 * BLOCK


def blocks(px: DataFrame, width: int) -> DataFrame:
    """(tile, by, bx, mu, s2) of 8 x 8 blocks of the interior: mean, and variance from a 3 x 3 response.

    Blocks with a missing, repeated or non-finite sample or response, and rasters with a side under 10, give none.
    The raster is cut into cells of whole blocks with the pixels around them, so a task holds one cell.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        tile, cy, cx = (int(f[c].iloc[0]) for c in ("tile", "cy", "cx"))
        at = np.frombuffer(b"".join(f["at"]), "<u4")
        high, wide = int(at.max()) // (SIDE + 2) + 1, min(SIDE + 2, width - cx * SIDE)
        n, m = max(0, (high - 2) // BLOCK), max(0, (wide - 2) // BLOCK)
        g = np.full(high * (SIDE + 2), np.nan)
        g[at] = np.frombuffer(b"".join(f["v"]), "<f8")
        g[np.bincount(at, minlength=len(g)) > 1] = np.nan
        g = g.reshape(high, SIDE + 2)[: n * BLOCK + 2, : m * BLOCK + 2] if n and m else np.empty((2, 2))
        near = lambda dy, dx: g[1 + dy : g.shape[0] - 1 + dy, 1 + dx : g.shape[1] - 1 + dx]
        by_block = lambda c: c.reshape(n, BLOCK, m, BLOCK).swapaxes(1, 2).reshape(n * m, BLOCK * BLOCK)
        with np.errstate(all="ignore"):
            v, r = near(0, 0), near(-1, 0) + near(1, 0) + near(0, -1) + near(0, 1)
            r = 4 * v - 2 * r + (near(-1, -1) + near(-1, 1) + near(1, -1) + near(1, 1))
            v, r = by_block(v), by_block(r)
            ok = (np.isfinite(v) & np.isfinite(r)).all(1)
            out = {"mu": v.sum(1) / 64, "s2": (r * r).sum(1) / (36 * 64) / BIAS}
        by, bx = np.divmod(np.arange(n * m), max(1, m))
        return pd.DataFrame({"tile": tile, "by": cy * SIDE // BLOCK + by, "bx": cx * SIDE // BLOCK + bx, **out})[ok]

    d = rasters.cells(px.withColumn("v", F.col("v").cast("double")), SIDE, SIDE, 2, "f64")
    return d.groupBy("tile", "cy", "cx").applyInPandas(run, "tile long, by long, bx long, mu double, s2 double")


def _bins(b: DataFrame) -> DataFrame:
    """``bins`` with the number of all blocks beside each. The blocks are read twice: for their range, and for the bins."""
    r = b.agg(F.min("mu").alias("lo"), F.max("mu").alias("hi"), F.count("*").alias("blocks"))
    d = b.crossJoin(F.broadcast(r))  # one row
    edge: Column = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda t: F.col("lo") + (F.col("hi") - F.col("lo")) * t / F.lit(BINS) <= F.col("mu")))
    d = d.where("hi > lo").withColumn("bin", edge)
    d = d.withColumn("c", F.count("*").over(W.partitionBy("bin"))).withColumn("rank", F.row_number().over(W.partitionBy("bin").orderBy("s2", "mu", "tile", "by", "bx")))
    d = d.where(F.col("c") >= PER_BIN)
    return d.groupBy("bin", "c", "blocks").agg(F.avg("mu").alias("mu"), F.max(F.when(F.col("rank") == 1 + F.floor(F.lit(QUANTILE) * F.col("c")), F.col("s2"))).alias("s2"))


def bins(b: DataFrame) -> DataFrame:
    """(bin, c, mu, s2) of bins with enough blocks: their mean, and the low quantile of variance.

    The range's ends are two scalars; a bin's blocks are ordered within it, by approximate position counts
    no more than its blocks.
    """
    return _bins(b).drop("blocks")


def fit(b: DataFrame) -> DataFrame:
    """One row (a, b, blocks, bins, range, colin, resid); none where the curve can't be told."""
    g = _bins(b).withColumn("w", F.col("c").cast("double"))
    s = g.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("mu")).alias("x"), F.sum(F.col("w") * F.col("s2")).alias("y"), F.sum(F.col("w") * F.col("mu") * F.col("mu")).alias("xx"), F.sum(F.col("w") * F.col("mu") * F.col("s2")).alias("xy"), F.count("*").alias("bins"), F.min_by("mu", "bin").alias("first"), F.max_by("mu", "bin").alias("last"), F.max("blocks").alias("blocks"), F.array_sort(F.collect_list(F.struct("bin", "mu", "s2"))).alias("all"))
    slope = (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("w") * F.col("xx") - F.col("x") * F.col("x"))
    s = s.withColumn("b", slope).withColumn("a", F.greatest(F.lit(0.0), (F.col("y") - F.col("b") * F.col("x")) / F.col("w")))
    s = s.withColumn("mean", F.col("x") / F.col("w")).withColumn("var", F.col("xx") / F.col("w") - F.col("mean") * F.col("mean"))
    over = lambda f: F.aggregate("all", F.lit(0.0), lambda t, e: t + f(e))  # noqa: E731  of BINS rows at most
    s = s.withColumn("resid", F.sqrt(over(lambda e: F.pow(e["s2"] - F.col("a") - F.col("b") * e["mu"], F.lit(2.0))) / over(lambda e: e["s2"] * e["s2"])))
    out = s.where((F.col("bins") >= LEAST_BINS) & (F.col("blocks") >= LEAST_BINS * PER_BIN) & (F.col("b") > 0))
    return out.select("a", "b", "blocks", "bins", (F.col("last") / F.col("first")).alias("range"), (F.abs("mean") / F.sqrt("var")).alias("colin"), "resid")


def recipe(a: float, b: float, k: float, values: bool = False) -> str:
    return f"SQRT:MAX_ERROR={k:.17g}N,A={a:.17g},B={b:.17g}" + ",STORE=VALUES" * values
