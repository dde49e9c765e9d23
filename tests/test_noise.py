"""Blocks of rasters larger than a cell against numpy, in any order of pixels and around missing and repeated ones; strips."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import noise, quantise
from rasterloom.plans import catalogue, graph
from rasterloom.sources import rasters


def raster(spark, v, tile=0):
    y, x = np.indices(v.shape)
    k = np.random.default_rng(2).permutation(v.size)
    return spark.createDataFrame([(tile, int(a), int(b), float(c)) for a, b, c in zip(y.ravel()[k], x.ravel()[k], v.ravel()[k], strict=True)], "tile long, y long, x long, v double")


def plain(v):
    """{(by, bx): (mu, s2)} by one loop over blocks."""
    out = {}
    for by in range((v.shape[0] - 2) // 8):
        for bx in range((v.shape[1] - 2) // 8):
            g = v[8 * by : 8 * by + 10, 8 * bx : 8 * bx + 10]
            r = np.diff(np.diff(g, 2, axis=0), 2, axis=1)
            if np.isfinite(g[1:-1, 1:-1]).all() and np.isfinite(r).all():
                out[by, bx] = g[1:-1, 1:-1].mean(), (r * r).mean() / 36 / noise.BIAS
    return out


def held(px, v, width=None):
    got = {(r.by, r.bx): (r.mu, r.s2) for r in noise.blocks(px, width or v.shape[1]).collect()}
    want = plain(v)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    return len(got)


@pytest.mark.parametrize("shape", [(270, 40), (20, 530), (258, 258), (10, 10), (9, 40), (40, 9), (17, 11)])
def test_blocks_across_cells_equal_numpy(spark, shape):
    v = np.random.default_rng(1).integers(0, 4000, shape).astype(float)
    held(raster(spark, v), v)


def test_missing_and_repeated_pixels_cost_their_own_blocks_only(spark):
    v = np.random.default_rng(3).integers(0, 4000, (300, 30)).astype(float)
    for y, x in ((100, 12), (256, 3), (257, 29)):
        v[y, x] = np.nan
    px = raster(spark, v)
    n = held(px, v)
    assert 0 < n < 37 * 3
    assert held(px.where("not isnan(v)"), v) == n
    assert held(px.where("not isnan(v)").unionByName(raster(spark, np.nan_to_num(v)).where("y = 100 and x = 12 or y = 256 and x = 3 or y = 257 and x = 29").selectExpr("tile", "y", "x", "stack(2, v, v) AS v")), v) == n


def test_one_raster_is_no_single_task(spark):
    v = np.zeros((30, 30))
    plan = noise.blocks(raster(spark, v), 30)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "cy" in plan


def test_rasters_are_pooled_and_the_fit_reads_blocks_twice(spark):
    r = np.random.default_rng(4)
    signal = np.repeat(500 + 20.0 * np.arange(100)[:, None], 90, 1)
    px = [raster(spark, np.floor(signal + np.sqrt(100 + signal) * r.normal(size=signal.shape)), t) for t in (0, 1)]
    b = noise.blocks(px[0].unionByName(px[1]), 90)
    fit = noise.fit(b)
    assert fit._jdf.queryExecution().analyzed().toString().count("FlatMapGroupsInPandas") == 2
    row = fit.first()
    g = noise.bins(b).orderBy("bin").collect()
    assert row.blocks == b.count() == 2 * 12 * 11 and row.bins == len(g)
    mu, s2 = np.array([x.mu for x in g]), np.array([x.s2 for x in g])
    a, slope = row.a, row.b
    assert slope > 0 and np.isclose(row.resid, np.sqrt(((s2 - a - slope * mu) ** 2).sum() / (s2 * s2).sum()))


def test_strips_of_one_raster_come_back_with_the_whole_raster_s_curve(spark):
    r = np.random.default_rng(5)
    signal = np.repeat(500 + 20.0 * np.arange(110)[:, None], 200, 1)
    v = np.floor(signal + np.sqrt(100 + signal) * r.normal(size=signal.shape))
    px = raster(spark, v, 3).withColumn("v", F.col("v").cast("long"))
    strips = rasters.to_strips(px, "u16", 200, 20)
    assert {x.tile: x.n for x in strips.select("tile", "n").collect()} == {(3 << 32) + s: 4000 if s < 5 else 2000 for s in range(6)}
    error = "SQRT:MAX_ERROR=0.5N"
    whole = graph.graph_for(rasters.to_tiles(px, "u16"), "planar>zigzag>transpose>zstd", "u16", 200, error)
    cut = graph.graph_for(strips, "planar>zigzag>transpose>zstd", "u16", 200, error, px=px)
    # Sums over bins have no fixed order, so the last digits of a curve are open.
    assert np.isclose(cut.plan.step, whole.plan.step, rtol=1e-12) and np.isclose(cut.plan.offset, whole.plan.offset, rtol=1e-9)
    back = rasters.from_strips(rasters.from_tiles(graph.decompress(graph.compress(strips, cut)), "u16"), 20)
    got = {(x.tile, x.y, x.x): x.v for x in back.collect()}
    want = quantise.encode_array(cut.plan, v.astype(np.uint16))
    assert got == {(3, y, x): int(want[y, x]) for y in range(110) for x in range(200)}


def test_strips_refuse_missing_and_repeated_pixels(spark):
    px = raster(spark, np.arange(80.0).reshape(20, 4)).withColumn("v", F.col("v").cast("long"))
    assert rasters.to_strips(px, "u16", 4, 5).count() == 4
    assert sorted(r.n for r in rasters.to_strips(px.where("y < 19 or x < 3"), "u16", 4, 5).select("n").collect()) == [19, 20, 20, 20]
    for bad in (px.where("not (y = 7 and x = 1)"), px.where("y < 5 or y > 9"), px.where("x < 3"), px.where("not (y between 5 and 9 and x = 3)"), px.unionByName(px.where("y = 3 and x = 0")), px.unionByName(px.selectExpr("tile", "y", "x + 4 AS x", "v").where("y = 3 and x = 4"))):
        with pytest.raises(Exception, match="missing or repeated pixel"):
            rasters.to_strips(bad, "u16", 4, 5).collect()


def test_the_fitted_frame_holds_no_raster_in_one_task(spark):
    got = catalogue.QUERIES["frame_sqrt_fitted"](spark, "/root/testdata/sf0.1")
    # What a task of Python is given is grouped by strip, never by raster alone.
    groups = re.findall(r"FlatMapGroupsInPandas \[([^\]]*)\]", got._jdf.queryExecution().executedPlan().toString())
    assert groups and all("cy#" in g for g in groups)
