"""Sentinels by their bits, values and pixels that are refused, steps that are no steps, matches, narrow plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.recipes import parse_error
from rasterloom.operators import fieldlz, quantise, split
from rasterloom.plans import graph
from rasterloom.sources import rasters


def pixels(spark, values, width=2, kind="double"):
    return spark.createDataFrame([(0, i // width, i % width, v) for i, v in enumerate(values)], f"tile long, y long, x long, v {kind}")


def test_a_zero_sentinel_is_not_the_other_zero(spark):
    px = pixels(spark, [0.0, -0.0, 1.0, float("nan")])
    assert [r.valid for r in split.mark(px, 0.0).orderBy("y", "x").collect()] == [False, True, True, True]
    assert [r.valid for r in split.mark(px, -0.0).orderBy("y", "x").collect()] == [True, False, True, True]


def test_missing_pixels_and_large_values_are_refused(spark):
    px = pixels(spark, range(8), kind="long")
    for bad in (px.where("not (y = 1 and x = 0)"), px.unionByName(px.where("y = 1 and x = 0"))):
        with pytest.raises(Exception, match="missing or repeated pixel"):
            rasters.to_tiles(bad, "u16").collect()
    assert rasters.from_tiles(rasters.to_tiles(px.where("not (y = 3 and x = 1)"), "u16"), "u16").count() == 7
    tile = spark.createDataFrame([(0, 2, bytearray(b"\xff" * 16))], "tile long, width long, data binary")
    with pytest.raises(Exception, match="beyond a long"):
        rasters.from_tiles(tile, "u64").collect()


def test_nan_and_half_precision_come_back(spark):
    px = pixels(spark, [1.0, float("nan"), -2.5, float("inf")])
    got = [r.v for r in rasters.from_tiles(rasters.to_tiles(px, "f64"), "f64").orderBy("y", "x").collect()]
    assert got[0] == 1.0 and np.isnan(got[1]) and got[2:] == [-2.5, float("inf")]
    # 2049 lies between two halves: ties go away from zero.
    assert [r.v for r in rasters.from_tiles(rasters.to_tiles(pixels(spark, [2049.0, -2049.0]), "f16"), "f16").orderBy("x").collect()] == [2050.0, -2050.0]


def test_bounds_without_a_finite_step():
    seen = {"max_abs": 5.0, "min_abs": 1.0, "lo": 1.0, "hi": 5.0, "any_negative": False}
    assert quantise.resolve(parse_error("LINEAR:MAX_ERROR=1e308"), "u16", seen).step == 65535
    for text in ("LINEAR:MAX_ERROR=1e308", "LINEAR:MAX_ERROR=1e308,STORE=VALUES", "SQRT:MAX_ERROR=1e308N,A=1,B=1e300"):
        try:
            assert np.isfinite(quantise.resolve(parse_error(text), "f64", seen).step)
        except quantise.Refused:
            pass


def test_matches_join_to_what_they_were():
    r = np.random.default_rng(1)
    for dtype in ("u1", "u2", "u4", "u8"):
        for v in (r.integers(0, 3, 5000), r.integers(0, 200, 3000), np.zeros(4000), np.tile(r.integers(0, 99, 37), 50), np.arange(9), np.zeros(0), np.ones(3)):
            v = v.astype(dtype)
            literals, rows = fieldlz.parse(v)
            assert (fieldlz.join(literals, rows, len(v)) == v).all()
    literals, rows = fieldlz.parse(np.zeros(4000, "u2"))
    assert len(rows) == 1 and len(literals) < 5
    for bad in ([[0, 4, 1]], [[9, 4, 1]], [[1, 4, 0]], [[1, 4, 2]]):
        with pytest.raises(ValueError):
            fieldlz.join(np.zeros(2, "u2"), np.array(bad, np.uint32), 6)


def test_narrow_plans_hold_the_bound_in_single_precision(spark):
    x = np.linspace(0, 5000, 4001, dtype=np.float32)
    error = parse_error("SQRT:MAX_ERROR=0.5N,A=100,B=1")
    seen = {"lo": 0.0, "hi": 5000.0, "max_abs": 5000.0, "min_abs": 1.0, "any_negative": False}
    plan = quantise.resolve(error, "f32", seen)
    assert plan.narrow
    q = quantise.encode_array(plan, x)
    back = quantise.decode_array(plan, q)
    u = q.astype(np.float32) * np.float32(plan.step)
    assert (back == np.maximum(u * u - np.float32(plan.offset), 0)).all()
    assert (np.abs(back.astype(float) - x) <= 0.5 * np.sqrt(100 + x.astype(float))).all()
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(q)], "i long, q long")
    got = [r.w for r in df.select("i", quantise.decode(plan, F.col("q")).alias("w")).orderBy("i").collect()]
    assert (np.array(got, np.float32) == back).all()


def test_profile_of_a_product_cuts_its_plan(spark):
    tiles = rasters.to_tiles(pixels(spark, [7, 7, 9, 11, 300, 9, 9, 9], kind="long"), "u16")
    sizes = {r.graph: r.bytes for r in graph.profile_product(tiles, "u16", 2, None, error="LINEAR:MAX_ERROR=5", nodata=300).collect()}
    assert len(sizes) == 56 and all(n > 0 for n in sizes.values())
    with pytest.raises(quantise.Refused):
        graph.graph_for(tiles, "id>zstd", "u16", 2, "SQRT:MAX_ERROR=1N")
