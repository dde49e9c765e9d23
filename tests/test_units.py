import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.functions import types
from rasterloom.functions.recipes import METHODS, grid, number, parse_error, parse_method
from rasterloom.operators import predict, quantise, split
from rasterloom.plans import graph


def test_grid_sizes():
    assert [len(grid(n)) for n in (1, 2, 4, 8)] == [32, 56, 48, 48]
    assert grid(2, "none") == grid(2, "id") and len(grid(2, "planar")) == 14
    with pytest.raises(ValueError):
        grid(2, "nothing")
    with pytest.raises(ValueError):
        parse_method("id>categorical", 4)


@pytest.mark.parametrize("text", ["0.5", "5", "1e-3", "1E+3", ".5"])
def test_numbers(text):
    assert number(text) == float(text)


@pytest.mark.parametrize("text", ["inf", "nan", "1 ", "1e", "1.0.0", "1_000", "1e999", "1e-320", ""])
def test_no_numbers(text):
    with pytest.raises(ValueError):
        number(text)


@pytest.mark.parametrize(
    "text", ["0.5", "linear:MAX_ERROR=1", "LINEAR", "LINEAR:", "LINEAR:MAX_ERROR=0", "LINEAR:MAX_ERROR=1,", "LINEAR:MAX_ERROR=1,MAX_ERROR=2", "LINEAR:MAX_ERROR=1,X=2", "LOG:MAX_ERROR=1", "LOG:MAX_ERROR=100%", "LOG:MAX_ERROR=1%,STORE=INDEX,STORE=INDEX", "SQRT:MAX_ERROR=1", "SQRT:MAX_ERROR=1N,A=1", "SQRT:MAX_ERROR=1N,A=1,B=0", "LINEAR:MAX_ERROR=1,STORE=BYTES"]
)
def test_refused_recipes(text):
    with pytest.raises(ValueError):
        parse_error(text)


def test_recipes():
    assert parse_error(None) is None and parse_error("") is None
    assert parse_error("LOG:STORE=VALUES,MAX_ERROR=1%").bound == 0.01
    assert parse_error("LINEAR:MAX_ERROR=1,STORE=INDEX,STORE=VALUES").values


def test_types():
    assert types.kind_of(np.uint16).code == 1 and types.component(np.complex64) == np.float32
    for bad in (np.bool_, ">u2"):
        with pytest.raises(ValueError):
            types.kind_of(bad)
    assert list(types.half_bits(np.array([1.0, -2.0, 65504.0, 1e9, 1 + 2.0**-11]))) == [0x3C00, 0xC000, 0x7BFF, 0x7C00, 0x3C01]


@pytest.mark.parametrize("size", [1, 2, 4, 8])
@pytest.mark.parametrize("shape", [(16, 16), (7, 13), (1, 32), (32, 1), (4, 4)])
def test_frames_round_trip(size, shape):
    r = np.random.default_rng(size)
    noisy = r.integers(0, 1 << min(62, 8 * size), shape).astype(types.UNSIGNED[size])
    ramp = (np.add.outer(np.arange(shape[0]) * 3, np.arange(shape[1]) * 5) % 200).astype(types.UNSIGNED[size])
    for v in (noisy, ramp, np.full(shape, 7, types.UNSIGNED[size])):
        for name in grid(size):
            if size > 2 and name.endswith(">entropy") and "transpose" not in name:
                continue
            for hole in (None, int(v[0, 0])):
                g = graph.Graph(name, size, shape[1], hole)
                assert graph.decompress_tile(graph.compress_tile(g, v.tobytes())) == v.tobytes(), name


def test_damaged_frames():
    g = graph.Graph("planar>zigzag>zstd", 2, 20)
    f = graph.compress_tile(g, np.arange(200, dtype=np.uint16).tobytes())
    for bad in (b"", f[:-1], f + b"x", b"XXXX" + f[4:], f[:4] + b"\xff\xff\xff\x7f" + f[8:]):
        with pytest.raises(ValueError):
            graph.decompress_tile(bad)
    with pytest.raises(ValueError):
        graph.compress_tile(graph.Graph("planar>zigzag>zstd", 2, 7), np.arange(200, dtype=np.uint16).tobytes())
    assert graph.decompress_tile(graph.compress_tile(g, b"")) == b""


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(width=64), min_size=1, max_size=40), st.integers(1, 52))
def test_float_splits(values, k):
    x = np.array(values, np.float64)
    back = split.floatquant_join(*split.floatquant(x, k), k, "f8")
    assert (back.view(np.uint64) == x.view(np.uint64)).all()
    with np.errstate(all="ignore"):
        back = split.floatmult_join(*split.floatmult(x, 0.01), 0.01)
    assert (back.view(np.uint64) == x.view(np.uint64)).all()


def test_trainer_prefers_the_planted_predictor(spark):
    r, v = np.random.default_rng(1), np.zeros((40, 32), np.int64)
    v[0] = 2000 + np.cumsum(r.integers(-40, 41, 32))
    for y in range(1, 40):
        v[y, 0] = v[y - 1, 0] + r.integers(-40, 41)
        for x in range(1, 32):
            ne = v[y - 1, x + 1] if x < 31 else v[y - 1, x]
            v[y, x] = v[y, x - 1] + ((ne - v[y - 1, x - 1]) >> 1) + r.integers(0, 3)
    v = v[:, :30]
    df = spark.createDataFrame([(0, y, x, int(v[y, x])) for y in range(40) for x in range(30)], "tile long, y long, x long, v long")
    row = predict.train(df, 30).first()
    assert row.shift > 0
    small = predict.train(df.where("y < 2"), 30).first()
    assert (small.c_n, small.c_nw, small["shift"]) == (1, -1, 0)


BOUNDS = ["LINEAR:MAX_ERROR=3", "LINEAR:MAX_ERROR=2,STORE=VALUES", "LOG:MAX_ERROR=1%", "LOG:MAX_ERROR=0.1%", "SQRT:MAX_ERROR=0.5N,A=100,B=1"]


@pytest.mark.parametrize("text", BOUNDS)
@pytest.mark.parametrize("kind", ["u8", "u16", "i16", "f32", "f64"])
def test_bounds_hold_and_a_second_pass_moves_nothing(spark, text, kind):
    k, error = types.BY_NAME[kind], parse_error(text)
    low = 1 if "VALUES" in text or error.family == "SQRT" else max(-3000, int(k.lo))
    v = [float(x) for x in range(max(low, int(max(k.lo, -3000))), min(3000, int(k.hi)) + 1, 3)]
    v = [x + 0.25 for x in v] if not k.integer and "VALUES" not in text else v
    df = spark.createDataFrame([(0, 0, i, int(x) if k.integer else x) for i, x in enumerate(v)], f"tile long, y long, x long, v {'long' if k.integer else 'double'}")
    from pyspark.sql import functions as F

    plan = quantise.plan_for(df, error, kind)
    once = df.withColumn("w", quantise.decode(plan, quantise.encode(plan, F.col("v"))))
    assert quantise.verify(once, error).first().worst <= 1
    twice = once.withColumn("w2", quantise.decode(plan, quantise.encode(plan, F.col("w"))))
    assert twice.where("abs(w2 - w) > 1e-6 * abs(w)").count() == 0


def test_refusals():
    some = {"max_abs": 1e9, "any_negative": False, "min_abs": 1e-9, "lo": -500.0, "hi": 9.0}
    for text, kind in (("LINEAR:MAX_ERROR=1e-12", "f32"), ("LINEAR:MAX_ERROR=0.2,STORE=VALUES", "f32"), ("LOG:MAX_ERROR=1%,STORE=VALUES", "f32"), ("SQRT:MAX_ERROR=1N,A=1,B=1", "f32"), ("SQRT:MAX_ERROR=1N", "f32")):
        with pytest.raises(quantise.Refused):
            quantise.resolve(parse_error(text), kind, some)
    with pytest.raises(quantise.Refused):
        quantise.resolve(parse_error("LINEAR:MAX_ERROR=1"), "u8", some | {"max_abs": 0})


def test_method_names():
    assert METHODS["planar>zigzag>transpose>entropy"] == ("planar", "transpose>entropy") and "id>zigzag>zstd" not in METHODS


def test_stream_of_tiles(spark, tmp_path):
    from rasterloom.streaming.tiles import compress_stream

    v = np.arange(200, dtype=np.uint16)
    shape = "tile long, dtype int, elt int, width long, n long, data binary"
    spark.createDataFrame([(i, 1, 2, 20, 200, (v + i).tobytes()) for i in range(3)], shape).write.parquet(str(tmp_path / "in"))
    q = compress_stream(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), graph.Graph("planar>zigzag>zstd", 2, 20), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = graph.decompress(spark.read.parquet(str(tmp_path / "out"))).orderBy("tile").collect()
    assert [np.frombuffer(r.data, np.uint16)[0] for r in got] == [0, 1, 2]
