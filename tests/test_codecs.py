import struct

import numpy as np
import pytest

from rasterloom.functions import types
from rasterloom.functions.recipes import grid, parse_error
from rasterloom.operators import bins, predict, quantise
from rasterloom.plans import codecs, graph


def block(size, shape=(12, 10), seed=0):
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 8 * size, shape, dtype=np.uint64 if size == 8 else np.int64, endpoint=False).astype(types.UNSIGNED[size]) if size < 8 else r.integers(0, 2**64 - 1, shape, dtype=np.uint64)


def test_ids():
    assert len(codecs.REGISTRY) == 15 and all(codecs.owned(i) for i in codecs.REGISTRY)
    assert [c.name for c in codecs.REGISTRY.values() if codecs.lossy(c.id)] == ["quant_linear", "quant_log", "quant_sqrt"]
    assert 0x72D780 not in codecs.REGISTRY and not codecs.owned(0x72D800)


@pytest.mark.parametrize("size", [1, 2, 4, 8])
@pytest.mark.parametrize("name", ["delta_w", "delta_n", "planar", "med", "average", "wp_static", "deinterleave", "binoffset", "intmult", "floatquant", "floatmult"])
def test_round_trip(name, size):
    if name.startswith("float") and size < 4:
        return
    extra = {"intmult": {"base": 7}, "floatquant": {"k": 5}, "floatmult": {"base": 0.01}}.get(name, {"width": 10} if codecs.IDS[name] in range(0x72D701, 0x72D708) and name != "deinterleave" else {})
    smooth = (np.add.outer(np.arange(12) * 3, np.arange(10) * 5) % 200).astype(types.UNSIGNED[size])
    for v in (block(size).ravel(), smooth.ravel(), smooth.ravel()[:0]):
        header, streams = codecs.encode(name, v, **extra)
        assert len(streams) == codecs.REGISTRY[codecs.IDS[name]].outputs
        back = codecs.decode(codecs.IDS[name], header, streams)
        assert back.dtype == v.dtype and (back == v).all()


def test_wide_shifts_and_trained_weights_of_every_size():
    for size in (1, 2, 4, 8):
        v = block(size, seed=3).ravel()
        for trained in (((3, -2, 1, 0), 1), ((-32768, 32767, 5, -1), 63), ((1, 2, 3, 4), 8)):
            header, streams = codecs.encode("wp_static", v, width=10, trained=trained)
            assert len(header) == 13 and (codecs.decode(0x72D707, header, streams) == v).all()
        default = codecs.encode("wp_static", v, width=10, trained=((1, -1, 0, 0), 0))[1][0]
        assert (default == codecs.encode("planar", v, width=10)[1][0]).all()


def test_trained_block_equals_trained_rows(spark):
    r = np.random.default_rng(5)
    v = np.cumsum(np.cumsum(r.integers(-9, 10, (24, 20)), axis=0), axis=1) + 9000
    df = spark.createDataFrame([(0, y, x, int(v[y, x])) for y in range(24) for x in range(20)], "tile long, y long, x long, v long")
    row = predict.train(df, 20).first()
    assert predict.train_block(v.astype(np.uint16)) == ((row.c_n, row.c_nw, row.c_ne, row.c_nn), row.shift)
    assert predict.train_block(v[:2].astype(np.uint16)) == ((1, -1, 0, 0), 0)
    assert predict.train_block(v.astype(np.uint64))[1] in range(9)


@pytest.mark.parametrize("width", [0, 7, 257, 10**9, 2**32 - 1])
def test_forged_widths(width):
    v = np.arange(256, dtype=np.uint16)
    for name in ("delta_w", "planar", "med"):
        _, streams = codecs.encode(name, v, width=16)
        with pytest.raises(codecs.Damaged):
            codecs.decode(codecs.IDS[name], struct.pack("<I", width), streams)


def test_rows_to_encode_by():
    assert [codecs.row_width(10, w) for w in (0, 11, 5)] == [10, 10, 5] and codecs.row_width(0, 4) == 1
    with pytest.raises(ValueError):
        codecs.row_width(10, 3)


def test_forged_headers():
    v = np.arange(200, dtype=np.uint16)
    cases = [
        ("wp_static", struct.pack("<IB4h", 20, 200, 1, -1, 0, 0), [v]),
        ("wp_static", struct.pack("<I", 20), [v]),
        ("deinterleave", b"", [v[:3], v[:5]]),
        ("deinterleave", b"x", [v[:3], v[:3]]),
        ("binoffset", b"\0", [v.astype(np.uint8), v]),
        ("binoffset", b"\1\0\0\x11", [np.zeros(200, np.uint8), v]),
        ("binoffset", b"\2\0\0\x10", [np.zeros(200, np.uint8), v]),
        ("intmult", b"\1\0", [v, v * 0]),
        ("intmult", b"\5\0", [v, v]),
        ("floatquant", b"\0", [v.astype(np.uint32)] * 2),
        ("floatquant", b"\5", [v] * 2),
        ("floatmult", struct.pack("<d", 0.0), [v.astype(np.uint32)] * 2),
        ("floatmult", struct.pack("<d", float("nan")), [v.astype(np.uint32)] * 2),
        ("nodata", b"", [v, v[:0].astype(np.uint8)]),
        ("nodata", b"\4", [v, v[:0].astype(np.uint8)]),
        ("nodata", b"\1\0\0", [v, np.ones(3, np.uint8)]),
        ("nodata", b"\3\0\0" + struct.pack("<Q", 2**63), [v[:0], np.zeros(0, np.uint8)]),
        ("quant_linear", struct.pack("<BBd", 10, 2, 5.0), [v]),
        ("quant_linear", struct.pack("<BBd", 1, 2, 1e-320), [v]),
        ("quant_linear", struct.pack("<BBd", 1, 0, 5.0), [v]),
        ("quant_linear", struct.pack("<BBd", 1, 130, 5.0), [v]),
        ("quant_linear", struct.pack("<BBd", 8, 2, 2.5), [v]),
        ("quant_log", struct.pack("<BBd", 1, 2, float("inf")), [v]),
        ("quant_sqrt", struct.pack("<BBdd", 1, 2, 1.0, -1.0), [v]),
        ("quant_sqrt", struct.pack("<BBdd", 1, 6, 1.0, 1.0), [v]),
        ("quant_sqrt", struct.pack("<BBdd", 1, 2, 1e-200, 1.0), [v]),
    ]
    for name, header, streams in cases:
        with pytest.raises(ValueError):
            codecs.decode(codecs.IDS[name], header, streams)
    with pytest.raises(codecs.Damaged):
        codecs.decode(0x72D780, b"", [v])


def test_float_latents_keep_order_and_signs():
    for kind in ("f4", "f8"):
        m = np.array([-1e30, -(2.0**60), -3, -0.0, 0.0, 1, 2**24, 2**53, 1e30], kind)
        x = codecs._latent(m)
        assert (np.sort(x) == x).all() and (codecs._from_latent(x).view(x.dtype) == m.view(x.dtype)).all()


def test_holes():
    v = np.array([7, 9, 7, 7, 3, 7, 7, 7, 5], np.uint16)
    header, (filled, mask) = codecs.encode("nodata", v, hole=7, width=3)
    assert header == b"\1\7\0" and list(filled) == [0, 9, 9, 0, 3, 3, 0, 3, 5] and list(mask) == [0, 1, 0, 0, 1, 0, 0, 0, 1]
    assert (codecs.decode(0x72D70C, header, [filled, mask]) == v).all()
    assert codecs.encode("nodata", v, hole=1, width=3)[0] == b"\2"
    header, streams = codecs.encode("nodata", v * 0 + 7, hole=7, width=3)
    assert len(header) == 11 and (codecs.decode(0x72D70C, header, streams) == 7).all()
    f = np.array([1.0, np.nan, np.inf, np.nan], np.float32)
    f.view(np.uint32)[1] = 0x7FC0BEEF
    header, streams = codecs.encode("nodata", f.view(np.uint32), hole="nan", width=2)
    assert header[1:] == struct.pack("<I", 0x7FC0BEEF) and streams[0].view(np.float32)[2] == np.inf


def test_hole_patterns():
    assert graph.hole_pattern("i16", -9999) == 65536 - 9999 and graph.hole_pattern("f32", float("nan")) == "nan"
    assert graph.hole_pattern("f64", -0.0) == 1 << 63 and graph.hole_pattern("u64", 2**64 - 1) == 2**64 - 1
    for kind, v in (("u8", 256), ("i16", 0.5), ("f16", 1.0), ("f32", 1e300)):
        with pytest.raises(ValueError):
            graph.hole_pattern(kind, v)


def plain_steps(v, s, lo, hi):
    out = []
    for x in v:
        q = (abs(x) + s // 2) // s * s
        out.append(max(lo, min(hi, q if x >= 0 else -q)))
    return out


@pytest.mark.parametrize("kind", ["u8", "i8", "u16", "i16", "u32", "i32", "u64", "i64"])
def test_whole_steps_at_the_ends(kind):
    info = np.iinfo(types.NUMPY[kind])
    v = [info.min, info.min + 1, info.max, info.max - 1, 0, 1, 2, 3, 7, 8, 100]
    for s in (1, 2, 3, 10, 11, 255):
        got = quantise._whole_steps(np.array(v, types.NUMPY[kind]), s)
        assert [int(x) for x in got] == plain_steps(v, s, info.min, info.max), s


def product(kind):
    r = np.random.default_rng(9)
    v = 50 + np.cumsum(r.random((2, 20, 16)), axis=2) * 3
    return [x.astype(types.NUMPY[kind]) for x in v]


def in_tiles(spark, kind, arrays):
    k = types.BY_NAME[kind]
    return spark.createDataFrame([(i, k.code, k.size, a.shape[1], a.size, a.tobytes()) for i, a in enumerate(arrays)], "tile long, dtype int, elt int, width long, n long, data binary")


@pytest.mark.parametrize("error", ["LINEAR:MAX_ERROR=2", "LINEAR:MAX_ERROR=1,STORE=VALUES", "LOG:MAX_ERROR=2%", "LOG:MAX_ERROR=2%,STORE=VALUES", "SQRT:MAX_ERROR=0.5N,A=100,B=1"])
@pytest.mark.parametrize("kind", ["u8", "u16", "i32", "u64", "f16", "f32", "f64"])
def test_lossy_frames_hold_their_bound(spark, kind, error):
    if kind == "f16" and "LOG" in error:
        return
    arrays, e = product(kind), parse_error(error)
    tiles = in_tiles(spark, kind, arrays)
    seen = quantise.scan_tiles(tiles, kind)
    flat = np.concatenate([a.ravel() for a in arrays]).astype(np.float64)
    assert (seen["lo"], seen["hi"], seen["max_abs"]) == (flat.min(), flat.max(), flat.max())
    plan = quantise.resolve(e, kind, seen)
    for name in ("planar>zigzag>zstd", "wp_static>zigzag>field_lz"):
        g = graph.Graph(name, types.BY_NAME[kind].size, 16, None, plan)
        for a in arrays:
            frame = graph.compress_tile(g, a.tobytes())
            head = graph.frame_head(frame)
            assert head["crc"] is None and codecs.lossy(head["steps"][0][0])
            back = np.frombuffer(graph.decompress_tile(frame), types.NUMPY[kind]).astype(np.float64)
            x = a.ravel().astype(np.float64)
            limit = {"LINEAR": e.bound, "LOG": e.bound * np.abs(x), "SQRT": e.bound * np.sqrt((e.a or 0) + (e.b or 0) * x)}[e.family]
            assert (np.abs(back - x) <= limit).all()


def test_one_grid_for_a_product_with_holes(spark):
    a, b = product("f32")
    b[3, 4:9] = np.nan
    tiles = in_tiles(spark, "f32", [a, b])
    g = graph.graph_for(tiles, "planar>zigzag>transpose>entropy", "f32", 16, "LINEAR:MAX_ERROR=0.25")
    assert g.hole == "nan" and g.plan.family == "LINEAR"
    frames = graph.compress(tiles, g)
    assert {(r.place, r.name) for r in graph.frame_steps(frames).collect()} == {(0, "nodata"), (1, "quant_linear"), (2, "planar")}
    back = {r.tile: np.frombuffer(r.data, np.float32).reshape(20, 16) for r in graph.decompress(frames).collect()}
    assert np.isnan(back[1][3, 4:9]).all() and np.nanmax(np.abs(back[1] - b)) <= 0.25
    whole = graph.graph_for(in_tiles(spark, "u16", product("u16")), "id>zstd", "u16", 16)
    assert whole.plan is None and whole.hole is None
    with pytest.raises(ValueError):
        graph.Graph("id>zstd", 2, 16, None, g.plan)
    assert graph.profile(tiles, "planar", 1, "nan", g.plan).where("tile = 1").count() > 0


def test_array_quantisers_equal_columns(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 1000, 300), [0.0, np.nan, -0.0]])
    for text in ("LINEAR:MAX_ERROR=0.5", "LINEAR:MAX_ERROR=2,STORE=VALUES", "LOG:MAX_ERROR=1%"):
        df = spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(x)], "tile long, y long, x long, v double")
        plan = quantise.plan_for(df, parse_error(text), "f64")
        got = [r.q for r in df.withColumn("q", quantise.encode(plan, F.col("v"))).orderBy("x").collect()]
        assert list(quantise.encode_array(plan, x)) == got, text


def plain_bins(v, log):
    """Sample by sample: each place's bin, values kept whole as ``bins.fine`` says."""
    n, k, out, i, free, opened = len(v), 1 << log, [], 0, 0, []
    end = lambda b: -(-(b + 1) * n // k)
    while i < n:
        goal = end(i * k // n)
        if goal == n:
            out.append(opened + v[i:])
            return [(b[0], b[-1], len(b)) for b in out]
        x = v[goal - 1]
        lo, hi = v.index(x), n - v[::-1].index(x)
        opened = opened + v[i:lo]
        b = (lo + (hi - lo) // 2) * k // n
        if b > free:
            if opened:
                out.append(opened)
                opened, free = [], b
            else:
                b -= 1
        opened = opened + v[lo:hi]
        if hi >= end(b):
            out.append(opened)
            opened, free = [], b + 1
        i = hi
    return [(b[0], b[-1], len(b)) for b in [*out, *([opened] if opened else [])]]


def test_bins_and_tables():
    r = np.random.default_rng(4)
    for trial in range(60):
        v = np.sort(r.integers(0, (5, 50, 5000)[trial % 3], int(r.integers(1, 200))))
        values, counts = np.unique(v, return_counts=True)
        for log in (0, 2, 5):
            lo, hi, c = bins.fine(values, counts, log)
            assert list(zip(lo.tolist(), hi.tolist(), c.tolist(), strict=True)) == plain_bins(v.tolist(), log)
            assert c.sum() == len(v) and len(c) <= 1 << log
        table = bins.merge(*bins.fine(values, counts, 4), 20.0)
        u = r.permutation(v).astype(np.uint16)
        which, packed = bins.pack(u, table)
        assert (bins.unpack(which, packed, table, 2) == u).all()
        assert len(packed) == (sum(table.bits[b] for b in which) + 7) // 8
        if packed:
            with pytest.raises(ValueError):
                bins.unpack(which, packed[:-1], table, 2)
    assert bins.merge(*bins.fine(np.zeros(0, int), np.zeros(0, int), 3), 1.0).lowers == (0,)


def test_merged_table_is_the_cheapest():
    lo, hi, c = np.array([0, 10, 500, 520, 9000]), np.array([9, 12, 515, 530, 9100]), np.array([50, 400, 30, 3, 200])

    def bits(stops):
        spent, start = 0.0, 0
        for stop in stops:
            n = c[start:stop].sum()
            spent += 25 + (np.log2(c.sum()) - np.log2(n) + int(hi[stop - 1] - lo[start]).bit_length()) * n
            start = stop
        return spent

    every = [[i for i in range(1, 6) if i == 5 or m >> (i - 1) & 1] for m in range(16)]
    best = min(every, key=bits)
    assert bins.merge(lo, hi, c, 25.0).lowers == tuple(int(lo[s]) for s in [0, *best[:-1]])


def test_widest_values_pack():
    v = np.array([0, 1, 2**63, 2**64 - 1, 12345678901234567890], np.uint64)
    for table in (bins.powers(8), bins.Table((0,), (64,))):
        which, packed = bins.pack(v, table)
        assert (bins.unpack(which, packed, table, 8) == v).all()


def test_damaged_frames_never_crash():
    v = (np.add.outer(np.arange(16), np.arange(16)) % 50).astype(np.uint16)
    r = np.random.default_rng(8)
    for name in grid(2):
        frame = graph.compress_tile(graph.Graph(name, 2, 16, 7), v.tobytes())
        for _ in range(20):
            bad = bytearray(frame)
            bad[int(r.integers(0, len(bad)))] ^= int(r.integers(1, 256))
            try:
                graph.decompress_tile(bytes(bad))
            except ValueError:
                pass
