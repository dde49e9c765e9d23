"""Queries over the driver tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.recipes import grid, parse_error
from rasterloom.operators import bins, noise, predict, quantise, split
from rasterloom.plans import codecs, graph
from rasterloom.sources import rasters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


U16 = "u16 AS (SELECT o_orderkey // 1500 AS tile, (o_orderkey % 1500) // 100 AS y, o_orderkey % 100 AS x, CAST(floor(o_totalprice) AS BIGINT) & 65535 AS v FROM orders)"
CENTS = "cents AS (SELECT o_orderkey // 1500 AS tile, (o_orderkey % 1500) // 100 AS y, o_orderkey % 100 AS x, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)"
SKEW = "skew AS (SELECT o_orderkey // 1500 AS tile, CASE WHEN o_totalprice > 490000 THEN 1 ELSE 0 END AS v FROM orders)"
F64 = "f64 AS (SELECT event_id // 1000 AS tile, (event_id % 1000) // 50 AS y, event_id % 50 AS x, value AS v FROM events)"
CLASSES = "cls AS (SELECT event_id // 1000 AS tile, list_position(['click','error','purchase','signup','view'], event_type) AS v FROM events)"
HOLED = "holed AS (SELECT event_id // 1000 AS tile, (event_id % 1000) // 50 AS y, event_id % 50 AS x, CASE WHEN event_type = 'error' THEN -9999e0 ELSE value END AS v FROM events)"
NEAR = (
    "a AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY tile, y ORDER BY x), 0) AS w, coalesce(lag(v) OVER (PARTITION BY tile, x ORDER BY y), 0) AS n, coalesce(lag(v, 2) OVER (PARTITION BY tile, x ORDER BY y), 0) AS nn FROM u16), "
    "nb AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY tile, y ORDER BY x), 0) AS nw, coalesce(lead(n) OVER (PARTITION BY tile, y ORDER BY x), 0) AS ne FROM a)"
)
PREDICTION = {
    "delta_w": "w",
    "delta_n": "n",
    "planar": "w + n - nw",
    "med": "CASE WHEN nw >= greatest(w, n) THEN least(w, n) WHEN nw <= least(w, n) THEN greatest(w, n) ELSE w + n - nw END",
    "average": "(w + n) // 2",
    "wp_static": "w + ((3 * n - 2 * nw + ne + 1) >> 1)",
}
RESIDUAL = {k: f"SELECT tile, y, x, (v - ({p})) & 65535 AS r FROM nb" for k, p in PREDICTION.items()}
RESIDUAL["delta_1d"] = "SELECT tile, y, x, (v - coalesce(lag(v) OVER (PARTITION BY tile ORDER BY y, x), 0)) & 65535 AS r FROM u16"
ORIGINAL = f"WITH {U16} SELECT tile, y, x, v FROM u16"
FIXED = {"coefficients": (3, -2, 1, 0), "shift": 1}


def _residual(spark, d, name):
    return predict.encode(rasters.u16(spark, d), name, 100, 2, **(FIXED if name == "wp_static" else {}))


for _name in RESIDUAL:
    query(f"WITH {U16}, {NEAR} {RESIDUAL[_name]}", f"{_name}_encode")(lambda s, d, n=_name: _residual(s, d, n))
for _name in ("delta_w", "delta_n", "planar", "delta_1d"):
    query(ORIGINAL, f"{_name}_decode")(lambda s, d, n=_name: predict.decode_by_sums(_residual(s, d, n), n))
for _name in ("med", "average", "wp_static"):
    query(ORIGINAL, f"{_name}_decode")(lambda s, d, n=_name: predict.decode_by_tiles(_residual(s, d, n), n, 2, **(FIXED if n == "wp_static" else {})))


@query(f"WITH {U16} SELECT tile, y, x, v AS r FROM u16")
def identity(spark, d):
    return predict.encode(rasters.u16(spark, d), "id", 100)


_F = ["n", "nw", "ne", "nn"]
_SUMS = ", ".join(f"CAST(sum({a} * {'(v - w)' if b == 't' else b}) AS BIGINT) AS {a}_{b}" for i, a in enumerate(_F) for b in [*_F[i:], "t"])


@query(f"WITH {U16}, {NEAR} SELECT tile, count(*) AS samples, {_SUMS} FROM nb WHERE y >= 2 AND x >= 1 AND x < 99 GROUP BY tile")
def wp_static_normal_eq(spark, d):
    return predict.normal_equations(rasters.u16(spark, d), 100)


ZIG = "CASE WHEN r < 32768 THEN r * 2 ELSE (65536 - r) * 2 - 1 END"


def _bits(keys: str, src: str, symbol: str) -> str:
    return f"SELECT {keys}, CAST(sum(c) AS BIGINT) AS samples, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS bits FROM (SELECT {keys}, {symbol}, count(*) AS c FROM {src} GROUP BY {keys}, {symbol}) GROUP BY {keys}"


_CANDS = [(1, -1, 0, 0, 0), (3, -2, 1, 0, 1), (5, -3, 2, -1, 2)]
_CAND_SQL = " UNION ALL ".join(f"SELECT {i} AS cand, tile, (v - w - (({a} * n + {b} * nw + {c} * ne + {e} * nn + {(1 << (s - 1)) if s else 0}) >> {s})) & 65535 AS r FROM nb" for i, (a, b, c, e, s) in enumerate(_CANDS))


@query(
    f"WITH {U16}, {NEAR}, r AS ({_CAND_SQL}), z AS (SELECT cand, tile, {ZIG} AS z FROM r), p AS (SELECT cand, tile, 0 AS plane, z & 255 AS b FROM z UNION ALL SELECT cand, tile, 1, z >> 8 FROM z), "
    "c AS (SELECT cand, tile, plane, b, count(*) AS c FROM p GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY cand, tile, plane) AS n FROM c) SELECT cand, tile, round(sum(-c * log2(c / n)), 4) AS bits FROM t GROUP BY cand, tile"
)
def wp_static_candidates(spark, d):
    nb, out = predict.neighbours(rasters.u16(spark, d), 100), None
    for i, (*c, shift) in enumerate(_CANDS):
        r = (F.col("v") - predict.fixed(tuple(c), shift)).bitwiseAND(F.lit(65535))
        part = nb.select(F.lit(i).alias("cand"), "tile", r.alias("r"))
        out = part if out is None else out.unionByName(part)
    bits = predict.plane_bits(out, ["cand", "tile"], predict.zigzag(F.col("r"), 2), 2)
    return bits.select("cand", "tile", F.round("bits", 4).alias("bits"))


@query()
def wp_static_train(spark, d):
    return predict.train(rasters.u16(spark, d), 100)


def _zigged(spark, d):
    r = _residual(spark, d, "planar")
    return r.select("tile", "y", "x", predict.zigzag(F.col("r"), 2).alias("z"))


ZIGGED = f"WITH {U16}, {NEAR}, r AS ({RESIDUAL['planar']}), z AS (SELECT tile, y, x, {ZIG} AS z FROM r)"
LANES = "l AS (SELECT tile, y, x, 0 AS lane, z & 255 AS b FROM z UNION ALL SELECT tile, y, x, 1, z >> 8 FROM z)"


@query(f"{ZIGGED} SELECT * FROM z")
def zigzag(spark, d):
    return _zigged(spark, d)


@query(f"{ZIGGED}, {LANES} SELECT * FROM l")
def byte_lanes(spark, d):
    return split.byte_lanes(_zigged(spark, d), ["tile", "y", "x"], F.col("z"), 2)


@query(f"{ZIGGED}, {LANES} {_bits('lane', 'l', 'b')}")
def planar_lane_entropy(spark, d):
    return split.entropy(split.byte_lanes(_zigged(spark, d), [], F.col("z"), 2), ["lane"], "b")


@query(f"{ZIGGED}, {LANES} {_bits('tile, lane', 'l', 'b')}")
def lane_entropy(spark, d):
    return split.entropy(split.byte_lanes(_zigged(spark, d), ["tile"], F.col("z"), 2), ["tile", "lane"], "b")


@query(f"WITH {U16}, l AS (SELECT tile, v & 255 AS b FROM u16 UNION ALL SELECT tile, v >> 8 FROM u16) {_bits('tile', 'l', 'b')}")
def order0_bits(spark, d):
    return split.entropy(split.byte_lanes(rasters.u16(spark, d), ["tile"], F.col("v"), 2), ["tile"], "b")


@query(f"{ZIGGED}, {LANES}, c AS (SELECT tile, b, count(*) AS c FROM l WHERE lane = 1 GROUP BY tile, b) SELECT tile, CAST(sum(c) AS BIGINT) AS raw_bytes, CAST(sum(c) AS BIGINT) AS samples, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS bits FROM c GROUP BY tile")
def store_lo_lanes(spark, d):
    lanes = split.byte_lanes(_zigged(spark, d), ["tile"], F.col("z"), 2).where("lane = 1")
    return split.entropy(lanes, ["tile"], "b").select("tile", F.col("samples").alias("raw_bytes"), "samples", "bits")


def _route(src: str) -> str:
    return f"SELECT tile, CAST(sum(c) AS BIGINT) AS n, max(c) AS hits, CASE WHEN max(c) = sum(c) THEN 'constant' WHEN max(c) > 0.95e0 * sum(c) THEN 'field_lz' ELSE 'entropy' END AS arm FROM (SELECT tile, v, count(*) AS c FROM {src} GROUP BY tile, v) GROUP BY tile"


@query(f"WITH {CLASSES} {_route('cls')}")
def categorical_route(spark, d):
    return split.route(rasters.classes(spark, d)).select("tile", "n", "hits", "arm")


@query(f"WITH {SKEW} {_route('skew')}")
def categorical_skew(spark, d):
    return split.route(rasters.skewed(spark, d)).select("tile", "n", "hits", "arm")


@query("SELECT 0 AS lane, o_orderkey AS i, o_totalprice AS v FROM orders UNION ALL SELECT 1, o_orderkey, CAST(o_custkey AS DOUBLE) FROM orders")
def deinterleave_split(spark, d):
    return split.deinterleave(rasters.lanes(spark, d))


@query("SELECT 2 * o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT 2 * o_orderkey + 1, CAST(o_custkey AS DOUBLE) FROM orders")
def deinterleave_join(spark, d):
    return split.interleave(split.deinterleave(rasters.lanes(spark, d)))


@query(f"WITH {CENTS} SELECT tile, y, x, v // 100 AS m, v % 100 AS a FROM cents")
def intmult_split(spark, d):
    m, a = split.intmult(F.col("v"), 100)
    return rasters.cents(spark, d).select("tile", "y", "x", m.alias("m"), a.alias("a"))


@query(f"WITH {CENTS} SELECT tile, y, x, v FROM cents")
def intmult_join(spark, d):
    return intmult_split(spark, d).select("tile", "y", "x", (F.col("m") * 100 + F.col("a")).alias("v"))


@query(f"WITH {U16} SELECT tile, y, x, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END AS bin, CASE WHEN v = 0 THEN 0 ELSE v - (1::BIGINT << (length(bin(v)) - 1)) END AS offset_ FROM u16")
def binoffset_pow2(spark, d):
    b, o = split.binoffset(F.col("v"))
    return rasters.u16(spark, d).select("tile", "y", "x", b.alias("bin"), o.alias("offset_"))


@query(ORIGINAL)
def binoffset_join(spark, d):
    return binoffset_pow2(spark, d).select("tile", "y", "x", split.binoffset_join(F.col("bin"), F.col("offset_")).alias("v"))


_LOWERS = [0, 100, 1000, 5000, 20000, 40000, 60000]


@query(f"WITH {U16}, t AS (SELECT unnest({_LOWERS}) AS lower, generate_subscripts({_LOWERS}, 1) - 1 AS bin) SELECT tile, y, x, max(bin) AS bin, v - max(lower) AS offset_ FROM u16 JOIN t ON lower <= v GROUP BY tile, y, x, v")
def binoffset_table(spark, d):
    return split.by_table(rasters.u16(spark, d), _LOWERS).select("tile", "y", "x", "bin", F.col("offset").alias("offset_"))


@query(f"WITH {F64} SELECT tile, y, x, v FROM f64")
def floatquant_round_trip(spark, d):
    return split.float_round_trip(rasters.f64(spark, d), "floatquant", 20).select("tile", "y", "x", "v")


@query(f"WITH {F64} SELECT tile, y, x, v FROM f64")
def floatmult_round_trip(spark, d):
    return split.float_round_trip(rasters.f64(spark, d), "floatmult", 0.01).select("tile", "y", "x", "v")


@query()
def floatmult_split(spark, d):
    return split.float_round_trip(rasters.f64(spark, d), "floatmult", 0.01)


def _marked(spark, d):
    return split.mark(rasters.holed(spark, d), -9999.0)


_FILL = (
    f"WITH {HOLED}, g AS (SELECT *, CASE WHEN v <> -9999e0 THEN v END AS g FROM holed), h AS (SELECT *, last_value(g IGNORE NULLS) OVER (PARTITION BY tile, y ORDER BY x) AS h FROM g), "
    "f AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY tile, x ORDER BY y), 0e0) AS f FROM h)"
)


@query(f"WITH {HOLED} SELECT tile, y, x, v, v <> -9999e0 AS valid FROM holed")
def nodata_mask(spark, d):
    return _marked(spark, d)


@query(f"{_FILL} SELECT tile, y, x, f AS v, g IS NOT NULL AS valid FROM f")
def nodata_fill(spark, d):
    return split.fill(_marked(spark, d))


@query(f"WITH {HOLED} SELECT tile, y, x, v FROM holed")
def nodata_restore(spark, d):
    return split.restore(split.fill(_marked(spark, d)), -9999.0)


@query(f"WITH {HOLED} SELECT tile, count(*) AS n, count(*) FILTER (v <> -9999e0) AS valid, 1 AS code, 9 AS header_bytes FROM holed GROUP BY tile")
def nodata_wire_code(spark, d):
    return split.wire_code(_marked(spark, d), 8)


@query(
    f"WITH {HOLED} SELECT tile, count(*) AS n, CASE tile % 3 WHEN 0 THEN count(*) FILTER (v <> -9999e0) WHEN 1 THEN count(*) ELSE 0 END AS valid, "
    "CASE tile % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS code, CASE tile % 3 WHEN 0 THEN 9 WHEN 1 THEN 1 ELSE 17 END AS header_bytes FROM holed GROUP BY tile"
)
def nodata_wire_codes(spark, d):
    """Every third tile with some holes, every third with none, every third with holes alone."""
    v = F.when(F.col("tile") % 3 == 1, F.lit(1.0)).when(F.col("tile") % 3 == 2, F.lit(-9999.0)).otherwise(F.col("v"))
    return split.wire_code(split.mark(rasters.holed(spark, d).withColumn("v", v), -9999.0), 8)


@query(f"WITH {HOLED} SELECT tile, y, x, v <> -9999e0 AS valid FROM holed")
def nan_mask(spark, d):
    """NaN as the hole: what is marked, and what a frame brings back as NaN."""
    px = rasters.holed(spark, d).withColumn("v", F.when(F.col("v") == -9999.0, F.lit(float("nan"))).otherwise(F.col("v")))
    tiles = rasters.to_tiles(px, "f64")
    back = rasters.from_tiles(graph.decompress(graph.compress_product(tiles, "planar>zigzag>zstd", "f64", 50)), "f64")
    return split.mark(back, None).select("tile", "y", "x", "valid")


@query(f"WITH {U16}, a AS (SELECT tile, y, x, v & 255 AS v FROM u16), b AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY tile, y ORDER BY x), 0) AS w, coalesce(lag(v) OVER (PARTITION BY tile, x ORDER BY y), 0) AS n FROM a), c AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY tile, y ORDER BY x), 0) AS nw FROM b) SELECT tile, y, x, (v - (w + n - nw)) & 255 AS r FROM c")
def planar_encode_u8(spark, d):
    return predict.encode(rasters.u16(spark, d).withColumn("v", F.col("v").bitwiseAND(F.lit(255).cast("long"))), "planar", 100, 1)


@query(f"WITH {CENTS}, s AS (SELECT tile, y, x, v - 25000000 AS v FROM cents) SELECT tile, y, x, sign(v)::BIGINT * ((abs(v) + 5) - (abs(v) + 5) % 10) AS q FROM s")
def linear_encode_signed(spark, d):
    px = rasters.cents(spark, d).withColumn("v", F.col("v") - 25000000)
    plan = quantise.plan_for(px, parse_error("LINEAR:MAX_ERROR=5"), "i32")
    return px.select("tile", "y", "x", quantise.encode(plan, F.col("v")).alias("q"))


LIN = "p AS (SELECT 2 * (0.5e0 - 2 * 1.1102230246251565e-16 * max(abs(v))) AS s FROM f64)"
ERRORS = {
    "linear": "LINEAR:MAX_ERROR=0.5",
    "linear_int": "LINEAR:MAX_ERROR=5",
    "linear_values": "LINEAR:MAX_ERROR=2.5,STORE=VALUES",
    "log": "LOG:MAX_ERROR=1%",
    "sqrt": "SQRT:MAX_ERROR=0.5N,A=100,B=1",
}


def _coded(spark, d, key, raster, kind):
    error, px = parse_error(ERRORS[key]), raster(spark, d)
    plan = quantise.plan_for(px, error, kind)
    return error, plan, px.withColumn("q", quantise.encode(plan, F.col("v")))


def _streams(key, raster, kind):
    return lambda s, d: _coded(s, d, key, raster, kind)[2].select("tile", "y", "x", "q")


def _rebuilt(key, raster, kind, digits=6):
    def run(s, d):
        _, plan, px = _coded(s, d, key, raster, kind)
        w = quantise.decode(plan, F.col("q"))
        return px.select("tile", "y", "x", F.round(w, digits).alias("w") if not kind.startswith("u") else w.alias("w"))

    return run


def _verified(key, raster, kind):
    def run(s, d):
        error, plan, px = _coded(s, d, key, raster, kind)
        r = quantise.verify(px.withColumn("w", quantise.decode(plan, F.col("q"))), error)
        return r.select((F.col("worst") <= 1).alias("holds"), "moved")

    return run


@query(f"WITH {F64} SELECT max(abs(v)) AS max_abs, bool_or(v < 0) AS any_negative FROM f64")
def linear_scan(spark, d):
    return quantise.scan(rasters.f64(spark, d), "LINEAR")


@query(f"WITH {F64} SELECT min(abs(v)) FILTER (v <> 0) AS min_abs, max(abs(v)) AS max_abs, bool_or(v < 0) AS any_negative, bool_or(v <> 0 AND abs(v) < 2.2250738585072014e-308) AS any_subnormal FROM f64")
def log_scan(spark, d):
    return quantise.scan(rasters.f64(spark, d), "LOG")


@query(f"WITH {F64} SELECT min(v) AS lo, max(v) AS hi, bool_or(v < 0) AS any_negative, false AS any_non_finite FROM f64")
def sqrt_scan(spark, d):
    return quantise.scan(rasters.f64(spark, d), "SQRT")


_Q_LIN = f"WITH {F64}, {LIN} SELECT tile, y, x, CAST(round_even(v / s, 0) AS BIGINT) AS q, s FROM f64, p"
_Q_INT = f"WITH {U16} SELECT tile, y, x, v, least((v + 5) // 10 * 10, 65535) AS q FROM u16"
_Q_VAL = f"WITH {F64} SELECT tile, y, x, v, round_even(v / 5e0, 0) * 5e0 AS q FROM f64"
query(f"SELECT tile, y, x, q FROM ({_Q_LIN})", "linear_encode_float")(_streams("linear", rasters.f64, "f64"))
query(f"SELECT tile, y, x, q FROM ({_Q_INT})", "linear_encode_int")(_streams("linear_int", rasters.u16, "u16"))
query(f"SELECT tile, y, x, q FROM ({_Q_VAL})", "linear_values")(_streams("linear_values", rasters.f64, "f64"))
query(f"SELECT tile, y, x, round(greatest(q * s, 0e0), 6) AS w FROM ({_Q_LIN})", "linear_decode")(_rebuilt("linear", rasters.f64, "f64"))
query(f"SELECT max(abs(v - q)) <= 5 AS holds, count(*) FILTER (v <> q) AS moved FROM ({_Q_INT})", "linear_verify")(_verified("linear_int", rasters.u16, "u16"))


@query(f"WITH {F64}, {LIN} SELECT 'LINEAR' AS family, 1 AS flags, round(s, 12) AS step, 0e0 AS offset_ FROM p")
def linear_plan(spark, d):
    p = quantise.plan_for(rasters.f64(spark, d), parse_error(ERRORS["linear"]), "f64")
    return spark.createDataFrame([(p.family, p.flags, round(p.step, 12), p.offset)], "family string, flags int, step double, offset_ double")


_SLACK = "(8 * 1.1102230246251565e-16 * {span})"
_LOG1P = "ln(1 + {x})"


def _log_step(span: int, index: bool) -> str:
    import math

    slack = 8 * 2.0**-53 * span
    if index:
        half = (math.log1p(0.01) - math.log1p(2.0**-53) - math.log1p(slack * math.log(2))) * math.log2(math.e) - slack
    else:
        half = (math.log1p(math.sqrt(1.01) - 1) - math.log1p(slack * math.log(2))) * math.log2(math.e) - slack
    return repr(2 * half)


_Q_LOGI = f"WITH {U16} SELECT tile, y, x, v, CASE WHEN v = 0 THEN 0 ELSE least(CAST(floor(power(2e0, floor(log2(v) * (1e0 / {_log_step(16, False)}) + 0.5e0) * {_log_step(16, False)}) + 0.5e0) AS BIGINT), 65535) END AS q FROM u16"
_Q_LOGF = f"WITH {F64} SELECT tile, y, x, v, CASE WHEN v = 0 THEN 0 ELSE CAST(sign(v) * floor((log2(abs(v)) + 1074) * (1e0 / {_log_step(2098, True)}) + 1.5e0) AS BIGINT) END AS q FROM f64"
query(f"SELECT tile, y, x, q FROM ({_Q_LOGI})", "log_encode_int")(_streams("log", rasters.u16, "u16"))
query(f"SELECT tile, y, x, q FROM ({_Q_LOGF})", "log_encode_float")(_streams("log", rasters.f64, "f64"))
query(f"SELECT tile, y, x, CASE WHEN q = 0 THEN 0e0 ELSE round(sign(q) * power(2e0, -1074 + (abs(q) - 1) * {_log_step(2098, True)}), 6) END AS w FROM ({_Q_LOGF})", "log_decode")(_rebuilt("log", rasters.f64, "f64"))
query(f"SELECT max(abs(v - q) / (0.01e0 * v)) FILTER (v <> 0) <= 1 AS holds, count(*) FILTER (v <> q) AS moved FROM ({_Q_LOGI})", "log_verify")(_verified("log", rasters.u16, "u16"))

_SQ = "p AS (SELECT 0.5e0 - 1.1102230246251565e-16 * greatest(CASE WHEN min(v) = 0 THEN 0 ELSE abs(min(v)) / sqrt(min(v) + 100e0) END, max(v) / sqrt(max(v) + 100e0)) - 3 * 2.220446049250313e-16 * sqrt(max(v) + 100e0) AS s FROM f64)"
_Q_SQF = f"WITH {F64}, {_SQ}, t AS (SELECT *, (v + 100e0) * (1e0 / (s * s)) AS t FROM f64, p) SELECT tile, y, x, v, s, CASE WHEN t <= 0.25e0 THEN 0 ELSE CAST(floor(0.5e0 + sqrt(t - 0.25e0)) AS BIGINT) END AS q FROM t"
_Q_SQI = f"WITH {U16}, t AS (SELECT *, (v + 100e0) * (1e0 / (0.25e0 * 0.25e0)) AS t FROM u16), q AS (SELECT *, floor(0.5e0 + sqrt(t - 0.25e0)) AS j FROM t) SELECT tile, y, x, v, CAST(floor(least(greatest((j * 0.25e0) * (j * 0.25e0) - 100e0, 0e0), 65535e0) + 0.5e0) AS BIGINT) AS q FROM q"
query(f"SELECT tile, y, x, q FROM ({_Q_SQF})", "sqrt_encode_float")(_streams("sqrt", rasters.f64, "f64"))
query(f"SELECT tile, y, x, q FROM ({_Q_SQI})", "sqrt_encode_int")(_streams("sqrt", rasters.u16, "u16"))
query(f"SELECT tile, y, x, round(greatest((q * s) * (q * s) - 100e0, 0e0), 6) AS w FROM ({_Q_SQF})", "sqrt_decode")(_rebuilt("sqrt", rasters.f64, "f64"))
query(f"SELECT max(abs(v - q) / (0.5e0 * sqrt(100e0 + v))) <= 1 AS holds, count(*) FILTER (v <> q) AS moved FROM ({_Q_SQI})", "sqrt_verify")(_verified("sqrt", rasters.u16, "u16"))

_W = "OVER (PARTITION BY x ORDER BY y)"
_BLOCKS = (
    "s AS (SELECT o_orderkey // 300 AS y, o_orderkey % 300 AS x, CAST(floor(o_totalprice) AS DOUBLE) AS v FROM orders), "
    f"c AS (SELECT *, lag(v) {_W} + lead(v) {_W} AS ns, v - 0 AS m FROM s), "
    "r AS (SELECT y, x, v, 4 * v - 2 * (ns + lag(v) OVER w + lead(v) OVER w) + (lag(ns) OVER w + lead(ns) OVER w) AS r FROM c WINDOW w AS (PARTITION BY y ORDER BY x)), "
    "h AS (SELECT max(y) + 1 AS h FROM s), "
    "b AS (SELECT 0 AS tile, (y - 1) // 8 AS by_, (x - 1) // 8 AS bx, sum(v) / 64 AS mu, sum(r * r) / (36 * 64) / 0.624732e0 AS s2 FROM r, h WHERE y >= 1 AND x >= 1 AND h >= 10 AND (y - 1) // 8 < (h - 2) // 8 AND (x - 1) // 8 < 298 // 8 GROUP BY 2, 3 HAVING count(*) = 64)"
)
_BINS = (
    f"{_BLOCKS}, e AS (SELECT min(mu) AS lo, max(mu) AS hi FROM b), k AS (SELECT b.*, (SELECT count(*) FROM range(1, 24) t(t) WHERE lo + (hi - lo) * t / 24e0 <= mu) AS bin FROM b, e), "
    "q AS (SELECT *, count(*) OVER (PARTITION BY bin) AS c, row_number() OVER (PARTITION BY bin ORDER BY s2, mu, by_, bx) AS rank FROM k), "
    "g AS (SELECT bin, c, avg(mu) AS mu, max(CASE WHEN rank = 1 + floor(0.1e0 * c) THEN s2 END) AS s2 FROM q WHERE c >= 12 GROUP BY bin, c)"
)


def _noise_blocks(spark, d):
    return noise.blocks(rasters.scene(spark, d), 300)


@query(f"WITH {_BLOCKS} SELECT by_, bx, round(mu, 6) AS mu, round(s2, 3) AS s2 FROM b")
def noise_blocks(spark, d):
    return _noise_blocks(spark, d).select(F.col("by").alias("by_"), "bx", F.round("mu", 6).alias("mu"), F.round("s2", 3).alias("s2"))


@query(f"WITH {_BINS} SELECT bin, c, round(mu, 4) AS mu, round(s2, 2) AS s2 FROM g")
def noise_bins(spark, d):
    return noise.bins(_noise_blocks(spark, d)).select("bin", "c", F.round("mu", 4).alias("mu"), F.round("s2", 2).alias("s2"))


_NOISY = (
    "z AS (SELECT o_orderkey * 10 + i AS k, (CAST(round(o_totalprice * 100) AS BIGINT) * (i + 1) * 7919) % 1000 / 1000e0 - 0.5e0 AS share FROM orders, range(0, 10) t(i)), "
    "noisy AS (SELECT k // 150 AS y, k % 150 AS x, CAST(floor(s + sqrt(s + 100) * share * 3.4641016151377544e0) AS DOUBLE) AS v FROM (SELECT k, share, 500e0 + 20 * (k // 150 % 100) AS s FROM z))"
)
_CURVE = (
    f"WITH {_NOISY}, {_BINS.replace('s AS (SELECT o_orderkey // 300 AS y, o_orderkey % 300 AS x, CAST(floor(o_totalprice) AS DOUBLE) AS v FROM orders)', 's AS (SELECT * FROM noisy)').replace('298 // 8', '148 // 8')}, "
    "m AS (SELECT sum(c) AS w, sum(c * mu) AS x, sum(c * s2) AS y, sum(c * mu * mu) AS xx, sum(c * mu * s2) AS xy, count(*) AS bins, arg_min(mu, bin) AS first, arg_max(mu, bin) AS last FROM g), "
    "sl AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS b FROM m), ab AS (SELECT *, greatest(0, (y - b * x) / w) AS a FROM sl)"
)


@query(
    f"{_CURVE} SELECT round(a, 3) AS a, round(b, 6) AS b, (SELECT count(*) FROM b) AS blocks, bins, round(last / first, 6) AS range, round(abs(x / w) / sqrt(xx / w - (x / w) * (x / w)), 6) AS colin, "
    "round((SELECT sqrt(sum((s2 - a - b * mu) * (s2 - a - b * mu)) / sum(s2 * s2)) FROM g, ab), 6) AS resid FROM ab"
)
def noise_fit(spark, d):
    """The curve of a raster whose noise has variance 100 + signal (as rounding to whole samples leaves it)."""
    r = noise.fit(noise.blocks(rasters.noisy(spark, d), 150))
    return r.select(F.round("a", 3).alias("a"), F.round("b", 6).alias("b"), "blocks", "bins", F.round("range", 6).alias("range"), F.round("colin", 6).alias("colin"), F.round("resid", 6).alias("resid"))


@query(
    f"{_CURVE} SELECT 0 AS tile, y, x, CAST(floor(least(greatest((j * st) * (j * st) - o, 0e0), 65535e0) + 0.5e0) AS BIGINT) AS v FROM ("
    "SELECT n.y, n.x, st, o, floor(0.5e0 + sqrt((n.v + o) * (1e0 / (st * st)) - 0.25e0)) AS j FROM noisy n, (SELECT 0.5e0 * sqrt(b) / 2 AS st, a / b AS o FROM ab))"
)
def frame_sqrt_fitted(spark, d):
    """A product within half its own noise, which is fitted when the plan is cut; its one raster goes in strips of 1000 rows."""
    px = rasters.noisy(spark, d)
    frames = graph.compress_product(rasters.to_strips(px, "u16", 150, 1000), "planar>zigzag>transpose>zstd", "u16", 150, "SQRT:MAX_ERROR=0.5N", px=px)
    return rasters.from_strips(rasters.from_tiles(graph.decompress(frames), "u16"), 1000)


#: Predictors with what follows them, and terminals by sample size.
_GRID = """WITH p(p) AS (VALUES ('id'), ('delta_1d'), ('delta_w>zigzag'), ('delta_n>zigzag'), ('planar>zigzag'), ('med>zigzag'), ('average>zigzag'), ('wp_static>zigzag')),
t(t, size) AS (VALUES ('entropy', 1), ('field_lz', 1), ('zstd', 1), ('categorical', 1),
  ('entropy', 2), ('field_lz', 2), ('zstd', 2), ('categorical', 2), ('transpose>entropy', 2), ('transpose>zstd', 2), ('store_lo', 2),
  ('entropy', 8), ('field_lz', 8), ('zstd', 8), ('transpose>entropy', 8), ('transpose>zstd', 8), ('store_lo', 8))
SELECT p || '>' || t AS method, size FROM p, t"""


@query(_GRID)
def method_grid(spark, d):
    return spark.createDataFrame([(m, size) for size in (1, 2, 8) for m in grid(size)], "method string, size int")


def _tiles(spark, d):
    return rasters.to_tiles(rasters.u16(spark, d), "u16")


for _m in ("planar>zigzag>transpose>entropy", "med>zigzag>store_lo", "average>zigzag>zstd", "wp_static>zigzag>entropy", "delta_1d>transpose>zstd", "id>field_lz"):
    query(ORIGINAL, "frame_" + _m.replace(">", "_"))(lambda s, d, m=_m: rasters.from_tiles(graph.decompress(graph.compress(_tiles(s, d), graph.Graph(m, 2, 100))), "u16"))


@query(f"WITH {U16} SELECT tile, count(*) AS n, 100 AS width, 2 AS size FROM u16 GROUP BY tile")
def frame_heads(spark, d):
    f = graph.decompress(graph.compress(_tiles(spark, d), graph.Graph("planar>zigzag>zstd", 2, 100)))
    return f.select("tile", "n", "width", F.col("elt").alias("size"))


@query(
    """SELECT * FROM (VALUES (7526145, 'delta_w', 1, false), (7526146, 'delta_n', 1, false), (7526147, 'planar', 1, false), (7526148, 'deinterleave', 2, false),
(7526149, 'med', 1, false), (7526150, 'average', 1, false), (7526151, 'wp_static', 1, false), (7526152, 'binoffset', 2, false), (7526153, 'intmult', 2, false),
(7526154, 'floatquant', 2, false), (7526155, 'floatmult', 2, false), (7526156, 'nodata', 2, false),
(7526273, 'quant_linear', 1, true), (7526274, 'quant_log', 1, true), (7526275, 'quant_sqrt', 1, true)) t(codec, name, streams, lossy)"""
)
def codec_registry(spark, d):
    return spark.createDataFrame([(i, c.name, c.outputs, codecs.lossy(i)) for i, c in codecs.REGISTRY.items()], "codec int, name string, streams int, lossy boolean")


@query(f"WITH {U16} SELECT DISTINCT tile, unnest([0, 1]) AS place, unnest([{0x72D781}, {0x72D703}]) AS codec, unnest(['quant_linear', 'planar']) AS name, unnest([true, false]) AS lossy, unnest(['01030000000000002440', '64000000']) AS header FROM u16")
def frame_steps(spark, d):
    """The steps in each frame of a product within 5 of its samples, and their header bytes."""
    tiles = _tiles(spark, d)
    return graph.frame_steps(graph.compress(tiles, graph.graph_for(tiles, "planar>zigzag>entropy", "u16", 100, ERRORS["linear_int"])))


@query(f"SELECT tile, y, x, q AS v FROM ({_Q_INT})")
def frame_linear_int(spark, d):
    tiles = _tiles(spark, d)
    g = graph.graph_for(tiles, "med>zigzag>transpose>entropy", "u16", 100, ERRORS["linear_int"])
    return rasters.from_tiles(graph.decompress(graph.compress(tiles, g)), "u16")


@query(f"{_FILL}, p AS (SELECT 2 * (0.5e0 - 2 * 1.1102230246251565e-16 * max(abs(v))) AS s FROM holed) SELECT tile, y, x, CASE WHEN g IS NULL THEN -9999e0 ELSE round(round_even(f / s, 0) * s, 6) END AS v FROM f, p")
def frame_linear_holes(spark, d):
    """Floats with a sentinel through one grid of the raw product; holes come back as they were."""
    tiles = rasters.to_tiles(rasters.holed(spark, d), "f64")
    g = graph.graph_for(tiles, "planar>zigzag>transpose>zstd", "f64", 50, ERRORS["linear"], -9999.0)
    return rasters.from_tiles(graph.decompress(graph.compress(tiles, g)), "f64").withColumn("v", F.round("v", 6))


@query(f"WITH {U16}, t AS (SELECT tile, count(*) * 2 AS bytes FROM u16 GROUP BY tile) SELECT tile, bytes FROM t UNION ALL SELECT -1 - tile, bytes FROM t UNION ALL SELECT 1000000 + tile, 0 FROM t")
def frame_sizes(spark, d):
    """What frames open to; of frames cut short behind their heads (negative numbers), and of what is none."""
    f = graph.compress(_tiles(spark, d), graph.Graph("planar>zigzag>zstd", 2, 100))
    short = f.select((-1 - F.col("tile")).alias("tile"), F.expr("substring(frame, 1, length(frame) - 20)").alias("frame"))
    none = f.select((F.col("tile") + 1000000).alias("tile"), F.expr("substring(frame, 3, 40)").alias("frame"))
    return graph.frame_sizes(f.select("tile", "frame").unionByName(short).unionByName(none))


@query(f"WITH {U16} SELECT tile, true AS refused, true AS opens FROM u16 GROUP BY tile")
def frame_checksums(spark, d):
    """A lossy frame with one stored bit turned over is refused, and opens where checksums are not asked for."""
    f = graph.compress(_tiles(spark, d), graph.Graph("id>store_lo", 2, 100, plan=quantise.Plan("LINEAR", "u16", 10.0, 0.0, True, True)))

    def run(frames):
        for x in frames:
            rows = []
            for t, b in zip(x["tile"], x["frame"], strict=True):
                at = graph.frame_head(b)["at"] + 3
                b = b[:at] + bytes([b[at] ^ 1]) + b[at + 1 :]
                try:
                    refused = graph.decompress_tile(b) is None
                except ValueError:
                    refused = True
                rows.append((t, refused, len(graph.decompress_tile(b, False)) > 0))
            yield pd.DataFrame(rows, columns=["tile", "refused", "opens"])

    return f.mapInPandas(run, "tile long, refused boolean, opens boolean")


for _c, _p in {"intmult": {"base": 10}, "binoffset": {}, "planar": {"width": 100}, "med": {"width": 100}, "average": {"width": 100}, "deinterleave": {}, "nodata": {"hole": 7, "width": 100}}.items():
    query(ORIGINAL, f"codec_{_c}")(lambda s, d, c=_c, p=_p: rasters.from_tiles(graph.decode_tiles(graph.encode_tiles(_tiles(s, d), c, **p), c), "u16"))


@query(f"WITH {SKEW} SELECT tile, count(*) AS n, true AS lz_smaller, true AS constant_small FROM skew GROUP BY tile")
def terminal_sizes(spark, d):
    """Tiles of a rare class: matches take less room than order-0 codes; a constant tile takes under 64 bytes behind its head."""
    skew = rasters.skewed(spark, d)
    tiles = {k: rasters.to_tiles(px, "u16") for k, px in (("skew", skew), ("flat", skew.withColumn("v", F.lit(3).cast("long"))))}

    def body(t, m, name):
        def run(frames):
            for x in frames:
                yield pd.DataFrame({"tile": x["tile"], "n": [graph.frame_head(b)["n"] for b in x["frame"]], name: [len(b) - graph.frame_head(b)["at"] for b in x["frame"]]})

        return graph.compress(tiles[t], graph.Graph(m, 2, 100)).mapInPandas(run, f"tile long, n long, {name} long")

    lz, order0, flat = body("skew", "id>field_lz", "lz"), body("skew", "id>transpose>entropy", "e").drop("n"), body("flat", "id>categorical", "c").drop("n")
    return lz.join(order0, "tile").join(flat, "tile").select("tile", "n", (F.col("lz") < F.col("e")).alias("lz_smaller"), (F.col("c") < 64).alias("constant_small"))


BIN_LOG, BIN_META = 6, 30.0


@query()
def binoffset_histogram(spark, d):
    return bins.histogram(rasters.u16(spark, d), BIN_LOG)


@query()
def binoffset_merged(spark, d):
    return bins.tables(rasters.u16(spark, d), BIN_LOG, BIN_META)


@query(ORIGINAL)
def binoffset_packed(spark, d):
    return rasters.from_tiles(bins.unpacked_tiles(bins.packed_tiles(_tiles(spark, d), BIN_LOG, BIN_META)), "u16")


@query()
def profile_sizes(spark, d):
    return graph.profile(_tiles(spark, d)).select("tile", "graph", "bytes", "ratio", "shannon_pct")


@query(
    f"{_FILL}, c AS (SELECT tile, y, x, CAST(round_even(f / s, 0) AS BIGINT) AS v FROM f, (SELECT 2 * (0.5e0 - 2 * 1.1102230246251565e-16 * max(abs(v))) AS s FROM holed)), "
    "a AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY tile, y ORDER BY x), 0) AS w, coalesce(lag(v) OVER (PARTITION BY tile, x ORDER BY y), 0) AS n FROM c), "
    "nb AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY tile, y ORDER BY x), 0) AS nw FROM a), "
    f"r AS (SELECT tile, (v - (w + n - nw)) & 65535 AS r FROM nb), z AS (SELECT tile, {ZIG} AS z FROM r) {_bits('tile', 'z', 'z')}"
)
def lossy_pipeline(spark, d):
    """Holes out, linear quantiser planned on the raw product, planar, zigzag, order-0 bits."""
    px = rasters.holed(spark, d)
    plan = quantise.plan_for(px, parse_error(ERRORS["linear"]), "f64")
    filled = split.fill(split.mark(px, -9999.0))
    q = filled.select("tile", "y", "x", quantise.encode(plan, F.col("v")).alias("v"))
    r = predict.encode(q, "planar", 50, 2)
    return split.entropy(r.select("tile", predict.zigzag(F.col("r"), 2).alias("z")), ["tile"], "z")
