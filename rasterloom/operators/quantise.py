"""Near-lossless quantisers: scan a product, cut one grid for it, encode, decode, verify."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.recipes import Error
from rasterloom.functions.types import BY_NAME, NUMPY, Kind, half_bits

EPS = 2.0**-52
#: Bits of span on values by type, span and anchor on indices of float types.
SPAN = {"u8": 8, "u16": 16, "u32": 32, "u64": 64, "i8": 8, "i16": 16, "i32": 32, "i64": 64, "f16": 11, "f32": 24, "f64": 53}
INDEX = {"f16": (40, -24), "f32": (277, -149), "f64": (2098, -1074)}


class Refused(ValueError):
    """A bound that no grid can hold on this raster."""


@dataclass(frozen=True)
class Plan:
    family: str
    kind: str
    step: float
    offset: float
    values: bool
    floor0: bool
    narrow: bool = False
    top: float = 0.0

    @property
    def flags(self) -> int:
        return int(self.floor0) | 2 * self.values | 4 * self.narrow


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def scan(px: DataFrame, family: str) -> DataFrame:
    """One row: what the family needs to know of the whole product; non-finite samples are skipped."""
    v = F.col("v").cast("double")
    ok = F.when(finite(v), v)
    if family == "LINEAR":
        return px.agg(F.max(F.abs(ok)).alias("max_abs"), F.coalesce(F.max(ok < 0), F.lit(False)).alias("any_negative"))
    if family == "LOG":
        a = F.when(ok != 0, F.abs(ok))
        low = F.coalesce(F.max((a < F.lit(2.2250738585072014e-308))), F.lit(False))
        return px.agg(F.coalesce(F.min(a), F.lit(float("inf"))).alias("min_abs"), F.coalesce(F.max(a), F.lit(0.0)).alias("max_abs"), F.coalesce(F.max(F.when(~F.isnan(v), v) < 0), F.lit(False)).alias("any_negative"), low.alias("any_subnormal"))
    return px.agg(F.min(ok).alias("lo"), F.max(ok).alias("hi"), F.coalesce(F.max(ok < 0), F.lit(False)).alias("any_negative"), F.coalesce(F.max(~finite(v)), F.lit(False)).alias("any_non_finite"))


def resolve(error: Error, kind: str, s: dict) -> Plan:
    """The grid of a product, from its scan; refuses where the bound can't be held."""
    k = BY_NAME[kind]
    values = k.integer or error.values
    plan = {"LINEAR": _linear, "LOG": _log, "SQRT": _sqrt}[error.family](error, k, s, values)
    if not math.isfinite(plan.step) or not math.isfinite(plan.offset):
        raise Refused("the grid has no finite step")
    return plan


def _linear(error: Error, k: Kind, s: dict, values: bool) -> Plan:
    if not s["max_abs"]:
        raise Refused("nothing but zeros")
    if k.integer:
        step = max(1.0, math.floor(min(2 * error.bound, float(k.hi))))
    elif values:
        step = math.floor(min(2 * error.bound, 2.0**1023))
        if step < 1 or math.ceil(s["max_abs"] / step) * step > min(k.exact, k.stream):
            raise Refused("whole steps do not fit")
    else:
        step = 2 * (error.bound - 2 * k.eps * s["max_abs"])
        if step <= 0 or s["max_abs"] / step > k.stream:
            raise Refused("the bound is below the type's resolution")
    return Plan("LINEAR", k.name, float(step), 0.0, values, not s["any_negative"])


def _log(error: Error, k: Kind, s: dict, values: bool) -> Plan:
    span, _ = (SPAN[k.name], 0) if values else INDEX[k.name]
    slack = 8 * 2.0**-53 * span
    if values:
        r = math.sqrt(1 + error.bound)
        half = (math.log1p(r - 1) - math.log1p(slack * math.log(2))) * math.log2(math.e) - slack
    else:
        half = (math.log1p(error.bound) - math.log1p(k.eps) - math.log1p(slack * math.log(2))) * math.log2(math.e) - slack
    if half <= 0:
        raise Refused("the bound is below the type's resolution")
    step = 2 * half
    if values:
        if not k.integer and (s["min_abs"] < 0.5 / (r - 1) or s["max_abs"] and 2.0 ** (math.ceil(math.log2(s["max_abs"]) / step) * step) > k.exact):
            raise Refused("whole levels do not fit")
        top = 0.0
    else:
        span_, anchor = INDEX[k.name]
        top = math.floor((math.log2(k.hi) - anchor) / step + 1.5)
        if top >= k.stream:
            raise Refused("too many levels")
    return Plan("LOG", k.name, step, 0.0, values, not s["any_negative"], top=top)


def _sqrt(error: Error, k: Kind, s: dict, values: bool) -> Plan:
    if s["lo"] is None:
        raise Refused("nothing finite")
    if error.a is None:
        raise Refused("the curve is not known; fit it first")
    c, offset = error.bound * math.sqrt(error.b), error.a / error.b
    if not math.isfinite(c) or not math.isfinite(offset):
        raise Refused("the curve is out of range")
    most = max(abs(s["lo"]), abs(s["hi"]))
    if s["lo"] < -offset:
        raise Refused("samples below the curve's zero")
    u, narrow = math.sqrt(most + offset), False
    if values:
        step = c / 2
        if u / step >= 0.5 / (3 * EPS) or not k.integer and (s["lo"] < 1 / (c * c) - offset or math.ceil(most) > k.exact):
            raise Refused("whole values do not fit")
    else:
        g = lambda x: abs(x) / math.sqrt(x + offset) if x else 0.0
        charge = k.eps * max(g(s["lo"]), g(s["hi"]))
        if k.name == "f32" and 8 * k.eps * u <= 0.25 * c:
            charge, narrow = 8 * k.eps * u, True
        step = c - charge - 3 * EPS * u
        if step <= 0 or u / step >= k.stream:
            raise Refused("the bound is below the type's resolution")
    return Plan("SQRT", k.name, step, offset, values, not s["any_negative"], narrow)


def away(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c) + F.lit(0.5))


def _clamp(c: Column, k: Kind) -> Column:
    return F.greatest(F.lit(float(k.lo)), F.least(c, F.lit(float(k.hi))))


def encode(p: Plan, v: Column) -> Column:
    """The stored stream of a sample column: whole numbers (as double for float types on values, else long)."""
    k = BY_NAME[p.kind]
    if p.family == "LINEAR":
        if k.integer:
            s = int(p.step)
            a = F.abs(v) + s // 2
            q = (a - a % s) * F.signum(v).cast("long")
            return F.greatest(F.lit(int(k.lo)), F.least(q, F.lit(int(k.hi)))).cast("long")
        q = F.rint(F.when(F.isnan(v), F.lit(0.0)).otherwise(v.cast("double")) / F.lit(p.step))
        q = F.greatest(F.lit(-float(k.stream)), F.least(q, F.lit(float(k.stream))))
        return q * F.lit(p.step) if p.values else q.cast("long")
    if p.family == "LOG":
        a, inv = F.abs(v.cast("double")), F.lit(1.0 / p.step)
        sign = F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        none = F.isnan(v.cast("double")) | (v == 0)
        if p.values:
            j = F.floor(F.log2(a) * inv + 0.5)
            level = F.floor(F.pow(F.lit(2.0), j.cast("double") * F.lit(p.step)) + 0.5)
            out = F.when(none, F.lit(0.0)).otherwise(sign * F.least(level.cast("double"), F.lit(float(k.hi if k.lo == 0 else -k.lo))))
            out = F.least(out, F.lit(float(k.hi)))
            return out.cast("long") if k.integer else out
        m = F.floor((F.log2(a) - INDEX[p.kind][1]) * inv + 1.5).cast("double")
        m = F.greatest(F.lit(1.0), F.least(F.when(a == float("inf"), F.lit(p.top)).otherwise(m), F.lit(p.top)))
        return F.when(none, F.lit(0.0)).otherwise(sign * m).cast("long")
    t = (v.cast("double") + F.lit(p.offset)) * F.lit(1.0 / (p.step * p.step))
    q = F.when((t <= 0.25) | F.isnan(t), F.lit(0)).otherwise(F.floor(F.lit(0.5) + F.sqrt(F.greatest(t - 0.25, F.lit(0.0))))).cast("long")
    if not p.values:
        return F.least(q, F.lit(k.stream))
    x = q.cast("double") * F.lit(p.step)
    out = away(_clamp(x * x - F.lit(p.offset), k))
    return out.cast("long") if k.integer else out


def decode(p: Plan, q: Column) -> Column:
    k = BY_NAME[p.kind]
    floor0 = lambda c: F.greatest(c, F.lit(0.0)) if p.floor0 and k.lo < 0 else c
    q = q.cast("double")
    if p.values:
        out = q if p.family == "SQRT" and k.integer else floor0(q)
    elif p.family == "LINEAR":
        out = _clamp(floor0(q * F.lit(p.step)), k)
    elif p.family == "LOG":
        out = F.when(q == 0, F.lit(0.0)).otherwise(F.signum(q) * F.pow(F.lit(2.0), INDEX[p.kind][1] + (F.abs(q) - 1) * F.lit(p.step)))
        out = _clamp(floor0(out), k)
    else:
        # A narrow plan has charged its bound for single precision.
        real = "float" if p.narrow else "double"
        x = q.cast(real) * F.lit(p.step).cast(real)
        out = _clamp(floor0((x * x - F.lit(p.offset).cast(real)).cast("double")), k)
    return out.cast("long") if k.integer else out.cast("float").cast("double") if p.kind == "f32" else out


def bound(error: Error, x: Column) -> Column:
    """The error that a sample may have."""
    if error.family == "LINEAR":
        return F.lit(error.bound)
    if error.family == "LOG":
        return F.lit(error.bound) * F.abs(x)
    return F.lit(error.bound) * F.sqrt(F.greatest(F.lit(error.a) + F.lit(error.b) * x, F.lit(0.0)))


def verify(both: DataFrame, error: Error, x: str = "v", y: str = "w") -> DataFrame:
    """One row: the worst error as a share of its bound (at most 1 holds), and how many samples moved."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    limit = bound(error, a)
    share = F.when(finite(a) & finite(b) & (a != b) & (limit > 0), F.abs(a - b) / limit)
    return both.agg(F.coalesce(F.max(share), F.lit(0.0)).alias("worst"), F.count(share).alias("moved"))


def plan_for(px: DataFrame, error: Error, kind: str) -> Plan:
    """Scans the product (one job, one row to the driver) and cuts its grid."""
    return resolve(error, kind, scan(px, error.family).first().asDict())


def carrier(kind: str) -> np.dtype:
    """The integer type of a kind's stream: its own, or a signed one of the same size for float types."""
    k = BY_NAME[kind]
    return np.dtype(NUMPY[kind]) if k.integer else np.dtype(f"i{k.size}")


def _whole_steps(v: np.ndarray, s: int) -> np.ndarray:
    """Integers to the nearest multiple of s, halves away from zero, cut to the type; no step overflows."""
    info = np.iinfo(v.dtype)
    s = min(s, 2**63)
    negative = v < 0
    a = np.where(negative, np.uint64(0) - v.astype(np.uint64), v.astype(np.uint64))
    top = np.where(negative, np.uint64(-int(info.min)), np.uint64(info.max))
    low = a - a % np.uint64(s)
    up = a - low >= np.uint64(s - s // 2)
    q = np.where(up, np.where(top - low < np.uint64(s), top, low + np.uint64(s)), low)
    return np.where(negative, np.uint64(0) - q, q).astype(v.dtype)


def encode_array(p: Plan, v: np.ndarray) -> np.ndarray:
    """As ``encode``, for the samples of one tile; the stream has the type of ``carrier``."""
    k, out = BY_NAME[p.kind], carrier(p.kind)
    if p.family == "LINEAR" and k.integer:
        return _whole_steps(v, int(p.step))
    x = v.astype(np.float64)
    with np.errstate(all="ignore"):
        if p.family == "LINEAR":
            q = np.clip(np.rint(np.where(np.isnan(x), 0.0, x) / p.step), -float(k.stream), float(k.stream))
            return (q * p.step if p.values else q).astype(out)
        if p.family == "LOG":
            a, inv = np.abs(x), 1.0 / p.step
            none = np.isnan(x) | (x == 0)
            a = np.where(none, 1.0, a)
            if p.values:
                j = np.floor(np.log2(a) * inv + 0.5)
                level = np.minimum(np.floor(np.exp2(j * p.step) + 0.5), float(k.hi if k.lo == 0 else -k.lo))
                q = np.minimum(np.where(none, 0.0, np.copysign(level, x)), float(k.hi))
                if not k.integer:
                    q = np.clip(q, -float(k.stream), float(k.stream))
                return q.astype(out)
            m = np.clip(np.where(np.isinf(a), p.top, np.floor((np.log2(a) - INDEX[p.kind][1]) * inv + 1.5)), 1.0, p.top)
            return np.where(none, 0.0, np.copysign(m, x)).astype(out)
        t = (x + p.offset) * (1.0 / (p.step * p.step))
        q = np.where((t <= 0.25) | np.isnan(t), 0.0, np.floor(0.5 + np.sqrt(np.maximum(t - 0.25, 0.0))))
        if not p.values:
            return np.minimum(q, float(k.stream)).astype(out)
        u = q * p.step
        u = np.clip(u * u - p.offset, float(k.lo), float(k.hi))
        return np.clip(np.copysign(np.floor(np.abs(u) + 0.5), u), *((float(k.lo), float(k.hi)) if k.integer else (-float(k.stream), float(k.stream)))).astype(out)


def decode_array(p: Plan, q: np.ndarray) -> np.ndarray:
    """As ``decode``: samples of the kind's type (half precision as its numpy type)."""
    k = BY_NAME[p.kind]
    floor0 = p.floor0 and k.lo < 0
    if k.integer:
        return np.maximum(q, 0) if floor0 and p.family != "SQRT" else q
    x = q.astype(np.float64)
    with np.errstate(all="ignore"):
        if p.values:
            pass
        elif p.family == "LINEAR":
            x = x * p.step
        elif p.family == "LOG":
            x = np.where(x == 0, 0.0, np.copysign(np.exp2(INDEX[p.kind][1] + (np.abs(x) - 1) * p.step), x))
        else:
            # A narrow plan has charged its bound for single precision.
            real = np.float32 if p.narrow else np.float64
            u = x.astype(real) * real(p.step)
            x = (u * u - real(p.offset)).astype(np.float64)
        x = np.clip(np.maximum(x, 0.0) if floor0 else x, float(k.lo), float(k.hi))
    return half_bits(x).view(np.float16) if p.kind == "f16" else x.astype(NUMPY[p.kind])


def scan_tiles(tiles: DataFrame, kind: str) -> dict:
    """What all three families need to know of a product in tile form, as one row.

    Each tile gives one row of partial figures. Declared holes count as any other sample, as the grid is cut
    on the raw product; any_nan tells whether NaNs have to be taken for holes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for data in f["data"]:
                v = np.frombuffer(data, np.dtype(NUMPY[kind]).newbyteorder("<")).astype(np.float64)
                ok = v[np.isfinite(v)]
                a = np.abs(ok[ok != 0])
                none = [None] * 4
                ends = [float(a.min()) if len(a) else None, float(np.abs(ok).max()), float(ok.min()), float(ok.max())] if len(ok) else none
                rows.append((*ends, bool((v < 0).any()), bool((a < 2.2250738585072014e-308).any()), len(ok) < len(v), bool(np.isnan(v).any())))
            yield pd.DataFrame(rows, columns=["min_abs", "max_abs", "lo", "hi", "any_negative", "any_subnormal", "any_non_finite", "any_nan"])

    flags = ("any_negative", "any_subnormal", "any_non_finite", "any_nan")
    part = tiles.select("data").mapInPandas(run, "min_abs double, max_abs double, lo double, hi double, " + ", ".join(f"{c} boolean" for c in flags))
    row = part.agg(F.coalesce(F.min("min_abs"), F.lit(float("inf"))).alias("min_abs"), F.coalesce(F.max("max_abs"), F.lit(0.0)).alias("max_abs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in flags))
    return row.first().asDict()
