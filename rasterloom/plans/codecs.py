"""Single codecs by id, over one tile's streams: header bytes out, header bytes checked on the way back.

A codec turns one stream into one or two and a little-endian header, all that its decoder gets beside them.
Decoders refuse headers that contradict themselves or their streams.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from rasterloom.functions.types import KINDS, UNSIGNED
from rasterloom.operators import bins, quantise, split
from rasterloom.operators.predict import around, decode_block, train_block, weighted

# The ids of the codecs, and the ends of their ranges.
IDS = {
    "delta_w": 0x72D701,
    "delta_n": 0x72D702,
    "planar": 0x72D703,
    "deinterleave": 0x72D704,
    "med": 0x72D705,
    "average": 0x72D706,
    "wp_static": 0x72D707,
    "binoffset": 0x72D708,
    "intmult": 0x72D709,
    "floatquant": 0x72D70A,
    "floatmult": 0x72D70B,
    "nodata": 0x72D70C,
    "quant_linear": 0x72D781,
    "quant_log": 0x72D782,
    "quant_sqrt": 0x72D783,
}
FIRST, LOSSLESS_LAST, LAST = 0x72D700, 0x72D77F, 0x72D7FF
NAMES = {v: k for k, v in IDS.items()}
FAMILIES = {"LINEAR": "quant_linear", "LOG": "quant_log", "SQRT": "quant_sqrt"}
Streams = list[np.ndarray]


class Damaged(ValueError):
    """A header or stream that no encoder writes."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise Damaged(what)


def owned(codec: int) -> bool:
    return FIRST <= codec <= LAST


def lossy(codec: int) -> bool:
    return LOSSLESS_LAST < codec <= LAST


def row_width(n: int, width: int) -> int:
    """Rows to encode by: a width of 0, or over the samples, is one row; one that does not divide is refused."""
    if width == 0 or width > n:
        return max(n, 1)
    if n % width:
        raise ValueError("width does not divide the samples")
    return width


def _checked_width(n: int, width: int) -> int:
    _need(n == 0 or 0 < width <= n and n % width == 0, "row width does not fit the samples")
    return max(width, 1)


def residuals(v: np.ndarray, name: str) -> np.ndarray:
    """A (rows, width) block less its prediction, in wrapping arithmetic."""
    w, n, nw, *_ = around(v)
    if name == "delta_w":
        return v - w
    if name == "delta_n":
        return v - n
    if name == "planar":
        return v - (w + n - nw)
    if name == "med":
        lo, hi = np.minimum(w, n), np.maximum(w, n)
        return v - np.where(nw >= hi, lo, np.where(nw <= lo, hi, w + n - nw))
    return v - ((w >> 1) + (n >> 1) + (w & n & 1))


def samples(r: np.ndarray, name: str) -> np.ndarray:
    if name == "delta_w":
        return np.cumsum(r, axis=1, dtype=r.dtype)
    if name == "delta_n":
        return np.cumsum(r, axis=0, dtype=r.dtype)
    if name == "planar":
        return np.cumsum(np.cumsum(r, axis=1, dtype=r.dtype), axis=0, dtype=r.dtype)
    return decode_block(r, name)


def _spatial(name: str) -> tuple[Callable, Callable]:
    def encode(v: np.ndarray, width: int) -> tuple[bytes, Streams]:
        width = row_width(len(v), width)
        return struct.pack("<I", width), [residuals(v.reshape(-1, width), name).reshape(-1)]

    def decode(header: bytes, streams: Streams) -> np.ndarray:
        _need(len(header) == 4, "a row width has 4 bytes")
        width = _checked_width(len(streams[0]), *struct.unpack("<I", header))
        return samples(streams[0].reshape(-1, width), name).reshape(-1)

    return encode, decode


def _encode_wp(v: np.ndarray, width: int, trained: tuple[tuple[int, int, int, int], int] | None = None) -> tuple[bytes, Streams]:
    """Coefficients come from the tile itself unless they are given."""
    width = row_width(len(v), width)
    block = v.reshape(-1, width)
    c, shift = trained or train_block(block)
    w, *near = around(block)
    return struct.pack("<IB4h", width, shift, *c), [(block - (w + weighted(*near, c, shift))).reshape(-1)]


def _decode_wp(header: bytes, streams: Streams) -> np.ndarray:
    _need(len(header) == 13, "a weighted predictor's header has 13 bytes")
    width, shift, *c = struct.unpack("<IB4h", header)
    _need(shift < 64, "shift is 64 or more")
    width = _checked_width(len(streams[0]), width)
    return decode_block(streams[0].reshape(-1, width), "wp_static", tuple(c), shift).reshape(-1)


def _encode_lanes(v: np.ndarray) -> tuple[bytes, Streams]:
    return b"", [v[::2].copy(), v[1::2].copy()]


def _decode_lanes(header: bytes, streams: Streams) -> np.ndarray:
    a, b = streams
    _need(not header and a.dtype == b.dtype and len(a) - len(b) in (0, 1), "lanes do not fit together")
    out = np.empty(len(a) + len(b), a.dtype)
    out[::2], out[1::2] = a, b
    return out


def _encode_bins(v: np.ndarray, table: bins.Table | None = None) -> tuple[bytes, Streams]:
    """By bit length unless a table is given."""
    table = table or bins.powers(v.itemsize)
    lower = (int(x).to_bytes(v.itemsize, "little") + bytes([b]) for x, b in zip(table.lowers, table.bits, strict=True))
    which = table.find(v)
    return bytes([len(table.lowers)]) + b"".join(lower), [which, (v - np.array(table.lowers, v.dtype)[which]).astype(v.dtype)]


def _decode_bins(header: bytes, streams: Streams) -> np.ndarray:
    which, off = streams
    _need(which.itemsize == 1 and len(which) == len(off) and len(header) > 0, "bins and offsets do not fit together")
    step = off.itemsize + 1
    _need(header[0] > 0 and len(header) == 1 + header[0] * step, "the bin table is cut short")
    entries = [header[1 + i * step : 1 + (i + 1) * step] for i in range(header[0])]
    table = bins.Table(tuple(int.from_bytes(e[:-1], "little") for e in entries), tuple(e[-1] for e in entries))
    _need(max(table.bits) <= 8 * off.itemsize, "a bin has too many bits")
    return table.join(which, off)


def _encode_multiple(v: np.ndarray, base: int) -> tuple[bytes, Streams]:
    if not 2 <= base < 1 << (8 * v.itemsize):
        raise ValueError("base has to be 2 or more and fit a sample")
    b = v.dtype.type(base)
    return base.to_bytes(v.itemsize, "little"), [v // b, v % b]


def _decode_multiple(header: bytes, streams: Streams) -> np.ndarray:
    m, a = streams
    _need(m.dtype == a.dtype and len(m) == len(a) and len(header) == m.itemsize, "multiples do not fit their rest")
    base = int.from_bytes(header, "little")
    _need(base >= 2 and not (a >= base).any(), "a rest is not below the base")
    return m * m.dtype.type(base) + a


def _float_pair(streams: Streams) -> np.dtype:
    a, b = streams
    _need(a.dtype == b.dtype and len(a) == len(b) and a.itemsize in (4, 8), "float parts do not fit together")
    return np.dtype(f"f{a.itemsize}")


def _encode_low_bits(v: np.ndarray, k: int) -> tuple[bytes, Streams]:
    if not 1 <= k <= {4: 23, 8: 52}.get(v.itemsize, 0):
        raise ValueError("k has to be within the mantissa")
    return bytes([k]), list(split.floatquant(v.view(f"f{v.itemsize}"), k))


def _decode_low_bits(header: bytes, streams: Streams) -> np.ndarray:
    kind = _float_pair(streams)
    _need(len(header) == 1 and 1 <= header[0] <= (23 if kind.itemsize == 4 else 52), "k is not within the mantissa")
    return split.floatquant_join(*streams, header[0], kind.str).view(streams[0].dtype)


def _latent(m: np.ndarray) -> np.ndarray:
    """Whole floats to unsigned integers in order: exact ones by value, larger ones by pattern."""
    u = np.dtype(f"u{m.itemsize}").type
    edge = 2 ** (24 if m.itemsize == 4 else 53)
    a, start = np.abs(m), np.array([edge], m.dtype).view(u)[0]
    small = a < edge
    place = np.where(small, np.where(small, a, 0).astype(u), a.view(u) - start + u(edge))
    mid = u(1 << (8 * m.itemsize - 1))
    return np.where(np.signbit(m), mid - u(1) - place, mid + place)


def _from_latent(x: np.ndarray) -> np.ndarray:
    u, kind = x.dtype.type, np.dtype(f"f{x.itemsize}")
    edge = 2 ** (24 if x.itemsize == 4 else 53)
    mid = u(1 << (8 * x.itemsize - 1))
    negative = x < mid
    place = np.where(negative, mid - u(1) - x, x - mid)
    start = np.array([edge], kind).view(u)[0]
    a = np.where(place < edge, place.astype(kind), (place - u(edge) + start).view(kind))
    return np.where(negative, -a, a).astype(kind)


def _encode_float_multiple(v: np.ndarray, base: float) -> tuple[bytes, Streams]:
    if v.itemsize not in (4, 8) or not (base > 0 or base < 0):
        raise ValueError("base has to be a number other than 0, samples of 4 or 8 bytes")
    with np.errstate(all="ignore"):
        m, off = split.floatmult(v.view(f"f{v.itemsize}"), base)
        return struct.pack("<d", base), [_latent(m), off + off.dtype.type(1 << (8 * v.itemsize - 1))]


def _decode_float_multiple(header: bytes, streams: Streams) -> np.ndarray:
    _float_pair(streams)
    _need(len(header) == 8, "a base has 8 bytes")
    (base,) = struct.unpack("<d", header)
    _need(base > 0 or base < 0, "base is 0 or no number")
    m, off = streams
    with np.errstate(all="ignore"):
        return split.floatmult_join(_from_latent(m), off - off.dtype.type(1 << (8 * off.itemsize - 1)), base).view(off.dtype)


def nan_patterns(v: np.ndarray) -> np.ndarray:
    """Where patterns of 2, 4 or 8 bytes are NaN; nothing is at 1 byte."""
    mantissa = {2: 10, 4: 23, 8: 52}.get(v.itemsize)
    if mantissa is None:
        return np.zeros(len(v), bool)
    u = v.dtype.type
    low, top = u((1 << mantissa) - 1), u(((1 << (8 * v.itemsize - 1)) - 1) >> mantissa << mantissa)
    return ((v & top) == top) & ((v & low) != 0)


def _encode_holes(v: np.ndarray, hole: int | str, width: int) -> tuple[bytes, Streams]:
    """Fills holes (a pattern, or "nan") from the left, else from above; the mask is 0 where a hole is."""
    holes = nan_patterns(v) if hole == "nan" else v == v.dtype.type(hole)
    nothing = np.zeros(0, np.uint8)
    if not holes.any():
        return b"\2", [v, nothing]
    pattern = int(v[holes.argmax()]).to_bytes(v.itemsize, "little")
    if holes.all():
        return b"\3" + pattern + struct.pack("<Q", len(v)), [v[:0], nothing]
    width = row_width(len(v), width)
    rows, ok = v.reshape(-1, width), ~holes.reshape(-1, width)
    last = np.maximum.accumulate(np.where(ok, np.arange(width), -1), axis=1)
    rows = np.where(last >= 0, np.take_along_axis(rows, np.maximum(last, 0), 1), 0)
    up = np.maximum.accumulate(np.where(last >= 0, np.arange(len(rows))[:, None], -1), axis=0)
    filled = np.where(up >= 0, np.take_along_axis(rows, np.maximum(up, 0), 0), 0)
    return b"\1" + pattern, [filled.astype(v.dtype).reshape(-1), (~holes).astype(np.uint8)]


def _decode_holes(header: bytes, streams: Streams) -> np.ndarray:
    v, mask = streams
    _need(len(header) > 0 and mask.itemsize == 1, "no code for the holes")
    pattern = int.from_bytes(header[1 : 1 + v.itemsize], "little")
    if header[0] == 2:
        _need(len(header) == 1 and not len(mask), "a tile without holes has no mask")
        return v
    if header[0] == 1:
        _need(len(header) == 1 + v.itemsize and len(mask) == len(v) > 0, "the mask does not fit")
        return np.where(mask == 0, v.dtype.type(pattern), v)
    _need(header[0] == 3 and len(header) == 9 + v.itemsize and not len(v) and not len(mask), "unknown code for the holes")
    (n,) = struct.unpack("<Q", header[1 + v.itemsize :])
    _need(0 < n < 1 << 40, "a count of holes is out of range")
    return np.full(n, pattern, v.dtype)


def plan_header(p: quantise.Plan) -> bytes:
    from rasterloom.functions.types import BY_NAME

    head = struct.pack("<BBd", BY_NAME[p.kind].code, p.flags, p.step)
    return head + struct.pack("<d", p.offset) if p.family == "SQRT" else head


def read_plan(family: str, header: bytes, size: int) -> quantise.Plan:
    """The plan in a header, for samples of a size; what no resolver cuts is refused."""
    _need(len(header) == (18 if family == "SQRT" else 10), "a quantiser's header has another size")
    code, flags, step = struct.unpack("<BBd", header[:10])
    offset = struct.unpack("<d", header[10:])[0] if family == "SQRT" else 0.0
    _need(code < len(KINDS) and KINDS[code].size == size, "no such sample type at this size")
    kind, values, narrow = KINDS[code], bool(flags & 2), bool(flags & 4)
    _need(flags < (8 if family == "SQRT" else 4), "unknown flags")
    _need(values or not kind.integer, "integers carry values")
    least = 2.2250738585072014e-308
    if family == "LINEAR":
        _need(least <= step < float("inf") and (kind.integer or not values or step == int(step)), "the step is no step")
    elif family == "LOG":
        _need(0 < step < float("inf"), "the step is no step")
    else:
        _need(0 < step < float("inf") and step * step >= least and 0 <= offset < float("inf") and (not narrow or kind.name == "f32"), "the step is no step")
    return quantise.Plan(family, kind.name, step, offset, values, bool(flags & 1), narrow)


def _quantiser(family: str) -> tuple[Callable, Callable]:
    def encode(v: np.ndarray, plan: quantise.Plan) -> tuple[bytes, Streams]:
        from rasterloom.functions.types import NUMPY

        q = quantise.encode_array(plan, v.view(NUMPY[plan.kind]))
        return plan_header(plan), [q.view(UNSIGNED[v.itemsize])]

    def decode(header: bytes, streams: Streams) -> np.ndarray:
        q = streams[0]
        plan = read_plan(family, header, q.itemsize)
        return quantise.decode_array(plan, q.view(quantise.carrier(plan.kind))).view(UNSIGNED[q.itemsize])

    return encode, decode


@dataclass(frozen=True)
class Codec:
    id: int
    name: str
    outputs: int
    encode: Callable[..., tuple[bytes, Streams]]
    decode: Callable[[bytes, Streams], np.ndarray]


_PAIRS = {
    "wp_static": (_encode_wp, _decode_wp),
    "deinterleave": (_encode_lanes, _decode_lanes),
    "binoffset": (_encode_bins, _decode_bins),
    "intmult": (_encode_multiple, _decode_multiple),
    "floatquant": (_encode_low_bits, _decode_low_bits),
    "floatmult": (_encode_float_multiple, _decode_float_multiple),
    "nodata": (_encode_holes, _decode_holes),
    **{name: _quantiser(family) for family, name in FAMILIES.items()},
}
TWO = {"deinterleave", "binoffset", "intmult", "floatquant", "floatmult", "nodata"}
REGISTRY = {i: Codec(i, name, 2 if name in TWO else 1, *(_PAIRS.get(name) or _spatial(name))) for name, i in IDS.items()}


def encode(name: str, v: np.ndarray, **parameters) -> tuple[bytes, Streams]:
    """(header, streams) of a codec by name, over unsigned patterns."""
    return REGISTRY[IDS[name]].encode(v, **parameters)


def decode(codec: int, header: bytes, streams: Streams) -> np.ndarray:
    if codec not in REGISTRY:
        raise Damaged(f"no codec {codec:#x}")
    _need(len(streams) == REGISTRY[codec].outputs, "a codec has another number of streams")
    return REGISTRY[codec].decode(header, streams)
