"""Sample types and exact floating-point constants."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Kind:
    code: int
    name: str
    size: int
    integer: bool
    signed: bool
    eps: float
    exact: int
    stream: int
    lo: float
    hi: float


# Fixed values of the sample types: code, name, bytes, integer, signed, half ulp, largest exact integer,
# largest index, least and largest value.
KINDS = [
    Kind(0, "u8", 1, True, False, 0.0, 0, 255, 0, 255),
    Kind(1, "u16", 2, True, False, 0.0, 0, 65535, 0, 65535),
    Kind(2, "u32", 4, True, False, 0.0, 0, 4294967295, 0, 4294967295),
    Kind(3, "u64", 8, True, False, 0.0, 0, 2**53, 0, 18446744073709549568),
    Kind(4, "i8", 1, True, True, 0.0, 0, 127, -128, 127),
    Kind(5, "i16", 2, True, True, 0.0, 0, 32767, -32768, 32767),
    Kind(6, "i32", 4, True, True, 0.0, 0, 2147483647, -2147483648, 2147483647),
    Kind(7, "i64", 8, True, True, 0.0, 0, 2**53, -(2.0**63), 9223372036854774784),
    Kind(8, "f16", 2, False, True, 2.0**-11, 2**11, 32767, -65504.0, 65504.0),
    Kind(9, "f32", 4, False, True, 2.0**-24, 2**24, 2147483647, -3.40282346638528860e38, 3.40282346638528860e38),
    Kind(10, "f64", 8, False, True, 2.0**-53, 2**53, 2**53, -1.79769313486231571e308, 1.79769313486231571e308),
]
BY_NAME = {k.name: k for k in KINDS}
NUMPY = dict(zip((k.name for k in KINDS), (np.uint8, np.uint16, np.uint32, np.uint64, np.int8, np.int16, np.int32, np.int64, np.float16, np.float32, np.float64), strict=True))
UNSIGNED = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def modulus(size: int) -> int:
    return 1 << (8 * size)


def kind_of(dtype: np.dtype | type) -> Kind:
    """The kind of a numpy type in native byte order; booleans and others are refused."""
    dtype = np.dtype(dtype)
    if not dtype.isnative:
        raise ValueError(f"{dtype} is not in native byte order")
    for k in KINDS:
        if np.dtype(NUMPY[k.name]) == dtype:
            return k
    raise ValueError(f"no sample type for {dtype}")


def component(dtype: np.dtype | type) -> np.dtype:
    """The type of a complex type's lanes; other types are their own."""
    dtype = np.dtype(dtype)
    return {"c8": np.dtype(np.float32), "c16": np.dtype(np.float64)}.get(dtype.str[1:], dtype)


def half_bits(x: np.ndarray) -> np.ndarray:
    """float64 to half-precision bits, nearest with ties away from zero."""
    a = np.abs(np.asarray(x, np.float64))
    sign = np.signbit(x).astype(np.uint16) << 15
    _, e = np.frexp(np.where(a > 0, a, 1.0))
    ulp = np.exp2(np.maximum(e - 11, -24).astype(float))
    r = np.floor(np.where(np.isfinite(a), a, 0) / ulp + 0.5) * ulp
    out = np.where(r > 65504, np.uint16(0x7C00), np.minimum(r, 65504.0).astype(np.float16).view(np.uint16))
    out = np.where(np.isinf(a), np.uint16(0x7C00), out)
    return np.where(np.isnan(a), np.uint16(0x7E00), out | sign).astype(np.uint16)
