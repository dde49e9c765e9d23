"""Grammars of methods and error recipes."""

from __future__ import annotations

import re
from dataclasses import dataclass

PREDICTORS = ("id", "delta_1d", "delta_w", "delta_n", "planar", "med", "average", "wp_static")
TERMINALS = ("entropy", "field_lz", "zstd", "categorical", "transpose>entropy", "transpose>zstd", "store_lo")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def method_name(predictor: str, terminal: str) -> str:
    return f"{predictor}>{terminal}" if predictor in ("id", "delta_1d") else f"{predictor}>zigzag>{terminal}"


METHODS = {method_name(p, t): (p, t) for p in PREDICTORS for t in TERMINALS}


def allowed(terminal: str, size: int) -> bool:
    """Lane terminals need 2 bytes or more; categorical takes 1 or 2; the rest take any."""
    if terminal == "categorical":
        return size <= 2
    return size >= 2 or terminal in ("entropy", "field_lz", "zstd")


def grid(size: int, prior: str | None = None) -> list[str]:
    """Methods to try: all, those of a prior predictor and id, or id's alone (none, id)."""
    if prior is None:
        some = PREDICTORS
    elif prior in ("none", "id"):
        some = ("id",)
    elif prior in PREDICTORS:
        some = (prior, "id")
    else:
        raise ValueError(f"no predictor {prior}")
    return [method_name(p, t) for p in some for t in TERMINALS if allowed(t, size)]


def parse_method(text: str, size: int) -> tuple[str, str]:
    if text not in METHODS or not allowed(METHODS[text][1], size):
        raise ValueError(f"no method {text} for {size} bytes")
    return METHODS[text]


def number(text: str) -> float:
    """A finite decimal, nothing around it, not below the normal range unless 0."""
    if not _NUMBER.fullmatch(text):
        raise ValueError(f"{text} is no number")
    v = float(text)
    if v in (float("inf"), float("-inf")) or 0 < abs(v) < 2.2250738585072014e-308:
        raise ValueError(f"{text} is out of range")
    return v


@dataclass(frozen=True)
class Error:
    family: str
    bound: float
    values: bool = False
    a: float | None = None
    b: float | None = None


def parse_error(text: str | None) -> Error | None:
    """LINEAR:MAX_ERROR=V, LOG:MAX_ERROR=P%, SQRT:MAX_ERROR=kN[,A=..,B=..], each with STORE=INDEX|VALUES; None is lossless."""
    if not text:
        return None
    family, colon, rest = text.partition(":")
    if family not in ("LINEAR", "LOG", "SQRT") or not colon:
        raise ValueError(f"no error recipe {text}")
    got: dict[str, str] = {}
    for part in rest.split(","):
        key, eq, value = part.partition("=")
        if not eq or key not in ("MAX_ERROR", "STORE", *(("A", "B") if family == "SQRT" else ())):
            raise ValueError(f"{part} does not belong in {text}")
        if key in got and (key != "STORE" or family == "LOG"):
            raise ValueError(f"{key} is repeated in {text}")
        got[key] = value
    bound = got.get("MAX_ERROR", "")
    suffix = {"LINEAR": "", "LOG": "%", "SQRT": "N"}[family]
    if suffix and not bound.endswith(suffix):
        raise ValueError(f"MAX_ERROR of {family} ends with {suffix}")
    v = number(bound.removesuffix(suffix))
    if v <= 0 or family == "LOG" and v >= 100:
        raise ValueError(f"MAX_ERROR is out of range in {text}")
    if got.get("STORE", "INDEX") not in ("INDEX", "VALUES"):
        raise ValueError(f"no STORE={got['STORE']}")
    a, b = (number(got[k]) if k in got else None for k in "AB")
    if (a is None) != (b is None) or a is not None and (a < 0 or b <= 0):
        raise ValueError(f"A and B go together, A at least 0 and B above 0: {text}")
    return Error(family, v / 100 if family == "LOG" else v, got.get("STORE") == "VALUES", a, b)
