"""Whole graphs over tiles: compress, decompress and profile.

A frame holds the magic ``RLF2``, its method, size, width and count, the ids and headers of its steps, and
streams with a crc32 of the plain bytes (none where values were quantised) and one of the stored bytes. Steps are codecs of
``plans.codecs``: holes, quantiser, predictor, in this order. One row is one tile; tiles go through Arrow
batches on their own, with a graph that the driver built once for the product.
"""

from __future__ import annotations

import json
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.recipes import grid, parse_error, parse_method
from rasterloom.functions.types import BY_NAME, KINDS, NUMPY, UNSIGNED
from rasterloom.operators import fieldlz, noise, quantise
from rasterloom.plans import codecs
from rasterloom.sources import rasters

MAGIC = b"RLF2"


@dataclass(frozen=True)
class Graph:
    """What a product's tiles go through: method, sample size, row width, holes (a pattern or "nan"), a plan."""

    method: str
    size: int
    width: int
    hole: int | str | None = None
    plan: quantise.Plan | None = None

    def __post_init__(self) -> None:
        parse_method(self.method, self.size)
        if self.size not in UNSIGNED:
            raise ValueError("samples have 1, 2, 4 or 8 bytes")
        if self.width < 1:
            raise ValueError("width has to be 1 or more")
        if self.plan and BY_NAME[self.plan.kind].size != self.size:
            raise ValueError("the plan is for samples of another size")


def hole_pattern(kind: str, nodata: float | int) -> int | str:
    """A declared sentinel as the bits of a sample; NaN of a float type stands for every NaN."""
    k = BY_NAME[kind]
    if k.integer:
        if nodata != int(nodata) or not np.iinfo(NUMPY[kind]).min <= int(nodata) <= np.iinfo(NUMPY[kind]).max:
            raise ValueError(f"{nodata} is no {kind}")
        return int(nodata) % (1 << (8 * k.size))
    if nodata != nodata:
        return "nan"
    if kind == "f16":
        raise ValueError("half precision can't carry a sentinel")
    with np.errstate(over="ignore"):
        v = np.array([nodata], NUMPY[kind])
    if np.isinf(v[0]) and not np.isinf(nodata):
        raise ValueError(f"{nodata} is no {kind}")
    return int(v.view(UNSIGNED[k.size])[0])


def graph_for(tiles: DataFrame, method: str, kind: str, width: int, error: str | None = None, nodata: float | None = None, px: DataFrame | None = None) -> Graph:
    """The graph of a whole product: one scan of all its tiles, before holes are filled, cuts one grid for all.

    Holes are the declared sentinel's samples, else NaNs where a float product has any. A lossless graph
    of an integer product needs no scan. A SQRT recipe without its curve gets the one that the product's own
    noise shows; ``quantise.Refused`` where it shows none.

    px: the rasters' pixels (samples as the kind holds them) where the tiles are strips of them. They are scanned
    in the tiles' place, so that noise is seen across strips.
    """
    recipe, k = parse_error(error), BY_NAME[kind]
    if recipe and recipe.family == "SQRT" and recipe.a is None:
        curve = noise.fit(noise.blocks(rasters.from_tiles(tiles, kind) if px is None else px, width)).first()
        if curve is None:
            raise quantise.Refused("the product's noise shows no curve")
        recipe = replace(recipe, a=curve.a, b=curve.b)
    hole = None if nodata is None else hole_pattern(kind, nodata)
    if not recipe and (k.integer or hole is not None):
        return Graph(method, k.size, width, hole)
    if px is None:
        seen = quantise.scan_tiles(tiles, kind)
    else:
        seen = quantise.scan(px, recipe.family if recipe else "LINEAR").first().asDict()
        seen["any_nan"] = not k.integer and not px.where(F.isnan("v")).isEmpty()
    if hole is None and not k.integer and seen["any_nan"]:
        hole = "nan"
    return Graph(method, k.size, width, hole, quantise.resolve(recipe, kind, seen) if recipe else None)


def _zig(r: np.ndarray) -> np.ndarray:
    one, top = r.dtype.type(1), r.dtype.type(8 * r.dtype.itemsize - 1)
    return (r << one) ^ (np.zeros_like(r) - (r >> top))


def _unzig(z: np.ndarray) -> np.ndarray:
    one = z.dtype.type(1)
    return (z >> one) ^ (np.zeros_like(z) - (z & one))


def _huffman(b: bytes) -> bytes:
    c = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return c.compress(b) + c.flush()


def _squeeze(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress(b)


def _terminal(v: np.ndarray, name: str) -> list[tuple[str, bytes]]:
    """Streams as (coder, bytes)."""
    data = v.tobytes()
    lanes = [v.view(np.uint8).reshape(-1, v.itemsize)[:, i].tobytes() for i in range(v.itemsize)]
    if name == "categorical":
        n = len(v)
        hits = int(np.unique(v, return_counts=True)[1].max()) if n else 0
        if n and hits == n:
            return [("constant", v[:1].tobytes())]
        name = "field_lz" if hits > 0.95 * n else "entropy"
    if name == "entropy":
        if v.itemsize > 2:
            raise ValueError("entropy takes samples of 1 or 2 bytes")
        return [("huffman", _huffman(x)) for x in lanes]
    if name == "transpose>entropy":
        return [("huffman", _huffman(x)) for x in lanes]
    if name == "transpose>zstd":
        return [("zstd", _squeeze(x)) for x in lanes]
    if name == "field_lz":
        literals, rows = fieldlz.parse(v)
        planes = [literals.view(np.uint8).reshape(-1, v.itemsize)[:, i].tobytes() for i in range(v.itemsize)]
        return [*(("huffman", _huffman(x)) for x in planes), ("matches", _squeeze(rows.T.tobytes()))]
    if name == "store_lo":
        return [("raw", lanes[0]), *(("huffman", _huffman(x)) for x in lanes[1:])]
    return [("zstd", _squeeze(data))]


def _streams(parts: list[tuple[str, bytes]], n: int, dtype: np.dtype) -> np.ndarray:
    import zstandard

    out = []
    if parts[-1][0] == "matches":
        *planes, (_, rows) = parts
        found = np.frombuffer(zstandard.ZstdDecompressor().decompress(rows), np.uint32).reshape(3, -1).T
        planes = [np.frombuffer(zlib.decompress(b, -15), np.uint8) for _, b in planes]
        return fieldlz.join(np.stack(planes, 1).reshape(-1).view(dtype), found, n)
    for coder, b in parts:
        if coder == "huffman":
            b = zlib.decompress(b, -15)
        elif coder == "zstd":
            b = zstandard.ZstdDecompressor().decompress(b)
        elif coder == "constant":
            b = b * n
        out.append(b)
    if len(out) == 1:
        return np.frombuffer(out[0], dtype)
    return np.stack([np.frombuffer(b, np.uint8) for b in out], 1).reshape(-1).view(dtype)


def compress_tile(g: Graph, data: bytes) -> bytes:
    v = np.frombuffer(data, UNSIGNED[g.size])
    n, (predictor, terminal) = len(v), parse_method(g.method, g.size)
    if n % g.width and n:
        raise ValueError("width does not divide the samples")
    head = {"method": g.method, "size": g.size, "width": g.width, "n": n, "crc": None if g.plan else zlib.crc32(data)}
    steps, mask = [], b""

    def step(name: str, v: np.ndarray, **parameters) -> list[np.ndarray]:
        header, out = codecs.encode(name, v, **parameters)
        steps.append((codecs.IDS[name], header.hex()))
        return out

    if g.hole is not None and n:
        v, valid = step("nodata", v, hole=g.hole, width=g.width)
        mask = _squeeze(valid.tobytes()) if len(valid) else b""
    if len(v):
        if g.plan:
            (v,) = step(codecs.FAMILIES[g.plan.family], v, plan=g.plan)
        if predictor == "delta_1d":
            v = np.diff(v, prepend=v.dtype.type(0))
        elif predictor != "id":
            v = _zig(step(predictor, v, width=g.width)[0])
    parts = _terminal(np.ascontiguousarray(v), terminal) if len(v) else []
    body = mask + b"".join(b for _, b in parts)
    head |= {"m": len(v), "steps": steps, "streams": [(c, len(b)) for c, b in parts], "mask": len(mask)}
    # Over what is stored: the head as it is without this sum, and the body.
    head["sum"] = zlib.crc32(body, zlib.crc32(_plain(head)))
    h = _plain(head)
    return MAGIC + struct.pack("<I", len(h)) + h + body


def _plain(head: dict) -> bytes:
    return json.dumps(head, separators=(",", ":")).encode()


def frame_size(frame: bytes) -> int:
    """Bytes that a frame opens to, from its head alone (the rest may be missing); 0 for what is no frame."""
    try:
        (n,) = struct.unpack("<I", frame[4:8])
        head = json.loads(frame[8 : 8 + n])
        return int(head["n"]) * int(head["size"]) if frame[:4] == MAGIC else 0
    except (ValueError, KeyError, TypeError, struct.error):
        return 0


def frame_head(frame: bytes) -> dict:
    """A frame's head; refuses what is no frame or is cut short."""
    if frame[:4] != MAGIC or len(frame) < 8:
        raise ValueError("no frame")
    (n,) = struct.unpack("<I", frame[4:8])
    try:
        head = json.loads(frame[8 : 8 + n])
        want = 8 + n + head["mask"] + sum(k for _, k in head["streams"])
        fits = len(frame) == want and head["size"] in UNSIGNED and 1 <= head["width"] and not head["n"] % head["width"]
        steps = [(int(i), bytes.fromhex(h)) for i, h in head["steps"]]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("damaged frame head") from e
    if not fits:
        raise ValueError("damaged frame")
    return head | {"at": 8 + n, "steps": steps, "plain": head}


def _open(frame: bytes, head: dict) -> bytes:
    import zstandard

    at, dtype = head["at"], np.dtype(UNSIGNED[head["size"]])
    predictor, _ = parse_method(head["method"], head["size"])
    mask, at = frame[at : at + head["mask"]], at + head["mask"]
    parts = []
    for coder, n in head["streams"]:
        parts.append((coder, frame[at : at + n]))
        at += n
    v = _streams(parts, head["m"], dtype) if parts else np.zeros(0, dtype)
    if len(v) != head["m"]:
        raise ValueError("damaged streams")
    if predictor == "delta_1d":
        v = np.cumsum(v, dtype=dtype)
    for codec, header in reversed(head["steps"]):
        name = codecs.NAMES.get(codec)
        if name == "nodata":
            valid = zstandard.ZstdDecompressor().decompress(mask) if mask else b""
            v = codecs.decode(codec, header, [v, np.frombuffer(valid, np.uint8)])
        else:
            v = codecs.decode(codec, header, [_unzig(v) if name == predictor else v])
    if len(v) != head["n"]:
        raise ValueError("damaged streams")
    return np.ascontiguousarray(v).tobytes()


def decompress_tile(frame: bytes, verify: bool = True) -> bytes:
    """A tile's bytes; whatever is wrong with a frame is a ValueError."""
    import zstandard

    head = frame_head(frame)
    if verify:
        said = {k: v for k, v in head["plain"].items() if k != "sum"}
        if zlib.crc32(frame[head["at"] :], zlib.crc32(_plain(said))) != head["plain"].get("sum"):
            raise ValueError("checksum of the stored bytes does not match")
    try:
        data = _open(frame, head)
    except (zlib.error, zstandard.ZstdError, struct.error, KeyError, TypeError, IndexError, OverflowError) as e:
        raise ValueError("damaged frame") from e
    if verify and head.get("crc") is not None and zlib.crc32(data) != head["crc"]:
        raise ValueError("checksum does not match")
    return data


def compress(tiles: DataFrame, graph: Graph) -> DataFrame:
    """(tile, dtype, frame); a tile of another sample size is refused."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if (f["elt"] != graph.size).any():
                raise ValueError("a tile's samples have another size than the graph's")
            yield pd.DataFrame({"tile": f["tile"], "dtype": f["dtype"], "frame": [compress_tile(graph, d) for d in f["data"]]})

    return tiles.mapInPandas(run, "tile long, dtype int, frame binary")


def compress_product(tiles: DataFrame, method: str, kind: str, width: int, error: str | None = None, nodata: float | None = None, px: DataFrame | None = None) -> DataFrame:
    """``compress`` with the graph that ``graph_for`` cuts for these tiles."""
    return compress(tiles, graph_for(tiles, method, kind, width, error, nodata, px))


def frame_sizes(frames: DataFrame) -> DataFrame:
    """(tile, bytes): what each frame opens to, 0 for what is no frame; only heads are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield pd.DataFrame({"tile": f["tile"], "bytes": [frame_size(x) for x in f["frame"]]})

    return frames.mapInPandas(run, "tile long, bytes long")


def encode_tiles(tiles: DataFrame, name: str, **parameters) -> DataFrame:
    """One codec over tiles: (tile, dtype, elt, width, n, header, first, second); second is null for codecs of one stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            got = [codecs.encode(name, np.frombuffer(d, UNSIGNED[e]), **parameters) for d, e in zip(f["data"], f["elt"], strict=True)]
            f = f.drop(columns="data").assign(header=[h for h, _ in got])
            for k, c in enumerate(("first", "second")):
                f[c] = [np.ascontiguousarray(x[k]).tobytes() if k < len(x) else None for _, x in got]
                f[f"{c}_elt"] = [x[k].itemsize if k < len(x) else None for _, x in got]
            yield f

    return tiles.mapInPandas(run, "tile long, dtype int, elt int, width long, n long, header binary, first binary, first_elt int, second binary, second_elt int")


def decode_tiles(coded: DataFrame, name: str) -> DataFrame:
    """Tiles again from ``encode_tiles``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            data = []
            for header, *parts in zip(f["header"], f["first"], f["first_elt"], f["second"], f["second_elt"], strict=True):
                streams = [np.frombuffer(b, UNSIGNED[int(e)]) for b, e in zip(parts[::2], parts[1::2], strict=True) if b is not None]
                data.append(np.ascontiguousarray(codecs.decode(codecs.IDS[name], header, streams)).tobytes())
            yield f[["tile", "dtype", "elt", "width", "n"]].assign(data=data)

    return coded.mapInPandas(run, "tile long, dtype int, elt int, width long, n long, data binary")


def frame_steps(frames: DataFrame) -> DataFrame:
    """(tile, place, codec, name, lossy, header): the steps that a frame's reader undoes, headers as hex."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            rows = [(t, i, c, codecs.NAMES[c], codecs.lossy(c), h.hex()) for t, x in zip(f["tile"], f["frame"], strict=True) for i, (c, h) in enumerate(frame_head(x)["steps"])]
            yield pd.DataFrame(rows, columns=["tile", "place", "codec", "name", "lossy", "header"])

    return frames.mapInPandas(run, "tile long, place int, codec int, name string, lossy boolean, header string")


def decompress(frames: DataFrame, verify: bool = True) -> DataFrame:
    """Tiles again: (tile, dtype, elt, width, n, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            heads = [frame_head(x) for x in f["frame"]]
            yield pd.DataFrame({"tile": f["tile"], "dtype": f["dtype"], "elt": [h["size"] for h in heads], "width": [h["width"] for h in heads], "n": [h["n"] for h in heads], "data": [decompress_tile(x, verify) for x in f["frame"]]})

    return frames.mapInPandas(run, "tile long, dtype int, elt int, width long, n long, data binary")


def _order0(data: bytes) -> float:
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = c[c > 0] / max(1, len(data))
    return float(-(p * np.log2(p)).sum())


def profile_tile(data: bytes, size: int, width: int, prior: str | None = "planar", reps: int = 5, verify: bool = False, hole: int | str | None = None, plan: quantise.Plan | None = None) -> list[dict]:
    """A row for each method that works on the tile, the smallest frame first."""
    if reps < 1:
        raise ValueError("reps has to be 1 or more")
    shannon, rows = len(data) * _order0(data) / 8, []
    for name in grid(size, prior):
        try:
            g = Graph(name, size, width, hole, plan)
            spent = []
            for _ in range(reps):
                t0 = time.perf_counter()
                frame = compress_tile(g, data)
                t1 = time.perf_counter()
                back = decompress_tile(frame, verify)
                spent.append((t1 - t0, time.perf_counter() - t1))
        except ValueError:
            continue
        if plan is None and hole != "nan" and back != data:
            raise AssertionError(name)
        e, d = (min(x) for x in zip(*spent, strict=True))
        speed = lambda s: len(data) / s / 1e6 if s > 0 else float("inf")
        rows.append({"graph": name, "bytes": len(frame), "ratio": len(data) / len(frame), "encode_mbps": speed(e), "decode_mbps": speed(d), "shannon_pct": 100 * shannon / len(frame)})
    return sorted(rows, key=lambda r: -r["ratio"])


def profile(tiles: DataFrame, prior: str | None = "planar", reps: int = 1, hole: int | str | None = None, plan: quantise.Plan | None = None) -> DataFrame:
    """Rows of ``profile_tile`` for every tile; holes and the plan are the product's, as in ``graph_for``."""

    names = ["graph", "bytes", "ratio", "encode_mbps", "decode_mbps", "shannon_pct"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t, e, w, d in zip(f["tile"], f["elt"], f["width"], f["data"], strict=True):
                # A tile that no method takes has no rows, but their columns.
                yield pd.DataFrame(profile_tile(d, int(e), int(w), prior, reps, hole=hole, plan=plan), columns=names).assign(tile=t)

    return tiles.mapInPandas(run, "tile long, graph string, bytes long, ratio double, encode_mbps double, decode_mbps double, shannon_pct double")


def profile_product(tiles: DataFrame, kind: str, width: int, prior: str | None = "planar", reps: int = 1, error: str | None = None, nodata: float | None = None) -> DataFrame:
    """``profile`` with the holes and the plan that ``graph_for`` cuts for these tiles."""
    g = graph_for(tiles, "id>zstd", kind, width, error, nodata)
    return profile(tiles, prior, reps, g.hole, g.plan)


def dtype_name(code: int) -> str:
    return KINDS[code].name
