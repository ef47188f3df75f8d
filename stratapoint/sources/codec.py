"""Binary forms of points and patches.

A point is u8 byte order, u32 pcid and its packed values; a patch u8 byte order, u32 pcid, u32 compression, u32 points and a
payload: rows if uncompressed, or for each dimension u8 codec, u32 size and bytes. Byte order 1 is little-endian, 0 big;
output is little-endian. Text is upper-case hex. Everything works on numpy arrays of stored numbers.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from stratapoint.errors import PointError
from stratapoint.schema import Dimension, Schema

#: Codec numbers of a dimension (fixed values).
NONE, RLE, SIGBITS, ZLIB = range(4)
#: When a codec is worth it: plain size over coded size (fixed values).
SIGBITS_RATIO, RLE_RATIO = 1.6, 4.0
ZLIB_LEVEL = 9


def _words(data: np.ndarray) -> np.ndarray:
    """The values' bit patterns as unsigned little-endian integers."""
    return np.ascontiguousarray(data).view(f"<u{data.dtype.itemsize}")


def run_count(data: np.ndarray) -> int:
    w = _words(data)
    return int(1 + (w[1:] != w[:-1]).sum()) if len(w) else 0


def common_bits(data: np.ndarray) -> tuple[int, int]:
    """How many leading bits all values share, and these bits."""
    w = _words(data)
    width = 8 * w.dtype.itemsize
    a, o = int(np.bitwise_and.reduce(w)), int(np.bitwise_or.reduce(w))
    unique = (a ^ o).bit_length()
    return width - unique, a >> unique << unique


def rle_encode(data: np.ndarray) -> bytes:
    """(u8 run, word)*: runs of up to 255 equal words."""
    w = _words(data)
    starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    sizes = np.diff(np.r_[starts, len(w)])
    pieces = -(-sizes // 255)
    run = np.repeat(starts, pieces)
    count = np.full(len(run), 255)
    count[np.cumsum(pieces) - 1] = sizes - 255 * (pieces - 1)
    out = np.zeros(len(run), np.dtype([("n", "u1"), ("w", w.dtype)]))
    out["n"], out["w"] = count, w[run]
    return out.tobytes()


def rle_decode(raw: bytes, dtype: str, n: int, order: str = "<") -> np.ndarray:
    width = np.dtype(dtype).itemsize
    rows = np.frombuffer(raw, np.dtype([("n", "u1"), ("w", f"{order}{dtype}" if width > 1 else dtype)]))
    out = np.repeat(rows["w"], rows["n"])
    if len(out) != n:
        raise PointError("run lengths do not add up to the number of points")
    return out.astype("<" + dtype)


def sigbits_encode(data: np.ndarray) -> bytes:
    """word unique bits, word common bits, then the low bits of every value, first value in the highest bits of a word."""
    w = _words(data)
    size = w.dtype.itemsize
    shared, common = common_bits(data)
    nbits = 8 * size - shared
    packed = nbits * len(w) // 8
    total = {1: packed + 3, 2: (packed + 5) + (packed + 5) % 2, 4: (packed + 9) + 4 - (packed + 9) % 4, 8: (packed + 17) + 8 - (packed + 17) % 8}[size]
    bits = (w[:, None] >> np.arange(nbits - 1, -1, -1, dtype=w.dtype)) & w.dtype.type(1)
    stream = np.packbits(bits.astype(np.uint8).ravel()).tobytes()
    body = stream.ljust(-(-len(stream) // size) * size, b"\0")
    head = np.array([nbits, common], w.dtype).tobytes()
    out = head + np.frombuffer(body, f">u{size}").astype(w.dtype).tobytes()
    return out[:total].ljust(total, b"\0")


def sigbits_decode(raw: bytes, dtype: str, n: int, order: str = "<") -> np.ndarray:
    size = np.dtype(dtype).itemsize
    nbits, common = (int(x) for x in np.frombuffer(raw, f"{order}u{size}", 2))
    own = f"<u{size}"
    if not nbits:
        return np.full(n, common, own).view("<" + dtype)
    words = np.frombuffer(raw, own, len(raw) // size)[2:]
    bits = np.unpackbits(np.frombuffer(words.astype(f">u{size}").tobytes(), np.uint8))[: nbits * n].reshape(n, nbits)
    low = np.zeros(n, own)
    for i in range(nbits):
        low = low << np.dtype(own).type(1) | bits[:, i].astype(own)
    return (low | np.dtype(own).type(common)).view("<" + dtype)


def encode(data: np.ndarray, codec: int) -> bytes:
    if codec == RLE:
        return rle_encode(data)
    if codec == SIGBITS:
        return sigbits_encode(data)
    raw = np.ascontiguousarray(data).tobytes()
    return zlib.compress(raw, ZLIB_LEVEL) if codec == ZLIB else raw


def decode(raw: bytes, codec: int, dtype: str, n: int, order: str = "<") -> np.ndarray:
    if codec == RLE:
        return rle_decode(raw, dtype, n, order)
    if codec == SIGBITS:
        return sigbits_decode(raw, dtype, n, order)
    if codec not in (NONE, ZLIB):
        raise PointError(f"unknown compression type {codec} of a dimension")
    return np.frombuffer(zlib.decompress(raw) if codec == ZLIB else raw, "<" + dtype, n)


#: So many points are a sample that no more patches add to (a fixed value).
SAMPLE_POINTS = 10_000


class DimensionStats:
    """Runs and shared bits of each dimension over patches, until they are a sample, and the codec they recommend."""

    def __init__(self, schema: Schema):
        self.schema, self.points, self.patches = schema, 0, 0
        self.runs, self.bits = [0] * schema.ndims, [0] * schema.ndims

    def update(self, dims: list[np.ndarray]) -> None:
        if self.points >= SAMPLE_POINTS:
            return
        self.points += len(dims[0])
        self.patches += 1
        for i, d in enumerate(dims):
            self.runs[i] += run_count(d)
            self.bits[i] += common_bits(d)[0]

    def recommended(self) -> list[int]:
        return [recommend(d, self.points, self.patches, r, b) for d, r, b in zip(self.schema.dims, self.runs, self.bits, strict=True)]


def recommend(d: Dimension, points: int, patches: int, runs: int, bits: int) -> int:
    """RLE if far smaller, else significant bits if smaller, else zlib, which doubles always take."""
    if d.interpretation == "double":
        return ZLIB
    plain = points * d.size
    by_runs = runs * (d.size + 1)
    by_bits = patches * 2 * d.size + points * (8 * d.size - bits // patches) / 8
    if plain / by_runs > RLE_RATIO:
        return RLE
    return SIGBITS if plain / by_bits > SIGBITS_RATIO else ZLIB


def typed(schema: Schema, dims) -> list[np.ndarray]:
    """Stored numbers as arrays of the dimensions' own types."""
    out = []
    for d, c in zip(schema.dims, dims, strict=True):
        a = np.asarray(c, np.float64)
        out.append(a.astype("<" + d.dtype) if d.interpretation != "uint64_t" else np.array([int(x) for x in np.clip(a, 0, 2.0**64 - 2048)], "<u8"))
    return out


def codecs_for(schema: Schema, arrays: list[np.ndarray], asked=None) -> list[int]:
    stats = DimensionStats(schema)
    stats.update(arrays)
    best = stats.recommended()
    return best if asked is None else [b if a < 0 else int(a) for a, b in zip(asked, best, strict=True)]


def point_to_wkb(schema: Schema, raw) -> bytes:
    return struct.pack("<BI", 1, schema.pcid) + b"".join(a.tobytes() for a in typed(schema, [[v] for v in raw]))


def pcid_of(wkb: bytes) -> int:
    if len(wkb) < 5:
        raise PointError("binary form is too short")
    return struct.unpack_from("<I" if wkb[0] == 1 else ">I", wkb, 1)[0]


def point_from_wkb(schema: Schema, wkb: bytes) -> list[float]:
    if len(wkb) != 5 + schema.size:
        raise PointError(f"point of {len(wkb) - 5} bytes does not have the {schema.size} of its schema")
    return [float(c[0]) for c in _rows(schema, wkb[5:], 1, "<" if wkb[0] == 1 else ">")]


def _rows(schema: Schema, raw: bytes, n: int, order: str) -> list[np.ndarray]:
    rows = np.frombuffer(raw, schema.row_dtype if order == "<" else schema.row_dtype.newbyteorder(">"), n)
    return [rows[str(i)] for i in range(schema.ndims)]


def patch_to_wkb(schema: Schema, compression: int, dims, asked=None) -> bytes:
    arrays = typed(schema, dims)
    n = len(arrays[0])
    head = struct.pack("<BIII", 1, schema.pcid, compression, n)
    if compression == 0:
        rows = np.zeros(n, schema.row_dtype)
        for i, a in enumerate(arrays):
            rows[str(i)] = a
        return head + rows.tobytes()
    if compression != 1:
        raise PointError("lazperf support is not enabled")
    out = [head]
    for a, codec in zip(arrays, codecs_for(schema, arrays, asked), strict=True):
        body = encode(a, codec)
        out.append(struct.pack("<BI", codec, len(body)) + body)
    return b"".join(out)


def patch_size(schema: Schema, compression: int, dims, asked=None) -> int:
    """Bytes of the serialised patch: header, three points of statistics, payload."""
    head = 63 + 3 * schema.size
    return head + len(patch_to_wkb(schema, compression, dims, asked)) - 13


def patch_from_wkb(schema: Schema, wkb: bytes) -> list[np.ndarray]:
    """Stored numbers by dimension."""
    order = "<" if wkb[0] == 1 else ">"
    pcid, compression, n = struct.unpack_from(f"{order}III", wkb, 1)
    if not pcid:
        raise PointError("pcid is zero")
    body = wkb[13:]
    if compression == 0:
        if len(body) != n * schema.size:
            raise PointError("patch size and number of points do not match")
        return [c.astype(np.float64) for c in _rows(schema, body, n, order)]
    if compression != 1:
        raise PointError("lazperf support is not enabled")
    out, at = [], 0
    for d in schema.dims:
        codec, size = struct.unpack_from(f"{order}BI", body, at)
        out.append(decode(body[at + 5 : at + 5 + size], codec, d.dtype, n, order).astype(np.float64))
        at += 5 + size
    return out


def from_hex(text: str) -> bytes:
    if len(text) % 2:
        raise PointError(f"hex of odd length {len(text)}")
    try:
        return bytes.fromhex(text)
    except ValueError as e:
        raise PointError(f"invalid hex character in {text[:20]!r}") from e
