import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratapoint.errors import PointError
from stratapoint.plans.formats import schema
from stratapoint.sources import codec
from tests.formats import S1, S3, S10, S11, dims
from stratapoint.schema import Schema


def u(values, dtype):
    return np.array(values, dtype)


def test_packed_bytes():
    b = codec.sigbits_encode(np.frombuffer(b"abcaabcaabcbabcc", "i1"))
    assert list(b[:6]) == [2, 96, 109, 109, 110, 111]
    assert list(codec.sigbits_encode(np.frombuffer(b"abcdab", "i1"))[:4]) == [3, 96, 41, 194]
    assert codec.common_bits(u([24929, 24930, 24931, 24932, 24933, 24934], "u2"))[0] == 13
    words = u([103241, 103251, 103261, 103271, 103281, 103291], "u4")
    assert codec.common_bits(words) == (26, 103232)
    assert list(np.frombuffer(codec.sigbits_encode(words), "u4")[:3]) == [6, 103232, 624388039]
    assert list(np.frombuffer(codec.sigbits_encode(words.astype("u8")), "u8")[:3]) == [6, 103232, 2681726210471362560]


def test_runs():
    assert codec.run_count(np.frombuffer(b"aaaabbbbbbdd", "u1")) == 3
    assert codec.rle_encode(np.frombuffer(b"aaaabbbbbbdd", "u1")) == b"\4a\6b\2d"
    assert codec.rle_encode(np.zeros(300, "u1")) == b"\xff\0\x2d\0"


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["i1", "u1", "i2", "u2", "i4", "u4", "i8", "u8", "f4", "f8"]), st.integers(1, 3), st.data())
def test_round_trip(dtype, codec_number, data):
    kind = np.dtype(dtype)
    raw = data.draw(st.lists(st.sampled_from(range(0, 256)), min_size=1, max_size=300))
    a = (np.array(raw) % (100 if kind.kind == "i" else 200)).astype(kind)
    assert (codec.decode(codec.encode(a, codec_number), codec_number, dtype, len(a)) == a).all()


def test_sizes_and_constant_columns():
    for dtype, size in (("u1", 3), ("u2", 6), ("u4", 12), ("u8", 24)):
        a = np.full(5, 7, dtype)
        assert len(codec.sigbits_encode(a)) == size and (codec.sigbits_decode(codec.sigbits_encode(a), dtype, 5) == 7).all()


def test_recommended_codecs():
    s = Schema.of(dims(("X", "int32_t", 0.01), ("Y", "int32_t", 0.01), ("Z", "int32_t", 0.01), ("Intensity", "uint16_t")))
    i = np.arange(400)
    q = lambda v: np.floor(np.abs(v) / 0.01 + 0.5).astype("i4")
    stats = codec.DimensionStats(s)
    for _ in range(3):
        stats.update([q(i * 2.0), q(i * 1.9), q(i * 0.34), np.full(400, 10, "u2")])
    assert stats.runs == [1200, 1200, 1200, 3] and stats.bits == [45, 45, 54, 48]
    assert stats.recommended() == [2, 2, 2, 1]


def test_points():
    big = codec.from_hex("00000000010000000100000002000000030004")
    assert codec.point_from_wkb(S1, big) == [1, 2, 3, 4] and codec.pcid_of(big) == 1
    assert codec.point_from_wkb(S1, codec.from_hex("01010000000100000002000000030000000500")) == [1, 2, 3, 5]
    assert codec.point_to_wkb(S1, [-12700, 4500, 12400, 4]).hex().upper() == "010100000064CEFFFF94110000703000000400"
    with pytest.raises(PointError):
        codec.point_from_wkb(S1, big + b"\0")


def test_patches():
    big = codec.from_hex("0000000001000000000000000200000002000000030000000500060000000200000003000000050008")
    d = codec.patch_from_wkb(S1, big)
    assert [c.tolist() for c in d] == [[2, 2], [3, 3], [5, 5], [6, 8]]
    assert codec.patch_to_wkb(S1, 0, d).hex().upper() == "0101000000000000000200000002000000030000000500000006000200000003000000050000000800"
    assert [c.tolist() for c in codec.patch_from_wkb(S3, codec.patch_to_wkb(S3, 1, d))] == [c.tolist() for c in d]
    with pytest.raises(PointError, match="do not match"):
        codec.patch_from_wkb(S1, big[:-1])
    with pytest.raises(PointError, match="pcid is zero"):
        codec.patch_from_wkb(S1, big[:1] + b"\0\0\0\0" + big[5:])
    with pytest.raises(PointError, match="lazperf"):
        codec.patch_from_wkb(S1, struct.pack("<BIII", 1, 1, 2, 1) + b"\0" * 9)


def test_memsize_of_tiny_patches():
    rows = [[(2, 3, 5, 6), (2, 3, 5, 8)], [(6, 7, 5, 6), (9, 10, 5, 10)], [(2, 3, 5, 6), (2, 3, 5, 3)], [(2, 3, 5, 6), (2, 3, 5, 1)]]
    assert sum(codec.patch_size(S3, 1, list(zip(*r, strict=True))) for r in rows) == 716


def test_hex_errors():
    with pytest.raises(PointError, match="odd"):
        codec.from_hex("000")
    with pytest.raises(PointError, match="invalid hex"):
        codec.from_hex("0G")


@pytest.mark.parametrize("asked", [[1] * 7, [2] * 7, [3] * 7, None])
def test_codec_matrix(asked):
    """Values over all widths keep through every codec."""
    for first in range(-127, 128, 64):
        v = [x for x in range(first, min(first + 64, 128), 4)]
        cols = [[x * 2**k // 256 for x in v] for k in (8, 8, 16, 32, 56)] + [[float(x) for x in v]] * 2
        back = codec.patch_from_wkb(S11, codec.patch_to_wkb(S11, 1, cols, asked))
        assert [c.tolist() for c in back] == [[float(x) for x in c] for c in cols]
        assert [c.tolist() for c in codec.patch_from_wkb(S10, codec.patch_to_wkb(S10, 0, cols))] == [[float(x) for x in c] for c in cols]


def test_sampling_stops():
    s = schema(101)
    stats = codec.DimensionStats(s)
    flat, mixed = [np.zeros(6000, "<" + d.dtype) for d in s.dims], [np.arange(6000).astype("<" + d.dtype) for d in s.dims]
    for dims in (flat, flat, mixed, mixed):
        stats.update(dims)
    assert (stats.points, stats.patches) == (12_000, 2) and stats.recommended() == [codec.RLE] * 4
