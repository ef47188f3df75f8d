import warnings

import pytest

from stratapoint.errors import PointError
from stratapoint.schema import Dimension, Registry, Schema, interpretation, parse_schema, schema_is_valid, to_xml
from tests.formats import S1, S3, S4, S10, dims

XML = """<?xml version="1.0"?><pc:PointCloudSchema xmlns:pc="urn:x">{}<pc:metadata><Metadata name="compression">{}</Metadata></pc:metadata></pc:PointCloudSchema>"""
DIM = "<pc:dimension><pc:position>{}</pc:position><pc:size>9</pc:size><pc:name>{}</pc:name><pc:interpretation>{}</pc:interpretation>{}</pc:dimension>"


def xml(*specs, compression="none", extra=""):
    return XML.format("".join(DIM.format(p, n, k, extra) for p, n, k in specs), compression)


def test_parse_and_round_trip():
    s = parse_schema("junk" + xml((2, "Y", "int16_t"), (1, "X", "uint8_t"), compression="Dimensional"), 7, 4326)
    assert [d.name for d in s.dims] == ["X", "Y"] and s.size == 3 and s.compression == 1 and s.is_valid
    assert [d.byteoffset for d in s.dims] == [0, 1] and (s.pcid, s.srid) == (7, 4326)
    assert parse_schema(to_xml(S4), S4.pcid).dims == S4.dims


@pytest.mark.parametrize("text", ["", "<xml/>", "<a", "<pc:PointCloudSchema/>", xml((1, "X", "int8_t")), xml((1, "X", "int8_t"), (3, "Y", "int8_t")), xml((1, "X", "int8_t"), (1, "Y", "int8_t"))])
def test_invalid(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert schema_is_valid(text) is False
    assert schema_is_valid(None) is None


def test_unknown_compression_is_none_and_loose_types():
    assert parse_schema(xml((1, "X", "double"), (2, "Y", "Float32"), compression="zip")).compression == 0
    assert [interpretation(x) for x in ("Int32", "uint1", "UINT8_T", "i", "int64_t", "Dbl")] == ["int32_t", "uint16_t", "uint8_t", "unknown", "int64_t", "double"]


def test_names_and_roles():
    s = Schema.of(dims(("X", "int8_t"), ("lat", "int8_t"), ("x", "int16_t"), ("H", "int8_t"), ("", "int8_t"), ("T", "double")))
    assert s.find("X") == 2 and s.role("x") == 2 and s.role("y") == 1 and s.role("z") == 3 and s.role("m") == 5
    with pytest.raises(PointError, match='dimension "w" does not exist in schema'):
        s.index("w")


def test_differences():
    assert S1.same_dimensions(S3) and not S1.same_dimensions(S4)
    assert S1.same_interpretations(S4) and not S1.same_interpretations(S10)
    assert '"compression": 1' in S3.to_json() and S1.struct()["X"].metadata["scale"] == 0.01


def test_registry(spark, tmp_path):
    r = Registry()
    r.register(1, 0, S1)
    r.register(777, 666, None)
    for pcid in (0, 65536, 1):
        with pytest.raises(PointError):
            r.register(pcid, 0, S1)
    with pytest.raises(PointError):
        r.register(2, 0, "<xml/>")
    assert r.ndims(1) == 4 and r.get(1).dims == S1.dims
    with pytest.raises(PointError, match="no entry in the formats table for pcid = 5"):
        r.get(5)
    with pytest.raises(PointError, match="null"):
        r.get(777)
    r.save(spark, str(tmp_path / "f"))
    assert Registry.load(spark, str(tmp_path / "f")).pcids() == [1, 777]


def test_wide_schema_size():
    names = ["int32_t"] * 3 + ["uint16_t"] + ["uint8_t"] * 5 + ["int8_t", "uint8_t", "uint16_t", "double", "uint16_t", "uint16_t", "uint16_t"]
    assert Schema.of([Dimension(f"d{i}", 0, k) for i, k in enumerate(names)]).size == 37
