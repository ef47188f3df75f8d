import json

import pytest
from pyspark.sql import functions as F

from stratapoint.errors import PointError
from stratapoint.functions import geometry as geo
from stratapoint.functions import intra, patches, points, versions, wkb
from stratapoint.functions.quant import fmt_g, half_away, quantise
from stratapoint.operators import patching, spatial
from stratapoint.schema import Schema
from tests.formats import S1, S3, S4, S10, S11, S20, dims


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def vals(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def patch(schema, *rows):
    return patches.make_patch(schema, vals(*[v for r in rows for v in r]))


def test_number_text(spark):
    numbers = [0.0, -0.0, 0.01, -127.0, 4862413.0, 100000.0, 999999.5, 1e6, 0.0001, 0.00001234, 123456.5, 1e300, 33813.45, 2.5, -0.1, float("nan"), float("inf"), 1e-5, 0.1 + 0.2]
    got = [r.t for r in spark.createDataFrame([(x,) for x in numbers], "v double").select(fmt_g(F.col("v")).alias("t")).collect()]
    assert got == ["%g" % x for x in numbers]


def test_rounding_and_clamping(spark):
    x = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 300.0, -300.0]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    assert [r.h for r in df.select(half_away(F.col("v")).alias("h")).collect()] == [1, -1, 2, 3, -3, 0, 300, -300]
    assert [r.q for r in df.select(quantise(F.col("v"), S10.dims[0]).alias("q")).collect()] == [50, -50, 127, 127, -128, 50, 127, -128]


def test_points(spark):
    pt = points.make_point(S1, vals(-127, 45, 124, 4))
    assert one(spark, points.as_text(pt, S1)) == '{"pcid":1,"pt":[-127,45,124,4]}'
    assert one(spark, wkb.point_to_hex(pt, S1)) == "010100000064CEFFFF94110000703000000400"
    assert one(spark, points.memsize(pt, S1)) == 25 and one(spark, points.pcid(pt)) == 1
    assert one(spark, points.get_all(pt, S1)) == [-127.0, 45.0, 124.0, 4.0]
    assert one(spark, points.get_role(pt, S1, "z")) == 124 and one(spark, points.get_role(pt, S1, "m")) is None
    assert one(spark, points.get(points.with_value(pt, S1, "Z", F.lit(1.234)), S1, "z")) == pytest.approx(1.23)
    with pytest.raises(PointError, match='dimension "q" does not exist in schema'):
        points.get(pt, S1, "q")
    assert one(spark, points.make_point(S1, F.lit(None).cast("array<double>"))) is None
    for bad in (vals(1, 2), F.array(*[F.lit(None).cast("double")] * 4)):
        with pytest.raises(Exception, match="values|null"):
            one(spark, points.make_point(S1, bad))


def test_sum_of_values_is_exact(spark):
    rows = spark.createDataFrame([("0000000001000000010000000%d000000030004" % i,) for i in (2, 3, 4)], "h string").select(wkb.point_from_hex(F.col("h"), S1).alias("pt"))
    assert str(rows.agg(F.sum(points.get_decimal(F.col("pt"), S1, "y"))).first()[0].normalize()) == "0.09"
    with pytest.raises(Exception, match="pcid"):
        spark.createDataFrame([("00000000020000000100000002000000030004",)], "h string").select(wkb.point_from_hex(F.col("h"), S1)).collect()


def test_pinned_pcid(spark):
    pt = points.make_point(S1, vals(1, 2, 3, 4))
    assert one(spark, points.with_typmod(pt, "point", 1, points.POINT)["pcid"]) == 1
    with pytest.raises(Exception, match="does not match column pcid"):
        one(spark, points.with_typmod(pt, "point", 3, points.POINT))


HEX = ["0000000001000000000000000200000002000000030000000500060000000200000003000000050008"] + ["000000000100000000000000020000000600000007000000050006000000090000000A00000005000A"] * 3


def hex_patches(spark):
    return spark.createDataFrame([(i, h) for i, h in enumerate(HEX)], "id int, h string").select("id", wkb.patch_from_hex(F.col("h"), S1).alias("pa"))


def test_patch_io(spark):
    df = hex_patches(spark).cache()
    text = [r.t for r in df.orderBy("id").select(patches.as_text(F.col("pa"), S1).alias("t")).collect()]
    assert text[0] == '{"pcid":1,"pts":[[0.02,0.03,0.05,6],[0.02,0.03,0.05,8]]}' and text[1] == '{"pcid":1,"pts":[[0.06,0.07,0.05,6],[0.09,0.1,0.05,10]]}'
    assert df.where("id = 0").select(wkb.patch_to_hex(intra.uncompress(F.col("pa")), S1)).first()[0] == "0101000000000000000200000002000000030000000500000006000200000003000000050000000800"
    env = [bytes(r.e).hex() for r in df.orderBy("id").select(geo.envelope_ewkb(F.col("pa"), S1).alias("e")).collect()]
    assert env[0] == "01030000000100000005000000" + "7b14ae47e17a943fb81e85eb51b89e3f" * 5 and env[1].startswith("01030000000100000005000000b81e85eb51b8ae3fec51b81e85ebb13f")
    union = patching.union(df, S1, F.col("pa"), [], [F.col("id")]).select(patches.as_text(F.col("pa"), S1)).first()[0]
    assert union == '{"pcid":1,"pts":[[0.02,0.03,0.05,6],[0.02,0.03,0.05,8]' + ",[0.06,0.07,0.05,6],[0.09,0.1,0.05,10]" * 3 + "]}"
    assert df.agg(F.sum(F.col("pa")["npoints"])).first()[0] == 8
    assert [r.t for r in df.where("id = 1").select(patches.as_text(intra.range_(F.col("pa"), S1, 1, 1), S1).alias("t")).collect()] == ['{"pcid":1,"pts":[[0.06,0.07,0.05,6]]}']
    i = [df.where("id = 0").select(patches.patch_stat(F.col("pa"), S1, k, "intensity")).first()[0] for k in range(3)]
    assert i == [6, 8, 7]
    assert df.where("id = 0").select(wkb.memsize(F.col("pa"), S1)).first()[0] == 63 + 3 * 14 + 28


def test_aggregate_and_explode(spark):
    df = spark.createDataFrame([(i, [0.01 * i, 0.01 * (i + 1), 0.03, 3.0 + i]) for i in (1, 2, 3)], "i int, v array<double>").select("i", points.make_point(S1, F.col("v")).alias("pt"))
    df = df.unionByName(spark.createDataFrame([(9,)], "i int").withColumn("pt", F.lit(None).cast(points.POINT)))
    pa = patching.patch_agg(df, S1, F.col("pt"), [], [F.col("i")])
    assert pa.select(patches.as_text(F.col("pa"), S1)).first()[0] == '{"pcid":1,"pts":[[0.01,0.02,0.03,4],[0.02,0.03,0.03,5],[0.03,0.04,0.03,6]]}'
    rows = patching.explode_points(pa, S1, "pa").select(points.as_text(F.col("pt"), S1).alias("t")).collect()
    assert [r.t for r in rows][2] == '{"pcid":1,"pt":[0.03,0.04,0.03,6]}'
    assert df.groupBy().agg(F.count("*")).first()[0] == 4 and patching.array_agg(df, F.col("pt"), [], [F.col("i")]).select(F.size("values")).first()[0] == 4
    nothing = df.where("i = 9")
    assert patching.patch_agg(nothing, S1, F.col("pt"), [], [F.col("i")]).first().pa is None
    assert patching.array_agg(df.where("i > 99"), F.col("pt"), [], [F.col("i")]).first()[0] is None
    assert patching.explode_points(nothing.select(F.lit(None).cast(patches.PATCH).alias("pa")), S1, "pa").count() == 0
    cols = patching.explode_columns(pa, S1, "pa")
    assert cols.columns == ["ordinal", "X", "Y", "Z", "Intensity"] and cols.agg(F.sum("Intensity")).first()[0] == 15
    with pytest.raises(Exception, match="more than one pcid"):
        patching.patch_agg(df, S3, F.col("pt"), [], [F.col("i")]).collect()


def test_statistics_of_generated_patches(spark):
    a = spark.range(1, 1601).withColumnRenamed("id", "a")
    v = {"X": -127 + F.col("a") / 100.0, "Y": 45 + F.col("a") / 100.0, "Z": F.col("a") * 1.0, "Intensity": F.floor(F.col("a") / 10)}
    pa = patching.patchify(a.withColumn("g", F.floor(F.col("a") / 400)), S3, v, ["g"], [F.col("a")]).cache()
    get = lambda f, g: [round(x, 6) for x in pa.where(F.col("g") == g).select(points.get_all(f(F.col("pa"), S3), S3)).first()[0]]
    assert get(patches.patch_max, 0) == [-123.01, 48.99, 399, 39] and get(patches.patch_min, 0) == [-126.99, 45.01, 1, 0] and get(patches.patch_avg, 0) == [-125, 47, 200, 20]
    text = pa.where("g = 4").select(patches.summary(F.col("pa"), S3, wkb.codecs_of(F.col("pa"), S3))).first()[0]
    dim = '{"pos":%d,"name":"%s","size":%d,"type":"%s","compr":"zlib","stats":{"min":%s,"max":%s,"avg":%s}}'
    want = ",".join(dim % (i, n, s, t, v, v, v) for i, (n, s, t, v) in enumerate((("X", 4, "int32_t", "-111"), ("Y", 4, "int32_t", "61"), ("Z", 4, "int32_t", "1600"), ("Intensity", 2, "uint16_t", "160"))))
    assert text == '{"pcid":3, "npts":1, "srid":0, "compr":"dimensional","dims":[' + want + "]}" and json.loads(text)["npts"] == 1
    total = pa.agg(F.sum(wkb.memsize(F.col("pa"), S3))).first()[0]
    assert abs(total - 8773) < 40  # the length of deflated bytes depends on the library


def test_filters(spark):
    p = patch(S1, *[(i, i, 0.1 * i, 100 - i) for i in range(20)])
    assert one(spark, patches.as_text(intra.filter_greater_than(p, S1, "x", 17), S1)) == '{"pcid":1,"pts":[[18,18,1.8,82],[19,19,1.9,81]]}'
    assert one(spark, intra.filter_less_than(p, S1, "X", 3)["npoints"]) == 3 and one(spark, intra.filter_equals(p, S1, "x", 5)["npoints"]) == 1
    assert one(spark, intra.filter_between(p, S1, "x", 7, 4)["npoints"]) == 2
    for none in (intra.filter_less_than(p, S1, "x", 0), intra.filter_greater_than(p, S1, "x", 19), intra.filter_equals(p, S1, "x", 5.5), intra.filter_between(p, S1, "x", 5, 6)):
        assert one(spark, none) is None
    with pytest.raises(PointError, match='dimension "q" does not exist'):
        intra.filter_equals(p, S1, "q", 1)
    assert one(spark, intra.filter_equals(patch(S20, (-1, 0, 1)), S20, "y", 0)["bounds"]["xmin"]) == -1
    big = intra.filter_equals(patch(S3, (-1, 0, 4862413, 1)), S3, "y", 0)
    assert one(spark, patches.patch_max(big, S3, "z")) == 4862413
    avg = intra.filter_greater_than(p, S1, "x", 17)
    assert one(spark, patches.patch_avg(avg, S1, "x")) == 18.5


def test_nan_is_no_extreme(spark):
    s = Schema.of(dims(("X", "double"), ("Y", "double")), 30)
    p = patch(s, (1, 1), (float("nan"), 2), (3, 3))
    assert one(spark, p["stats"]["max"][0]) == 3 and one(spark, intra.filter_greater_than(p, s, "x", 0)["npoints"]) == 2


def test_nth_and_range(spark):
    p = patch(S1, *[(i, i, 0, i) for i in range(20)])
    x = lambda n: one(spark, points.get(patches.point_n(p, S1, n), S1, "x"))
    assert (x(1), x(2), x(20), x(-1), x(-20)) == (0, 1, 19, 19, 0) and [x(0), x(21), x(-21)] == [None] * 3
    assert one(spark, F.transform(intra.range_(p, S1, 16, 4)["dims"][3], lambda v: v.cast("int"))) == [15, 16, 17, 18]
    assert one(spark, intra.range_(p, S1, 18, 99)["npoints"]) == 3
    assert [one(spark, intra.range_(p, S1, *a)) for a in ((1, 0), (0, 1), (21, 1))] == [None] * 3


def test_sorting(spark):
    p = patch(S1, (3, 1, 0, 0), (1, 2, 0, 1), (2, 1, 0, 2), (1, 1, 0, 3))
    ids = lambda names: one(spark, F.transform(intra.sort(p, S1, names)["dims"][3], lambda v: v.cast("int")))
    assert ids(["x"]) == [1, 3, 2, 0] and ids(["X", "y"]) == [3, 1, 2, 0] and ids([]) == [0, 1, 2, 3] and ids(["y", None, "x"]) == [3, 2, 0, 1]
    by_x = intra.sort(p, S1, ["x"])
    assert [one(spark, f(by_x, S1, ["x"], s)) for f in (intra.is_sorted, intra.is_sorted_documented) for s in (False, True)] == [False, True, True, False]
    assert one(spark, intra.is_sorted(p, S1, ["x"], True)) is False and one(spark, intra.is_sorted(p, S1, [], False)) is True
    with pytest.raises(PointError):
        intra.sort(p, S1, ["q"])


def test_other_schemas(spark):
    p = patch(S1, (-1, 0, 4862413, 1))
    text = lambda c, s: one(spark, patches.as_text(c, s))
    assert text(intra.set_pcid(p, S1, S1), S1) == '{"pcid":1,"pts":[[-1,0,4.86241e+06,1]]}'
    three = intra.set_pcid(p, S1, S3)
    assert text(three, S3) == '{"pcid":3,"pts":[[-1,0,4.86241e+06,1]]}' and one(spark, three["compression"]) == 1
    assert text(intra.set_pcid(p, S1, S4, 2.0), S4) == '{"pcid":4,"pts":[[2,-1,0,4.86241e+06,2]]}'
    with pytest.raises(PointError, match="dimension interpretations are not matching"):
        intra.set_pcid(p, S1, Schema.of(dims(("X", "int8_t", 0.01), ("Y", "int8_t", 0.01)), 9))
    ten = intra.transform(p, S1, S10, 1.0)
    assert text(ten, S10) == '{"pcid":10,"pts":[[-1,0,1,1,1,1,1]]}' and one(spark, ten["compression"]) == 0
    with pytest.warns(UserWarning):
        assert one(spark, intra.transform(p, S1, Schema.of(dims(("X", "int32_t"), ("Y", "int32_t")), 5, 4326))) is None
    shifted = Schema.of(dims(("X", "int32_t", 0.01), ("Y", "int32_t", 0.01), ("W", "uint16_t", 1.0, 10.0)), 6)
    assert text(intra.set_pcid(p, S1, shifted), shifted) == '{"pcid":6,"pts":[[-1,0,10]]}'


def test_constructors(spark):
    assert one(spark, patches.as_text(patch(S1, (-1, 0, 5, 1), (-1, 0, 6, 1), (-1, 0, 7, 1)), S1)) == '{"pcid":1,"pts":[[-1,0,5,1],[-1,0,6,1],[-1,0,7,1]]}'
    with pytest.raises(Exception, match="multiple"):
        one(spark, patches.make_patch(S1, vals(1, 2, 3)))
    a, b = points.make_point(S1, vals(1, 2, 3, 4)), F.lit(None).cast(points.POINT)
    assert one(spark, patches.patch_of_points(S1, F.array(a, b, a))["npoints"]) == 2 and one(spark, patches.patch_of_points(S1, F.array(b))) is None
    p = patch(S1, (1, 1, 1, 1))
    assert one(spark, patches.union_of_patches(S1, F.array(p, F.lit(None).cast(patches.PATCH), p))["npoints"]) == 2
    with pytest.raises(Exception, match="more than one pcid"):
        one(spark, patches.union_of_patches(S3, F.array(p)))


def test_compression(spark):
    p = patch(S3, *[(i, i * 2, 0, 7) for i in range(50)])
    codecs = lambda scheme, config="": one(spark, wkb.codecs_of(intra.compress(p, S3, scheme, config), S3))
    assert codecs("dimensional", "rle,sigbits,zlib,auto") == [1, 2, 3, 1] and one(spark, intra.compress(p, S3)["compression"]) == 1
    assert one(spark, intra.uncompress(p)["compression"]) == 0
    for bad, match in ((("laz", ""), "lazperf"), (("Dimensional", ""), "scheme"), (("dimensional", "gzip"), "dimensional compression")):
        with pytest.raises(PointError, match=match):
            intra.compress(p, S3, *bad)
    for config in ("rle,rle,rle,rle", "sigbits,sigbits,sigbits,sigbits", "zlib", ""):
        h = wkb.patch_to_hex(intra.compress(p, S3, "dimensional", config), S3)
        assert one(spark, wkb.patch_from_hex(h, S3)["dims"]) == one(spark, p["dims"])


def test_geometry(spark):
    schemas = {
        "XY": (dims(("X", "int32_t"), ("Y", "int32_t", 2.0), ("I", "uint16_t", 3.0)), (1, 4, 9), "0101000000000000000000F03F0000000000001040"),
        "XYZ": (dims(("X", "int32_t"), ("Y", "int32_t", 2.0), ("Z", "int32_t", 4.0)), (1, 4, 12), "0101000080000000000000F03F00000000000010400000000000002840"),
        "XYM": (dims(("X", "int32_t"), ("Y", "int32_t", 2.0), ("M", "int32_t", 4.0)), (1, 4, 12), "0101000040000000000000F03F00000000000010400000000000002840"),
        "XYZM": (dims(("X", "int32_t"), ("Y", "int32_t", 2.0), ("Z", "int32_t", 4.0), ("M", "int32_t", 8.0)), (1, 4, 12, 32), "01010000C0000000000000F03F000000000000104000000000000028400000000000004040"),
    }
    for d, v, want in schemas.values():
        s = Schema.of(d, 1)
        assert bytes(one(spark, geo.point_ewkb(points.make_point(s, vals(*v)), s))).hex().upper() == want
    p = patch(S1, (0, 0, 0, 10), (1, 1, 1, 10), (10, 10, 10, 10))
    want = "010200008002000000000000000000000000000000000000000000000000000000000000000000244000000000000024400000000000002440"
    assert bytes(one(spark, geo.diagonal_ewkb(p, S1))).hex() == want
    flat = Schema.of(dims(("X", "int32_t"), ("Y", "int32_t")), 1, 4326)
    assert bytes(one(spark, geo.envelope_ewkb(patch(flat, (1, 2)), flat))).hex().startswith("0103000020e6100000")
    assert one(spark, geo.patches_intersect(p, patch(S1, (10, 10, 0, 0)))) is True and one(spark, geo.patches_intersect(p, patch(S1, (10.01, 10, 0, 0)))) is False
    with pytest.raises(Exception, match="pcid mismatch"):
        one(spark, geo.patches_intersect(p, patch(S3, (0, 0, 0, 0))))


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    pts = [((1.0, 1.0), True), ((2.0, 1.0), True), ((2.0, 1.5), False), ((0.0, 2.0), True), ((4.0, 4.0), True), ((5.0, 0.0), False), ((2.0, 0.0), True), ((3.9, 3.0), True), ((2.0, 3.0), False)]
    df = spark.createDataFrame([p for p, _ in pts], "x double, y double")
    assert [r.c for r in df.select(geo.point_in_polygon(F.col("x"), F.col("y"), ring).alias("c")).collect()] == [w for _, w in pts]
    hole = [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]
    assert one(spark, geo.point_in_polygon(F.lit(1.0), F.lit(1.0), ring, [hole])) is False and one(spark, geo.point_in_polygon(F.lit(0.5), F.lit(1.0), ring, [hole])) is True
    box = lambda *b: patch(S1, (b[0], b[2], 0, 0), (b[1], b[3], 0, 0))
    cases = [((1, 1.5, 0.2, 0.4), True), ((-1, 5, -1, 5), True), ((1.9, 2.1, 2, 3), False), ((4, 5, 4, 5), True), ((1, 3, 2, 2.2), True), ((6, 7, 0, 1), False)]
    assert [one(spark, geo.patch_intersects_polygon(box(*b), ring)) for b, _ in cases] == [w for _, w in cases]
    p = patch(S1, (1, 1, 0, 1), (2, 3, 0, 2), (0, 2, 0, 3))
    assert one(spark, geo.intersection(p, S1, ring)["dims"][3]) == [1.0, 3.0] and one(spark, geo.intersection(p, S1, [(9.0, 9.0), (9.0, 10.0), (10.0, 9.0)])) is None


def test_overlap_join_is_exact(spark):
    import random

    rng = random.Random(5)
    boxes = []
    for i in range(120):
        x, y, w = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0, 1, 5, 80])
        boxes.append((i, (x, x + w, y, y + rng.choice([0, 2, 70]))))
    df = spark.createDataFrame(boxes, "i int, box struct<xmin:double,xmax:double,ymin:double,ymax:double>")
    got = sorted((r.a, r.b) for r in spatial.overlap_join(df, df, F.col("box"), F.col("box"), 2.0).select(F.col("left.i").alias("a"), F.col("right.i").alias("b")).collect())
    meet = lambda p, q: p[0] <= q[1] and p[1] >= q[0] and p[2] <= q[3] and p[3] >= q[2]
    assert got == sorted((i, j) for i, p in boxes for j, q in boxes if meet(p, q))


def test_geometry_input(spark):
    """Text and binary forms of every kind, in both orders, against a rule made of small steps."""
    import struct

    from stratapoint.errors import PointError
    from stratapoint.functions.shapes import shape

    square = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]
    hole = [(4.0, 4.0), (4.0, 6.0), (6.0, 6.0), (6.0, 4.0), (4.0, 4.0)]
    ring = lambda r: "(" + ", ".join(f"{x} {y}" for x, y in r) + ")"
    packed = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r)
    wkb_ = struct.pack("<BIII", 1, 3 | 0x20000000, 4326, 2) + packed(square) + packed(hole)
    with_hole = shape(f"SRID=4326;POLYGON ({ring(square)}, {ring(hole)})")
    assert with_hole == shape(wkb_) == shape(wkb_.hex()) and with_hole.box() == (0, 10, 0, 10)
    multi = shape(f"MULTIPOLYGON (({ring(square)}, {ring(hole)}), ({ring([(x + 20, y) for x, y in square])}))")
    assert len(multi.polygons) == 2 and shape("MULTIPOINT (1 2, (3 4))").points == [(1, 2), (3, 4)] and shape("POLYGON EMPTY").box() is None
    mixed = shape("GEOMETRYCOLLECTION (POINT Z (30 30 1), LINESTRING (40 0, 50 10))")
    for bad in ("POLYGON ((0 0, 1 1))", "CIRCLE (1 1)", "POINT (1)", "POINT (1 2) x", b"\1\3\0\0\0"):
        with pytest.raises(PointError):
            shape(bad)
    cases = {(4.5, 5.5, 4.5, 5.5): (False, False, False), (3, 5, 4.5, 5): (True, True, False), (5, 5, 1, 1): (True, True, False), (-1, 11, -1, 11): (True, True, False), (21, 22, 1, 2): (False, True, False), (29, 31, 29, 31): (False, False, True), (44, 46, 4, 6): (False, False, True), (40, 41, 8, 9): (False, False, False)}
    for (x0, x1, y0, y1), want in cases.items():
        b = F.struct(*[F.lit(float(v)).alias(n) for v, n in ((x0, "xmin"), (x1, "xmax"), (y0, "ymin"), (y1, "ymax"))])
        p = F.struct(b.alias("bounds"))
        assert tuple(spark.range(1).select(*[geo.intersects(p, g) for g in (with_hole, multi, mixed)]).first()) == want
        assert spark.range(1).select(geo.intersects(multi, p)).first()[0] == want[1]
    at = spark.createDataFrame([(5.0, 5.0), (4.0, 5.0), (1.0, 1.0), (25.0, 5.0), (30.0, 30.0), (45.0, 5.0), (45.0, 5.5)], "x double, y double")
    got = at.select(*[geo.point_meets(F.col("x"), F.col("y"), g).alias(f"g{i}") for i, g in enumerate((with_hole, multi, mixed))]).collect()
    assert [tuple(r) for r in got] == [(False, False, False), (True, True, False), (True, True, False), (False, True, False), (False, False, True), (False, False, True), (False, False, False)]


def test_chips_are_bounded(spark):
    df = spark.range(3000).select((F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("y"), "id")
    chips = spatial.chip(df, F.col("x"), F.col("y"), 1.0, [F.col("id")], 100)
    sizes = chips.groupBy("cell", "part").count()
    assert sizes.agg(F.max("count"), F.sum("count")).first() == (100, 3000)


def test_header_queries_prune(spark, tmp_path):
    from stratapoint.sources.tables import read_patches, write_patches

    df = hex_patches(spark)
    write_patches(df, str(tmp_path / "pa"), cell=0.05)
    ring = [(0.0, 0.0), (0.05, 0.0), (0.05, 0.05)]
    own = read_patches(spark, str(tmp_path / "pa"), ring=ring).select(F.col("pa")["npoints"])
    plan = own._jdf.queryExecution().explainString(own._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    read = next(x for x in plan.split("\n") if x.startswith("ReadSchema"))
    assert "dims" not in read and "stats" not in read and "LessThanOrEqual(pa.bounds.xmin" in plan
    assert own.count() == 1


def test_versions(spark):
    assert one(spark, versions.lazperf_enabled()) is False and "lazperf enabled: false" in one(spark, versions.full_version())
    with pytest.warns(UserWarning):
        assert versions.version_no_commit("1.0 abc", "1.1 abc") == "1.0"


def test_mixed_types_round_trip(spark):
    for s in (S10, S11):
        p = patches.make_patch(s, vals(-1.27, 1.27, 3.2, -5, 123456.78, 0.25, 1e-9, 0, 0, 0, 0, 0, 0, 0))
        assert one(spark, wkb.patch_from_hex(wkb.patch_to_hex(p, s), s)["dims"]) == one(spark, p["dims"])


def test_make_patch_computes_its_array_once(spark):
    """In a lambda the array would be computed anew for every point: quadratic in the points of a patch."""
    parts = spark.range(1).select(F.array(vals(1, 2, 3, 4), vals(5, 6, 7, 8, 9, 10, 11, 12)).alias("v")).localCheckpoint()
    df = parts.select(patches.make_patch(S1, F.flatten("v")).alias("pa"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("flatten(") == 1
    assert df.first().pa.dims == [[100.0, 500.0, 900.0], [200.0, 600.0, 1000.0], [300.0, 700.0, 1100.0], [4.0, 8.0, 12.0]]
    empty, null = F.array().cast("array<double>"), F.lit(None).cast("array<double>")
    assert one(spark, patches.make_patch(S1, empty)) is None and one(spark, patches.make_patch(S1, null)) is None


def test_intersection_is_exact_on_borders(spark):
    """Points on a slanted edge, of a whole number of hundredths: all of them on it, whatever doubles make of the products."""
    triangle, y = [(0.0, 0.0), (60000.5, 0.0), (0.0, 40.0)], range(4, 40, 4)
    on = [(round(60000.5 - 1500.0125 * v, 2), v, 0, v) for v in y]
    rows = [*on, *[(round(a - 0.01, 2), b, 0, 100 + n) for a, b, _, n in on], *[(round(a + 0.01, 2), b, 0, 200 + n) for a, b, _, n in on]]
    # 35 * 0.01 is more than 0.35: the box of a patch is tested on stored numbers too.
    square = [(0.0, 0.0), (0.35, 0.0), (0.35, 0.35), (0.0, 0.35)]
    hole = [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2), (0.1, 0.2)]
    many = [(0.15, 0.15, 0, 1), (0.2, 0.15, 0, 2), (0.21, 0.15, 0, 3)]
    given = [(n, [float(v) for r in own for v in r]) for n, own in enumerate((rows, [(0.35, 0.1, 0, 1)], many))]
    pas = spark.createDataFrame(given, "n int, v array<double>").select("n", patches.make_patch(S1, F.col("v")).alias("pa")).orderBy("n").localCheckpoint()
    own = lambda n, *a, **k: pas.where(F.col("n") == n).select(geo.intersection(F.col("pa"), S1, *a, **k)["dims"][3].alias("c")).first().c
    inner = [100.0 + v for v in y]
    assert own(0, triangle) == [*map(float, y), *inner] and own(0, triangle, closed=False) == inner
    assert own(1, square) == [1.0] and own(1, square, closed=False) is None
    assert own(2, square, [hole]) == [2.0, 3.0] and own(2, square, [hole], closed=False) == [3.0]
