import pytest
from pyspark.sql import functions as F

from stratapoint import api
from stratapoint.functions import geometry, intra, patches, points, wkb
from stratapoint.plans.formats import registry, schema
from tests.test_patches import one


@pytest.fixture(scope="module")
def p(spark):
    api.register_sql(spark, registry())
    vals = F.array(*[F.lit(float(v)) for v in (3, 2, 3, 4, 5, 6, 7, 8, 1, 9, 2, 6)])
    df = spark.range(1).select(patches.make_patch(schema(101), vals).alias("pa"), points.make_point(schema(101), F.slice(vals, 1, 4)).alias("pt")).cache()
    df.createOrReplaceTempView("p")
    return df


def sql(spark, text):
    return spark.sql(f"SELECT {text} FROM p").first()[0]


def test_sql_functions(spark, p):
    row = spark.sql("SELECT PC_NumPoints(pa), PC_PCId(pa), PC_Compression(pa), PC_PatchMax(pa, 'X'), PC_GetAll(PC_PatchMinPoint(pa)), PC_Intersects(pa, pa), pc_typmod_pcid(65539), pc_version(), PC_PointPCId(pt) FROM p").first()
    assert list(row) == [3, 101, 1, 5.0, [1.0, 2.0, 2.0, 4.0], True, 3, "0.1.0", 101]
    assert spark.sql("SELECT PC_Get(PC_MakePoint(101, array(1.005D, 2, 3, 70000)), 'Intensity'), PC_PointMemSize(PC_MakePoint(101, array(1D, 2, 3, 4)))").first()[:] == (65535.0, 25)
    for bad, match in (("PC_Get(PC_MakePoint(101, array(1D, 2, 3, 4)), 'q')", "does not exist in schema"), ("PC_MakePoint(9, array(1D))", "no entry"), ("PC_MakePoint(101, array(1D))", "number of values"), ("PC_FilterEquals(pa, 'q', 1)", "does not exist"), ("PC_Compress(pa, 'laz')", "lazperf"), ("PC_Compress(pa, 'x')", "unrecognized compression scheme")):
        with pytest.raises(Exception, match=match):
            spark.sql(f"SELECT {bad} FROM p").collect()


S101, S103, S104 = schema(101), schema(103), schema(104)
#: SQL and the column that it must equal.
PAIRS = {
    "PC_AsText(pa)": lambda pa, pt: patches.as_text(pa, S101),
    "PC_PointAsText(pt)": lambda pa, pt: points.as_text(pt, S101),
    "PC_Summary(pa)": lambda pa, pt: patches.summary(pa, S101),
    "PC_PointN(pa, -1)": lambda pa, pt: patches.point_n(pa, S101, -1),
    "PC_FilterLessThan(pa, 'x', 3.5)": lambda pa, pt: intra.filter_less_than(pa, S101, "x", 3.5),
    "PC_FilterGreaterThan(pa, 'y', 2)": lambda pa, pt: intra.filter_greater_than(pa, S101, "y", 2),
    "PC_FilterEquals(pa, 'Intensity', 6)": lambda pa, pt: intra.filter_equals(pa, S101, "intensity", 6),
    "PC_FilterBetween(pa, 'X', 6, 2)": lambda pa, pt: intra.filter_between(pa, S101, "X", 6, 2),
    "PC_FilterLessThan(pa, 'x')": lambda pa, pt: intra.filter_less_than(pa, S101, "x", 0.0),
    "PC_Range(pa, 2, 5)": lambda pa, pt: intra.range_(pa, S101, 2, 5),
    "PC_Sort(pa, array('x'))": lambda pa, pt: intra.sort(pa, S101, ["x"]),
    "PC_Sort(pa, array(CAST(NULL AS STRING)))": lambda pa, pt: pa,
    "PC_IsSorted(PC_Sort(pa, array('Z', 'x')), array('z'), true)": lambda pa, pt: F.lit(True),
    "PC_IsSorted(pa, array('x'))": lambda pa, pt: intra.is_sorted(pa, S101, ["x"]),
    "PC_SetPCId(pa, 104, 7.0D)": lambda pa, pt: intra.set_pcid(pa, S101, S104, 7.0),
    "PC_SetPCId(pa, 103)": lambda pa, pt: intra.set_pcid(pa, S101, S103),
    "PC_Transform(pa, 103)": lambda pa, pt: intra.transform(pa, S101, S103),
    "PC_Compress(pa)": lambda pa, pt: intra.compress(pa, S101),
    "PC_Compress(pa, 'dimensional', 'rle,zlib')": lambda pa, pt: intra.compress(pa, S101, "dimensional", "rle,zlib"),
    "PC_Uncompress(pa)": lambda pa, pt: intra.uncompress(pa),
    "PC_MakePatch(101, array(1D, 2, 3, 4, 5, 6, 7, 8))": lambda pa, pt: patches.make_patch(S101, F.array(*[F.lit(float(v)) for v in range(1, 9)])),
    "PC_Patch(array(pt, NULL, pt))": lambda pa, pt: patches.patch_of_points(S101, F.array(pt, pt)),
    "PC_Union(array(pa, pa))": lambda pa, pt: patches.union_of_patches(S101, F.array(pa, pa)),
    "PC_AsBinary(pt)": lambda pa, pt: geometry.point_ewkb(pt, S101),
    "PC_EnvelopeAsBinary(pa)": lambda pa, pt: geometry.envelope_ewkb(pa, S101),
    "PC_Envelope(pa)": lambda pa, pt: geometry.envelope_ewkb(pa, S101),
    "PC_EnvelopeGeometry(pa)": lambda pa, pt: geometry.envelope_ewkb(pa, S101),
    "PC_BoundingDiagonalAsBinary(pa)": lambda pa, pt: geometry.diagonal_ewkb(pa, S101),
    "PC_BoundingDiagonalGeometry(pa)": lambda pa, pt: geometry.diagonal_ewkb(pa, S101),
    "PC_MemSize(pa)": lambda pa, pt: wkb.memsize(pa, S101),
    "PC_Envelope(CASE WHEN pt IS NULL THEN pa END)": lambda pa, pt: F.lit(None),
    "PC_FilterLessThan(CASE WHEN pt IS NULL THEN pa END, 'x', 1)": lambda pa, pt: F.lit(None),
}


@pytest.mark.parametrize("text", PAIRS)
def test_sql_is_the_column_function(spark, p, text):
    assert sql(spark, text) == p.select(PAIRS[text](F.col("pa"), F.col("pt"))).first()[0]


def test_explode_in_sql(spark, p):
    rows = spark.sql("SELECT e.ordinal, PC_Get(e.pt, 'x') AS x FROM (SELECT PC_FilterGreaterThan(pa, 'x', 2) AS pa FROM p) AS q, LATERAL PC_Explode(q.pa) AS e").collect()
    assert sorted(map(tuple, rows)) == [(1, 3.0), (2, 5.0)]
    back = spark.sql("SELECT PC_Union(collect_list(pa)) AS u, PC_NumPoints(PC_Patch(collect_list(pt))) AS n FROM p").first()
    assert back.u.npoints == 3 and back.n == 1


def test_every_name_has_a_builder(spark):
    assert all(callable(f) for f in api.FUNCTIONS.values())
    assert one(spark, api.FUNCTIONS["pc_version"]()) == "0.1.0"
