import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from stratapoint.plans import queries as points

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v):
        if isinstance(v, float | Decimal):
            v = float(v)
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str([text(x) for x in v]) if isinstance(v, list | tuple) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(points.QUERIES))
def test_query(spark, oracle, name):
    df = points.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    got = oracle.execute(points.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(rows, df.columns) == canonical(got.fetchall(), names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_overlap_join_is_of_whole_patches(spark, oracle):
    """Each patch meets itself, and these patches hold every point."""
    rows = points.QUERIES["patch_overlap_join"](spark, SF).where("a = b and a_cx = b_cx and a_cy = b_cy").agg({"a_n": "sum"}).first()
    assert rows[0] == oracle.execute("SELECT count(*) FROM lineitem").fetchone()[0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_intersects_geometry_of_whole_patches(spark, oracle):
    """The patches hold every point, and both answers occur."""
    rows = points.QUERIES["patch_intersects_geometry"](spark, SF).collect()
    assert sum(r.n for r in rows) == oracle.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    assert {r.hit for r in rows} == {True, False}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_make_patch_of_every_point(spark, oracle):
    assert points.QUERIES["make_patch_array"](spark, SF).count() == oracle.execute("SELECT count(*) FROM lineitem").fetchone()[0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_triangle_without_its_border(spark, tmp_path):
    """Points on the slanted edge, which only larger tables hold by chance."""
    con = duckdb.connect()
    price = "CASE WHEN l_orderkey % 3 = 0 THEN round(60000.5 - 1500.0125 * (4 + 4 * (l_orderkey % 9)), 2) ELSE l_extendedprice END"
    quantity = "CASE WHEN l_orderkey % 3 = 0 THEN (4 + 4 * (l_orderkey % 9))::DOUBLE ELSE l_quantity END"
    con.execute(f"COPY (SELECT * REPLACE (({price})::DOUBLE AS l_extendedprice, ({quantity}) AS l_quantity) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = con.execute(points.ORACLE_SQL["triangle_intersection"])
    names = [c[0] for c in got.description]
    df = points.QUERIES["triangle_intersection"](spark, str(tmp_path))
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(got.fetchall(), names)


def test_percentiles_are_exact(spark):
    """Against Spark's own, over ties, nulls, NaN, one value, a null group and a group in which a sketch's parts are large."""
    import random

    from pyspark.sql import functions as F

    from stratapoint.operators.ranks import percentiles

    rng, fractions = random.Random(3), [0.0, 0.25, 0.48, 0.5, 0.52, 0.999, 1.0]
    rows = [("many", round(rng.lognormvariate(3, 2), 2)) for _ in range(20_000)] + [("ties", float(rng.choice([1, 1, 1, 2, 9]))) for _ in range(999)]
    rows += [("one", -0.5), ("two", 1.0), ("two", 4.0), ("none", None), (None, 3.0), (None, 8.0), (None, None), ("nan", 1.0), ("nan", float("nan")), ("nan", 2.0), ("huge", 1e300), ("huge", -1e300), ("huge", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r.p for r in percentiles(df, "g", "v", fractions, "p").collect()}
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(f) for f in fractions])).alias("p")).collect() if r.p is not None}
    assert {g: [repr(x) for x in p] for g, p in got.items()} == {g: [repr(x) for x in p] for g, p in want.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_approximate_aggregates_keep_no_values_by_part(spark):
    """A percentile beside a distinct count would gather the values of every flag and part in buffers."""
    plan = points.QUERIES["approximate_aggregates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "percentile(" in line]
