import pytest
from pyspark.sql import functions as F

from stratapoint.errors import PointError
from stratapoint.functions import wkb
from stratapoint.plans.formats import epoch_seconds, schema
from stratapoint.sources import tables
from stratapoint.schema import Registry
from stratapoint.streaming.windows import windowed
from tests.formats import S1
from tests.test_patches import HEX, hex_patches


def test_hex_files(spark, tmp_path):
    df = hex_patches(spark).select(wkb.patch_to_hex(F.col("pa"), S1).alias("wkb"))
    tables.write_hex(df, str(tmp_path / "a"))
    assert tables.read_hex(spark, str(tmp_path / "a")).select(wkb.patch_from_hex(F.col("wkb"), S1)["npoints"]).count() == len(HEX)
    spark.dataSource.register(tables.HexWkb)
    df.write.format("hexwkb").mode("append").save(str(tmp_path / "b"))
    df.write.format("hexwkb").mode("overwrite").save(str(tmp_path / "b"))
    assert spark.read.format("hexwkb").load(str(tmp_path / "b")).count() == len(HEX)


def test_columns_view(spark):
    r = Registry()
    r.register(1, 4326, S1)
    pa = hex_patches(spark)
    got = tables.columns_view(spark, r, {"a": pa, "b": tables.pin(pa, "pa", "patch", 1)}).collect()
    assert sorted((x["table"], x.column, x.pcid, x.srid, x.type) for x in got) == [("a", "pa", None, None, "pcpatch"), ("b", "pa", 1, 4326, "pcpatch")]
    with pytest.raises(Exception, match="does not match column pcid"):
        tables.pin(pa, "pa", "patch", 3).collect()


def test_type_modifiers():
    assert tables.typmod_in(["7"]) == 7 and tables.typmod_out(7) == "(7)" and tables.typmod_out(-1) == ""
    assert [tables.typmod_pcid(x) for x in (None, -1, 0, 65536 + 3)] == [None, None, None, 3]
    for bad in ([], ["1", "2"], ["x"]):
        with pytest.raises(PointError):
            tables.typmod_in(bad)


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = [(i, i % 3, f"2024-01-01 0{i // 20}:{i % 20:02d}:00", 1.5 * i) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t string, value double").select("event_id", "user_id", F.to_timestamp("t").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    v = {"X": F.col("user_id"), "Y": F.col("value"), "Time": epoch_seconds("ts")}
    run = lambda d: windowed(d, schema(105), v, ["user_id"], "ts", [F.col("ts"), F.col("event_id")], "1 hour", delay="10 minutes")
    stream = run(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("patches").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    flat = lambda d: sorted((str(r.window_start), r.user_id, r.pa.npoints, r.pa.stats.max[1]) for r in d.collect())
    assert flat(spark.table("patches")) == flat(run(df))
