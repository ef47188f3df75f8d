import pytest

from stratapoint.runtime import BATCH_BYTES, Scratch, ship


def test_scratch_tables(spark):
    scratch = Scratch(spark)
    a, b = scratch.table(spark.range(5), "a"), scratch.table(spark.range(7), "b")
    scratch.only("b")
    assert b.count() == 7 and scratch in Scratch.made
    with pytest.raises(Exception, match="not exist|FileNotFound|PATH_NOT_FOUND"):
        a.collect()
    scratch.drop()
    assert scratch not in Scratch.made


def test_batches_are_bounded(spark):
    ship(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES
