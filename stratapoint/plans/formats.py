"""The schemas that the queries over the driver's tables use, and these tables as points and patches."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.operators.patching import patchify
from stratapoint.schema import Dimension, Registry, Schema


def _dims(*specs: tuple[str, str, float]) -> list[Dimension]:
    return [Dimension(name, 0, kind, scale) for name, kind, scale in specs]


_XYZ = (("X", "int32_t", 0.01), ("Y", "int32_t", 0.01), ("Z", "int32_t", 0.01))


@cache
def registry() -> Registry:
    out = Registry()
    out.register(101, 0, Schema.of(_dims(*_XYZ, ("Intensity", "uint16_t", 1.0)), compression="dimensional"))
    out.register(102, 0, Schema.of(_dims(*_XYZ, ("Intensity", "uint16_t", 1.0), ("GPSTime", "double", 1.0)), compression="dimensional"))
    out.register(103, 0, Schema.of(_dims(("X", "int32_t", 0.02), ("Y", "int32_t", 0.02), ("Z", "int32_t", 0.02), ("Intensity", "uint16_t", 1.0)), compression="dimensional"))
    out.register(104, 0, Schema.of(_dims(("I1", "uint16_t", 1.0), *_XYZ, ("I2", "uint16_t", 1.0))))
    out.register(105, 0, Schema.of(_dims(("X", "int32_t", 1.0), ("Y", "int32_t", 0.01), ("Time", "double", 1.0)), compression="dimensional"))
    out.register(106, 0, Schema.of(_dims(("X", "int16_t", 0.01), ("Y", "uint8_t", 0.5), ("Z", "int8_t", 0.02), ("Intensity", "uint16_t", 1.0))))
    return out


def schema(pcid: int) -> Schema:
    return registry().get(pcid)


KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def epoch_seconds(name: str) -> Column:
    """Seconds since 1970 of a timestamp without time zone, the same in any session time zone."""
    t = F.col(name)
    whole = F.date_diff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    return (whole * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")) / 1e6


def values() -> dict[str, Column]:
    return {"X": F.col("l_extendedprice"), "Y": F.col("l_quantity"), "Z": F.col("l_discount"), "Intensity": F.col("l_linenumber"), "GPSTime": epoch_seconds("l_shipdate")}


def order() -> list[Column]:
    return [F.col(c) for c in KEY]


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def patches(spark: SparkSession, sf_dir: str, pcid: int = 101, keys: tuple[str, ...] = ("l_suppkey",)) -> DataFrame:
    return patchify(lineitem(spark, sf_dir), schema(pcid), values(), list(keys), order())
