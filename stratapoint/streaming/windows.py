"""Patches from streams: points gathered by event-time window and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapoint.operators.patching import patchify
from stratapoint.schema import Schema


def windowed(df: DataFrame, schema: Schema, values: dict[str, Column], keys: list[str], time: str, order: list[Column], length: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """window_start, window_end, keys, pa: tumbling or sliding windows, the same plan on a table and on a stream.

    delay: how late a row may come; a stream emits a window once the watermark has passed its end and then drops its state.
    """
    if delay is not None and df.isStreaming:
        df = df.withWatermark(time, delay)
    at = F.window(time, length, slide) if slide else F.window(time, length)
    own = df.withColumn("__window", at)
    out = patchify(own, schema, values, ["__window", *keys], order)
    return out.select(F.col("__window.start").alias("window_start"), F.col("__window.end").alias("window_end"), *keys, "pa")


def sessions(df: DataFrame, schema: Schema, values: dict[str, Column], keys: list[str], time: str, order: list[Column], gap: str, delay: str | None = None) -> DataFrame:
    """The same by sessions: runs of rows of a key with no gap of this length."""
    if delay is not None and df.isStreaming:
        df = df.withWatermark(time, delay)
    raw = patchify_by(df, schema, values, [F.session_window(time, gap).alias("__window"), *[F.col(k) for k in keys]], order)
    return raw.select(F.col("__window.start").alias("window_start"), F.col("__window.end").alias("window_end"), *keys, "pa")


def patchify_by(df: DataFrame, schema: Schema, values: dict[str, Column], by: list[Column], order: list[Column]) -> DataFrame:
    """patchify by grouping expressions that only exist inside a groupBy, such as session windows."""
    from stratapoint.functions.patches import from_dims
    from stratapoint.functions.quant import quantise

    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[quantise(values[d.name], d).alias(f"r{i}") for i, d in enumerate(schema.dims)])
    got = df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    dims = F.array(*[F.transform("__rows", lambda r: r[f"r{i}"]) for i in range(schema.ndims)])
    return got.withColumn("pa", from_dims(schema, dims)).drop("__rows")
