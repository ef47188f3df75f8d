"""Binary input and output of points and patches: the only functions here that need Python workers (Arrow batches)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stratapoint.errors import PointError
from stratapoint.functions.patches import PATCH, from_dims
from stratapoint.functions.points import POINT, point
from stratapoint.schema import Schema
from stratapoint.sources import codec


def _checked(text: str, schema: Schema) -> bytes:
    if not text or text[0] != "0":
        raise PointError("the text of a point or patch is hex of its binary form, and starts with 0")
    raw = codec.from_hex(text)
    if codec.pcid_of(raw) != schema.pcid:
        raise PointError(f"pcid ({codec.pcid_of(raw)}) does not match column pcid ({schema.pcid})")
    return raw


def point_from_hex(text: Column, schema: Schema) -> Column:
    @F.pandas_udf("array<double>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else codec.point_from_wkb(schema, _checked(t, schema)))

    raw = read(text)
    return F.when(raw.isNotNull(), point(F.lit(schema.pcid), raw)).cast(POINT)


def point_to_wkb(pt: Column, schema: Schema) -> Column:
    @F.pandas_udf("binary")
    def write(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else codec.point_to_wkb(schema, v))

    return write(pt["raw"])


def point_to_hex(pt: Column, schema: Schema) -> Column:
    return F.hex(point_to_wkb(pt, schema))


def patch_from_hex(text: Column, schema: Schema) -> Column:
    """Any compression in; statistics and box are computed anew, the schema's compression is the patch's."""

    @F.pandas_udf("array<array<double>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else [c.tolist() for c in codec.patch_from_wkb(schema, _checked(t, schema))])

    return from_dims(schema, read(text))


def _over_patches(schema: Schema, returns: str, one):
    @F.pandas_udf(returns)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kind, asked, dims in batches:
            yield pd.Series([None if d is None else one(int(k), list(d), None if a is None else list(a)) for k, a, d in zip(kind, asked, dims, strict=True)], dtype=object)

    return lambda pa: run(F.coalesce(pa["compression"], F.lit(0)), pa["codecs"], pa["dims"])


def patch_to_wkb(pa: Column, schema: Schema) -> Column:
    return _over_patches(schema, "binary", lambda k, d, a: codec.patch_to_wkb(schema, k, d, a))(pa)


def patch_to_hex(pa: Column, schema: Schema) -> Column:
    return F.hex(patch_to_wkb(pa, schema))


def memsize(pa: Column, schema: Schema) -> Column:
    """Bytes of the serialised patch in its compression."""
    return _over_patches(schema, "int", lambda k, d, a: codec.patch_size(schema, k, d, a))(pa)


def codecs_of(pa: Column, schema: Schema) -> Column:
    """The codec each dimension would be written with: array<int>."""
    return _over_patches(schema, "array<int>", lambda k, d, a: codec.codecs_for(schema, codec.typed(schema, d), a))(pa)


def patch_type() -> str:
    return PATCH
