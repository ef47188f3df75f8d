"""Functions on patches: many points of one schema as one nested value.

A patch is struct(pcid, compression, npoints, bounds, stats, codecs, dims). ``dims`` holds the stored numbers by dimension and
point; the small leaves in front of it are what scans prune and push down. ``compression`` is what a serialised form would
use (0 none, 1 dimensional, 2 laz), ``codecs`` the codec of each dimension if one was asked for. Values at rest are
compressed by Parquet whatever these tags say. No function makes a patch without points: it gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratapoint.errors import PointError
from stratapoint.functions.points import point, values_text
from stratapoint.functions.quant import fmt_g, half_away, let, quantise, value_of
from stratapoint.schema import COMPRESSIONS, Dimension, Schema

BOUNDS = "struct<xmin:double,xmax:double,ymin:double,ymax:double>"
STATS = "struct<min:array<double>,max:array<double>,avg:array<double>>"
PATCH = f"struct<pcid:int,compression:int,npoints:int,bounds:{BOUNDS},stats:{STATS},codecs:array<int>,dims:array<array<double>>>"
#: Fixed bytes of a serialised patch before statistics and payload.
HEADER_BYTES = 63


def _known(c: Column, d: Dimension) -> Column:
    """NaN counts for no minimum and no maximum; integers have none."""
    return c if d.is_integer else F.filter(c, lambda v: ~F.isnan(v))


def mean_stored(total: Column, n: Column, d: Dimension) -> Column:
    """The stored number of a mean, from a sum of stored numbers: exact for integers in any order of addition."""
    mean = total / n
    if d.interpretation == "double":
        return mean
    return mean.cast("float").cast("double") if d.interpretation == "float" else half_away(mean)


def assemble(schema: Schema, npoints: Column, low: list[Column], high: list[Column], mean: list[Column], dims: Column, compression: Column | None = None, codecs: Column | None = None) -> Column:
    """A patch from its dimensions and their statistics, all as stored numbers."""
    x, y = schema.role("x"), schema.role("y")
    at = lambda stat, i: value_of(stat[i], schema.dims[i]) if i is not None else F.lit(None).cast("double")
    bounds = F.struct(at(low, x).alias("xmin"), at(high, x).alias("xmax"), at(low, y).alias("ymin"), at(high, y).alias("ymax"))
    stats = F.struct(F.array(*low).alias("min"), F.array(*high).alias("max"), F.array(*mean).alias("avg"))
    return F.struct(
        F.lit(schema.pcid).alias("pcid"), (F.lit(schema.compression) if compression is None else compression).cast("int").alias("compression"), npoints.cast("int").alias("npoints"),
        bounds.alias("bounds"), stats.alias("stats"), (F.lit(None) if codecs is None else codecs).cast("array<int>").alias("codecs"), dims.alias("dims"),
    ).cast(PATCH)


def from_dims(schema: Schema, dims: Column, compression: Column | None = None, codecs: Column | None = None) -> Column:
    """A patch of stored numbers by dimension and point; null if there are no points."""

    def build(own: Column) -> Column:
        n = F.size(own[0])
        low = [F.array_min(_known(own[i], d)) for i, d in enumerate(schema.dims)]
        high = [F.array_max(_known(own[i], d)) for i, d in enumerate(schema.dims)]
        mean = [mean_stored(F.aggregate(own[i], F.lit(0.0), lambda a, v: a + v), n, d) for i, d in enumerate(schema.dims)]
        return F.when(n > 0, assemble(schema, n, low, high, mean, own, compression, codecs))

    return F.when(dims.isNotNull(), let(dims, build))


def make_patch(schema: Schema, vals: Column) -> Column:
    """vals: array<double>, point after point; a length that is no multiple of the dimensions is an error."""
    nd = schema.ndims

    def build(own: Column) -> Column:
        n = F.size(own)
        wrong = F.raise_error(F.concat(F.lit(f"array length is not a multiple of the {nd} dimensions of pcid {schema.pcid}: "), n.cast("string"))).cast(PATCH)
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(nd))).otherwise(F.array().cast("array<int>"))
        dims = F.array(*[F.transform(at, lambda j: quantise(own[j + i], d)) for i, d in enumerate(schema.dims)])
        return F.when(n % nd != 0, wrong).otherwise(from_dims(schema, dims))

    # Inside a lambda an expression is computed anew for every element; a variable is not.
    return F.when(vals.isNotNull(), let(vals, build))


def patch_of_points(schema: Schema, pts: Column) -> Column:
    """An array of points as a patch; null points are skipped, another pcid is an error."""
    own = F.filter(pts, F.isnotnull)
    mixed = F.raise_error(F.lit("points of more than one pcid in a patch")).cast(PATCH)
    dims = F.array(*[F.transform(own, lambda p: p["raw"][i]) for i in range(schema.ndims)])
    return F.when(F.size(own) > 0, F.when(F.exists(own, lambda p: p["pcid"] != schema.pcid), mixed).otherwise(from_dims(schema, dims)))


def union_of_patches(schema: Schema, patches: Column) -> Column:
    """An array of patches as one patch, point after point; duplicates stay, null patches are skipped."""
    own = F.filter(patches, F.isnotnull)
    mixed = F.raise_error(F.lit("patches of more than one pcid in a union")).cast(PATCH)
    dims = F.array(*[F.flatten(F.transform(own, lambda p: p["dims"][i])) for i in range(schema.ndims)])
    return F.when(F.size(own) > 0, F.when(F.exists(own, lambda p: p["pcid"] != schema.pcid), mixed).otherwise(from_dims(schema, dims)))


# Accessors: none but the last three reads more than the leaves in front of dims.


def pcid(pa: Column) -> Column:
    return pa["pcid"]


def num_points(pa: Column) -> Column:
    return pa["npoints"]


def compression(pa: Column) -> Column:
    return pa["compression"]


def bounds(pa: Column) -> Column:
    return pa["bounds"]


def patch_stat(pa: Column, schema: Schema, stat: int, name: str | None = None) -> Column:
    """0 minimum, 1 maximum, 2 average; of one dimension as a value, or of all as a point."""
    if stat not in (0, 1, 2):
        raise PointError(f'stat number "{stat}" is not supported')
    own = pa["stats"][("min", "max", "avg")[stat]]
    if name is None:
        return F.when(pa.isNotNull(), point(pa["pcid"], own))
    i = schema.index(name, 'dimension "{}" does not exist in schema')
    return value_of(own[i], schema.dims[i])


def patch_min(pa: Column, schema: Schema, name: str | None = None) -> Column:
    return patch_stat(pa, schema, 0, name)


def patch_max(pa: Column, schema: Schema, name: str | None = None) -> Column:
    return patch_stat(pa, schema, 1, name)


def patch_avg(pa: Column, schema: Schema, name: str | None = None) -> Column:
    return patch_stat(pa, schema, 2, name)


def uncompressed_memsize(pa: Column, schema: Schema) -> Column:
    """Bytes of the serialised form without compression, from the header alone."""
    return F.lit(HEADER_BYTES + 3 * schema.size) + pa["npoints"] * schema.size


def point_n(pa: Column, schema: Schema, n: Column | int) -> Column:
    """The n-th point from 1 on, or from the end if n is negative; null if there is none."""
    n = F.lit(n) if isinstance(n, int) else n
    at = F.when(n > 0, n - 1).otherwise(pa["npoints"] + n)
    there = (n != 0) & (at >= 0) & (at < pa["npoints"])
    return F.when(there, point(pa["pcid"], F.array(*[F.get(pa["dims"][i], at) for i in range(schema.ndims)])))


def as_text(pa: Column, schema: Schema) -> Column:
    at = F.sequence(F.lit(0), pa["npoints"] - 1)
    row = lambda j: values_text(F.array(*[value_of(F.get(pa["dims"][i], j), d) for i, d in enumerate(schema.dims)]))
    return F.concat(F.lit('{"pcid":'), pa["pcid"].cast("string"), F.lit(',"pts":['), F.array_join(F.transform(at, row), ","), F.lit("]}"))


def summary(pa: Column, schema: Schema, codecs: Column | None = None) -> Column:
    """A JSON text of header and statistics; codecs: array<int> by dimension (see codecs.codecs_of), for dimensional patches."""
    names = F.array(*[F.lit(x) for x in ("none", "rle", "sigbits", "zlib")])
    parts: list[Column] = []
    for i, d in enumerate(schema.dims):
        head = f'{"," if i else ""}{{"pos":{d.position},"name":"{d.name}","size":{d.size},"type":"{d.interpretation}"'
        codec = F.lit("") if codecs is None else F.when(pa["compression"] == 1, F.concat(F.lit(',"compr":"'), F.get(names, codecs[i]), F.lit('"'))).otherwise(F.lit(""))
        stat = [fmt_g(value_of(pa["stats"][s][i], d)) for s in ("min", "max", "avg")]
        parts += [F.lit(head), codec, F.lit(',"stats":{"min":'), stat[0], F.lit(',"max":'), stat[1], F.lit(',"avg":'), stat[2], F.lit("}}")]
    scheme = F.get(F.array(*[F.lit(x) for x in COMPRESSIONS]), pa["compression"])
    head = [F.lit('{"pcid":'), pa["pcid"].cast("string"), F.lit(', "npts":'), pa["npoints"].cast("string"), F.lit(f', "srid":{schema.srid}, "compr":"'), scheme, F.lit('","dims":[')]
    return F.concat(*head, *parts, F.lit("]}"))
