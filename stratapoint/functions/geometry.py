"""Bounding boxes, polygons and EWKB."""

from __future__ import annotations

import math
import struct
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as arrow
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from stratapoint.errors import PointError
from stratapoint.functions.intra import filter_points
from stratapoint.functions.points import get_role
from stratapoint.functions.quant import let, value_of
from stratapoint.functions.shapes import Ring, Shape, shape
from stratapoint.schema import Dimension, Schema

#: EWKB flags and geometry types (fixed values).
SRID_FLAG, M_FLAG, Z_FLAG = 0x20000000, 0x40000000, 0x80000000
POINT_TYPE, LINESTRING_TYPE, POLYGON_TYPE = 1, 2, 3

def box_intersects(a: Column, b: Column) -> Column:
    """Whether two bounds meet; touching counts."""
    return (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])


def patches_intersect(a: Column, b: Column) -> Column:
    """Whether two patches' boxes meet; patches of different pcid are an error."""
    mixed = F.raise_error(F.lit("pcid mismatch")).cast("boolean")
    return F.when(a["pcid"] != b["pcid"], mixed).otherwise(box_intersects(a["bounds"], b["bounds"]))


def _edges(ring: Ring) -> list[tuple[float, float, float, float]]:
    if len(ring) < 3:
        raise PointError("a polygon takes at least three corners")
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    return [(*a, *b) for a, b in zip(closed, closed[1:], strict=False)]


def point_in_polygon(x: Column, y: Column, ring: Ring, holes: list[Ring] = (), closed: bool = True) -> Column:
    """Closed test: a point on an edge is inside, of the ring as of a hole. Open: a point on an edge is outside."""

    def inside_and_on(edges) -> tuple[Column, Column]:
        crossings, on = F.lit(False), F.lit(False)
        for x1, y1, x2, y2 in edges:
            cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
            on = on | ((cross == 0) & (x >= min(x1, x2)) & (x <= max(x1, x2)) & (y >= min(y1, y2)) & (y <= max(y1, y2)))
            if y1 != y2:
                hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (cross < 0 if y2 > y1 else cross > 0)
                crossings = crossings != hit
        return crossings, on

    inside, on = inside_and_on(_edges(ring))
    out = inside | on if closed else inside & ~on
    for hole in holes:
        inside, on = inside_and_on(_edges(hole))
        out = out & (~inside | on if closed else ~inside & ~on)
    return out


def polygon_box(ring: Shape | str | bytes | Ring) -> tuple[float, float, float, float]:
    """xmin, xmax, ymin, ymax of a geometry; of an empty one, a box that nothing meets."""
    return shape(ring).box() or (math.inf, -math.inf, math.inf, -math.inf)


def _near(bounds: Column, geom: Shape) -> Column:
    xmin, xmax, ymin, ymax = polygon_box(geom)
    return (bounds["xmin"] <= xmax) & (bounds["xmax"] >= xmin) & (bounds["ymin"] <= ymax) & (bounds["ymax"] >= ymin)


def _cross(x: Column, y: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    return (x - a[0]) * (b[1] - a[1]) - (y - a[1]) * (b[0] - a[0])


def _over(b: Column, p: tuple[float, float], q: tuple[float, float]) -> Column:
    """A segment meets a box if it spans it on both axes and the corners are not all on one side of its line."""
    side = [F.signum(_cross(b[x], b[y], p, q)) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    spans = (b["xmin"] <= max(p[0], q[0])) & (b["xmax"] >= min(p[0], q[0])) & (b["ymin"] <= max(p[1], q[1])) & (b["ymax"] >= min(p[1], q[1]))
    return spans & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)


def patch_intersects_polygon(pa: Column, geom: Shape | str | bytes | Ring) -> Column:
    """Whether a patch's box meets a geometry: a box test that scans can push down, then borders, points and what lies inside.

    If no border meets a box, the box is inside a polygon as a whole or not at all; one corner tells, holes included.
    """
    own = shape(geom)

    def meets(b: Column) -> Column:
        hit = F.lit(False)
        for x, y in own.points:
            hit = hit | ((b["xmin"] <= x) & (b["xmax"] >= x) & (b["ymin"] <= y) & (b["ymax"] >= y))
        for p, q in own.segments():
            hit = hit | _over(b, p, q)
        for ring, holes in own.polygons:
            hit = hit | point_in_polygon(b["xmin"], b["ymin"], ring, holes)
        return hit

    return _near(pa["bounds"], own) & let(pa["bounds"], meets)


def intersects(a: Column | Shape | str | bytes | Ring, b: Column | Shape | str | bytes | Ring) -> Column:
    """Whether two patches, or a patch and a geometry in either order, meet."""
    if isinstance(a, Column) and isinstance(b, Column):
        return patches_intersect(a, b)
    return patch_intersects_polygon(a, b) if isinstance(a, Column) else patch_intersects_polygon(b, a)


def point_meets(x: Column, y: Column, geom: Shape | str | bytes | Ring, closed: bool = True) -> Column:
    """Whether a point lies on or inside a geometry; if not closed, polygons are without their borders."""
    own, hit = shape(geom), F.lit(False)
    for px, py in own.points:
        hit = hit | ((x == px) & (y == py))
    for line in own.lines:
        for p, q in zip(line, line[1:], strict=False):
            hit = hit | ((_cross(x, y, p, q) == 0) & (x >= min(p[0], q[0])) & (x <= max(p[0], q[0])) & (y >= min(p[1], q[1])) & (y <= max(p[1], q[1])))
    for ring, holes in own.polygons:
        hit = hit | point_in_polygon(x, y, ring, holes, closed)
    return hit


def _on_grid(geom: Shape, dx: Dimension, dy: Dimension) -> tuple[int, Shape] | None:
    """A factor and the geometry in whole numbers, so that tests of stored numbers times the factor are exact in 64 bits; None if they are not."""
    if geom.box() is None or not all(math.isfinite(c) for c in geom.box()) or not (dx.is_integer and dy.is_integer):
        return None
    number = lambda v: Fraction(repr(float(v)))  # noqa: E731  decimals as they are written
    at = lambda p: tuple((number(c) - number(d.offset)) / number(d.scale) for c, d in zip(p, (dx, dy), strict=True))
    moved = geom.map(at)
    corners = [*moved.points, *(p for line in moved.lines for p in line), *(p for ring, holes in moved.polygons for r in (ring, *holes) for p in r)]
    factor = math.lcm(*[c.denominator for p in corners for c in p])
    own = moved.map(lambda p: tuple(int(c * factor) for c in p))
    x0, x1, y0, y1 = own.box()
    far = [factor * int(max(map(abs, d.limits))) + max(abs(a), abs(b)) for d, a, b in ((dx, x0, x1), (dy, y0, y1))]
    return (factor, own) if far[0] * max(y1 - y0, 1) + far[1] * max(x1 - x0, 1) < 2**63 else None


def intersection(pa: Column, schema: Schema, geom: Shape | str | bytes | Ring, holes: list[Ring] = (), closed: bool = True) -> Column:
    """The points of a patch on or inside a geometry; null if there are none. holes: of a geometry that is one ring.

    Not closed: points on the border of a polygon are outside. Stored whole numbers are tested exactly where 64 bits hold the products.
    """
    own = shape(geom)
    if holes:
        own = Shape(polygons=[(own.polygons[0][0], list(holes))])
    i, j = schema.role("x"), schema.role("y")
    x, y = schema.dims[i].name, schema.dims[j].name
    grid = _on_grid(own, schema.dims[i], schema.dims[j])
    if grid is None:
        return F.when(_near(pa["bounds"], own), filter_points(pa, schema, lambda value: point_meets(value(x), value(y), own, closed)))
    factor, own = grid
    whole = lambda c: c.cast("long") * factor
    low, high = pa["stats"]["min"], pa["stats"]["max"]
    box = F.struct(*[whole(c).alias(n) for c, n in ((low[i], "xmin"), (high[i], "xmax"), (low[j], "ymin"), (high[j], "ymax"))])
    return F.when(_near(box, own), filter_points(pa, schema, lambda value: point_meets(whole(value(x)), whole(value(y)), own, closed), stored=True))


def envelope(pa: Column) -> Column:
    """The five corners of the closed box, as array<struct<x,y>>."""
    b = pa["bounds"]
    corners = (("xmin", "ymin"), ("xmin", "ymax"), ("xmax", "ymax"), ("xmax", "ymin"), ("xmin", "ymin"))
    return F.when(pa.isNotNull(), F.array(*[F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in corners]))


def _ewkb(kind: int, srid: int, has_z: bool, has_m: bool, srid_flag: bool) -> bytes:
    flags = kind | (Z_FLAG if has_z else 0) | (M_FLAG if has_m else 0) | (SRID_FLAG if srid_flag else 0)
    return struct.pack("<BI", 1, flags) + (struct.pack("<I", srid) if srid_flag else b"")


def pack_doubles(head: arrow.Array, values: arrow.Array) -> arrow.Array:
    """Of each row, the head's bytes and the doubles of its array, little-endian; null where either is null."""
    ok = pc.and_(head.is_valid(), values.is_valid())
    values = values.filter(ok)
    counts = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    body = arrow.py_buffer(values.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes())
    ends = np.cumsum(np.r_[0, counts * 8]).astype(np.int32)
    packed = pc.binary_join_element_wise(head.filter(ok).cast(arrow.binary()), arrow.BinaryArray.from_buffers(arrow.binary(), len(counts), [None, arrow.py_buffer(ends), body]), b"")
    at = np.cumsum(ok.to_numpy(zero_copy_only=False)) - 1
    return packed.take(arrow.array(at, mask=~ok.to_numpy(zero_copy_only=False)))


@cache
def _pack():
    return F.arrow_udf(pack_doubles, "binary")


def _packed(head: bytes, values: Column) -> Column:
    return _pack()(F.when(values.isNotNull(), F.lit(head)), values)


def point_head(schema: Schema) -> bytes:
    """The EWKB of a point up to its coordinates; the SRID if it is not 0."""
    z, m = schema.role("z") is not None, schema.role("m") is not None
    return _ewkb(POINT_TYPE, schema.srid, z, m, schema.srid != 0)


def envelope_head(schema: Schema) -> bytes:
    return _ewkb(POLYGON_TYPE, schema.srid, False, False, schema.srid > 0) + struct.pack("<II", 1, 5)


def diagonal_head(schema: Schema) -> bytes:
    z, m = schema.role("z") is not None, schema.role("m") is not None
    return _ewkb(LINESTRING_TYPE, schema.srid, z, m, schema.srid != 0) + struct.pack("<I", 2)


def point_ewkb(pt: Column, schema: Schema) -> Column:
    """EWKB POINT; Z and M by the roles that the schema has, the SRID if it is not 0."""
    roles = [r for r in "xyzm" if r in "xy" or schema.role(r) is not None]
    return _packed(point_head(schema), F.when(pt.isNotNull(), F.array(*[get_role(pt, schema, r) for r in roles])))


def envelope_ewkb(pa: Column, schema: Schema) -> Column:
    """EWKB POLYGON of the box; the SRID only if it is positive."""
    return _packed(envelope_head(schema), F.flatten(F.transform(envelope(pa), lambda c: F.array(c["x"], c["y"]))))


def diagonal(pa: Column, schema: Schema) -> Column:
    """Lowest and highest corner over x, y and, if the schema has them, z and m: array<array<double>>."""
    roles = [i for r in "xyzm" if (i := schema.role(r)) is not None]
    at = lambda s: F.array(*[value_of(pa["stats"][s][i], schema.dims[i]) for i in roles])
    return F.when(pa.isNotNull(), F.array(at("min"), at("max")))


def diagonal_ewkb(pa: Column, schema: Schema) -> Column:
    """EWKB LINESTRING of the two corners."""
    return _packed(diagonal_head(schema), F.flatten(diagonal(pa, schema)))
