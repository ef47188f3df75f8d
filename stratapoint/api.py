"""The functions by the names that SQL users know, as Python builders and as temporary SQL functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as arrow
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from stratapoint.errors import PointError
from stratapoint.functions import geometry, intra, patches, points, versions, wkb
from stratapoint.functions.patches import PATCH
from stratapoint.functions.points import POINT
from stratapoint.functions.quant import let
from stratapoint.operators import patching
from stratapoint.runtime import ship
from stratapoint.schema import Registry, Schema, schema_is_valid
from stratapoint.sources import codec
from stratapoint.sqltext import sql_text

PATCH_FIELDS = ("pcid", "compression", "npoints", "bounds", "stats", "codecs", "dims")

#: SQL name -> builder. Builders take columns and, where values are read or made, the schema.
FUNCTIONS = {
    "PC_SchemaIsValid": schema_is_valid,
    "PC_SchemaGetNDims": Registry.ndims,
    "PC_MakePoint": points.make_point,
    "PC_Get": points.get,
    "PC_GetAll": points.get_all,
    "PC_PCId": points.pcid,
    "PC_MemSize": wkb.memsize,
    "PC_AsText": patches.as_text,
    "PC_PointAsText": points.as_text,
    "PC_AsBinary": geometry.point_ewkb,
    "PC_MakePatch": patches.make_patch,
    "PC_Patch": patching.patch_agg,
    "PC_PatchOfArray": patches.patch_of_points,
    "PC_Point_Agg": patching.array_agg,
    "PC_Patch_Agg": patching.array_agg,
    "PC_Union": patching.union,
    "PC_Explode": patching.explode_points,
    "PC_NumPoints": patches.num_points,
    "PC_Compression": patches.compression,
    "PC_Summary": patches.summary,
    "PC_PatchMin": patches.patch_min,
    "PC_PatchMax": patches.patch_max,
    "PC_PatchAvg": patches.patch_avg,
    "PC_PointN": patches.point_n,
    "PC_FilterLessThan": intra.filter_less_than,
    "PC_FilterGreaterThan": intra.filter_greater_than,
    "PC_FilterEquals": intra.filter_equals,
    "PC_FilterBetween": intra.filter_between,
    "PC_Range": intra.range_,
    "PC_Sort": intra.sort,
    "PC_IsSorted": intra.is_sorted,
    "PC_SetPCId": intra.set_pcid,
    "PC_Transform": intra.transform,
    "PC_Compress": intra.compress,
    "PC_Uncompress": intra.uncompress,
    "PC_Intersects": geometry.intersects,
    "PC_IntersectsGeometry": geometry.patch_intersects_polygon,
    "PC_Intersection": geometry.intersection,
    "PC_EnvelopeAsBinary": geometry.envelope_ewkb,
    "PC_Envelope": geometry.envelope_ewkb,
    "PC_EnvelopeGeometry": geometry.envelope_ewkb,
    "PC_BoundingDiagonalAsBinary": geometry.diagonal_ewkb,
    "PC_BoundingDiagonalGeometry": geometry.diagonal_ewkb,
    "pc_lazperf_enabled": versions.lazperf_enabled,
    "pc_script_version": versions.script_version,
    "pc_lib_version": versions.lib_version,
    "pc_pgsql_version": versions.engine_version,
    "pc_libxml2_version": versions.xml_version,
    "pc_version": versions.version,
    "pc_full_version": versions.full_version,
    "PC_PostGIS_Version": versions.geometry_version,
}


def _raise(text: Column | str, type_: str) -> Column:
    return F.raise_error(F.lit(text) if isinstance(text, str) else text).cast(type_)


def _by_pcid(schemas: list[Schema], pcid: Column, type_: str, build: Callable[[Schema], Column]) -> Column:
    """The schema's own expression, chosen by a pcid as the query runs; null for null."""
    out = F.when(pcid.isNull(), F.lit(None).cast(type_))
    for s in schemas:
        try:
            own = build(s)
        except PointError as e:  # known when the function is made, raised when it is used
            own = _raise(str(e), type_)
        out = out.when(pcid == s.pcid, own)
    return out.otherwise(_raise(F.concat(F.lit("no entry in the formats table for pcid = "), pcid.cast("string")), type_))


def _index(schema: Schema, dim: Column, missing: str) -> Column:
    """The place of a dimension by its name, whatever its case."""
    out, found = None, {}
    for i, d in enumerate(schema.dims):
        if d.name:
            found[d.name.lower()] = i
    for name, i in found.items():
        out = (F if out is None else out).when(F.lower(dim) == name, F.lit(i))
    text = F.concat(F.lit('dimension "'), dim, F.lit(f'" {missing}'))
    return _raise(text, "int") if out is None else out.when(dim.isNull(), F.lit(None).cast("int")).otherwise(_raise(text, "int"))


def _dimension(schema: Schema, dim: Column, missing: str) -> Column:
    """Place, scale and offset of a dimension."""
    i = _index(schema, dim, missing)
    return let(i, lambda k: F.struct(k.alias("i"), F.get(F.array(*[F.lit(float(d.scale)) for d in schema.dims]), k).alias("s"), F.get(F.array(*[F.lit(float(d.offset)) for d in schema.dims]), k).alias("o")))


_NO_DIM, _NO_DIM_IN = "does not exist", "does not exist in schema"


def _of_dim(schema: Schema, dim: Column, stored: Column) -> Column:
    return let(_dimension(schema, dim, _NO_DIM_IN), lambda q: F.get(stored, q["i"]) * q["s"] + q["o"])


#: Modes of a filter by number (fixed values), with the test of a value and what the statistics must allow.
MODES: dict[int, tuple[Callable, Callable]] = {
    0: (lambda x, a, b: x < a, lambda low, high, a, b: low < a),
    1: (lambda x, a, b: x > a, lambda low, high, a, b: high > a),
    2: (lambda x, a, b: x == a, lambda low, high, a, b: (low <= a) & (high >= a)),
    3: (lambda x, a, b: (x > F.least(a, b)) & (x < F.greatest(a, b)), lambda low, high, a, b: (low < F.greatest(a, b)) & (high > F.least(a, b))),
}


def filter_mode(pa: Column, schema: Schema, dim: Column, mode: int, v1: Column, v2: Column) -> Column:
    """The points that pass a filter of a mode; dimension and values are columns."""
    if mode not in MODES:
        raise PointError(f"unknown filter mode: {mode}")
    keep, may = MODES[mode]

    def body(q: Column) -> Column:
        value = lambda x: x * q["s"] + q["o"]
        own, stat = F.get(pa["dims"], q["i"]), lambda n: value(F.get(pa["stats"][n], q["i"]))
        at = F.filter(F.sequence(F.lit(0), pa["npoints"] - 1), lambda j: keep(value(F.get(own, j)), v1, v2) & ~F.isnan(F.get(own, j)))
        return F.when(may(stat("min"), stat("max"), v1, v2), intra._pick(pa, schema, at))

    return F.when(pa.isNotNull(), let(_dimension(schema, dim, _NO_DIM), body))


def _sort_keys(pa: Column, schema: Schema, dims: Column) -> Column:
    """The stored numbers of each point in the order of the named dimensions: array<array<double>>."""
    at = F.transform(F.filter(dims, F.isnotnull), lambda d: _index(schema, d, _NO_DIM))
    return let(at, lambda keys: F.transform(F.sequence(F.lit(0), pa["npoints"] - 1), lambda j: F.transform(keys, lambda k: F.get(F.get(pa["dims"], k), j))))


def sort_by(pa: Column, schema: Schema, dims: Column) -> Column:
    rows = F.transform(_sort_keys(pa, schema, dims), lambda k, j: F.struct(k.alias("k"), j.alias("j")))
    at = F.transform(F.array_sort(rows), lambda r: r["j"])
    sorted_ = let(at, lambda own: F.array(*[F.transform(own, lambda j: F.get(pa["dims"][i], j)) for i in range(schema.ndims)]))
    tagged = pa.withField("dims", sorted_).withField("compression", F.lit(schema.compression)).withField("codecs", F.lit(None).cast("array<int>"))
    return F.when(F.size(F.filter(dims, F.isnotnull)) == 0, pa).otherwise(tagged)


def sorted_by(pa: Column, schema: Schema, dims: Column, strict: Column) -> Column:
    """As in the original interface, strict = true is the one that accepts equal neighbours."""
    later = F.when(pa["npoints"] > 1, F.sequence(F.lit(1), pa["npoints"] - 1)).otherwise(F.array().cast("array<int>"))
    ordered = let(_sort_keys(pa, schema, dims), lambda k: F.forall(later, lambda j: F.when(strict, F.get(k, j - 1) <= F.get(k, j)).otherwise(F.get(k, j - 1) < F.get(k, j))))
    return F.when(F.size(F.filter(dims, F.isnotnull)) == 0, F.lit(True)).otherwise(ordered)


def compress_by(pa: Column, schema: Schema, scheme: Column, config: Column) -> Column:
    ints = "array<int>"
    asked = F.slice(F.when(config == "", F.array().cast("array<string>")).otherwise(F.split(config, ",")), 1, schema.ndims)
    number = lambda x: F.when(F.startswith(x, F.lit("rle")), 1).when(F.startswith(x, F.lit("sigbits")), 2).when(F.startswith(x, F.lit("zlib")), 3).when(F.startswith(x, F.lit("auto")), -1).otherwise(
        _raise(F.concat(F.lit("unrecognized dimensional compression '"), x, F.lit("', please use 'auto', 'rle', 'sigbits' or 'zlib'")), "int"))
    codecs = F.concat(F.transform(asked, number), F.array_repeat(F.lit(-1), F.lit(schema.ndims) - F.size(asked)))
    codecs = let(codecs, lambda c: F.when(F.exists(c, lambda x: x >= 0), c))
    tagged = lambda n, c: pa.withField("compression", F.lit(n)).withField("codecs", c)
    laz = _raise(intra.LAZ_REFUSED, PATCH)
    own = laz if schema.compression == 2 else tagged(schema.compression, F.lit(None).cast(ints))
    wrong = _raise(F.concat(F.lit("unrecognized compression scheme '"), scheme, F.lit("', please specify 'auto', 'dimensional' or 'laz'")), PATCH)
    return F.when((scheme == "") | (F.lower(scheme) == "auto"), own).when(scheme == "dimensional", tagged(1, codecs)).when(scheme == "laz", laz).otherwise(wrong)


#: name -> (parameters, result, expression); the parameters are attributes of the expression.
Definitions = dict[str, tuple[str, str, Column]]


def sql_functions(registry: Registry, pcids: list[int] | None = None) -> Definitions:
    """Functions that find a value's schema by its pcid as a query runs, for some or all schemas of a registry.

    The interface overloads names by type, which SQL functions of Spark do not: the variants on points are called
    PC_GetAll, PC_PointPCId, PC_PointMemSize, PC_PointAsText, those that give statistics as points PC_PatchMinPoint and so
    on, and the aggregates take what collect_list gathers: PC_Patch(points), PC_Union(patches).
    """
    schemas = [registry.get(p) for p in pcids or registry.pcids()]
    pa, pt, dim, v1, v2 = (F.col(x) for x in ("pa", "pt", "dim", "v1", "v2"))
    P, PAS, PTS = f"pa {PATCH}", f"pas ARRAY<{PATCH}>", f"pts ARRAY<{POINT}>"  # noqa: N806
    patch = lambda type_, build: _by_pcid(schemas, pa["pcid"], type_, build)
    point_ = lambda type_, build: _by_pcid(schemas, pt["pcid"], type_, build)
    out: Definitions = {
        "PC_SchemaGetNDims": ("pcid INT", "INT", _by_pcid(schemas, F.col("pcid"), "int", lambda s: F.lit(s.ndims))),
        "PC_MakePoint": ("pcid INT, vals ARRAY<DOUBLE>", POINT, _by_pcid(schemas, F.col("pcid"), POINT, lambda s: points.make_point(s, F.col("vals")))),
        "PC_MakePatch": ("pcid INT, vals ARRAY<DOUBLE>", PATCH, _by_pcid(schemas, F.col("pcid"), PATCH, lambda s: patches.make_patch(s, F.col("vals")))),
        "PC_Patch": (PTS, PATCH, _by_pcid(schemas, F.get(F.filter(F.col("pts"), F.isnotnull), F.lit(0))["pcid"], PATCH, lambda s: patches.patch_of_points(s, F.col("pts")))),
        "PC_Union": (PAS, PATCH, _by_pcid(schemas, F.get(F.filter(F.col("pas"), F.isnotnull), F.lit(0))["pcid"], PATCH, lambda s: patches.union_of_patches(s, F.col("pas")))),
        "PC_Get": (f"pt {POINT}, dim STRING", "DOUBLE", point_("double", lambda s: _of_dim(s, dim, pt["raw"]))),
        "PC_GetAll": (f"pt {POINT}", "ARRAY<DOUBLE>", point_("array<double>", lambda s: points.get_all(pt, s))),
        "PC_PointPCId": (f"pt {POINT}", "INT", pt["pcid"]),
        "PC_PointMemSize": (f"pt {POINT}", "INT", point_("int", lambda s: points.memsize(pt, s))),
        "PC_PointAsText": (f"pt {POINT}", "STRING", point_("string", lambda s: points.as_text(pt, s))),
        "PC_PCId": (P, "INT", pa["pcid"]),
        "PC_NumPoints": (P, "INT", pa["npoints"]),
        "PC_Compression": (P, "INT", pa["compression"]),
        "PC_AsText": (P, "STRING", patch("string", lambda s: patches.as_text(pa, s))),
        "PC_Summary": (P, "STRING", patch("string", lambda s: patches.summary(pa, s))),
        "PC_PointN": (f"{P}, n INT", POINT, patch(POINT, lambda s: patches.point_n(pa, s, F.col("n")))),
        "PC_Range": (f"{P}, first INT, count INT", PATCH, patch(PATCH, lambda s: intra.range_(pa, s, F.col("first"), F.col("count")))),
        "PC_Sort": (f"{P}, dims ARRAY<STRING>", PATCH, patch(PATCH, lambda s: sort_by(pa, s, F.col("dims")))),
        "PC_IsSorted": (f"{P}, dims ARRAY<STRING>, strict BOOLEAN DEFAULT false", "BOOLEAN", patch("boolean", lambda s: sorted_by(pa, s, F.col("dims"), F.col("strict")))),
        "PC_SetPCId": (f"{P}, pcid INT, def DOUBLE DEFAULT 0.0D", PATCH, patch(PATCH, lambda a: _by_pcid(schemas, F.col("pcid"), PATCH, lambda b: intra.set_pcid(pa, a, b, F.col("def"))))),
        "PC_Transform": (f"{P}, pcid INT, def DOUBLE DEFAULT 0.0D", PATCH, patch(PATCH, lambda a: _by_pcid([b for b in schemas if b.srid == a.srid], F.col("pcid"), PATCH, lambda b: intra.transform(pa, a, b, F.col("def"))))),
        "PC_Compress": (f"{P}, scheme STRING DEFAULT '', config STRING DEFAULT ''", PATCH, patch(PATCH, lambda s: compress_by(pa, s, F.col("scheme"), F.col("config")))),
        "PC_Uncompress": (P, PATCH, intra.uncompress(pa)),
        "PC_Intersects": (f"a {PATCH}, b {PATCH}", "BOOLEAN", geometry.patches_intersect(F.col("a"), F.col("b"))),
        "pc_typmod_pcid": ("typmod INT", "INT", F.expr("CASE WHEN typmod <> -1 THEN nullif(typmod & 65535, 0) END")),
    }
    for name in ("min", "max", "avg"):
        out[f"PC_Patch{name.title()}"] = (f"{P}, dim STRING", "DOUBLE", patch("double", lambda s, name=name: _of_dim(s, dim, pa["stats"][name])))
        out[f"PC_Patch{name.title()}Point"] = (P, POINT, F.when(pa.isNotNull(), points.point(pa["pcid"], pa["stats"][name])))
    for name, mode in (("LessThan", 0), ("GreaterThan", 1), ("Equals", 2)):
        out[f"PC_Filter{name}"] = (f"{P}, dim STRING, v1 DOUBLE DEFAULT 0.0D", PATCH, patch(PATCH, lambda s, mode=mode: filter_mode(pa, s, dim, mode, v1, v1)))
    out["PC_FilterBetween"] = (f"{P}, dim STRING, v1 DOUBLE DEFAULT 0.0D, v2 DOUBLE DEFAULT 0.0D", PATCH, patch(PATCH, lambda s: filter_mode(pa, s, dim, 3, v1, v2)))
    for name, f in (("pc_lazperf_enabled", versions.lazperf_enabled), ("pc_script_version", versions.script_version), ("pc_lib_version", versions.lib_version), ("pc_pgsql_version", versions.engine_version), ("pc_libxml2_version", versions.xml_version), ("pc_version", versions.version), ("pc_full_version", versions.full_version), ("PC_PostGIS_Version", versions.geometry_version)):
        out[name] = ("", "BOOLEAN" if name == "pc_lazperf_enabled" else "STRING", f())
    return out


def _binary_functions(registry: Registry, pcids: list[int]) -> dict[str, tuple[str, object]]:
    """name -> (result, Arrow-batched function): those that make bytes, and so need Python workers."""
    schemas = {p: registry.get(p) for p in pcids}

    def over(build: Callable[[Schema], Callable]) -> Callable:
        """Rows of each schema go through that schema's function together."""
        own = {p: build(s) for p, s in schemas.items()}

        def run(value: arrow.Array) -> arrow.Array:
            kind = value.field("pcid").to_numpy(zero_copy_only=False) if value.type.num_fields else np.zeros(0)
            parts, order = [], []
            for p in {int(x) for x in kind[value.is_valid().to_numpy(zero_copy_only=False)]}:
                if p not in own:
                    raise PointError(f"no entry in the formats table for pcid = {p}")
                at = np.flatnonzero(value.is_valid().to_numpy(zero_copy_only=False) & (kind == p))
                parts.append(own[p](value.take(arrow.array(at))))
                order.append(at)
            place = np.full(len(value), -1)
            if not parts:
                return arrow.nulls(len(value), arrow.int32() if build is size else arrow.binary())
            order = np.concatenate(order)
            place[order] = np.arange(len(order))
            return arrow.concat_arrays(parts).take(arrow.array(place, mask=place < 0))

        return run

    def rows(value: arrow.Array, columns: list[np.ndarray]) -> arrow.Array:
        flat = np.stack(columns, 1).astype("<f8")
        return arrow.FixedSizeListArray.from_arrays(arrow.array(flat.ravel()), flat.shape[1]).cast(arrow.list_(arrow.float64()))

    def packed(head: bytes, value: arrow.Array, columns: list[np.ndarray]) -> arrow.Array:
        return geometry.pack_doubles(arrow.array([head] * len(value), arrow.binary()), rows(value, columns))

    def scaled(s: Schema, raw: arrow.Array, i: int) -> np.ndarray:
        d = s.dims[i]
        x = np.array([r[i].as_py() for r in raw], float) if not len(raw) else pc.list_element(raw, i).to_numpy(zero_copy_only=False)
        x = x * d.scale if d.scale != 1 else x
        return x + d.offset if d.offset != 0 else x

    def point(s: Schema):
        roles = [i for r in "xyzm" if (i := s.role(r)) is not None]
        return lambda value: packed(geometry.point_head(s), value, [scaled(s, value.field("raw"), i) for i in roles])

    def box(s: Schema):
        b = lambda value, f: value.field("bounds").field(f).to_numpy(zero_copy_only=False)
        corners = (("xmin", "ymin"), ("xmin", "ymax"), ("xmax", "ymax"), ("xmax", "ymin"), ("xmin", "ymin"))
        return lambda value: packed(geometry.envelope_head(s), value, [b(value, f) for c in corners for f in c])

    def line(s: Schema):
        roles = [i for r in "xyzm" if (i := s.role(r)) is not None]
        return lambda value: packed(geometry.diagonal_head(s), value, [scaled(s, value.field("stats").field(e), i) for e in ("min", "max") for i in roles])

    def size(s: Schema):
        return lambda value: arrow.array([codec.patch_size(s, x["compression"] or 0, x["dims"], x["codecs"]) for x in value.to_pylist()], arrow.int32())

    made = {"PC_AsBinary": ("binary", point), "PC_MemSize": ("int", size)}
    made |= dict.fromkeys(("PC_Envelope", "PC_EnvelopeAsBinary", "PC_EnvelopeGeometry"), ("binary", box))
    made |= dict.fromkeys(("PC_BoundingDiagonalAsBinary", "PC_BoundingDiagonalGeometry"), ("binary", line))
    return {name: (result, over(build)) for name, (result, build) in made.items()}


def register_sql(spark: SparkSession, registry: Registry, pcids: list[int] | None = None) -> None:
    """Make the SQL functions of a registry known to a session. All but those that make bytes are expressions that Catalyst
    inlines; PC_Explode is a table function: ``SELECT e.pt FROM t, LATERAL PC_Explode(t.pa) AS e`` (its argument is a column)."""
    ship(spark)
    for name, (parameters, result, body) in sql_functions(registry, pcids).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {sql_text(body, PATCH_FIELDS)}")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION PC_Explode(pa {PATCH}) RETURNS TABLE (ordinal INT, pt {POINT}) RETURN "
        "SELECT n + 1, named_struct('pcid', pa.pcid, 'raw', transform(pa.dims, d -> get(d, n))) FROM explode(CASE WHEN pa.npoints > 0 THEN sequence(0, pa.npoints - 1) END) AS t(n)"
    )
    for name, (result, f) in _binary_functions(registry, pcids or registry.pcids()).items():
        f.__annotations__ = {"value": arrow.Array, "return": arrow.Array}
        spark.udf.register(name, F.arrow_udf(f, result))
