"""From rows to patches and back: the aggregates and the generator.

Every patch build takes an order, since Spark has no order of arrival. Minima, maxima, sums and counts are partial
aggregates next to the gathered points, so that statistics never need a second pass over a patch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapoint.functions.patches import assemble, mean_stored
from stratapoint.functions.points import POINT
from stratapoint.functions.quant import quantise, value_of
from stratapoint.schema import Schema


def _stats(schema: Schema, raw: list[Column]) -> list[Column]:
    out = []
    for i, (c, d) in enumerate(zip(raw, schema.dims, strict=True)):
        known = c if d.is_integer else F.nanvl(c, F.lit(None).cast("double"))
        out += [F.min(known).alias(f"__min{i}"), F.max(known).alias(f"__max{i}"), F.sum(c).alias(f"__sum{i}")]
    return out


def _built(schema: Schema, dims: Column, compression: Column | None = None) -> Column:
    n, all_ = F.col("__n"), range(schema.ndims)
    low, high = [F.col(f"__min{i}") for i in all_], [F.col(f"__max{i}") for i in all_]
    mean = [mean_stored(F.col(f"__sum{i}"), n, d) for i, d in enumerate(schema.dims)]
    return F.when(n > 0, assemble(schema, n, low, high, mean, dims, compression))


def _gather(df: DataFrame, schema: Schema, keys: list[str], order: list[Column], raw: list[Column], ok: Column, name: str) -> DataFrame:
    """One patch a group of the rows where ok holds; groups without any get null."""
    own = df.select(*keys, *[F.when(ok, c).alias(f"__r{i}") for i, c in enumerate(raw)], *[c.alias(f"__o{i}") for i, c in enumerate(order)], ok.alias("__ok"))
    cols = [F.col(f"__r{i}") for i in range(schema.ndims)]
    row = F.struct(*[F.col(f"__o{i}") for i in range(len(order))], *cols)
    grouped = own.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("__ok"), row))).alias("__rows"), F.count_if("__ok").alias("__n"), *_stats(schema, cols))
    dims = F.array(*[F.transform("__rows", lambda r: r[f"__r{i}"]) for i in range(schema.ndims)])
    return grouped.select(*keys, _built(schema, dims).alias(name))


def patchify(df: DataFrame, schema: Schema, values: dict[str, Column] | list[Column], keys: list[str], order: list[Column], name: str = "pa") -> DataFrame:
    """Group rows of values into patches. values: a column for each dimension, by name or in order; order must tell rows apart."""
    cols = [values[d.name] for d in schema.dims] if isinstance(values, dict) else list(values)
    raw = [quantise(c, d) for c, d in zip(cols, schema.dims, strict=True)]
    return _gather(df, schema, keys, order, raw, F.lit(True), name)


def _one_pcid(c: Column, schema: Schema, what: str) -> Column:
    """True for a value of the schema, false for null, an error for another pcid."""
    text = F.concat(F.lit(f"{what} of more than one pcid: "), c["pcid"].cast("string"))
    return F.when(c.isNull(), F.lit(False)).when(c["pcid"] != schema.pcid, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))


def patch_agg(df: DataFrame, schema: Schema, pt: Column, keys: list[str], order: list[Column], name: str = "pa") -> DataFrame:
    """Points of a group as a patch; null points are skipped, a group without points gives null."""
    raw = [pt["raw"][i] for i in range(schema.ndims)]
    return _gather(df, schema, keys, order, raw, _one_pcid(pt, schema, "points"), name)


def array_agg(df: DataFrame, value: Column, keys: list[str], order: list[Column], name: str = "values") -> DataFrame:
    """All values of a group as an array, nulls included; a group without rows gives null."""
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))
    got = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return got.select(*keys, F.when(F.size("rows") > 0, F.transform("rows", lambda r: r["v"])).alias(name))


def union(df: DataFrame, schema: Schema, pa: Column, keys: list[str], order: list[Column], name: str = "pa") -> DataFrame:
    """Patches of a group as one: bounds and statistics merge from the small leaves, the points are concatenated in order."""
    ok = _one_pcid(pa, schema, "patches")
    own = df.select(*keys, *[c.alias(f"__o{i}") for i, c in enumerate(order)], ok.alias("__ok"), F.when(ok, pa).alias("__pa"))
    p = F.col("__pa")
    stats = []
    for i in range(schema.ndims):
        stats += [F.min(p["stats"]["min"][i]).alias(f"__min{i}"), F.max(p["stats"]["max"][i]).alias(f"__max{i}"), F.sum(F.aggregate(p["dims"][i], F.lit(0.0), lambda a, v: a + v)).alias(f"__sum{i}")]
    row = F.struct(*[F.col(f"__o{i}") for i in range(len(order))], p["dims"].alias("dims"))
    got = own.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("__ok"), row))).alias("__rows"), F.sum(p["npoints"]).alias("__n"), *stats)
    dims = F.array(*[F.flatten(F.transform("__rows", lambda r: r["dims"][i])) for i in range(schema.ndims)])
    return got.select(*keys, _built(schema, dims).alias(name))


def explode_points(df: DataFrame, schema: Schema, pa: str | Column, keep: list[str] = (), name: str = "pt") -> DataFrame:
    """One row a point, in stored order: keep columns, ordinal (from 1) and the point; null patches give no rows."""
    p = F.col(pa) if isinstance(pa, str) else pa
    zipped = F.arrays_zip(*[p["dims"][i].alias(f"d{i}") for i in range(schema.ndims)])
    rows = df.select(*keep, p["pcid"].alias("__pcid"), F.posexplode(zipped).alias("__at", "__v"))
    raw = F.array(*[F.col(f"__v.`{f}`") for f in _zip_fields(rows)])
    return rows.select(*keep, (F.col("__at") + 1).alias("ordinal"), F.struct(F.col("__pcid").alias("pcid"), raw.alias("raw")).cast(POINT).alias(name))


def _zip_fields(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema["__v"].dataType.fields]


def explode_columns(df: DataFrame, schema: Schema, pa: str | Column, keep: list[str] = (), values: bool = True) -> DataFrame:
    """One row a point with a column for each dimension: values, or stored numbers in the dimensions' own types."""
    p = F.col(pa) if isinstance(pa, str) else pa
    zipped = F.arrays_zip(*[p["dims"][i].alias(f"d{i}") for i in range(schema.ndims)])
    rows = df.select(*keep, F.posexplode(zipped).alias("__at", "__v"))
    cols = []
    for field, f, d in zip(schema.struct().fields, _zip_fields(rows), schema.dims, strict=True):
        c = F.col(f"__v.`{f}`")
        cols.append((value_of(c, d) if values else c.cast(field.dataType)).alias(field.name, metadata=field.metadata))
    return rows.select(*keep, (F.col("__at") + 1).alias("ordinal"), *cols)
