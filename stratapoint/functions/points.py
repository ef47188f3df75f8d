"""Functions on points: struct(pcid int, raw array<double>), raw holding the stored numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratapoint.functions.quant import fmt_g, quantise, value_of
from stratapoint.schema import Schema

POINT = "struct<pcid:int,raw:array<double>>"


def point(pcid: Column, raw: Column) -> Column:
    return F.struct(pcid.cast("int").alias("pcid"), raw.cast("array<double>").alias("raw"))


def make_point(schema: Schema, vals: Column) -> Column:
    """vals: array<double>, one value a dimension; null gives null, a null value or another length is an error."""
    stored = F.array(*[quantise(F.get(vals, F.lit(i)), d) for i, d in enumerate(schema.dims)])
    wrong = F.raise_error(F.concat(F.lit(f"number of values does not match the {schema.ndims} dimensions of pcid {schema.pcid}: "), F.size(vals).cast("string")))
    nulls = F.raise_error(F.lit("a value of a point is null"))
    made = F.when(F.size(vals) != schema.ndims, wrong.cast(POINT)).when(F.exists(vals, F.isnull), nulls.cast(POINT)).otherwise(point(F.lit(schema.pcid), stored))
    return F.when(vals.isNotNull(), made)


def from_columns(schema: Schema, *columns: Column) -> Column:
    """A point of one column a dimension: the same as make_point without an array on the way."""
    stored = F.array(*[quantise(c, d) for c, d in zip(columns, schema.dims, strict=True)])
    return point(F.lit(schema.pcid), stored)


def get(pt: Column, schema: Schema, name: str) -> Column:
    """A value by name, as a double; the name is looked up when the query is built."""
    i = schema.index(name)
    return value_of(pt["raw"][i], schema.dims[i])


def get_decimal(pt: Column, schema: Schema, name: str, scale: int = 6) -> Column:
    """A value by name as a decimal of its 15 significant digits, so that sums are exact."""
    return F.format_string("%.14e", get(pt, schema, name)).cast("double").cast(f"decimal(38,{scale})")


def get_all(pt: Column, schema: Schema) -> Column:
    return F.when(pt.isNotNull(), F.array(*[value_of(pt["raw"][i], d) for i, d in enumerate(schema.dims)]))


def get_role(pt: Column, schema: Schema, role: str) -> Column:
    """x, y, z or m; null if the schema has no such dimension."""
    i = schema.role(role)
    return F.lit(None).cast("double") if i is None else value_of(pt["raw"][i], schema.dims[i])


def with_value(pt: Column, schema: Schema, name: str, value: Column) -> Column:
    i = schema.index(name)
    stored = quantise(value, schema.dims[i])
    return F.when(pt.isNotNull(), point(pt["pcid"], F.transform(pt["raw"], lambda v, j: F.when(j == i, stored).otherwise(v))))


def pcid(pt: Column) -> Column:
    return pt["pcid"]


def memsize(pt: Column, schema: Schema) -> Column:
    """Bytes of the serialised form: 11 bytes of header and the packed values."""
    return F.when(pt.isNotNull(), F.lit(11 + schema.size))


def values_text(values: Column) -> Column:
    """An array of values as the inside of a JSON array."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, fmt_g), ","), F.lit("]"))


def as_text(pt: Column, schema: Schema) -> Column:
    return F.concat(F.lit('{"pcid":'), pt["pcid"].cast("string"), F.lit(',"pt":'), values_text(get_all(pt, schema)), F.lit("}"))


def with_typmod(value: Column, kind: str, typmod_pcid: int, type_: str) -> Column:
    """The cast to a column pinned to one pcid: another pcid is an error."""
    text = F.concat(F.lit(f"{kind} pcid ("), value["pcid"].cast("string"), F.lit(f") does not match column pcid ({typmod_pcid})"))
    return F.when(value["pcid"] != typmod_pcid, F.raise_error(text).cast(type_)).otherwise(value)
