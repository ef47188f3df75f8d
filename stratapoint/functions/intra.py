"""Relational algebra inside a patch: filters, slices, order, other schemas. All are expressions; null in, null out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratapoint.errors import PointError
from stratapoint.functions.patches import PATCH, assemble, from_dims
from stratapoint.functions.quant import let, quantise, value_of
from stratapoint.schema import COMPRESSIONS, Dimension, Schema

_MISSING = 'dimension "{}" does not exist'


def _indexes(pa: Column) -> Column:
    return F.sequence(F.lit(0), pa["npoints"] - 1)


def _pick(pa: Column, schema: Schema, at: Column) -> Column:
    """The points at these places, in this order."""
    dims = let(at, lambda own: F.array(*[F.transform(own, lambda j: F.get(pa["dims"][i], j)) for i in range(schema.ndims)]))
    return F.when(pa.isNotNull(), from_dims(schema, dims, F.lit(schema.compression)))


def _where(pa: Column, schema: Schema, name: str, keep: Callable[[Column], Column], may: Callable[[Column, Column], Column]) -> Column:
    i = schema.index(name, _MISSING)
    d = schema.dims[i]

    def test(j: Column) -> Column:
        v = value_of(F.get(pa["dims"][i], j), d)
        return keep(v) if d.is_integer else keep(v) & ~F.isnan(v)

    # What the statistics rule out is never decoded.
    possible = may(value_of(pa["stats"]["min"][i], d), value_of(pa["stats"]["max"][i], d))
    return F.when(possible, _pick(pa, schema, F.filter(_indexes(pa), test)))


def filter_less_than(pa: Column, schema: Schema, name: str, v: float) -> Column:
    return _where(pa, schema, name, lambda x: x < v, lambda low, high: low < v)


def filter_greater_than(pa: Column, schema: Schema, name: str, v: float) -> Column:
    return _where(pa, schema, name, lambda x: x > v, lambda low, high: high > v)


def filter_equals(pa: Column, schema: Schema, name: str, v: float) -> Column:
    return _where(pa, schema, name, lambda x: x == v, lambda low, high: (low <= v) & (high >= v))


def filter_between(pa: Column, schema: Schema, name: str, v1: float, v2: float) -> Column:
    """Points strictly between the two values, whichever is larger."""
    lo, hi = min(v1, v2), max(v1, v2)
    return _where(pa, schema, name, lambda x: (x > lo) & (x < hi), lambda low, high: (low < hi) & (high > lo))


def filter_points(pa: Column, schema: Schema, keep: Callable[[Callable[[str], Column]], Column], stored: bool = False) -> Column:
    """Points for which keep(value) holds, value(name) being a point's value by name, or its stored number."""

    def test(j: Column) -> Column:
        def value(name: str) -> Column:
            i = schema.index(name, _MISSING)
            v = F.get(pa["dims"][i], j)
            return v if stored else value_of(v, schema.dims[i])

        return keep(value)

    return F.when(pa.isNotNull(), _pick(pa, schema, F.filter(_indexes(pa), test)))


def range_(pa: Column, schema: Schema, first: Column | int, count: Column | int) -> Column:
    """count points from place first (1 is the first); fewer at the end, null if there are none."""
    first = F.lit(first) if isinstance(first, int) else first
    count = F.lit(count) if isinstance(count, int) else count
    ok = (first >= 1) & (count > 0) & (first <= pa["npoints"])
    dims = F.transform(pa["dims"], lambda c: F.slice(c, F.greatest(first, F.lit(1)), F.greatest(count, F.lit(0))))
    return F.when(ok, F.when((first == 1) & (count >= pa["npoints"]), pa.cast(PATCH)).otherwise(from_dims(schema, dims, F.lit(schema.compression))))


def _keys(schema: Schema, names: list[str | None]) -> list[int]:
    return [schema.index(n, _MISSING) for n in names if n is not None]


def sort(pa: Column, schema: Schema, names: list[str | None]) -> Column:
    """Points in ascending order of stored numbers; equal ones stay in their order."""
    keys = _keys(schema, names)
    if not keys:
        return pa
    rows = F.transform(_indexes(pa), lambda j: F.struct(*[F.get(pa["dims"][k], j).alias(f"k{n}") for n, k in enumerate(keys)], j.alias("j")))
    at = F.transform(F.array_sort(rows), lambda r: r["j"])
    dims = let(at, lambda own: F.array(*[F.transform(own, lambda j: F.get(pa["dims"][i], j)) for i in range(schema.ndims)]))
    return F.when(pa.isNotNull(), pa.withField("dims", dims).withField("compression", F.lit(schema.compression)).withField("codecs", F.lit(None).cast("array<int>")))


def is_sorted(pa: Column, schema: Schema, names: list[str | None], strict: bool = False) -> Column:
    """Whether neighbours are in order. As in the original interface, strict=True is the one that accepts equal neighbours."""
    keys = _keys(schema, names)
    if not keys:
        return F.when(pa.isNotNull(), F.lit(True))
    at = lambda j: F.struct(*[F.get(pa["dims"][k], j).alias(f"k{n}") for n, k in enumerate(keys)])
    later = F.when(pa["npoints"] > 1, F.sequence(F.lit(1), pa["npoints"] - 1)).otherwise(F.array().cast("array<int>"))
    return F.forall(later, lambda j: at(j - 1) <= at(j) if strict else at(j - 1) < at(j))


def is_sorted_documented(pa: Column, schema: Schema, names: list[str | None], strict: bool = True) -> Column:
    """The plain meaning of the word: strict refuses equal neighbours."""
    return is_sorted(pa, schema, names, not strict)


def _default(default: Column | float, d: Dimension) -> Column:
    return quantise(default if isinstance(default, Column) else F.lit(float(default)), d)


def set_pcid(pa: Column, old: Schema, new: Schema, default: Column | float = 0.0) -> Column:
    """The stored numbers under another schema, matched by name; dimensions only the new one has get the default."""
    if old.same_dimensions(new):
        low, high, mean = (pa["stats"][s] for s in ("min", "max", "avg"))
        n = range(new.ndims)
        out = assemble(new, pa["npoints"], [low[i] for i in n], [high[i] for i in n], [mean[i] for i in n], pa["dims"])
        return F.when(pa.isNotNull(), out)
    if not old.same_interpretations(new):
        raise PointError("dimension interpretations are not matching")
    dims, low, high, mean = [], [], [], []
    for d in new.dims:
        j = old.find(d.name) if d.name else None
        fill = _default(default, d)
        dims.append(pa["dims"][j] if j is not None else F.array_repeat(fill, pa["npoints"]))
        for out, s in ((low, "min"), (high, "max"), (mean, "avg")):
            out.append(pa["stats"][s][j] if j is not None else fill)
    return F.when(pa.isNotNull(), assemble(new, pa["npoints"], low, high, mean, F.array(*dims)))


def transform(pa: Column, old: Schema, new: Schema, default: Column | float = 0.0) -> Column:
    """The values under another schema, stored anew; another spatial reference gives null."""
    if old.srid != new.srid:
        import warnings

        warnings.warn("reprojection is not supported: schemas have different srids", stacklevel=2)
        return F.lit(None).cast(PATCH)
    dims = []
    for d in new.dims:
        j = old.find(d.name) if d.name else None
        if j is None:
            dims.append(F.array_repeat(_default(default, d), pa["npoints"]))
        else:
            dims.append(F.transform(pa["dims"][j], lambda v: quantise(value_of(v, old.dims[j]), d)))
    return F.when(pa.isNotNull(), from_dims(new, F.array(*dims)))


#: Codecs of a dimension by number and the prefixes that name them (fixed values).
DIM_CODECS = {"none": 0, "rle": 1, "sigbits": 2, "zlib": 3}
LAZ_REFUSED = "lazperf support is not enabled"


def compress(pa: Column, schema: Schema, scheme: str = "", config: str = "") -> Column:
    """Tag a patch with a compression scheme: the schema's ('' or 'auto'), or dimensional with codecs by dimension."""
    if scheme == "" or scheme.lower() == "auto":
        number, codecs = schema.compression, None
    elif scheme == "dimensional":
        number, codecs = 1, []
        for i, own in enumerate(config.split(",") if config else []):
            if i >= schema.ndims:
                break
            found = [n for name, n in DIM_CODECS.items() if name != "none" and own.startswith(name)]
            if not found and not own.startswith("auto"):
                raise PointError(f"unrecognized dimensional compression '{own}', please use 'auto', 'rle', 'sigbits' or 'zlib'")
            codecs.append(found[0] if found else -1)
        codecs += [-1] * (schema.ndims - len(codecs))
    elif scheme == "laz":
        raise PointError(LAZ_REFUSED)
    else:
        raise PointError(f"unrecognized compression scheme '{scheme}', please specify 'auto', 'dimensional' or 'laz'")
    if number == 2:
        raise PointError(LAZ_REFUSED)
    tag = F.lit(None).cast("array<int>") if codecs is None or set(codecs) == {-1} else F.array(*[F.lit(c) for c in codecs])
    return F.when(pa.isNotNull(), pa.withField("compression", F.lit(number)).withField("codecs", tag))


def uncompress(pa: Column) -> Column:
    return F.when(pa.isNotNull(), pa.withField("compression", F.lit(COMPRESSIONS.index("none"))).withField("codecs", F.lit(None).cast("array<int>")))
