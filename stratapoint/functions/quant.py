"""Values and stored numbers, and the text of a number, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratapoint.schema import Dimension


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def half_away(x: Column) -> Column:
    """The nearest integer as a double, halves away from zero; rint is exact, and only its ties differ."""
    r = F.rint(x)
    return F.when(F.abs(x - r) == 0.5, x + F.signum(x) * 0.5).otherwise(r)


def quantise(value: Column, d: Dimension) -> Column:
    """The stored number of a value: unscaled, clamped to the type, rounded half away from zero."""
    x = value.cast("double")
    if d.offset != 0:
        x = x - F.lit(d.offset)
    if d.scale != 1:
        x = x / F.lit(d.scale)
    if d.interpretation == "double":
        return x
    if d.interpretation == "float":
        return x.cast("float").cast("double")
    low, high = d.limits
    return half_away(F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def value_of(stored: Column, d: Dimension) -> Column:
    x = stored
    if d.scale != 1:
        x = x * F.lit(d.scale)
    if d.offset != 0:
        x = x + F.lit(d.offset)
    return x


def fmt_g(value: Column) -> Column:
    """A double as C's %g writes it: six digits, trailing zeros gone, an exponent below -4 and from 6 on."""

    def digits(s: Column) -> Column:
        exp = F.substring_index(s, "E", -1).cast("int")
        sign = F.when(F.startswith(s, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
        six = F.translate(F.substring_index(s, "E", 1), "-.", "")
        trim = lambda x: F.rtrim(F.rtrim(x, F.lit("0")), F.lit("."))  # noqa: E731  x has a point
        mantissa = trim(F.concat(F.substring(six, 1, 1), F.lit("."), F.substring(six, 2, 5)))
        tail = F.concat(F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(exp).cast("string"), 2, "0"))
        wide = F.when(F.abs(exp) > 99, F.concat(F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")), F.abs(exp).cast("string"))).otherwise(tail)
        fixed = F.when(exp < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), six)).otherwise(F.concat(F.substring(six, F.lit(1), exp + 1), F.lit("."), F.substring(six, exp + 2, F.lit(6))))
        return F.concat(sign, F.when((exp < -4) | (exp >= 6), F.concat(mantissa, wide)).otherwise(trim(fixed)))

    special = F.when(F.isnan(value), F.lit("nan")).when(value == float("inf"), F.lit("inf")).when(value == float("-inf"), F.lit("-inf"))
    # Not format_string: it rounds the shortest decimal form of a double, C its exact value.
    return special.otherwise(let(F.call_function("format_number", value, F.lit("0.00000E0")), digits))
