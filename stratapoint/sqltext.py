"""Columns as SQL text, so that one definition of a function serves DataFrames and temporary SQL functions.

Covers what the functions of this package are made of: literals, attributes, extraction, function calls and operators,
casts, CASE, lambdas, aliases within struct() and replaced struct fields.
"""

from __future__ import annotations

import math

from pyspark.sql import Column

_INFIX = {"+", "-", "*", "/", "%", "=", "<", ">", "<=", ">=", "<=>", "and", "or", "&", "|", "^"}
_PREFIX = {"!": "NOT ", "not": "NOT ", "negative": "- "}


def sql_text(c: Column, fields: tuple[str, ...] = ()) -> str:
    """fields: those of the only struct type whose fields are replaced."""
    return _Text(fields).of(c._jc.node())


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


class _Text:
    def __init__(self, fields: tuple[str, ...]):
        self.fields = fields

    def of(self, n) -> str:
        kind = n.getClass().getSimpleName()
        make = getattr(self, f"_{kind}", None)
        if make is None:
            raise NotImplementedError(f"no SQL text for {kind}: {n.sql()}")
        return make(n)

    def _Literal(self, n) -> str:
        v = n.value()
        if isinstance(v, bool) or v is None:
            return n.sql()
        if isinstance(v, float):
            return f"{v!r}D" if math.isfinite(v) else f"CAST('{v}' AS DOUBLE)"
        if isinstance(v, bytes | bytearray):
            return f"X'{bytes(v).hex()}'"
        return _quoted(v) if isinstance(v, str) else n.sql()

    def _UnresolvedAttribute(self, n) -> str:
        return ".".join(f"`{p}`" for p in _seq(n.nameParts()))

    def _UnresolvedNamedLambdaVariable(self, n) -> str:
        return n.name()

    def _UnresolvedExtractValue(self, n) -> str:
        return f"{self.of(n.child())}[{self.of(n.extraction())}]"

    def _UnresolvedFunction(self, n) -> str:
        name, args = n.functionName(), [self.of(a) for a in _seq(n.arguments())]
        if name.lower() in _INFIX and len(args) == 2:
            return f"({args[0]} {name} {args[1]})"
        if name.lower() in _PREFIX and len(args) == 1:
            return f"({_PREFIX[name.lower()]}{args[0]})"
        return f"{name}({', '.join(args)})"

    def _Cast(self, n) -> str:
        return f"CAST({self.of(n.child())} AS {n.dataType().sql()})"

    def _CaseWhenOtherwise(self, n) -> str:
        when = " ".join(f"WHEN {self.of(b._1())} THEN {self.of(b._2())}" for b in _seq(n.branches()))
        rest = n.otherwise()
        return f"(CASE {when}{'' if rest.isEmpty() else ' ELSE ' + self.of(rest.get())} END)"

    def _LambdaFunction(self, n) -> str:
        names = [x.name() for x in _seq(n.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {self.of(n.function())}"

    def _Alias(self, n) -> str:
        return f"{self.of(n.child())} AS {', '.join(f'`{x}`' for x in _seq(n.name()))}"

    def _SqlExpression(self, n) -> str:
        return f"({n.expression()})"

    def _UpdateFields(self, n) -> str:
        new: dict[str, str] = {}
        while n.getClass().getSimpleName() == "UpdateFields":
            new.setdefault(n.fieldName(), self.of(n.valueExpression().get()))
            n = n.structExpression()
        base = self.of(n)
        return f"struct({', '.join((new.get(f) or f'{base}.{f}') + f' AS {f}' for f in self.fields)})"
