"""Geometry literals: WKT, WKB and EWKB of points, lines, polygons and their collections, read when a query is built."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

from stratapoint.errors import PointError

XY = tuple[float, float]
Ring = list[XY]

#: Geometry types of WKB by number (fixed values).
TYPES = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


@dataclass
class Shape:
    """The parts of a geometry in the plane; a polygon is its outer ring and its holes."""

    points: list[XY] = field(default_factory=list)
    lines: list[list[XY]] = field(default_factory=list)
    polygons: list[tuple[Ring, list[Ring]]] = field(default_factory=list)

    def box(self) -> tuple[float, float, float, float] | None:
        """xmin, xmax, ymin, ymax; None of an empty geometry."""
        every = [*self.points, *(p for line in self.lines for p in line), *(p for ring, _ in self.polygons for p in ring)]
        if not every:
            return None
        xs, ys = zip(*every, strict=True)
        return min(xs), max(xs), min(ys), max(ys)

    def map(self, f: Callable[[XY], XY]) -> Shape:
        """The same parts with every corner replaced."""
        path = lambda ps: [f(p) for p in ps]
        return Shape(path(self.points), [path(line) for line in self.lines], [(path(ring), [path(h) for h in holes]) for ring, holes in self.polygons])

    def segments(self) -> list[tuple[XY, XY]]:
        """All segments of lines and borders."""
        rings = [r if r[0] == r[-1] else [*r, r[0]] for ring, holes in self.polygons for r in (ring, *holes)]
        return [s for path in (*self.lines, *rings) for s in zip(path, path[1:], strict=False)]


def shape(value: Shape | str | bytes | list) -> Shape:
    """A geometry from WKT or EWKT text, hex or binary (E)WKB, or the corners of one ring."""
    if isinstance(value, Shape):
        return value
    out = Shape()
    if isinstance(value, list):
        if len(value) < 3:
            raise PointError("a polygon takes at least three corners")
        out.polygons.append(([tuple(p) for p in value], []))
    elif isinstance(value, bytes | bytearray):
        _binary(bytes(value), 0, out)
    elif re.fullmatch(r"\s*[0-9A-Fa-f]+\s*", value):
        _binary(bytes.fromhex(value.strip()), 0, out)
    else:
        _text(value, out)
    return out


def _add(out: Shape, kind: str, parts) -> None:
    if kind == "POINT":
        out.points += parts
    elif kind == "LINESTRING":
        out.lines += [parts] if parts else []
    elif parts:
        if any(len(r) < 4 for r in parts):
            raise PointError("a polygon takes at least three corners")
        out.polygons.append((parts[0], parts[1:]))


def _text(text: str, out: Shape) -> None:
    tokens = re.findall(r"[A-Za-z]+|[(),]|[-+0-9.][-+0-9.eE]*|\S", re.sub(r"^\s*SRID=\d+;", "", text))
    at = 0

    def take(want: str | None = None) -> str:
        nonlocal at
        token = tokens[at] if at < len(tokens) else ""
        if want is not None and token != want:
            raise PointError(f"invalid geometry text: expected {want!r}, found {token!r}")
        at += 1
        return token

    def listed(item) -> list:
        if at < len(tokens) and tokens[at].upper() == "EMPTY":
            take()
            return []
        take("(")
        out_ = [item()]
        while tokens[at : at + 1] == [","]:
            take()
            out_.append(item())
        take(")")
        return out_

    def position() -> XY:
        numbers = []
        while at < len(tokens) and re.match(r"[-+0-9.]", tokens[at]):
            numbers.append(float(take()))
        if len(numbers) < 2:
            raise PointError("invalid geometry text: a position has two numbers at least")
        return numbers[0], numbers[1]

    def path() -> list[XY]:
        return listed(position)

    def one() -> None:
        kind = take().upper()
        if tokens[at : at + 1] and tokens[at].upper() in ("Z", "M", "ZM"):
            take()
        if kind in ("POINT", "LINESTRING"):
            _add(out, kind, path())
        elif kind == "POLYGON":
            _add(out, kind, listed(path))
        elif kind == "MULTIPOINT":
            for p in listed(lambda: path() if tokens[at] == "(" else [position()]):
                _add(out, "POINT", p)
        elif kind == "MULTILINESTRING":
            for p in listed(path):
                _add(out, "LINESTRING", p)
        elif kind == "MULTIPOLYGON":
            for p in listed(lambda: listed(path)):
                _add(out, "POLYGON", p)
        elif kind == "GEOMETRYCOLLECTION":
            listed(one)
        else:
            raise PointError(f"unknown geometry type {kind!r}")

    one()
    if at != len(tokens):
        raise PointError(f"invalid geometry text after {' '.join(tokens[:at])!r}")


def _binary(data: bytes, at: int, out: Shape) -> int:
    try:
        order = "<" if data[at] == 1 else ">"
        (flags,) = struct.unpack_from(f"{order}I", data, at + 1)
        at += 9 if flags & 0x20000000 else 5
        number = flags & 0xFFFF
        dims = 2 + bool(flags & 0x80000000) + bool(flags & 0x40000000) + (number // 1000 in (1, 2)) + 2 * (number // 1000 == 3)
        kind = TYPES.get(number % 1000)

        def count() -> int:
            nonlocal at
            at += 4
            return struct.unpack_from(f"{order}I", data, at - 4)[0]

        def positions(n: int) -> list[XY]:
            nonlocal at
            got = [struct.unpack_from(f"{order}2d", data, at + 8 * dims * i) for i in range(n)]
            at += 8 * dims * n
            return got

        if kind == "POINT":
            _add(out, kind, [p for p in positions(1) if p == p and p[0] == p[0]])  # an empty point has NaN for numbers
        elif kind == "LINESTRING":
            _add(out, kind, positions(count()))
        elif kind == "POLYGON":
            _add(out, kind, [positions(count()) for _ in range(count())])
        elif kind is not None:
            for _ in range(count()):
                at = _binary(data, at, out)
        else:
            raise PointError(f"unknown geometry type {number}")
    except (IndexError, struct.error):
        raise PointError("geometry binary is too short") from None
    return at
