"""Dimension schemas: how a point's stored numbers are typed, scaled and named, and the registry of schemas by pcid."""

from __future__ import annotations

import json
import re
import warnings
import xml.etree.ElementTree as ET
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stratapoint.errors import PointError

#: Storage types: name, bytes, numpy type, Spark type of an exploded column (fixed values).
INTERPRETATIONS = {
    "int8_t": (1, "i1", T.ByteType()),
    "uint8_t": (1, "u1", T.ShortType()),
    "int16_t": (2, "i2", T.ShortType()),
    "uint16_t": (2, "u2", T.IntegerType()),
    "int32_t": (4, "i4", T.IntegerType()),
    "uint32_t": (4, "u4", T.LongType()),
    "int64_t": (8, "i8", T.LongType()),
    "uint64_t": (8, "u8", T.DecimalType(20, 0)),
    "double": (8, "f8", T.DoubleType()),
    "float": (4, "f4", T.FloatType()),
}
#: Compression schemes by number (fixed values).
COMPRESSIONS = ("none", "dimensional", "laz")
#: Names that give a dimension a role, lower-cased (fixed values).
ROLES = {"x": ("x", "longitude", "lon"), "y": ("y", "latitude", "lat"), "z": ("z", "height", "h"), "m": ("m", "t", "time", "gpstime")}
MAX_PCID = 65535


def interpretation(name: str) -> str:
    """The storage type a loose name stands for: its first letter and one digit decide."""
    low = name.lower()
    digits = {"8": "8", "1": "16", "3": "32", "6": "64"}
    if low[:1] == "d":
        return "double"
    if low[:1] == "f":
        return "float"
    at = {"i": 3, "u": 4}.get(low[:1])
    if at is not None and (bits := digits.get(low[at : at + 1])):
        return f"{'u' if low[0] == 'u' else ''}int{bits}_t"
    return "unknown"


@dataclass(frozen=True)
class Dimension:
    name: str
    position: int
    interpretation: str
    scale: float = 1.0
    offset: float = 0.0
    description: str = ""
    active: int = 1
    byteoffset: int = 0

    @property
    def size(self) -> int:
        return INTERPRETATIONS[self.interpretation][0] if self.interpretation in INTERPRETATIONS else 0

    @property
    def dtype(self) -> str:
        return INTERPRETATIONS[self.interpretation][1]

    @property
    def is_integer(self) -> bool:
        return self.interpretation not in ("double", "float")

    @property
    def limits(self) -> tuple[float, float]:
        info = np.iinfo(self.dtype)
        return float(info.min), float(info.max)


@dataclass(frozen=True)
class Schema:
    dims: tuple[Dimension, ...]
    pcid: int = 0
    srid: int = 0
    compression: int = 0
    complete: bool = True

    @staticmethod
    def of(dims: list[Dimension], pcid: int = 0, srid: int = 0, compression: str | int = 0) -> Schema:
        at, out = 0, []
        for i, d in enumerate(dims):
            out.append(replace(d, position=i, byteoffset=at))
            at += d.size
        number = COMPRESSIONS.index(compression) if isinstance(compression, str) else compression
        return Schema(tuple(out), pcid, srid, number)

    @property
    def ndims(self) -> int:
        return len(self.dims)

    @cached_property
    def size(self) -> int:
        """Bytes of a point."""
        return sum(d.size for d in self.dims)

    @cached_property
    def _by_name(self) -> dict[str, int]:
        return {d.name.lower(): i for i, d in enumerate(self.dims) if d.name}  # of equal names the last one counts

    def find(self, name: str) -> int | None:
        return self._by_name.get(name.lower())

    def index(self, name: str, what: str = 'dimension "{}" does not exist in schema') -> int:
        if (i := self.find(name)) is None:
            raise PointError(what.format(name))
        return i

    def role(self, role: str) -> int | None:
        """The last dimension with a name of this role (x, y, z or m)."""
        found = [i for i, d in enumerate(self.dims) if d.name.lower() in ROLES[role]]
        return found[-1] if found else None

    @property
    def is_valid(self) -> bool:
        return self.complete and self.ndims > 0 and self.role("x") is not None and self.role("y") is not None and all(d.size for d in self.dims)

    @property
    def row_dtype(self) -> np.dtype:
        return np.dtype({"names": [str(i) for i in range(self.ndims)], "formats": ["<" + d.dtype for d in self.dims], "offsets": [d.byteoffset for d in self.dims], "itemsize": self.size})

    def same_dimensions(self, other: Schema) -> bool:
        """Same number of dimensions, names (case aside) and storage types, in order."""
        return self.ndims == other.ndims and all(a.name.lower() == b.name.lower() and a.interpretation == b.interpretation for a, b in zip(self.dims, other.dims, strict=True))

    def same_interpretations(self, other: Schema) -> bool:
        """Dimensions that both schemas have by name are stored alike."""
        return all((j := other.find(d.name)) is None or other.dims[j].interpretation == d.interpretation for d in self.dims if d.name)

    def to_json(self) -> str:
        dims = [{"name": d.name, "description": d.description, "position": d.position, "size": d.size, "byteoffset": d.byteoffset, "interpretation": d.interpretation, "scale": d.scale, "offset": d.offset, "active": d.active} for d in self.dims]
        return json.dumps({"pcid": self.pcid, "srid": self.srid, "compression": self.compression, "dims": dims})

    def struct(self) -> T.StructType:
        """The exploded form: one column a dimension, its metadata telling schema and scaling."""
        return T.StructType([T.StructField(d.name or f"dim{i}", INTERPRETATIONS[d.interpretation][2], True, {"pcid": self.pcid, "scale": d.scale, "offset": d.offset}) for i, d in enumerate(self.dims)])


def _number(text: str, default: float = 0.0) -> float:
    m = re.match(r"\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?", text)
    return float(m[0]) if m else default


def parse_schema(xml: str, pcid: int = 0, srid: int = 0) -> Schema | None:
    """The schema an XML document declares; None if it is no such document. It may be invalid: see Schema.is_valid."""
    try:
        root = ET.fromstring(xml[xml.index("<") :])
    except (ValueError, ET.ParseError):
        return None
    space, _, local = root.tag.rpartition("}")
    if local != "PointCloudSchema" or not space:
        return None
    space += "}"
    nodes = root.findall(f"{space}dimension")
    placed: dict[int, Dimension] = {}
    complete = True
    for node in nodes:
        fields: dict[str, str] = {}
        for child in node:
            name = child.tag.rpartition("}")[2] if isinstance(child.tag, str) else ""
            if name in ("name", "description", "size", "active", "position", "interpretation", "scale", "offset"):
                fields[name] = child.text or ""
            elif name not in ("uuid", "parent_uuid", ""):
                warnings.warn(f"unhandled schema type element {name!r} encountered", stacklevel=2)
        at = int(_number(fields.get("position", "0"))) - 1
        if not 0 <= at < len(nodes) or at in placed:
            warnings.warn(f"schema dimension at position {at + 1} is out of range or declared twice", stacklevel=2)
            complete = False
            break
        placed[at] = Dimension(
            fields.get("name", ""), at, interpretation(fields.get("interpretation", "")), _number(fields["scale"]) if "scale" in fields else 1.0,
            _number(fields.get("offset", "0")), fields.get("description", ""), int(_number(fields.get("active", "0"))),
        )
    kind = [m.text or "" for m in root.findall(f"{space}metadata/Metadata") if m.get("name") == "compression"]
    number = COMPRESSIONS.index(kind[0].strip().lower()) if kind and kind[0].strip().lower() in COMPRESSIONS else 0
    out = Schema.of([placed[i] for i in sorted(placed)], pcid, srid, number)
    return replace(out, complete=complete and len(placed) == len(nodes))


def schema_is_valid(xml: str | None) -> bool | None:
    if xml is None:
        return None
    found = parse_schema(xml)
    return found is not None and found.is_valid


def to_xml(schema: Schema) -> str:
    """An XML document that parse_schema reads back."""
    space = "urn:stratapoint:schema"
    root = ET.Element("pc:PointCloudSchema", {"xmlns:pc": space})
    for d in schema.dims:
        node = ET.SubElement(root, "pc:dimension")
        for tag, value in (("position", d.position + 1), ("size", d.size), ("description", d.description), ("name", d.name), ("interpretation", d.interpretation), ("scale", repr(d.scale)), ("offset", repr(d.offset)), ("active", d.active)):
            ET.SubElement(node, f"pc:{tag}").text = str(value)
    ET.SubElement(ET.SubElement(root, "pc:metadata"), "Metadata", {"name": "compression"}).text = COMPRESSIONS[schema.compression]
    return ET.tostring(root, encoding="unicode")


class Registry:
    """The formats table: schemas by pcid. It lives on the driver; plans carry what they need as literals."""

    DDL = "pcid int, srid int, schema string"

    def __init__(self):
        self._rows: dict[int, tuple[int | None, str | None]] = {}
        self._schemas: dict[int, Schema] = {}

    def register(self, pcid: int, srid: int | None, xml: str | Schema | None) -> None:
        """Checks what the table's constraints check: the pcid's range and, unless it is null, the document."""
        if not 0 < pcid <= MAX_PCID:
            raise PointError(f"pcid {pcid} is out of range 1..{MAX_PCID}")
        if pcid in self._rows:
            raise PointError(f"pcid {pcid} is registered already")
        text = to_xml(xml) if isinstance(xml, Schema) else xml
        if text is not None and not schema_is_valid(text):
            raise PointError(f"invalid schema for pcid {pcid}")
        self._rows[pcid] = (srid, text)

    def __contains__(self, pcid: int) -> bool:
        return pcid in self._rows

    def pcids(self) -> list[int]:
        return sorted(self._rows)

    def get(self, pcid: int) -> Schema:
        if pcid not in self._schemas:
            if pcid not in self._rows:
                raise PointError(f"no entry in the formats table for pcid = {pcid}")
            srid, xml = self._rows[pcid]
            if srid is None or xml is None:
                raise PointError(f"srid or schema is null for pcid = {pcid}")
            self._schemas[pcid] = parse_schema(xml, pcid, srid)
        return self._schemas[pcid]

    def ndims(self, pcid: int) -> int:
        return self.get(pcid).ndims

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, *self._rows[p]) for p in self.pcids()], self.DDL)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Registry:
        out = cls()
        for r in spark.read.schema(cls.DDL).parquet(path).collect():  # at most 65,535 rows
            out.register(r.pcid, r.srid, r.schema)
        return out
