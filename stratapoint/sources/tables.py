"""Patch tables on disk, the catalog of patch columns, and a text format of hex WKB."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from stratapoint.errors import PointError
from stratapoint.functions.geometry import Ring, polygon_box
from stratapoint.functions.points import with_typmod
from stratapoint.operators.spatial import grid_key
from stratapoint.schema import Registry

#: What a pinned column's metadata key is called.
TYPMOD = "pcid"


def typmod_in(args: list[str]) -> int:
    """The pcid that a type modifier such as ('7') names."""
    if len(args) != 1:
        raise PointError("a type modifier takes exactly one element, the pcid")
    try:
        return int(args[0].strip())
    except ValueError:
        raise PointError(f"a type modifier is an integer, not {args[0]!r}") from None


def typmod_out(typmod: int) -> str:
    return f"({typmod})" if typmod > 0 else ""


def typmod_pcid(typmod: int | None) -> int | None:
    """The low 16 bits; None for 0 and for -1, which stands for no modifier."""
    return None if typmod in (None, -1) else (typmod & 0xFFFF) or None


def pin(df: DataFrame, column: str, kind: str, pcid: int) -> DataFrame:
    """Pin a point or patch column to a pcid: its metadata says so, and values of another pcid are an error."""
    type_ = df.schema[column].dataType.simpleString()
    return df.withColumn(column, with_typmod(F.col(column), kind, pcid, type_).alias(column, metadata={TYPMOD: pcid, "kind": kind}))


def write_patches(df: DataFrame, path: str, pa: str = "pa", cell: float | None = None, files: int | None = None, mode: str = "overwrite") -> None:
    """Write a table of patches; with a cell size, neighbours are put together so that boxes prune files and row groups."""
    if cell is not None:
        box = F.col(pa)["bounds"]
        key = grid_key(box["xmin"], box["ymin"], cell)
        out = df.withColumn("__key", key)
        out = out.repartitionByRange(files, "__key") if files else out.repartitionByRange("__key")
        df = out.sortWithinPartitions("__key").drop("__key")
    df.write.mode(mode).parquet(path)


def read_patches(spark: SparkSession, path: str, pa: str = "pa", ring: Ring | None = None, where: Column | str | None = None) -> DataFrame:
    """Read a table of patches; ring and where become conjuncts on leaves that the scan pushes down."""
    df = spark.read.parquet(path)
    if ring is not None:
        xmin, xmax, ymin, ymax = polygon_box(ring)
        b = F.col(pa)["bounds"]
        df = df.where((b["xmin"] <= xmax) & (b["xmax"] >= xmin) & (b["ymin"] <= ymax) & (b["ymax"] >= ymin))
    return df if where is None else df.where(where)


_COLUMNS = "schema string, table string, column string, pcid int, type string"


def columns_view(spark: SparkSession, registry: Registry, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Every point or patch column of the session's tables, with pcid and srid if it is pinned.

    tables: name -> DataFrame, by default all tables and views that the current catalog lists.
    """
    if tables is None:
        tables = {t.name: spark.table(t.name if t.isTemporary else f"`{'`.`'.join([*(t.namespace or []), t.name])}`") for t in spark.catalog.listTables()}
    rows = []
    for name, df in sorted(tables.items()):
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType) and (kind := _kind(f.dataType)):
                rows.append(("default", name, f.name, typmod_pcid(f.metadata.get(TYPMOD)), kind))
    return spark.createDataFrame(rows, _COLUMNS).join(registry.table(spark).select("pcid", "srid"), "pcid", "left").select("schema", "table", "column", "pcid", "srid", "type")


def _kind(t: T.StructType) -> str | None:
    names = tuple(t.fieldNames())
    return {("pcid", "raw"): "pcpoint", ("pcid", "compression", "npoints", "bounds", "stats", "codecs", "dims"): "pcpatch"}.get(names)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Part]:
        import glob
        import os

        files = sorted(glob.glob(os.path.join(self.path, "*.hex"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_Part(f) for f in files]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition is None:
            return
        with open(partition.path) as f:
            for n, line in enumerate(f, 1):
                if line := line.strip():
                    yield partition.path, n, line


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import os
        import uuid

        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f".part-{uuid.uuid4().hex}.tmp")
        with open(name, "w") as f:
            for r in rows:
                f.write(f"{r['wkb']}\n")
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages: list) -> None:
        import glob
        import os

        before = glob.glob(os.path.join(self.path, "*.hex"))
        for m in messages:
            if m is not None:
                head, name = os.path.split(m.name)
                os.rename(m.name, os.path.join(head, name[1:-4] + ".hex"))
        if self.overwrite:  # only when the new files are there
            for old in before:
                os.remove(old)

    def abort(self, messages: list) -> None:
        import contextlib
        import os

        for m in messages:
            if m is not None:
                with contextlib.suppress(OSError):
                    os.remove(m.name)


class HexWkb(DataSource):
    """Format ``hexwkb``: files of one hex WKB a line, on a mounted file system, read as file, line, wkb.

    For object stores and HDFS use ``read_hex`` and ``write_hex``, which go through Spark's own text files.
    """

    @classmethod
    def name(cls) -> str:
        return "hexwkb"

    def schema(self) -> str:
        return "file string, line long, wkb string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def read_hex(spark: SparkSession, path: str) -> DataFrame:
    """Lines of hex WKB from any file system, in column wkb."""
    return spark.read.text(path).select(F.trim("value").alias("wkb")).where("wkb <> ''")


def write_hex(df: DataFrame, path: str, column: str = "wkb", mode: str = "overwrite") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)
