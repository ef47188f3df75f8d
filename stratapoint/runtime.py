"""Session-level helpers: shipping the package to executors and scratch tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_stratapoint_shipped"
#: Rows go to Python workers in batches of at most so many bytes: Spark's default holds tens of megabytes several times over.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, through Spark's own file server; bound Arrow batches by bytes."""
    sc = spark.sparkContext
    if not sc.getConf().contains(_BATCH) and sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(sc, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix="stratapoint-", suffix=".zip")
    os.close(fd)
    atexit.register(Path(path).unlink, missing_ok=True)  # served from here while the application runs
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)


class Scratch:
    """Tables of one operator run, under the folder the cluster names in ``spark.checkpoint.dir``.

    Writing a table cuts lineage: its files are committed by Spark's output protocol and outlive any executor. Where the
    folder is not named, a local master gets a temporary one; any other is refused, as its machines share no such folder.
    """

    #: The folders of this process's runs that may still hold tables, in order.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="stratapoint-scratch-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.dir = f"{base.rstrip('/')}/stratapoint-{uuid.uuid4().hex}"
        self.names: list[str] = []
        Scratch.made.append(self)

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read from its files."""
        df.write.parquet(self.path(name))
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def only(self, *names: str) -> None:
        """Delete the tables but these: the operator's result reads no others."""
        for name in [x for x in self.names if x not in names]:
            self._delete(self.path(name))
            self.names.remove(name)

    def drop(self) -> None:
        """Delete all tables, when nothing reads the operator's result any more."""
        self._delete(self.dir)
        if self in Scratch.made:
            Scratch.made.remove(self)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
