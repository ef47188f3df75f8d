"""Token ids as length-delimited binary records, with a separate offset index.

A record is one document: u64 length, u32 masked checksum of the length, payload, u32 masked checksum of the payload, one
line feed (all little-endian). The payload is a byte (bytes per id, plus 128 if doc_id is null), doc_id as i64 and the ids
with the end id, 2 bytes each if the vocabulary allows it, else 4. The checksum is CRC-32 (zlib), masked by a rotation
and an added constant, as usual for framed records, so that a checksum of data that holds checksums stays useful.

The files are written by Spark's own text sink, whose line separator is the record's last byte; so they are committed
like any other Spark output, on any file system, and a lost executor costs a task. A row is a block of at most
``BLOCK_BYTES`` (or one record), a file at most ``BLOCKS_PER_FILE`` rows. Files in the order of their names hold the
documents in ascending doc_id (null first; rows that repeat an id stand together in the order of a hash of their text).

A very long text is one record, and a block of its own if need be. Null text counts as empty: the end id alone. An empty table gives no records. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapoint.llm.tokens import END, encoder
from stratapoint.runtime import Scratch, ship

BLOCK_BYTES = 8 << 20
BLOCKS_PER_FILE = 8
_HEAD, _PAYLOAD = struct.Struct("<QI"), struct.Struct("<Bq")
_FRAME = _HEAD.size + 5


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """ids: little-endian unsigned 32-bit integers."""
    body = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    payload = _PAYLOAD.pack(width | (128 if doc_id is None else 0), doc_id or 0) + body
    size = len(payload).to_bytes(8, "little")
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload)) + b"\n"


def records(content: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """Offset, length with the frame, doc_id and ids of each record; raises if a checksum is wrong."""
    at = 0
    while at < len(content):
        doc_id, ids, size = record(content, at)
        yield at, size, doc_id, ids
        at += size


def record(content: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """The record at an offset: doc_id, ids, length with the frame."""
    size, check = _HEAD.unpack_from(content, at)
    payload = content[at + _HEAD.size : at + _HEAD.size + size]
    end = at + _HEAD.size + size
    if check != masked(content[at : at + 8]) or len(payload) != size or struct.unpack_from("<I", content, end)[0] != masked(payload):
        raise ValueError(f"corrupt record at byte {at}")
    kind, doc_id = _PAYLOAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u2" if kind & 127 == 2 else "<u4", offset=_PAYLOAD.size)
    return None if kind & 128 else doc_id, ids, size + _FRAME


def _blocks(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 2 if enc.vocabulary <= 1 << 16 else 4
        held: list[bytes] = []
        size = 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["block"])  # noqa: E731  Spark adds the last line feed
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1)), strict=True):
                f = frame(doc_id, ids + END, width)
                if held and size + len(f) > BLOCK_BYTES:
                    yield out()
                    held, size = [], 0
                held.append(f)
                size += len(f)
        if held:
            yield out()

    return run


def write_records(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode docs(doc_id, text) into record files under path."""
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = own.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_blocks(tokenizer), "block binary")
    blocks.select(F.col("block").cast("string")).write.option("maxRecordsPerFile", BLOCKS_PER_FILE).option("lineSep", "\n").text(path)


_INDEX = "part int, chunk int, file string, offset long, length long, doc_id long, n_tokens long, start_in_file long, ids_crc32 long"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, chunk, file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            rows, start = [], 0
            for at, size, doc_id, ids in records(content.as_buffer().to_pybytes()):
                rows.append((at, size, doc_id, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            cols = list(zip(*rows, strict=True)) or [()] * 6
            one = lambda x, t, n=len(rows): pa.array([x] * n, t)
            yield pa.RecordBatch.from_arrays([one(part, pa.int32()), one(chunk, pa.int32()), one(file, pa.string()), *[pa.array(c, pa.int64()) for c in cols]], [x.split()[0] for x in _INDEX.split(", ")])


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    part = F.regexp_extract(name, r"^part-(\d+)-", 1).cast("int")
    chunk = F.regexp_extract(name, r"-c(\d+)\.", 1).cast("int")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(part.alias("part"), chunk.alias("chunk"), F.col("path").alias("file"), "content")


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Read every record back, check it, and say where it stands and what it holds."""
    ship(spark)
    return _files(spark, path).mapInArrow(_walk, _INDEX)


def read_records(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """doc_id and ids of the records that the index rows name, whatever their order or number; one read a file."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, offsets in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                data = content.as_buffer().to_pybytes()
                got = [record(data, at) for at in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1].tolist() for x in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    wanted = index.groupBy("file").agg(F.collect_list("offset").alias("offsets"))
    return _files(spark, path).join(wanted, "file").select("content", "offsets").mapInArrow(run, "doc_id long, ids array<long>")


def token_records(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the record files and their index, and describe every document as read back from them."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    path = path or scratch.path("records")
    write_records(docs, path, tokenizer)
    index = scratch.table(build_index(spark, path), "index")
    # One row a file: files are of many megabytes, so this table is small, and pre-aggregated before it meets one task.
    sums = index.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("part", "chunk", before.alias("base"))
    return index.join(bases, ["part", "chunk"]).select(
        "doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32", "file", "offset", "length"
    )
