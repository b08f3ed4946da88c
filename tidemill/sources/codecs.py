"""Binary logs and sorted tables as rows, read with Spark's binaryFile source, and their encoders.

Each file is decoded by one task, so files of up to 2 GB (one cell) are read; logs and runs rotate well below that.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: file formats
WAL_HEADER = struct.Struct(">QQBBHHI")  # lsn, transaction, type, flags, key length, value length, CRC32 of key and value
BLOCK_MAGIC = 0x53535442
BLOCK_HEADER, BLOCK_FOOTER = struct.Struct(">QQ"), struct.Struct(">QQQ")  # magic, version; index offset, index size, magic
RUN_MAGIC = 0x1234567890ABCDEF
RUN_META = struct.Struct(">QQQ")  # entries, data size, index size
TOMBSTONE = (1 << 64) - 1
MOST_META = 1024


class CorruptFileError(ValueError):
    pass


def encode_wal(lsn: int, tx_id: int, kind: int, key: bytes = b"", value: bytes = b"", flags: int = 0) -> bytes:
    if len(key) > 0xFFFF or len(value) > 0xFFFF:
        raise ValueError("keys and values hold 65535 bytes at most")
    return WAL_HEADER.pack(lsn, tx_id, kind, flags, len(key), len(value), zlib.crc32(key + value)) + key + value


def decode_wal(raw: bytes, *, last: bool = True) -> Iterator[tuple]:
    """(place, lsn, tx_id, type, flags, key, value, checksum); a torn record ends the last segment, elsewhere it is an error."""
    at = 0
    while at < len(raw):
        head = raw[at : at + WAL_HEADER.size]
        size = WAL_HEADER.size
        if len(head) == size:
            lsn, tx, kind, flags, k, v, crc = WAL_HEADER.unpack(head)
            size += k + v
        if len(head) < WAL_HEADER.size or at + size > len(raw):
            if last:
                return
            raise CorruptFileError(f"torn record at byte {at}")
        key, value = raw[at + WAL_HEADER.size : at + WAL_HEADER.size + k], raw[at + WAL_HEADER.size + k : at + size]
        if zlib.crc32(key + value) != crc:
            raise CorruptFileError(f"wrong checksum at byte {at}")
        if lsn >> 63 or tx >> 63:
            raise CorruptFileError(f"number beyond 63 bits at byte {at}")
        yield at, lsn, tx, kind, flags, key, value, crc
        at += size


def encode_blocks(entries: list[tuple[bytes, bytes]], *, limit: int = 4096) -> bytes:
    """A sorted table: blocks of entries, an index of their first keys, a footer."""
    out, index, block = [BLOCK_HEADER.pack(BLOCK_MAGIC, 1)], [], []
    at = BLOCK_HEADER.size

    def close() -> None:
        nonlocal at, block
        raw = struct.pack(">I", len(block)) + b"".join(struct.pack(">I", len(k)) + k + struct.pack(">I", len(v)) + v for k, v in block)
        index.append((block[0][0], at, len(raw)))
        out.append(raw)
        at, block = at + len(raw), []

    used = 0
    for k, v in sorted(dict(entries).items()):
        size = 8 + len(k) + len(v)
        if block and used + size > limit:
            close()
            used = 0
        block.append((k, v))
        used += size
    if block:
        close()
    tail = b"".join(struct.pack(">I", len(k)) + k + struct.pack(">QQ", o, n) for k, o, n in index)
    return b"".join([*out, tail, BLOCK_FOOTER.pack(at, len(tail), BLOCK_MAGIC)])


def decode_blocks(raw: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(block offset, key, value)."""
    if len(raw) < BLOCK_FOOTER.size or len(raw) < BLOCK_HEADER.size + BLOCK_FOOTER.size:
        raise CorruptFileError("too short for a sorted table")
    end, size, magic = BLOCK_FOOTER.unpack(raw[-BLOCK_FOOTER.size :])
    if magic != BLOCK_MAGIC or BLOCK_HEADER.unpack(raw[: BLOCK_HEADER.size])[0] != BLOCK_MAGIC or end + size + BLOCK_FOOTER.size != len(raw):
        raise CorruptFileError("not a sorted table")
    at = BLOCK_HEADER.size
    try:
        while at < end:
            start = at
            (count,) = struct.unpack_from(">I", raw, at)
            at += 4
            for _ in range(count):
                pair = []
                for _ in range(2):
                    (n,) = struct.unpack_from(">I", raw, at)
                    if at + 4 + n > end:
                        raise CorruptFileError(f"entry beyond the blocks at byte {at}")
                    pair.append(raw[at + 4 : at + 4 + n])
                    at += 4 + n
                yield start, *pair
    except struct.error as e:
        raise CorruptFileError(f"broken block at byte {at}") from e


def encode_run(entries: list[tuple[bytes, bytes | None]]) -> bytes:
    """A sorted run with tombstones (None)."""
    data, index, at = [], [], 0
    for k, v in sorted(dict(entries).items(), key=lambda e: e[0]):
        raw = struct.pack("<Q", len(k)) + k + (struct.pack("<Q", TOMBSTONE) if v is None else struct.pack("<Q", len(v)) + v)
        index.append(struct.pack("<Q", len(k)) + k + struct.pack("<Q", at))
        data.append(raw)
        at += len(raw)
    tail = b"".join(index)
    meta = RUN_META.pack(len(data), at, len(tail))
    return b"".join([*data, tail, meta, struct.pack(">Q", RUN_MAGIC), struct.pack("<QQ", len(meta), at + len(tail))])


def decode_run(raw: bytes) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(offset, key, value or None for a tombstone)."""
    if len(raw) < 24 or struct.unpack(">Q", raw[-24:-16])[0] != RUN_MAGIC:
        raise CorruptFileError("not a sorted run")
    size, start = struct.unpack("<QQ", raw[-16:])
    if not 0 < size <= MOST_META or start + size + 24 != len(raw) or size != RUN_META.size:
        raise CorruptFileError("wrong bounds in a sorted run")
    count, end, _ = RUN_META.unpack(raw[start : start + size])
    at = 0
    try:
        for _ in range(count):
            begin = at
            (k,) = struct.unpack_from("<Q", raw, at)
            key = raw[at + 8 : at + 8 + k]
            at += 8 + k
            (v,) = struct.unpack_from("<Q", raw, at)
            at += 8
            if v != TOMBSTONE and at + v > end:
                raise CorruptFileError(f"entry beyond the data at byte {begin}")
            yield begin, key, None if v == TOMBSTONE else raw[at : at + v]
            at += 0 if v == TOMBSTONE else v
    except struct.error as e:
        raise CorruptFileError(f"broken entry at byte {at}") from e


def _varint(n: int) -> bytes:
    if n < 251:
        return bytes([n])
    for mark, kind in ((251, "<H"), (252, "<I"), (253, "<Q")):
        if n < 1 << (8 * struct.calcsize(kind)):
            return bytes([mark]) + struct.pack(kind, n)
    raise ValueError(n)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    if (first := raw[at]) < 251:
        return first, at + 1
    kind = {251: "<H", 252: "<I", 253: "<Q"}[first]
    return struct.unpack_from(kind, raw, at + 1)[0], at + 1 + struct.calcsize(kind)


def encode_op(op: str, key: bytes, value: bytes | None = None) -> bytes:
    """A put ('P') or delete ('D') of a key-value log."""
    body = _varint(0 if op == "P" else 1) + _varint(len(key)) + key + (_varint(len(value or b"")) + (value or b"") if op == "P" else b"")
    return struct.pack("<Q", len(body)) + body


def decode_ops(raw: bytes) -> Iterator[tuple[int, str, bytes, bytes | None]]:
    """(place, op, key, value); a torn last record is dropped."""
    at = 0
    while at + 8 <= len(raw):
        (n,) = struct.unpack_from("<Q", raw, at)
        if at + 8 + n > len(raw):
            return
        body, begin = raw[at + 8 : at + 8 + n], at
        at += 8 + n
        try:
            kind, p = _read_varint(body, 0)
            size, p = _read_varint(body, p)
            key, value = body[p : p + size], None
            if kind == 0:
                more, p = _read_varint(body, p + size)
                value = body[p : p + more]
        except (IndexError, KeyError, struct.error) as e:
            raise CorruptFileError(f"broken record at byte {begin}") from e
        if kind not in (0, 1):
            raise CorruptFileError(f"unknown operation at byte {begin}")
        yield begin, "PD"[kind], key, value


def _read(files: DataFrame, schema: str, decode: Callable[[str, bytes, bool], Iterator[tuple]]) -> DataFrame:
    """Rows of decode(path, content, is the last file) for each file (path, content, is_last)."""
    kind = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            for path, content, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, it = [], decode(path, content, last)
                for row in it:
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path", "content", "is_last").mapInArrow(run, kind)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """(segment, place, lsn, tx_id, type, flags, key, value, checksum, pos) of the *.wal files in a folder; pos orders the log."""
    files = _files(spark, path, "*.wal").withColumn("segment", F.regexp_extract("path", r"(\d+)[^/]*\.wal$", 1).cast("long"))
    last = files.select("segment").agg(F.max("segment").alias("last"))
    files = files.join(F.broadcast(last)).withColumn("is_last", F.col("segment") == F.col("last"))

    def decode(name: str, raw: bytes, is_last: bool) -> Iterator[tuple]:
        segment = int("".join(c for c in name.rpartition("/")[2] if c.isdigit()))
        for row in decode_wal(raw, last=is_last):
            yield segment, *row

    out = _read(files, "segment long, place long, lsn long, tx_id long, type byte, flags byte, key binary, value binary, checksum long", decode)
    return out.withColumn("pos", F.struct("segment", "place"))


def read_sorted(spark: SparkSession, path: str, layout: str = "blocks") -> DataFrame:
    """(file, place, key, value, deleted) of the *.sst files in a folder (or one file); layout is 'blocks' or 'run'."""
    decode_file = {"blocks": decode_blocks, "run": decode_run}[layout]

    def decode(name: str, raw: bytes, is_last: bool) -> Iterator[tuple]:
        for place, key, value in decode_file(raw):
            yield name.rpartition("/")[2], place, key, value, value is None

    return _read(_files(spark, path, "*.sst").withColumn("is_last", F.lit(True)), "file string, place long, key binary, value binary, deleted boolean", decode)


def read_ops(spark: SparkSession, path: str, pattern: str = "*.wal") -> DataFrame:
    """(file, seq, op, key, value) of a key-value log, which file and seq order; no files, no rows."""

    def decode(name: str, raw: bytes, is_last: bool) -> Iterator[tuple]:
        for row in decode_ops(raw):
            yield name.rpartition("/")[2], *row

    return _read(_files(spark, path, pattern).withColumn("is_last", F.lit(True)), "file string, seq long, op string, key binary, value binary", decode)
