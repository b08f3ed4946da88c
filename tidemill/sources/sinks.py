"""Binary logs and sorted tables written by Spark tasks, and folders that are shared.

Rows are dealt into ranges of their key; each range is written by one task to files of its own, whose numeric names keep
the order. A file is written under another name and then renamed, so a repeated task leaves the same files. A table of
what was written (file, records, bytes) lies beside them in _manifest. Paths are what pyarrow.fs understands.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import ranges
from tidemill.sources import codecs

SEGMENT_BYTES = 64 << 20
_MANIFEST = "file string, records long, bytes long"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or f"file://{tempfile.gettempdir()}/tidemill").rstrip("/")


def _put(folder: str, name: str, raw: bytes) -> None:
    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    hidden = f"{at}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden) as out:
        out.write(raw)
    fs.move(hidden, f"{at}/{name}")


def exists(folder: str) -> bool:
    """Whether the folder has files."""
    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True))
    return bool(found)


def clear(folder: str) -> None:
    """Deletes what was written; no error if nothing was."""
    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    if fs.get_file_info(at).type != pyarrow.fs.FileType.NotFound:
        fs.delete_dir(at)


def _write(rows: DataFrame, key: str, columns: list, path: str, end: str, size: Callable, encode: Callable, limit: int, run: int) -> DataFrame:
    """Writes rows in order of key to files that encode() makes of lists of rows of `limit` bytes (by size()) at most."""
    spread = ranges.with_range(rows, key, "_part").select("_part", F.col(key).alias("_key"), *columns)
    spread = spread.repartition("_part").sortWithinPartitions("_part", "_key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, used, done = None, 0, [], 0, []

        def close() -> None:
            nonlocal k, held, used
            if held:
                raw = encode(held)
                name = f"{run:06d}{part:06d}{k:06d}.{end}"
                _put(path, name, raw)
                done.append((name, len(held), len(raw)))
                k, held, used = k + 1, [], 0

        for batch in batches:
            parts = batch.column(0).to_pylist()
            for own, row in zip(parts, zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True), strict=True):
                if own != part:
                    close()
                    part, k = own, 0
                n = size(row)
                if held and used + n > limit:
                    close()
                held.append(row)
                used += n
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["file", "records", "bytes"])

    spread.mapInArrow(work, _MANIFEST).write.parquet(f"{path}/_manifest/run={run}")
    return rows.sparkSession.read.schema(_MANIFEST).parquet(f"{path}/_manifest/run={run}")


def write_wal(log: DataFrame, path: str, *, order: str = "lsn", segment_bytes: int = SEGMENT_BYTES, run: int = 0) -> DataFrame:
    """Rows (lsn, tx_id, type, flags, key, value) as *.wal segments of at most so many bytes (a record is never parted)."""
    columns = [F.col(c) for c in ("lsn", "tx_id", "type", "flags")] + [F.coalesce(F.col(c).cast("binary"), F.lit(b"")).alias(c) for c in ("key", "value")]
    encode = lambda rows: b"".join(codecs.encode_wal(lsn, tx, kind, k, v, flags) for lsn, tx, kind, flags, k, v in rows)
    return _write(log, order, columns, path, "wal", lambda r: codecs.WAL_HEADER.size + len(r[4]) + len(r[5]), encode, segment_bytes, run)


def write_ops(log: DataFrame, path: str, *, order: str = "seq", segment_bytes: int = SEGMENT_BYTES, run: int = 0) -> DataFrame:
    """Rows (op, key, value) as *.wal files of a key-value log; a further run is appended after those before."""
    columns = [F.col("op"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")]
    encode = lambda rows: b"".join(codecs.encode_op(op, k, v) for op, k, v in rows)
    return _write(log, order, columns, path, "wal", lambda r: 24 + len(r[1]) + len(r[2] or b""), encode, segment_bytes, run)


def write_table(rows: DataFrame, path: str, *, layout: str = "blocks", key: str = "key", value: str = "value", file_bytes: int = SEGMENT_BYTES, mode: str = "errorifexists", run: int = 0) -> DataFrame:
    """Rows of a key each as sorted *.sst files of about so many bytes; in layout 'run' a null value is a tombstone.

    mode: errorifexists, overwrite or append (as a further run).
    """
    if mode == "errorifexists" and exists(path):
        raise FileExistsError(path)
    if mode == "overwrite":
        clear(path)
    encode = {"blocks": codecs.encode_blocks, "run": codecs.encode_run}[layout]
    columns = [F.col(key).cast("binary").alias("key"), F.col(value).cast("binary").alias("value")]
    rows = rows.withColumn("_bytes", columns[0])
    return _write(rows, "_bytes", columns, path, "sst", lambda r: 24 + 2 * len(r[0]) + len(r[1] or b""), encode, file_bytes, run)
