"""Streaming twins of the log operators; each equals its batch operator once the stream has been read to its end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.operators import kv

DELIVERED = "topic string, partition int, tx_id string, offset long, emit_offset long, value string"
_ROW = ["topic", "partition", "tx_id", "offset", "is_marker", "tx_state", "value"]
_KEPT = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("tx_id", pa.string()), ("offset", pa.int64()), ("is_marker", pa.bool_()), ("tx_state", pa.string()), ("value", pa.string())])
TX_BUCKETS = 512


def _deliver(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of one bucket of transactions, all at once by arrays. State is log rows: of each transaction in a partition its
    last marker, or else its held messages."""
    rows = pd.concat(list(parts))[_ROW].sort_values("offset", kind="stable")
    rows = rows[~rows["is_marker"] | rows["tx_state"].notna()]
    if state.exists:
        kept = pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas()
        rows = pd.concat([kept.astype({"offset": "int64", "is_marker": "bool"}), rows]) if len(kept) else rows
    tx = rows.groupby(["topic", "partition", "tx_id"], sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(tx, kind="stable")  # by transaction, then as they came
    rows, tx = rows.iloc[order], tx[order]
    at, marker, offset = np.arange(len(rows)), rows["is_marker"].to_numpy(bool), rows["offset"].to_numpy(np.int64)
    first, end = np.searchsorted(tx, tx, side="left"), np.searchsorted(tx, tx, side="right")
    before = np.maximum.accumulate(np.where(marker, at, -1))
    after = np.minimum.accumulate(np.where(marker, at, len(at))[::-1])[::-1]
    known, marked = before >= first, after < end
    by = np.where(known, before, np.where(marked, after, 0))  # the marker that decides
    committed = (rows["tx_state"] == "COMMITTED").to_numpy(bool)
    seen = ~marker & (known | marked) & committed[by] if len(rows) else marker
    later = np.append(after[1:], len(at)) if len(rows) else after
    keep = np.where(marker, later >= end, ~known & ~marked)
    state.update((_bytes(rows[keep]),))
    out = rows.loc[:, ["topic", "partition", "tx_id", "offset"]][seen]
    yield out.assign(emit_offset=np.where(known, offset, offset[by])[seen], value=rows["value"][seen])


def _bytes(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _KEPT) as out:
        out.write_table(pa.Table.from_pandas(rows.assign(value=rows["value"].where(~rows["is_marker"], None)), _KEPT, preserve_index=False))
    return sink.getvalue().to_pybytes()


def read_committed(log: DataFrame, *, buckets: int = TX_BUCKETS) -> DataFrame:
    """DELIVERED rows of a stream of log rows (topic, partition, offset, tx_id, is_marker, tx_state, value).

    A partition's rows arrive by offset, as a log gives them; within a micro-batch they are put in order here. State is a
    transaction's last marker in a partition and its held messages. Transactions are dealt into buckets; a micro-batch
    rewrites the state of those that it touches, and a checkpoint goes with one number of buckets. Messages outside
    transactions pass as they come.
    """
    inside = log.where(F.col("tx_id").isNotNull()).select(F.pmod(F.xxhash64("topic", "partition", "tx_id"), F.lit(buckets)).cast("int").alias("bucket"), *_ROW)
    held = inside.groupBy("bucket").applyInPandasWithState(_deliver, DELIVERED, "kept binary", "append", GroupStateTimeout.NoTimeout)
    free = log.where(F.col("tx_id").isNull() & ~F.col("is_marker")).select("topic", "partition", "tx_id", "offset", F.col("offset").alias("emit_offset"), "value")
    return held.unionByName(free)


BUCKETS, VERSIONS = 64, 2


def upsert_latest(log: DataFrame, path: str, checkpoint: str, *, buckets: int = BUCKETS, **names):
    """A query that keeps the last write of each key under path; see latest_version().

    Keys are dealt into buckets, and a micro-batch rewrites only those that it touches, as a version of its own; of each
    bucket the VERSIONS newest stay.
    """
    key, seq, op, value = (names.get(c, c) for c in ("key", "seq", "op", "value"))

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key, seq, op, value).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        before = {b: [v for v in found if v < epoch] for b, found in _versions(spark, path).items()}  # an epoch may run again
        newest = {b: found for b, found in before.items() if found}
        touched = sorted({r.bucket for r in rows.select("bucket").distinct().collect()})
        old = [f"{path}/bucket={b}/version={max(newest[b])}" for b in touched if b in newest]
        if old:
            rows = rows.unionByName(spark.read.option("basePath", path).parquet(*old).select(*rows.columns))
        last = kv.latest(rows, **names, keep_tombstones=True).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        for_writing = last.withColumn("version", F.lit(epoch)).repartition("bucket")
        for_writing.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
        for b in touched:
            for v in sorted(newest.get(b, []))[: -(VERSIONS - 1)]:
                _delete(spark, f"{path}/bucket={b}/version={v}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark, path: str) -> dict[int, list[int]]:
    """The versions of each bucket under path, from folder names."""
    fs, p = _path(spark, f"{path}/bucket=*/version=*")
    found: dict[int, list[int]] = {}
    for status in fs.globStatus(p) or ():
        folder = status.getPath()
        found.setdefault(int(folder.getParent().getName().split("=")[1]), []).append(int(folder.getName().split("=")[1]))
    return found


def _delete(spark, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def latest_version(spark, path: str) -> DataFrame:
    """What upsert_latest() wrote last: the newest version of each bucket."""
    newest = [f"{path}/bucket={b}/version={max(v)}" for b, v in sorted(_versions(spark, path).items())]
    return spark.read.option("basePath", path).parquet(*newest).drop("bucket", "version")


def timed_out(transactions: DataFrame, timeout: str = "timeout_ms"):
    """(tx_id, state) of a stream of commands (tx_id, cmd, at, timeout_ms): ABORTED once event time passes begin + timeout.

    `at` has a watermark; transactions that were finished before it passed are COMMITTED or ABORTED as they said.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, limit, done = state.get if state.exists else (None, None, None)
        out = []
        if state.hasTimedOut:
            if done is None:
                out.append((key[0], "ABORTED"))
            state.remove()
        else:
            rows = pd.concat(list(parts)).sort_values("at", kind="stable")
            for r in rows.itertuples(index=False):
                at = int(r.at.timestamp() * 1000)
                if r.cmd == "begin" and begun is None:
                    begun, limit = at, int(r.timeout_ms)
                elif r.cmd in ("commit", "abort") and done is None and begun is not None and at - begun <= limit:
                    done = "COMMITTED" if r.cmd == "commit" else "ABORTED"
                    out.append((key[0], done))
            state.update((begun, limit, done))
            if begun is not None:
                state.setTimeoutTimestamp(max(begun + limit, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["tx_id", "state"])

    rows = transactions.select("tx_id", "cmd", "at", F.col(timeout).alias("timeout_ms"))
    return rows.groupBy("tx_id").applyInPandasWithState(fold, "tx_id string, state string", "begun long, stop long, done string", "append", GroupStateTimeout.EventTimeTimeout)
