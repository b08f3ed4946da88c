"""A partitioned log with transactions: offsets, read-committed visibility, positions and the coordinator.

Log rows: topic, partition, offset, tx_id, is_marker, tx_state (of markers: COMMITTED or ABORTED), key, value, headers.
Visibility is positional: a message's state is that of its transaction's last marker before it in its partition, or else
of the first one after it; without a marker the message is held. Messages outside transactions are visible.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import ranges

COMMITTED, ABORTED = "COMMITTED", "ABORTED"
_PART = ("topic", "partition")


def with_offsets(rows: DataFrame, *, seq: str = "seq") -> DataFrame:
    """rows with an offset from 0 in each partition, by seq; a partition of any size is numbered in ranges of seq."""
    return ranges.row_numbers(rows, seq, "offset", _PART)


def append(log: DataFrame, rows: DataFrame, *, seq: str = "seq") -> DataFrame:
    """log and rows, whose offsets go on in each partition after those of the log."""
    new = with_offsets(rows, seq=seq).join(latest_offsets(log), list(_PART), "left")
    new = new.withColumn("offset", F.col("offset") + F.coalesce("latest", F.lit(0))).drop("latest")
    return log.unionByName(new.select(*log.columns))


def append_markers(log: DataFrame, marks: DataFrame, *, seq: str = "seq") -> DataFrame:
    """log and a marker for each of marks (topic, partition, tx_id, tx_state, seq), which take offsets like messages.

    A marker on a partition that the log doesn't have fails the query.
    """
    known = log.select(*_PART).distinct().withColumn("_known", F.lit(True))
    marks = marks.join(known, list(_PART), "left")
    said = F.concat(F.lit("no partition "), F.col("topic"), F.lit("-"), F.col("partition").cast("string"))
    checked = F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
    own = {"is_marker": checked, "tx_state": F.col("tx_state"), seq: F.col(seq), "tx_id": F.col("tx_id"), **{c: F.col(c) for c in _PART}}
    rows = marks.select(*[own[c].alias(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in log.dtypes if c != "offset"])
    return append(log, rows, seq=seq)


def read(log: DataFrame, topic: str, partition: int, offset: int, most: int) -> DataFrame:
    """[offset, offset + most) of one partition, whatever its state."""
    return log.where((F.col("topic") == topic) & (F.col("partition") == partition) & F.col("offset").between(offset, offset + most - 1)).orderBy("offset")


def with_state(log: DataFrame) -> DataFrame:
    """Messages (no markers) with `state` (null: held) and `emit_offset`, where a reader in order would see them."""
    marked = F.when(F.col("is_marker"), F.col("tx_state"))
    at = F.when(F.col("is_marker"), F.col("offset"))
    tx = Window.partitionBy(*_PART, "tx_id").orderBy("offset")
    before, after = tx.rowsBetween(Window.unboundedPreceding, -1), tx.rowsBetween(1, Window.unboundedFollowing)
    known, later = F.last(marked, ignorenulls=True).over(before), F.first(marked, ignorenulls=True).over(after)
    inside = log.where(F.col("tx_id").isNotNull()).withColumn("state", F.coalesce(known, later))
    inside = inside.withColumn("emit_offset", F.when(known.isNotNull(), F.col("offset")).otherwise(F.first(at, ignorenulls=True).over(after)))
    outside = log.where(F.col("tx_id").isNull()).withColumn("state", F.lit(COMMITTED)).withColumn("emit_offset", F.col("offset"))
    return inside.unionByName(outside).where(~F.col("is_marker"))


def read_committed(log: DataFrame, *, from_offset: int | None = None, limit: int | None = None) -> DataFrame:
    """Committed messages in the order in which a reader gets them."""
    out = with_state(log).where(F.col("state") == COMMITTED)
    if from_offset is not None:
        out = out.where(F.col("offset") >= from_offset)
    out = out.orderBy("topic", "partition", "emit_offset", "offset")
    return out if limit is None else out.limit(limit)


def latest_offsets(log: DataFrame) -> DataFrame:
    """(topic, partition, latest): the next offset of each partition."""
    return log.groupBy(*_PART).agg((F.max("offset") + 1).alias("latest"))


def seek(log: DataFrame, topic: str, partition: int, offset: int) -> int:
    """offset, if it is in [0, latest] of the partition."""
    row = latest_offsets(log.where((F.col("topic") == topic) & (F.col("partition") == partition))).first()
    if row is None:
        raise ValueError(f"no partition {topic}-{partition}")
    if not 0 <= offset <= row.latest:
        raise ValueError(f"offset {offset} is outside [0, {row.latest}]")
    return offset


def commit_offsets(positions: DataFrame) -> DataFrame:
    """The last committed offset of each group and partition, from rows (group, topic, partition, offset, seq)."""
    return positions.groupBy("group", *_PART).agg(F.max_by("offset", "seq").alias("offset"))


def touched_partitions(log: DataFrame) -> DataFrame:
    """(tx_id, topic, partition) that a transaction's messages touch."""
    return log.where(F.col("tx_id").isNotNull() & ~F.col("is_marker")).select("tx_id", *_PART).distinct()


def markers(log: DataFrame, results: DataFrame) -> DataFrame:
    """Marker rows (tx_id, topic, partition, tx_state) for each partition that the transactions of results touch."""
    return touched_partitions(log).join(results.select("tx_id", "tx_state"), "tx_id").select("tx_id", *_PART, "tx_state")


def expired(transactions: DataFrame, as_of) -> DataFrame:
    """Unfinished transactions (tx_id, state, start_ts, timeout_ms) whose time since the start exceeds their timeout."""
    spent = F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis(F.col("start_ts").cast("timestamp"))
    return transactions.where(~F.col("state").isin(COMMITTED, ABORTED) & (spent > F.col("timeout_ms")))


def add_partitions(has, more):
    """(all, newly added) of two array columns."""
    return F.array_union(has, more), F.array_except(more, has)


REPLAYED = "seq long, tx_id string, cmd string, accepted boolean, reason string, state string, added int"


class _Transaction:
    """One transaction as its commands change it."""

    def __init__(self):
        self.state, self.timeout, self.began = None, 0, None
        self.partitions: set = set()

    def apply(self, cmd: str, at, timeout, partitions) -> tuple[str | None, int]:
        """(reason to reject, newly added partitions)."""
        if cmd == "begin":
            if self.state is not None:
                return "it exists", 0
            if not timeout or timeout <= 0:
                return "the timeout isn't positive", 0
            self.state, self.timeout, self.began = "BEGIN", timeout, at
            return None, 0
        if self.state is None:
            return "it doesn't exist", 0
        if self.state not in (COMMITTED, ABORTED) and (at - self.began).total_seconds() * 1000 > self.timeout:
            self.state = ABORTED
            return ("it timed out", 0) if cmd != "abort" else (None, 0)
        if cmd == "add":
            if self.state != "BEGIN":
                return f"it is {self.state}", 0
            if not len(partitions):
                return "no partitions", 0
            new = {tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in partitions} - self.partitions
            self.partitions |= new
            return None, len(new)
        allowed = {"prepare": ("BEGIN",), "commit": ("PREPARED",), "abort": ("BEGIN", "PREPARED")}
        if self.state not in allowed.get(cmd, ()):
            return f"it is {self.state}", 0
        self.state = {"prepare": "PREPARED", "commit": COMMITTED, "abort": ABORTED}[cmd]
        return None, 0


def replay_commands(commands: DataFrame) -> DataFrame:
    """REPLAYED rows for commands (seq, cmd, tx_id, timeout_ms, partitions, at): begin, add, prepare, commit, abort.

    Rejected commands change nothing and say why. A transaction's commands are folded in order of seq as they stream by.
    """
    rows = commands.select("tx_id", "seq", "cmd", "timeout_ms", "partitions", "at").repartition("tx_id").sortWithinPartitions("tx_id", "seq")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, tx = None, _Transaction()
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r.tx_id != own:
                    own, tx = r.tx_id, _Transaction()
                reason, added = tx.apply(r.cmd, r.at, r.timeout_ms, () if r.partitions is None else r.partitions)
                out.append((r.seq, r.tx_id, r.cmd, reason is None, reason, tx.state or "UNKNOWN", added))
            yield pd.DataFrame(out, columns=["seq", "tx_id", "cmd", "accepted", "reason", "state", "added"])

    return rows.mapInPandas(fold, REPLAYED)
