"""Last-write-wins tables over a changelog (sequence, operation, key, value).

A delete is an operation, not a null: empty keys and values are legal. Of writes with equal sequence the delete, then the
larger value, comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETE = "D"


def _is_delete(op: str) -> Column:
    return F.coalesce(F.col(op) == DELETE, F.lit(False))


def latest(log: DataFrame, *, key: str = "key", seq: str = "seq", op: str = "op", value: str = "value", keep_tombstones: bool = False) -> DataFrame:
    """The last row of each key; one shuffle, after partial aggregation."""
    last = F.max_by(F.struct(F.col(op), F.col(value), F.col(seq)), F.struct(F.col(seq), _is_delete(op), F.col(value)))
    out = log.groupBy(key).agg(last.alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in (op, value, seq)])
    return out if keep_tombstones else out.where(~_is_delete(op))


def get(log: DataFrame, k, **names) -> DataFrame:
    """The live row of one key: none if it was never written or is deleted."""
    return latest(log.where(F.col(names.get("key", "key")) == k), **names)


def size_bytes(log: DataFrame, **names) -> DataFrame:
    """Keys and values in bytes, 1 for each tombstone."""
    key, op, value = (names.get(c, c) for c in ("key", "op", "value"))
    rows = latest(log, **names, keep_tombstones=True)
    size = F.octet_length(F.col(key).cast("binary")) + F.when(_is_delete(op), 1).otherwise(F.coalesce(F.octet_length(F.col(value).cast("binary")), F.lit(0)))
    return rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("size_bytes"))


def previous(log: DataFrame, *, key: str = "key", seq: str = "seq", op: str = "op", value: str = "value") -> DataFrame:
    """log with what each write replaced: previous_op and previous_value, null for the first."""
    order = Window.partitionBy(key).orderBy(seq)
    return log.withColumn("previous_op", F.lag(op).over(order)).withColumn("previous_value", F.lag(value).over(order))


def overlay(*runs: DataFrame, **names) -> DataFrame:
    """The live rows over several runs and a log, whichever holds a key's last write."""
    both = runs[0]
    for r in runs[1:]:
        both = both.unionByName(r)
    return latest(both, **names)


def ordered(log: DataFrame, **names) -> DataFrame:
    """By key bytes, tombstones included."""
    return latest(log, **names, keep_tombstones=True).orderBy(names.get("key", "key"))


def append(rows: DataFrame, path: str, run: int | None = None) -> None:
    """Adds rows to the changelog at path, as a run of its own if numbered."""
    if run is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)
