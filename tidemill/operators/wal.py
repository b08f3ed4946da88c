"""A write-ahead log as rows (pos, lsn, tx_id, type, flags, key, value, checksum); pos is the place in the log.

Visibility is final-state: a transaction's writes count if its last commit or rollback in the whole log is a commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import ranges

# fixed values: record types
WRITE, COMMIT, ABORT, CHECKPOINT, TXN_BEGIN, TXN_COMMIT, TXN_ROLLBACK = 1, 2, 3, 4, 5, 6, 7


def outcomes(log: DataFrame) -> DataFrame:
    """(tx_id, type): the last commit or rollback of each transaction."""
    ends = log.where(F.col("type").isin(TXN_COMMIT, TXN_ROLLBACK) & (F.col("tx_id") != 0))
    return ends.groupBy("tx_id").agg(F.max_by("type", "pos").alias("type"))


def read_all(log: DataFrame) -> DataFrame:
    """What a reader sees, in log order: writes outside transactions or of committed ones, and other records outside.

    Commit, rollback and begin records of transactions are never shown.
    """
    control = F.col("type").isin(TXN_BEGIN, TXN_COMMIT, TXN_ROLLBACK)
    plain = log.where((F.col("tx_id") == 0) & ~control)
    committed = outcomes(log).where(F.col("type") == TXN_COMMIT).select("tx_id")
    inside = log.where((F.col("type") == WRITE) & (F.col("tx_id") != 0)).join(committed, "tx_id", "left_semi")
    return plain.unionByName(inside).orderBy("pos")


def active_transactions(log: DataFrame) -> DataFrame:
    """(tx_id): began or wrote after their last commit or rollback, if any."""
    begun = F.max(F.when(F.col("type").isin(WRITE, TXN_BEGIN), F.col("pos")))
    ended = F.max(F.when(F.col("type").isin(TXN_COMMIT, TXN_ROLLBACK), F.col("pos")))
    last = log.where("tx_id <> 0").groupBy("tx_id").agg(begun.alias("begun"), ended.alias("ended"))
    return last.where(F.col("begun").isNotNull() & (F.col("ended").isNull() | (F.col("begun") > F.col("ended")))).select("tx_id")


def last_ids(log: DataFrame) -> DataFrame:
    """(last_lsn, last_tx_id), 0 in an empty log."""
    return log.agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("last_lsn"), F.coalesce(F.max("tx_id"), F.lit(0)).alias("last_tx_id"))


def from_commands(commands: DataFrame) -> DataFrame:
    """What a writer makes of commands (seq, cmd, tx_id, key, value): begin, write, commit, abort.

    Rows (seq, cmd, tx_id, accepted, type, key, value). A transaction is active from its first begin to the first commit
    or abort after that; a begin of a known id and an end of an inactive one are rejected. Writes take their place in the
    log at once, inside or outside transactions; begins leave no record (type null).
    """
    tx = Window.partitionBy("tx_id")
    begun = F.min(F.when(F.col("cmd") == "begin", F.col("seq"))).over(tx)
    rows = commands.select("seq", "cmd", "tx_id", "key", "value").withColumn("_begun", begun)
    ends = F.col("cmd").isin("commit", "abort")
    rows = rows.withColumn("_ended", F.min(F.when(ends & (F.col("seq") > F.col("_begun")), F.col("seq"))).over(tx))
    accepted = F.when(F.col("cmd") == "begin", F.col("seq") == F.col("_begun")).when(ends, F.coalesce(F.col("seq") == F.col("_ended"), F.lit(False))).otherwise(F.col("cmd") == "write")
    kind = F.when(F.col("cmd") == "write", WRITE).when(F.col("cmd") == "commit", TXN_COMMIT).when(F.col("cmd") == "abort", TXN_ROLLBACK)
    return rows.select("seq", "cmd", "tx_id", accepted.alias("accepted"), F.when(accepted, kind).cast("byte").alias("type"), "key", "value")


def write(commands: DataFrame) -> DataFrame:
    """The log rows (pos, lsn, tx_id, type, flags, key, value, checksum) of the accepted commands; lsn counts from 1."""
    rows = from_commands(commands).where(F.col("type").isNotNull())
    rows = ranges.row_numbers(rows, "seq", "_n").withColumn("lsn", F.col("_n") + 1)
    body = [F.when(F.col("type") == WRITE, F.coalesce(F.col(c).cast("binary"), F.lit(b""))).otherwise(F.lit(b"")).alias(c) for c in ("key", "value")]
    return checksum(rows.select(F.col("lsn").alias("pos"), "lsn", "tx_id", "type", F.lit(0).cast("byte").alias("flags"), *body)).withColumnRenamed("computed", "checksum")


def checksum(log: DataFrame) -> DataFrame:
    """log with the CRC32 of key and value, as `computed`."""
    return log.withColumn("computed", F.crc32(F.concat(F.coalesce(F.col("key").cast("binary"), F.lit(b"")), F.coalesce(F.col("value").cast("binary"), F.lit(b"")))))


def corrupt(log: DataFrame) -> DataFrame:
    """The rows whose checksum is wrong."""
    return checksum(log).where(~F.col("computed").eqNullSafe(F.col("checksum"))).drop("computed")
