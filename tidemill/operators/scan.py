"""Point, range and prefix scans over sorted tables, and their blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import ranges

BLOCK_BYTES, ENTRY_BYTES = 4096, 8


class KeyNotFoundError(KeyError):
    pass


def point(df: DataFrame, key: str, k) -> DataFrame:
    return df.where(F.col(key) == k)


def require(df: DataFrame, key: str, k):
    """The row with this key, or KeyNotFoundError."""
    found = point(df, key, k).first()
    if found is None:
        raise KeyNotFoundError(k)
    return found


def between(df: DataFrame, key: str, start=None, end=None) -> DataFrame:
    """Rows with start <= key <= end (None: open), by key; both bounds reach the reader."""
    if start is not None:
        df = df.where(F.col(key) >= start)
    if end is not None:
        df = df.where(F.col(key) <= end)
    return df.orderBy(key)


def prefix(df: DataFrame, key: str, p: str) -> DataFrame:
    return df.where(F.col(key).startswith(p))


def traverse(df: DataFrame, key: str, p: str, limit: int | None = None) -> DataFrame:
    """prefix() in order, the first `limit` rows if given."""
    df = prefix(df, key, p).orderBy(key)
    return df if limit is None else df.limit(limit)


def write_sorted(df: DataFrame, key: str, path: str, *, mode: str = "errorifexists", files: int | None = None) -> None:
    """Ranges of keys in files of their own, sorted within, so that the files' statistics are an index."""
    spread = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    spread.sortWithinPartitions(key).write.mode(mode).parquet(path)


def block_index(blocks: DataFrame, block: str, key: str) -> DataFrame:
    """(block, first_key, next_first_key, entries); next_first_key is null for the last. A row for each block.

    Neighbours are found in ranges of keys; a range's last block takes the first key of the next range that has any.
    """
    first = blocks.groupBy(block).agg(F.min(key).alias("first_key"), F.count("*").alias("entries"))
    first = ranges.with_range(first, "first_key", "_part")
    firsts = first.groupBy("_part").agg(F.min("first_key").alias("_first"))
    after = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_after"))  # a row for each range
    out = first.withColumn("_next", F.lead("first_key").over(Window.partitionBy("_part").orderBy("first_key"))).join(F.broadcast(after), "_part")
    return out.select(block, "first_key", "entries", F.coalesce("_next", "_after").alias("next_first_key"))


def floor_block(keys: DataFrame, key: str, index: DataFrame, block: str) -> DataFrame:
    """keys with the block of largest first_key <= key; keys below all go to the first block.

    Both sides meet in one sort by key: each key takes the last block that began before it, so nothing is joined by
    inequality. The sort is cut into ranges of keys, and each range starts with the block that is open there. Both uses
    of the ranges agree, as their bounds are literals.
    """
    spread = keys.select("*", F.lit(1).alias("_kind"), F.col(key).alias("_at"), F.lit(None).cast(dict(index.dtypes)[block]).alias("_block"))
    starts = index.select(*[F.lit(None).cast(t).alias(c) for c, t in keys.dtypes], F.lit(0).alias("_kind"), F.col("first_key").alias("_at"), F.col(block).alias("_block"))
    both = ranges.with_range(spread.unionByName(starts), "_at", "_part")
    order = Window.partitionBy("_part").orderBy("_at", "_kind")
    both = both.withColumn("_seen", F.last("_block", ignorenulls=True).over(order))
    parts = both.groupBy("_part").agg(F.max_by("_block", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last"))
    open_at = parts.select("_part", F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))  # a row for each range
    least = index.agg(F.min_by(block, "first_key").alias("_first"))
    out = both.where("_kind = 1").join(F.broadcast(open_at), "_part").join(F.broadcast(least))
    return out.withColumn(block, F.coalesce("_seen", "_open", "_first")).drop("_kind", "_at", "_block", "_part", "_seen", "_open", "_first")


def pack_blocks(df: DataFrame, key: str, value: str, *, range_key: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """df with the block (from 0, in each range) that a writer would put each entry in, in order of key.

    A block closes when the next entry, of ENTRY_BYTES and its key and value, would take it past limit; an entry larger
    than that has a block of its own. range_key is the column of the ranges of keys that are packed apart, each by one
    task (see ranges.with_range).
    """
    size = ENTRY_BYTES + F.octet_length(F.col(key).cast("binary")) + F.octet_length(F.col(value).cast("binary"))
    rows = df.withColumn("_range", F.col(range_key)).withColumn("_size", size.cast("long"))
    schema = rows.drop("_range", "_size").schema.add("block", "long")

    def pack(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block, used = None, 0, 0
        for part in groups:
            blocks = []
            for own, n in zip(part["_range"], part["_size"], strict=True):
                if own != at:
                    at, block, used = own, 0, 0
                if used and used + n > limit:
                    block, used = block + 1, 0
                used += n
                blocks.append(block)
            yield part.drop(columns=["_range", "_size"]).assign(block=blocks)

    return rows.repartition("_range").sortWithinPartitions("_range", F.col(key).cast("binary")).mapInPandas(pack, schema)
