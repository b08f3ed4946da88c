"""A table of bits of bounded size for a set of 64-bit hashes: no member is missed, and few others seem to be members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import partitions
from tidemill.llm.near import _groups

MOST_BITS, BITS_EACH, BLOCK = 1 << 28, 32, 1 << 18
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a table of so many (a power of 2)."""
    mask = np.uint64(size - 1)
    return (h & mask).astype(np.int64), ((h * _SECOND >> np.uint64(20)) & mask).astype(np.int64)


def build(members: DataFrame, column: str) -> np.ndarray:
    """The table of the hashes in a column, as bytes. What reaches the driver is MOST_BITS / 8 bytes at most."""
    spark = members.sparkSession
    size, n = BLOCK, members.count()
    while size < min(MOST_BITS, BITS_EACH * n):
        size *= 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(places(batch.column(0).to_numpy().view(np.uint64), size))
            yield pa.RecordBatch.from_arrays([pa.array((at // BLOCK).astype(np.int32)), pa.array((at % BLOCK).astype(np.int32))], ["block", "bit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 0):
            block, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(block):
                bits = np.zeros(BLOCK, bool)
                bits[bit[block == k]] = True
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["block", "bytes"])

    dealt = members.select(column).mapInArrow(spread, "block int, bit int").repartition(partitions(spark), "block").sortWithinPartitions("block")
    table = np.zeros(size // 8, np.uint8)
    for r in dealt.mapInArrow(fill, "block int, bytes binary").toLocalIterator():
        table[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = np.frombuffer(r.bytes, np.uint8)
    return table


def holds(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = places(h, 8 * len(table))
    return ((table[a >> 3] >> (a & 7).astype(np.uint8)) & (table[b >> 3] >> (b & 7).astype(np.uint8)) & np.uint8(1)).astype(bool)
