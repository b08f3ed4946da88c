"""Removal of repeated substrings: every byte inside a string of LENGTH bytes that also starts earlier.

Anchors cut the work to where repeats can be. A window of LENGTH bytes is owned by the least of the hashes of its
LENGTH / 2 bytes strings (the leftmost of equals), so equal windows have equal owners. Owners are counted over all
documents; windows whose owner occurs once are unique. The others go on.

Each task lays its documents, in order, into shards of about SHARD bytes. Over the windows that go on, a shard gets a
suffix array by Larsson-Sadakane refinement, and Kasai's common prefixes group equal windows: all but the first of a
group are repeats. First windows are then merged across shards: they are dealt by owner, so equal windows meet, and the
hash of each is binary-searched among the sorted hashes of all. What that finds is compared byte by byte with the first
window of its group, and hashes that different windows share are grouped by their bytes, so hashes decide nothing.

A shard sends a window once at most. Windows of owners with more than HOT occurrences are dealt one by one by their own
hash, and merged in two levels: first in SALTS parts of the documents each, then what is left of the parts.

The owners that occur more than once, and those of more than HOT occurrences, reach the tasks as tables of bits of
bounded size; hash collisions there only let more windows go on, or alone, so the result is the same for any size of input.

Exact copies of an earlier document (equal by 192 bits of two hashes) are repeats as a whole and are set aside before.
Documents are ordered by doc_id (null first), then by a hash of the text; rows with equal doc_id and text are one
document and get the same result.

Defined cases: null texts are empty; texts of fewer than LENGTH bytes keep all; matches never cross documents; empty
tables give empty results; texts of any length are read whole, in pieces of SHARD bytes that overlap; other columns of
the input are not read, and remove() returns doc_id, kept and spans only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import bits
from tidemill.llm.common import materialize, partitions, release
from tidemill.llm.near import _groups, small_enough
from tidemill.llm.suffix import common_prefixes, pack, suffix_array

LENGTH, SHARD, HOT, SALTS = 100, 2 << 20, 4000, 64
_K = LENGTH // 2
_CHUNK = 1 << 16
_SPAN = LENGTH - _K + 1  # strings of _K bytes in a window
_P = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_STIR = np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        both = []
        for base in (_P, _INVERSE):
            x = np.full(max(n, SHARD + (1 << 16)), base)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def rolling(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes of b."""
    power, back = _power(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.multiply(power[:-1], b, out=sums[1:])
    np.cumsum(sums, out=sums)
    x = sums[k:] - sums[:-k]
    x *= back[: len(x)]
    x ^= x >> np.uint64(32)
    x *= _STIR
    x ^= x >> np.uint64(29)
    x *= _P
    x ^= x >> np.uint64(32)
    return x


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values that follow each other."""
    n = len(x)
    rows = np.append(x, np.full(-n % w, _NONE)).reshape(-1, w)
    down = np.minimum.accumulate(rows, axis=1).ravel()
    up = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[: n - w + 1], down[w - 1 : n])


class Owned(NamedTuple):
    """Runs of windows [low, high] (positions of their first bytes in the buffer) with one owner each."""

    low: np.ndarray
    high: np.ndarray
    owner: np.ndarray


def owned(b: np.ndarray, ends: np.ndarray) -> Owned:
    """Of a buffer of texts that end at ends; no window crosses an end."""
    empty = np.empty(0, np.int64)
    if len(b) < LENGTH:
        return Owned(empty, empty, np.empty(0, np.uint64))
    h, at = np.empty(len(b) - _K + 1, np.uint64), np.empty(len(b) - LENGTH + 1, np.int64)
    shift = np.uint64(_CHUNK.bit_length())
    low = (np.uint64(1) << shift) - np.uint64(1)
    for begin in range(0, len(at), _CHUNK):  # pieces that fit the cache
        some = rolling(b[begin : begin + _CHUNK + LENGTH - 1], _K)
        h[begin : begin + len(some)] = some
        some &= ~low
        some |= np.arange(len(some), dtype=np.uint64)
        least = sliding_min(some, _SPAN)
        least &= low
        at[begin : begin + len(least)] = least
        at[begin : begin + len(least)] += begin
    valid = np.ones(len(at), bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - LENGTH + 1) : e] = False
    at[~valid] = -1
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(edge[1:], len(at)) - 1
    ok = at[edge] >= 0
    return Owned(edge[ok], last[ok], h[at[edge][ok]])


def _pieces(ids: list, hashes: list, texts: list[str | None]) -> Iterator[tuple[list, list, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about SHARD bytes: (doc ids, hashes, first byte of each piece in its document, ends, bytes), in order."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, hashes[k]))
    out: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    seen = set()
    for k in order:
        raw = (texts[k] or "").encode("utf-8", "surrogatepass")
        if len(raw) < LENGTH or (ids[k], hashes[k]) in seen:
            continue
        seen.add((ids[k], hashes[k]))
        for at in range(0, len(raw) - LENGTH + 1, SHARD):
            part = raw[at : at + SHARD + LENGTH - 1]
            for column, x in zip(out, (ids[k], hashes[k], at, part), strict=True):
                column.append(x)
            size += len(part)
            if size >= SHARD:
                yield out[0], out[1], np.array(out[2]), np.cumsum([len(x) for x in out[3]]), np.frombuffer(b"".join(out[3]), np.uint8)
                out, size = ([], [], [], []), 0
    if size:
        yield out[0], out[1], np.array(out[2]), np.cumsum([len(x) for x in out[3]]), np.frombuffer(b"".join(out[3]), np.uint8)


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:  # (doc_id, hash, text)
        yield from _pieces(*(c.to_pylist() for c in batch.columns))


def repeated_in_shard(b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """True for each window start in b that some run [low, high] holds and whose window starts earlier in such a run."""
    flagged = np.zeros(len(b), bool)
    if not low.size:
        return flagged
    stop = np.maximum.accumulate(high + LENGTH)
    new = np.concatenate([[True], low[1:] >= stop[:-1]])  # runs of one document that touch are one region
    begin, end = low[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)]
    size = end - begin + 1
    at = np.cumsum(size) - size
    place = np.repeat(begin - at, size) + np.arange(int(size.sum()))
    text = b[np.minimum(place, len(b) - 1)].astype(np.int16) + 1
    text[at + size - 1] = 0  # ends a region
    packed, _ = pack(text, 9)
    sa, _ = suffix_array(text, LENGTH, 9, packed)
    same = common_prefixes(text, sa, LENGTH, 9, packed) >= LENGTH
    start = np.flatnonzero(~same)
    first = np.repeat(np.minimum.reduceat(sa, start), np.diff(np.append(start, len(sa))))
    later = sa[sa != first]
    whole = np.arange(len(text)) + LENGTH < np.repeat(at + size, size)  # equal ends of regions don't make windows
    flagged[place[later[whole[later]]]] = True
    return flagged


_RUN = "doc_id long, hash long, start long, stop long, owner long, bytes binary, alone boolean"
_NAMES = ["doc_id", "hash", "start", "stop", "owner", "bytes", "alone"]


def count_owners(docs: DataFrame) -> DataFrame:
    """(owner, n) from rows (doc_id, hash, text), for owners of more than one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, ends, b in _buffers(batches):
            owner, n = np.unique(owned(b, ends).owner, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(owner.view(np.int64)), pa.array(n)], ["owner", "n"])

    return docs.mapInArrow(run, "owner long, n long").groupBy("owner").agg(F.sum("n").alias("n")).where("n > 1")


def shard_runs(docs: DataFrame, table: np.ndarray, hot: np.ndarray) -> DataFrame:
    """_RUN rows: bytes that a shard removes (owner null), and runs of windows to merge across shards, with their bytes.

    table holds the owners that occur again, hot those that occur very often, whose windows go alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast((table, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot_owners = shared.value
        for ids, hashes, offsets, ends, b in _buffers(batches):
            o = owned(b, ends)
            go = bits.holds(table, o.owner)
            low, high, owner = o.low[go], o.high[go], o.owner[go]
            flagged = repeated_in_shard(b, low, high)
            begins = np.concatenate([[0], ends[:-1]])

            def rows(start: np.ndarray, stop: np.ndarray, who: pa.Array, raw: pa.Array, alone: np.ndarray, *, ids=ids, hashes=hashes, offsets=offsets, ends=ends, begins=begins) -> pa.RecordBatch:
                doc = np.searchsorted(ends, start, side="right")
                shift = offsets[doc] - begins[doc]
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(doc)), pa.array(hashes, pa.int64()).take(pa.array(doc)), pa.array(start + shift), pa.array(stop + shift), who, raw, pa.array(alone)], _NAMES)

            edge = np.flatnonzero(np.diff(np.concatenate([[0], flagged.astype(np.int8), [0]])))
            if edge.size:
                s, e = edge[::2], edge[1::2] - 1 + LENGTH
                yield rows(s, e, pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.binary()), np.zeros(len(s), bool))
            if not low.size:
                continue
            # of each run, the part from its first to its last window that isn't flagged
            free = np.concatenate([[0], np.cumsum(~flagged)])
            some = free[high + 1] > free[low]
            low, high, owner = low[some], high[some], owner[some]
            positions = np.flatnonzero(~flagged)
            low = positions[free[low]]
            high = positions[free[high + 1] - 1]
            single = bits.holds(hot_owners, owner)
            alone = np.zeros(len(low), bool)
            if single.any():
                many = (high - low + 1)[single]
                ones = np.repeat(low[single] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                ones = ones[~flagged[ones]]
                own = rolling(b, LENGTH)[ones]
                low, high, owner = np.concatenate([low[~single], ones]), np.concatenate([high[~single], ones]), np.concatenate([owner[~single], own])
                alone = np.concatenate([alone[~single], np.ones(len(ones), bool)])
            raw = b.tobytes()
            for at in range(0, len(low), 20_000):
                part = slice(at, at + 20_000)
                texts = pa.array([raw[s : e + LENGTH] for s, e in zip(low[part].tolist(), high[part].tolist(), strict=True)], pa.binary())
                yield rows(low[part], high[part] + 1, pa.array(owner[part].view(np.int64)), texts, alone[part])

    return docs.mapInArrow(run, _RUN)


def _first_equal(h: np.ndarray, at: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each window (its hash, and the place of its first byte in b) the first one with equal bytes."""
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    first = np.empty(len(h), np.int64)
    first[order] = order[np.searchsorted(ordered, ordered, side="left")]
    later = np.flatnonzero(first != np.arange(len(h)))
    every = np.lib.stride_tricks.sliding_window_view(b, LENGTH)
    wrong = [later[:0]]
    for k in range(0, len(later), _CHUNK):
        some = later[k : k + _CHUNK]
        wrong.append(some[(every[at[some]] != every[at[first[some]]]).any(1)])
    for value in np.unique(h[np.concatenate(wrong)]).tolist():  # different windows of one hash
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(h == np.uint64(value)).tolist():
            first[i] = seen.setdefault(every[at[i]].tobytes(), i)
    return first


def merge_shards(runs: DataFrame) -> DataFrame:
    """_RUN rows from shard_runs() with a column part, dealt and sorted by it: removed bytes (alone false, no bytes) and,
    of the windows that go alone, the first of its equals in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, len(_NAMES)):
            done = pa.compute.is_null(batch.column(5))
            local = batch.filter(done)
            if len(local):
                yield local.select(_NAMES)
            batch = batch.filter(pa.compute.invert(done))
            if not len(batch):
                continue
            batch = batch.take(pa.compute.sort_indices(batch, [("doc_id", "ascending"), ("hash", "ascending"), ("start", "ascending")], null_placement="at_start"))
            doc, own, start = batch.column(0).fill_null(-(1 << 63)).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            raws = batch.column(5).to_pylist()
            sizes = np.array([len(r) for r in raws])
            windows = sizes - LENGTH + 1
            b = np.frombuffer(b"".join(raws), np.uint8)
            begin = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(raws)), windows)
            head = np.cumsum(windows) - windows
            inside = np.arange(len(row)) - np.repeat(head, windows)
            at = np.repeat(begin, windows) + inside
            # the first of equal windows, in the documents' order
            first = _first_equal(rolling(b, LENGTH)[at], at, b)
            alone = batch.column(6).to_numpy(zero_copy_only=False)
            if alone.any():
                yield batch.filter(pa.array(alone & (first[head] == head))).select(_NAMES)
            place = start[row] + inside
            flagged = (place != place[first]) | (doc[row] != doc[row[first]]) | (own[row] != own[row[first]])  # not the same row again
            # flagged windows of a run that follow each other are one span
            follows = np.concatenate([[False], flagged[:-1] & (row[1:] == row[:-1])])
            s = np.flatnonzero(flagged & ~follows)
            if not s.size:
                continue
            ends_here = flagged & ~np.concatenate([follows[1:] & flagged[1:], [False]])
            e = np.flatnonzero(ends_here)
            part = pa.array(row[s])
            spans = [batch.column(0).take(part), batch.column(1).take(part), pa.array(start[row[s]] + inside[s]), pa.array(start[row[e]] + inside[e] + LENGTH)]
            yield pa.RecordBatch.from_arrays([*spans, pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.binary()), pa.array(np.zeros(len(s), bool))], _NAMES)

    return runs.mapInArrow(run, _RUN)


def find(docs: DataFrame, *, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text) with hash, and spans: array of (start, stop) in bytes that repeat what is earlier."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text")).withColumn("hash", F.xxhash64("text"))
    # copies of an earlier document as a whole
    long = docs.where(F.octet_length("text") >= LENGTH).select("doc_id", "hash", F.octet_length("text").alias("size"), F.md5("text").alias("check"))
    earliest = long.groupBy("hash", "check").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"), F.countDistinct(F.struct("doc_id")).alias("ids"))
    again = materialize(earliest.where("ids > 1").select("hash", "check", F.col("first.doc_id").alias("first")))
    copies = materialize(long.join(again, ["hash", "check"]).where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "hash", "size").distinct())
    same = lambda x: F.col("d.doc_id").eqNullSafe(F.col(f"{x}.doc_id")) & (F.col("d.hash") == F.col(f"{x}.hash"))
    rest = docs.alias("d").join(small_enough(copies).alias("c"), same("c"), "left_anti").select("doc_id", "hash", "text")
    counts = materialize(count_owners(rest))
    table = bits.build(counts, "owner")
    runs = shard_runs(rest, table, bits.build(counts.where(F.col("n") > hot), "owner"))
    n = partitions(spark)
    dealt = lambda rows, part: rows.withColumn("part", part).repartition(n, "part").sortWithinPartitions("part")
    salted = F.xxhash64("owner", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(SALTS)))
    level = materialize(merge_shards(dealt(runs, F.when(F.col("alone"), salted).otherwise(F.coalesce("owner", F.xxhash64("doc_id", "start"))))))
    last = merge_shards(dealt(level.where("alone").withColumn("alone", F.lit(False)), F.col("owner")))
    spans = level.where("NOT alone").unionByName(last).select("doc_id", "hash", "start", "stop")
    spans = spans.unionByName(copies.select("doc_id", "hash", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("stop")))
    release(counts)
    spans = spans.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return docs.alias("d").join(spans.alias("s"), same("s"), "left").select("d.doc_id", "d.hash", "d.text", "s.spans")


def cut(text: str | None, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal spans that are gone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    merged: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["stop"]) for x in spans or ()):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    kept, at = [], 0
    for s, e in merged:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]]), merged


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, kept binary, spans) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [cut(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in done], pa.binary()), pa.array([[list(x) for x in s] for _, s in done], pa.list_(pa.list_(pa.int64())))], ["doc_id", "kept", "spans"])

    return find(docs).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, kept binary, spans array<array<long>>")


def digest(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, merged = cut(t, s)
                gone = sum(e - b for b, e in merged)
                rows.append((len(kept) + gone, gone, len(merged), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return find(docs).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
