"""Benchmark decontamination by an FM-index per training shard.

Each task cuts its documents into shards of about shard_bytes. Only runs of benchmark words at least as long as the
shortest window can hold a window, so a shard's index covers just those runs: word ids, suffix array, Burrows-Wheeler
transform in a wavelet matrix, and every SAMPLE-th suffix position. All windows are searched backward at once, hits are
located by walking to sampled positions, and their spans are merged per document.

The benchmark is read in blocks of block_bytes at most (plus one item); each block is broadcast on its own and the tasks
go through them one after the other, so no size of benchmark is ever held whole.

Defined cases: a null or empty text has no words and is never hit; an item whose text is null or has no words has no
window; an item without an id can hit words but is not listed; equal items count once; rows that repeat (also the
doc_id) each give a row; empty tables of documents or items give empty results or no hits; texts of any length are read
whole, as a shard of their own if they are longer; other columns of the inputs are ignored by the search and kept by decontaminate().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import enter
from tidemill.llm.suffix import suffix_array

WINDOW = 10
SAMPLE = 8
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 32 << 20

# lower-cases A-Z; what is no word character becomes a space
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WaveletMatrix:
    """Rank and access over an integer array, vectorised over many queries."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.levels = len(values), []
        x = values.astype(np.uint32)
        for b in range(bits - 1, -1, -1):
            bit = ((x >> np.uint32(b)) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(np.uint64)
            count = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=count[1:])
            self.levels.append((b, packed, count, self.n - int(count[-1])))
            x = np.concatenate([x[~bit], x[bit]])

    @staticmethod
    def _ones(packed: np.ndarray, count: np.ndarray, i: np.ndarray) -> np.ndarray:
        at, off = i >> 6, (i & 63).astype(np.uint64)
        return count[at] + np.bitwise_count(packed[at] & ((np.uint64(1) << off) - np.uint64(1))).astype(np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs before position i."""
        low = np.zeros(len(i), np.int64)
        for b, packed, count, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            r_low, r = self._ones(packed, count, low), self._ones(packed, count, i)
            low, i = np.where(one, zeros + r_low, low - r_low), np.where(one, zeros + r, i - r)
        return i - low

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it occurs before i."""
        symbol, low = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for _, packed, count, zeros in self.levels:
            one = ((packed[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            r_low, r = self._ones(packed, count, low), self._ones(packed, count, i)
            low, i = np.where(one, zeros + r_low, low - r_low), np.where(one, zeros + r, i - r)
            symbol = (symbol << 1) | one
        return symbol, i - low


class FMIndex:
    """Over symbols >= 1; 0 ends the text."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0)
        sa, _ = suffix_array(text)
        self.bwt = WaveletMatrix(text[sa - 1], max(1, int(symbols).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        marked = sa % SAMPLE == 0
        self.marked, self.sampled = np.cumsum(marked), sa[marked]
        self.is_marked, self.n = marked, len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots [low, high) of the suffixes that begin with each pattern; rows of patterns are filled from the left."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not live.size:
                continue
            c = patterns[live, lengths[live] - back]
            low[live] = self.before[c] + self.bwt.rank(c, low[live])
            high[live] = self.before[c] + self.bwt.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, slots: np.ndarray) -> np.ndarray:
        """Text positions of suffix slots: steps back until a sampled position is met."""
        out, steps, live, at = np.empty(len(slots), np.int64), 0, np.arange(len(slots)), slots
        while live.size:
            hit = self.is_marked[at]
            out[live[hit]] = self.sampled[self.marked[at[hit]] - 1] + steps
            live, at = live[~hit], at[~hit]
            c, r = self.bwt.access_rank(at)
            at = self.before[c] + r
            steps += 1
        return out


class Phrases:
    """The windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners = found.setdefault(tuple(ids[i : i + window]), set())
                if item is not None:
                    owners.add(item)
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for row, w in zip(self.patterns, found, strict=True):
            row[: len(w)] = w
        self.names = sorted({x for owners in found.values() for x in owners})
        number = {x: i for i, x in enumerate(self.names)}
        self.owners = [np.array(sorted(number[x] for x in owners), np.int64) for owners in found.values()]
        self.shortest = int(self.lengths.min()) if found else 0


def search_shard(docs: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """Covered word positions of the shard's documents laid end to end: (offsets, starts, ends, names by document)."""
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in docs])]).astype(np.int64)
    names: list[set[str]] = [set() for _ in docs]
    none = np.empty(0, np.int64)
    if not len(phrases.lengths) or not offsets[-1]:
        return offsets, none, none, names
    get, n = phrases.vocabulary.get, int(offsets[-1])
    ids = np.zeros(n + len(docs), np.int64)  # a gap after each document
    at = offsets + np.arange(len(docs) + 1)
    for k, w in enumerate(docs):
        ids[at[k] : at[k] + len(w)] = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
    inside = np.concatenate([[False], ids > 0, [False]])
    begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not begin.size:
        return offsets, none, none, names
    size = end - begin + 1  # with the separator 1
    run_at = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(begin - run_at[:-1], size) + np.arange(run_at[-1])
    text = np.where(place < np.repeat(end, size), ids[np.minimum(place, len(ids) - 1)], 1)
    index = FMIndex(text, len(phrases.vocabulary) + 2)
    low, high = index.search(phrases.patterns, phrases.lengths)
    many = high - low
    which = np.repeat(np.arange(len(many)), many)
    if not which.size:
        return offsets, none, none, names
    slots = np.arange(which.size) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    position = place[index.locate(slots)]
    doc = np.searchsorted(at, position, side="right") - 1
    for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
        names[d].update(phrases.names[i] for i in phrases.owners[p])
    starts = position - doc  # back to positions without gaps
    return offsets, starts, starts + phrases.lengths[which], names


def merged(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True for each of n words that some span covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text")).distinct()
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        size += len(text or "") + 16
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: its id, n_words, n_hit, items (sorted list) and spans (list of [start, end) in words)."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(Phrases(b, window)) for b in _blocks(benchmark, block_bytes)]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(source.dtypes)['id']}, n_words long, n_hit long, items array<string>, spans array<array<int>>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontaminate")
        def flush(ids: list[pa.Array], texts: list[str | None]) -> pa.RecordBatch:
            docs_words = [words_of(t) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in docs_words])]).astype(np.int64)
            names: list[set[str]] = [set() for _ in texts]
            starts, ends = [], []
            for b in blocks:
                _, s, e, found = search_shard(docs_words, b.value)
                starts.append(s)
                ends.append(e)
                for own, new in zip(names, found, strict=True):
                    own |= new
                if len(blocks) > 1:
                    b.__dict__.pop("_value", None)  # one block in memory at a time
            n = int(offsets[-1])
            covered = merged(np.concatenate(starts), np.concatenate(ends), n) if starts else np.zeros(n, bool)
            # no span crosses documents, but two may touch at a border
            edge = np.zeros(n + 1, bool)
            edge[offsets] = True
            left = np.flatnonzero(covered & (edge[:-1] | ~np.concatenate([[False], covered[:-1]]))) if n else np.empty(0, np.int64)
            right = np.flatnonzero(covered & (edge[1:] | ~np.concatenate([covered[1:], [False]]))) + 1 if n else np.empty(0, np.int64)
            hits = np.concatenate([[0], np.cumsum(covered)]) if n else np.zeros(1, np.int64)
            bound = np.searchsorted(left, offsets)
            spans = [[[int(a - offsets[k]), int(z - offsets[k])] for a, z in zip(left[bound[k] : bound[k + 1]], right[bound[k] : bound[k + 1]], strict=True)] for k in range(len(texts))]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array(np.diff(offsets)), pa.array(hits[offsets[1:]] - hits[offsets[:-1]]), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                ["id", "n_words", "n_hit", "items", "spans"],
            )

        ids: list[pa.Array] = []
        texts: list[str | None] = []
        size = 0
        for batch in batches:
            column, at = batch.column(1).to_pylist(), 0
            for k, t in enumerate(column):
                size += len(t or "")
                if size >= shard_bytes:
                    ids.append(batch.column(0).slice(at, k + 1 - at))
                    texts += column[at : k + 1]
                    yield flush(ids, texts)
                    ids, texts, size, at = [], [], 0, k + 1
            if at < len(column):
                ids.append(batch.column(0).slice(at))
                texts += column[at:]
        if texts:
            yield flush(ids, texts)

    return source.mapInArrow(search, schema).withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a window of some benchmark item; same columns."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(Phrases(b, options.get("window", WINDOW))) for b in _blocks(benchmark, options.get("block_bytes", BLOCK_BYTES))]
    text_at, limit = docs.columns.index(options.get("text_col", "text")), options.get("shard_bytes", SHARD_BYTES)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontaminate")
        for batch in batches:
            column = batch.column(text_at).to_pylist()
            sizes = np.cumsum([len(t or "") for t in column])
            cut = np.searchsorted(sizes, np.arange(limit, (sizes[-1] if len(sizes) else 0) + limit, limit), side="left") + 1
            clean, at = np.ones(len(column), bool), 0
            for z in cut:
                z = min(int(z), len(column))
                if z <= at:
                    continue
                shard = [words_of(t) for t in column[at:z]]
                for b in blocks:
                    offsets, starts, _, _ = search_shard(shard, b.value)
                    hit = np.searchsorted(offsets, starts, side="right") - 1
                    clean[at + hit] = False
                    if len(blocks) > 1:
                        b.__dict__.pop("_value", None)
                at = z
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from find_contamination()."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

