"""Substring dedup by paragraphs: MinHash bands, exact Jaccard, and one paragraph kept of each component.

Paragraphs are lines of LEAST words or more, and shorter lines that follow each other (up to a blank or a long one) if
they have as many together. Those whose signatures collide in a band (Lists of BANDS bands of ROWS coordinates, which
join paragraphs of similarity 0.8 with probability 0.998) are confirmed by the exact Jaccard index of their 5-word
shingles, and of each component of links all but the first paragraph (by doc_id, then place) go.

A passage that is set into different paragraphs makes no such pair. So each document is also cut, whatever its lines, into
pieces at words whose hash is the least within REACH words on both sides; passages are cut alike wherever they stand.
Pieces that are equal (by 128 bits of two hashes of their words) to an earlier one go where RUN words or more of them
follow each other. A passage begins and ends within a piece, so those of RUN words are found only if their ends fall on
cuts; README.md has figures. Equal pieces that follow each other (words that repeat in turn) travel as one row, and keys
of more than HOT rows are joined in parts.

Band keys and pieces are counted first; only units with a key that occurs again are sent on, through a table of bits of
bounded size whose collisions cost work but change nothing.

Defined cases: null texts are empty; shorter texts keep all; rows with equal doc_id and text are one document and get
the same result; a null doc_id comes first; an empty table gives an empty result; texts of any length are read whole;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import bits, near
from tidemill.llm.common import materialize, release
from tidemill.llm.repeats import sliding_min
from tidemill.llm.shingles import SIZE, describe, fold, fold_lines, mix, shingle_sets, shingles, signatures, word_hashes, word_places

LEAST, RUN, REACH, BANDS, ROWS, HOT = 20, 10, 3, 12, 4, 4000
NUM, DEN, MATCH = 80, 100, 38
_TURN = np.uint64(0xA24BAED4963EE407 | 1)
_BACK = np.uint64(pow(int(_TURN), -1, 1 << 64))
_SECOND = np.uint64(0x9FB21C651E98DF25 | 1)  # multiplies words' hashes for the second hash of a piece


def paragraph_words(raw: bytes, start: np.ndarray) -> np.ndarray:
    """Pairs [first, last) of words of each paragraph that counts."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    edge = np.concatenate([[0], np.searchsorted(start, breaks), [len(start)]])
    size = np.diff(edge)
    short = (size > 0) & (size < LEAST)
    begin = np.flatnonzero(~(short & np.concatenate([[False], short[:-1]])))
    pairs = np.stack([edge[begin], edge[np.append(begin[1:], len(size))]], 1)
    return pairs[pairs[:, 1] - pairs[:, 0] >= LEAST]


def pieces(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs [first, last) of words, two keys) of the pieces of a text with these word hashes."""
    n = len(h)
    if n < RUN:
        return np.empty((0, 2), np.int64), np.empty((0, 2), np.uint64)
    two = mix(h[:-1] + h[1:] * _TURN)
    none = np.full(REACH, ~np.uint64(0))
    least = two == sliding_min(np.concatenate([none, two, none]), 2 * REACH + 1)  # each of equals: words that repeat in turn make equal pieces
    edge = np.unique(np.concatenate([[0], np.flatnonzero(least), [n]]))
    power, back = np.full(n, _TURN), np.full(n, _BACK)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.multiply.accumulate(back)[edge[:-1]]
    keys = np.empty((len(edge) - 1, 2), np.uint64)
    for k, words in enumerate((h, mix(h * _SECOND))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power)])
        keys[:, k] = mix((sums[edge[1:]] - sums[edge[:-1]]) * back + np.diff(edge).astype(np.uint64))
    return np.stack([edge[:-1], edge[1:]], 1), keys


def _units(texts: list[str | None], lists: near.Lists):
    """For each text: (word hashes, paragraph pairs, piece pairs, piece keys); and the list keys of all paragraphs."""
    per_text, runs = [], []
    for t in texts:
        raw = fold_lines(t)
        h, start, _ = word_hashes(raw.replace(b"\n", b" ")) if raw else (np.empty(0, np.uint64), np.empty(0, np.int64), None)
        pairs = paragraph_words(raw, start)
        if len(pairs):
            s = shingles(h)
            runs += [s[a : b - SIZE + 1] for a, b in pairs.tolist()]
        per_text.append((h, pairs, *pieces(h)))
    if not runs:
        return per_text, np.empty((0, len(lists.choices)), np.uint64)
    at = np.cumsum([0, *map(len, runs[:-1])])
    return per_text, lists.keys(signatures(np.concatenate(runs), at, np.unique(lists.choices)))


def count_keys(docs: DataFrame, lists: near.Lists) -> DataFrame:
    """(owner, n): band keys and piece keys that occur more than once in rows (doc_id, hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = []
            for at in range(0, len(batch), 256):
                per_text, keys = _units(batch.column(2).slice(at, 256).to_pylist(), lists)
                seen += [keys.ravel(), *(k[:, 0] for *_, k in per_text)]
            key, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["owner", "n"])

    return docs.mapInArrow(run, "owner long, n long").groupBy("owner").agg(F.sum("n").alias("n")).where("n > 1")


_SCHEMA = f"doc_id long, hash long, first long, last long, one long, piece long, piece2 long, {near.SIGNED}"


def repeated_units(docs: DataFrame, table: np.ndarray, lists: near.Lists) -> DataFrame:
    """_SCHEMA rows: paragraphs (piece null) and runs of equal pieces (n null; the first ends at one) with a key in the table."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                per_text, keys = _units(part.column(2).to_pylist(), lists)
                doc = np.repeat(np.arange(len(part)), [len(p) for _, p, _, _ in per_text])
                pairs = np.concatenate([p for _, p, _, _ in per_text]).reshape(-1, 2)
                go = np.flatnonzero(bits.holds(shared.value, keys.ravel()).reshape(keys.shape).any(1))
                if go.size:
                    s = describe(shingle_sets([per_text[d][0][a:b] for d, (a, b) in zip(doc[go].tolist(), pairs[go].tolist(), strict=True)]))
                    binary = [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (s.signatures, s.signatures.astype(np.uint8))]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[go])), part.column(1).take(pa.array(doc[go])), pa.array(pairs[go, 0]), pa.array(pairs[go, 1]), *[pa.nulls(len(go), pa.int64())] * 3, pa.array(s.sizes), *(pa.array(s.keys[:, k].view(np.int64)) for k in (0, 1)), *binary, pa.array(s.grams, pa.binary())], names)
                doc = np.repeat(np.arange(len(part)), [len(k) for *_, k in per_text])
                pairs, key = np.concatenate([p for _, _, p, _ in per_text]), np.concatenate([k for *_, k in per_text])
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1) | (doc[1:] != doc[:-1])]) if len(key) else [])
                one, pairs = pairs[new, 1], np.stack([pairs[new, 0], pairs[np.append(new[1:], len(key)) - 1, 1] if len(key) else pairs[new, 1]], 1)
                doc, key = doc[new], key[new]
                go = np.flatnonzero(bits.holds(shared.value, key[:, 0]))
                if go.size:
                    none = [pa.nulls(len(go), pa.int64())] * 3 + [pa.nulls(len(go), pa.binary())] * 3
                    both = [pa.array(key[go, k].view(np.int64)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[go])), part.column(1).take(pa.array(doc[go])), pa.array(pairs[go, 0]), pa.array(pairs[go, 1]), pa.array(one[go]), *both, *none], names)

    return docs.mapInArrow(run, _SCHEMA)


def _place():
    return F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash", "first")


def find(docs: DataFrame, *, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text) with hash, and found: array of (first, last, earlier, whole) of repeated words.

    earlier is the document with the first copy; whole is true of paragraphs.
    """
    lists = near.Lists.of(BANDS, ROWS)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text")).select("doc_id", "hash", "text")
    counts = materialize(count_keys(docs, lists))
    units = repeated_units(docs, bits.build(counts, "owner"), lists)
    release(counts)
    units = materialize(units.withColumn("row", F.monotonically_increasing_id()))

    paragraphs = units.where("piece IS NULL")
    classes = materialize(paragraphs.groupBy("k1", "k2").agg(F.min("row").alias("cid"), F.min(_place()).alias("least")))
    roots = near.connected(paragraphs, classes, num=NUM, den=DEN, match=MATCH, lists=lists, need=1)
    placed = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    placed = materialize(placed.join(placed.groupBy("root").agg(F.min("least").alias("kept")), "root").select("k1", "k2", "kept"))
    release(classes, roots)
    again = paragraphs.select("k1", "k2", "doc_id", "hash", "first", "last").join(placed, ["k1", "k2"]).where(_place() > F.col("kept"))

    small, keys = units.where("piece IS NOT NULL").select("piece", "piece2", "doc_id", "hash", "first", "last", "one"), ["piece", "piece2"]
    least = small.groupBy(*keys).agg(F.min(_place()).alias("kept"), F.count("*").alias("n"), F.max(F.col("one") < F.col("last")).alias("again"))
    least = materialize(least.where("n > 1 OR again").select(*keys, "kept", F.ceil(F.col("n") / hot).alias("parts")))
    # a piece of very many rows is dealt over parts of hot rows
    small = small.join(near.small_enough(least.where("parts > 1").select(*keys, "parts")), keys, "left")
    small = small.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "hash", "first"), "parts"), F.lit(0))).drop("parts")
    least = least.select(*keys, "kept", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # of the run with the first copy, all but the first piece repeat
    later = small.join(least, [*keys, "part"]).withColumn("first", F.when(_place() > F.col("kept"), F.col("first")).otherwise(F.col("one"))).where("first < last")

    columns = ["doc_id", "hash", F.struct("first", "last", F.col("kept.doc_id").alias("earlier"), F.col("whole")).alias("found")]
    every = again.withColumn("whole", F.lit(True)).select(*columns).unionByName(later.withColumn("whole", F.lit(False)).select(*columns))
    every = every.groupBy("doc_id", "hash").agg(F.collect_set("found").alias("found"))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.hash") == F.col("f.hash"))
    return docs.alias("d").join(every.alias("f"), same, "left").select("d.doc_id", "d.hash", "d.text", "f.found")


def cut(text: str | None, found: list[dict] | None) -> tuple[int, int, list[tuple[int, int]], bytes, list[int]]:
    """(words, words that go, their spans, what is left, documents with earlier copies)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not found:
        return len(fold(text).split()), 0, [], raw, []
    start, end = word_places(fold(text))
    gone, earlier = np.zeros(len(start) + 1, bool), set()
    small = np.zeros(len(start) + 1, bool)
    for f in found:
        (gone if f["whole"] else small)[f["first"] : f["last"]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], small.astype(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a >= RUN:
            gone[a:b] = True
    for f in found:
        if gone[f["first"]] and f["earlier"] is not None:
            earlier.add(f["earlier"])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
    spans = list(zip(edge[::2], edge[1::2], strict=True))
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : int(start[a])])
        at = int(end[b - 1])
    return len(start), int(gone.sum()), spans, b"".join([*kept, raw[at:]]), sorted(earlier)


def _map(found: DataFrame, schema: str, row) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(*cut(t, f)) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) if not isinstance(c[0], list) else pa.array(c, pa.list_(pa.int64())) for c in zip(*rows, strict=True))], names)

    return found.select("doc_id", "text", "found").mapInArrow(run, schema)


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): what is left of each row's text."""
    return _map(find(docs), "doc_id long, kept string", lambda n, gone, spans, kept, earlier: (kept.decode("utf-8", "surrogatepass"),))


def digest(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, earlier_docs array<long>"
    return _map(find(docs), schema, lambda n, gone, spans, kept, earlier: (n, gone, len(spans), hashlib.sha256(kept).hexdigest(), earlier))
