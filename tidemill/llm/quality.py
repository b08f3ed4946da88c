"""Quality classifier by compression: one zstandard dictionary of good texts, one of bad.

A text is cut into blocks of BLOCK bytes and each block is compressed with either dictionary. The difference of the two
sizes by byte of text is calibrated to a probability by a logistic curve. The dictionaries are trained by one task on a
bounded sample of labelled rows: SAMPLE_ROWS of each class at most, those with the smallest hash of the id (ties: the
id), of which a row that would take the sample past SAMPLE_BYTES stays out; rows are read whole. The curve comes from all
rows of another fold. Rows of fold 0 teach nothing. Everything that is scored is scored over its whole text.

Defined cases: null and empty texts have difference 0 and get the curve's value there; with one class only, the score is
that class; without any labels it is 1 (nothing is known to be bad); contradicting labels of one id count as 1; a
labelled row that repeats counts each time; empty tables give empty results; other columns of docs stay, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import enter, fresh
from tidemill.llm.labelled import fold, join_labels, logistic, usable

THRESHOLD = 0.3
SAMPLE_ROWS, SAMPLE_BYTES, PIECE = 3000, 32 << 20, 1024
DICTIONARY, LEVEL, BLOCK = 256 << 10, 3, 1024


class Model(NamedTuple):
    good: bytes
    bad: bytes
    a: float
    b: float


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False)
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=options)
    kind = zstandard.ZstdCompressionDict(dictionary)
    kind.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=kind, compression_params=options)


def difference(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Bytes that the good dictionary saves against the bad one, by byte of text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return 0.0
    g = b = 0
    for i in range(0, len(raw), BLOCK):
        block = raw[i : i + BLOCK]
        g += len(good.compress(block))
        b += len(bad.compress(block))
    return (b - g) / len(raw)


def _dictionary(pieces: list[bytes]) -> bytes:
    size = min(DICTIONARY, sum(map(len, pieces)))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: use it as it is
        return b"".join(pieces)[-DICTIONARY:]


def dictionaries(sample: DataFrame, most: int = SAMPLE_BYTES) -> dict[int, bytes]:
    """The dictionary of each class, from rows (y, text, place) in the order of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[bytes]] = {}
        size = {0: 0, 1: 0}
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if raw and size[y] + len(raw) <= most:
                    size[y] += len(raw)
                    pieces.setdefault(y, []).extend(raw[i : i + PIECE] for i in range(0, len(raw), PIECE))
        for y, some in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([_dictionary(some)], pa.binary())], ["y", "dictionary"])

    one = sample.repartition(1).sortWithinPartitions("y", "place").select("y", "text")  # bounded by its rows
    return {r.y: bytes(r.dictionary) for r in one.mapInArrow(run, "y int, dictionary binary").collect()}


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> Model:
    learn = usable(labels, "quality")
    seen = {r.y for r in learn.groupBy("y").count().collect()}
    if len(seen) < 2:
        return Model(b"", b"", 0.0, -60.0 if seen == {0} else 60.0)
    place = F.struct(F.xxhash64("doc_id"), "doc_id")
    train = learn.where("fold <> 4").select("doc_id", "y", place.alias("place"))
    chosen = train.where("y = 0").orderBy("place").limit(rows).unionByName(train.where("y = 1").orderBy("place").limit(rows))
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * rows rows
    trained = dictionaries(picked.select("y", "text", F.struct("place", F.xxhash64("text")).alias("place")), most)
    model = Model(trained.get(1, b""), trained.get(0, b""), 1.0, 0.0)
    tune = differences(join_labels(docs.select("doc_id", "text"), learn.where("fold = 4").select("doc_id", "y")).select("y", "text"), model, "x")
    bins = tune.groupBy("y", F.round(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), "x")), 4).alias("x")).count().orderBy("y", "x").collect()  # 80002 at most
    if len({r.y for r in bins}) < 2:
        return model._replace(a=0.0, b=0.0)
    a, b = logistic(np.array([r.x for r in bins]), np.array([r.y for r in bins], float), np.array([r["count"] for r in bins], float))
    return model._replace(a=a, b=b)


def differences(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs with a further column `name`: difference() of the text."""
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        m = shared.value
        good, bad = compressor(m.good), compressor(m.bad)
        for batch in batches:
            found = [difference(t, good, bad) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(name)).schema)


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """docs with a further column `name`, which docs must not have."""
    line = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col(name) * model.a + model.b))
    return differences(docs, model, name).withColumn(name, 1 / (1 + F.exp(-line)))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold; same columns."""
    name = fresh(docs, "quality_score")
    return score(docs, fit(docs, labels), name).where(F.col(name) >= threshold).select(*docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


