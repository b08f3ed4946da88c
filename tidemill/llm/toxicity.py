"""Toxicity by class-conditional Kneser-Ney models.

A word is an expression spelled letter by letter: each class has a model of order ORDER over the letters of its words,
counted over every word of every labelled document that isn't held out (fold 4 only calibrates). Both classes back off
to the same lower orders, made of continuation counts over both, so spellings that are rare in either class say nothing
for or against it.

A text's two log-likelihoods are compared over all of its words. Toxic texts are ordinary ones but for some expressions,
so under the toxic hypothesis each word is drawn from the toxic model with probability MIX and else from the ordinary
one; a word with log ratio r then adds log(1 - MIX + MIX * exp(r)). Without that mixture, small differences between the
classes in their everyday words (such as each language's share) drown the expressions that matter. The sum is normalised
by the number of words to the power NORM; a logistic curve turns it into a probability.

The counts are summed and turned into ratios by Spark, for every letter group. The table of ratios that goes to the
workers holds MOST_GRAMS at most (16 bytes each); should there be more, it has the most frequent groups, and words with
others get theirs by joins. Where a ratio is held changes no score.

Defined cases: null texts, and texts without letters, get the curve's value at 0; without toxic labels the score is 0;
contradicting labels of one id count as 1; a labelled row that repeats counts each time; empty tables give empty results;
runs of more than LONGEST letters are read as several words; texts of any length are read whole; columns of docs stay but
for toxic_raw and toxic_score, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import enter, fresh, materialize, release
from tidemill.llm.labelled import fold, join_labels, logistic, usable
from tidemill.llm.shingles import mix

ORDER, LONGEST, DISCOUNT = 5, 40, 0.75
MIX, NORM = 0.01, 0.75
MOST_GRAMS = 4_000_000
FLUSH = 200_000
LETTERS = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


class Ratios(NamedTuple):
    """Log ratios, toxic to ordinary, by the codes of letter groups (see codes()), in order."""

    code: np.ndarray
    ratio: np.ndarray

    @classmethod
    def of(cls, found: DataFrame) -> Ratios:
        """From rows (letters, ratio)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code = codes(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), batch.column(1)], ["code", "ratio"])

        got = found.mapInArrow(run, "code long, ratio double").toArrow()
        code, ratio = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
        order = np.argsort(code)
        return cls(code[order], ratio[order])

    def get(self, code: np.ndarray) -> np.ndarray:
        """The ratios; nan for codes that it doesn't have."""
        if not len(self.code):
            return np.full(len(code), np.nan)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.ratio[at], np.nan)


class Model(NamedTuple):
    grams: Ratios  # of a letter after its context
    contexts: Ratios  # of any letter that neither class has after this context
    a: float
    b: float
    rest: tuple[DataFrame, DataFrame] | None = None  # (gram, ratio) and (context, ratio) of all, where grams hasn't all


_PLACES = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _code(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of n code points from each place."""
    x = np.full(len(at), n, np.uint64)
    for k in range(n):
        x += points[at + k] * _PLACES[k]
    return mix(x)


def codes(groups: list[str]) -> np.ndarray:
    """Of letter groups of one length."""
    n = len(groups[0]) if groups else 0
    return _code(_points("".join(groups)), np.arange(len(groups)) * n, n)


def count_words(labelled: DataFrame) -> DataFrame:
    """(word, y, n) from rows (text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for y, c in enumerate(counts):
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["word", "y", "n"])
                c.clear()

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y].update(words_of(text))
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield from flush()
        yield from flush()

    return labelled.select("text", "y").mapInArrow(run, "word string, y int, n long").groupBy("word", "y").agg(F.sum("n").alias("n"))


def _spelled():
    """The letter groups of a column `word`."""
    spelled = F.concat(F.lit("^" * (ORDER - 1)), "word", F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substr(spelled, i, F.lit(ORDER)))


def count_grams(words: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): how often each group of ORDER letters occurs in either class."""
    grams = words.select(F.explode(_spelled()).alias("gram"), "y", "n")
    return grams.groupBy("gram").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("ordinary"))


def log_ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio, n) and (context, ratio), as Model.grams and Model.contexts."""
    context, below = F.expr("substr(gram, 1, length(gram) - 1)").alias("context"), F.expr("substr(gram, 2)").alias("below")
    held = lambda n: F.greatest(n - DISCOUNT, F.lit(0.0))
    orders, above = [], grams
    for _ in range(ORDER - 1):  # continuation counts: how many letters stand before
        above = materialize(above.groupBy(below.alias("gram")).agg(F.count("*").alias("n")))
        orders.append(above)
    letters, total = orders[-1].agg(F.count("*"), F.sum("n")).first()
    backoff = orders[-1].select("gram", ((held(F.col("n")) + DISCOUNT * letters / max(1, letters)) / F.lit(total or 1)).alias("p"))
    for here in reversed(orders[:-1]):
        sums = here.groupBy(context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        joined = here.select("gram", "n", context, below).join(sums, "context").join(backoff.select(F.col("gram").alias("below"), "p"), "below")
        backoff = materialize(joined.select("gram", ((held(F.col("n")) + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("total")).alias("p")))
    classes = ("toxic", "ordinary")
    sums = grams.groupBy(context).agg(*[x for c in classes for x in (F.sum(c).alias(f"total_{c}"), F.count_if(F.col(c) > 0).alias(f"types_{c}"))])
    weight = [F.when(F.col(f"total_{c}") > 0, DISCOUNT * F.col(f"types_{c}") / F.col(f"total_{c}")).otherwise(1.0) for c in classes]
    joined = grams.select("gram", *classes, context, below).join(sums, "context").join(backoff.select(F.col("gram").alias("below"), "p"), "below")
    p = [F.when(F.col(f"total_{c}") > 0, held(F.col(c)) / F.col(f"total_{c}")).otherwise(0.0) + w * F.col("p") for c, w in zip(classes, weight, strict=True)]
    ratios = materialize(joined.select("gram", F.log(p[0] / p[1]).alias("ratio"), (F.col("toxic") + F.col("ordinary")).alias("n")))
    contexts = materialize(sums.select("context", F.log(weight[0] / weight[1]).alias("ratio")))
    release(*orders)
    return ratios, contexts


class Scorer:
    """Of words, which it remembers (up to KEPT of them), and of texts."""

    KEPT = 300_000

    def __init__(self, grams: Ratios, contexts: Ratios):
        self.grams, self.contexts = grams, contexts
        self.seen: dict[str, float] = {}

    def words(self, words: list[str], *, strict: bool = False) -> np.ndarray:
        """What each word adds to a text's sum; with strict, nan for words with letter groups that grams hasn't."""
        if not words:
            return np.empty(0)
        pad = "^" * (ORDER - 1)
        points = _points("".join([f"{pad}{w}$" for w in words]))
        sizes = np.array([len(w) + 1 for w in words])
        begin = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(words)) * (ORDER - 1), sizes)
        r = self.grams.get(_code(points, at, ORDER))
        missing = np.flatnonzero(np.isnan(r))
        if missing.size and not strict:
            r[missing] = np.nan_to_num(self.contexts.get(_code(points, at[missing], ORDER - 1)))
        return added(np.add.reduceat(r, begin))

    def learn(self, words: set[str], *, strict: bool = False) -> dict[str, float]:
        if len(self.seen) > self.KEPT:
            self.seen.clear()
        new = [w for w in words if w not in self.seen]
        self.seen.update(zip(new, self.words(new, strict=strict).tolist(), strict=True))
        return self.seen

    def texts(self, texts: list[str | None]) -> list[float]:
        out = []
        for at in range(0, len(texts), 256):
            every = [words_of(t) for t in texts[at : at + 256]]
            seen = self.learn(set().union(*every))
            out += [sum(map(seen.__getitem__, w)) / max(1, len(w)) ** NORM for w in every]
        return out


def added(r: np.ndarray) -> np.ndarray:
    return np.log(1 - MIX + MIX * np.exp(np.minimum(r, 50.0)))


def _raw(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column toxic_raw."""
    docs = docs.drop("toxic_raw")
    shared = docs.sparkSession.sparkContext.broadcast((model.grams, model.contexts))
    if model.rest is not None:
        return _raw_joined(docs, shared, *model.rest)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        scorer = Scorer(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.texts(batch.column(at).to_pylist()), pa.float64())], [*batch.schema.names, "toxic_raw"])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("toxic_raw")).schema)


def _raw_joined(docs: DataFrame, shared, ratios: DataFrame, contexts: DataFrame) -> DataFrame:
    """_raw by joins for the words with letter groups that the workers don't hold."""
    row = fresh(docs, "row")
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text a row with its words' number and the sum of those that are held; and one for each other word."""
        scorer = Scorer(*shared.value)
        for batch in batches:
            for begin in range(0, len(batch), 256):
                some = batch.slice(begin, 256)
                every = [Counter(words_of(t)) for t in some.column(1).to_pylist()]
                seen = scorer.learn(set().union(*every), strict=True)
                out: list[tuple] = []
                for r, words in zip(some.column(0).to_pylist(), every, strict=True):
                    out.append((r, None, words.total(), sum(n * seen[w] for w, n in words.items() if not math.isnan(seen[w]))))
                    out += [(r, w, n, None) for w, n in words.items() if math.isnan(seen[w])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.float64()), strict=True)], ["row", "word", "n", "value"])

    used = materialize(docs.select(F.col(row).alias("row"), "text").mapInArrow(split, "row long, word string, n long, value double"))
    words = used.where("word IS NOT NULL").select("word").distinct()
    grams = words.select("word", F.explode(_spelled()).alias("gram")).withColumn("context", F.expr("substr(gram, 1, length(gram) - 1)"))
    grams = grams.join(ratios.select("gram", "ratio"), "gram", "left").join(contexts.withColumnRenamed("ratio", "other"), "context", "left")
    total = F.least(F.sum(F.coalesce("ratio", "other", F.lit(0.0))), F.lit(50.0))
    values = grams.groupBy("word").agg(F.log(1 - MIX + MIX * F.exp(total)).alias("adds"))
    values = used.where("word IS NOT NULL").select("row", "n", "word").join(values, "word").select("row", (F.col("n") * F.col("adds")).alias("value"), F.lit(None).cast("long").alias("words"))
    values = values.unionByName(used.where("word IS NULL").select("row", "value", F.col("n").alias("words")))
    raw = values.groupBy("row").agg((F.sum("value") / F.greatest(F.max("words"), F.lit(1)) ** NORM).alias("toxic_raw")).withColumnRenamed("row", row)
    return docs.join(raw, row, "left").withColumn("toxic_raw", F.coalesce("toxic_raw", F.lit(0.0))).drop(row)


def fit(docs: DataFrame, labels: DataFrame, *, most: int = MOST_GRAMS) -> Model:
    learn = usable(labels, "toxic")
    words = count_words(join_labels(docs.select("doc_id", "text"), learn.where("fold <> 4").select("doc_id", "y")))
    grams = materialize(count_grams(words))
    if grams.where("toxic > 0").isEmpty():
        release(grams)
        none = Ratios(np.empty(0, np.uint64), np.empty(0))
        return Model(none, none, 0.0, -60.0)
    ratios, contexts = log_ratios(grams)
    release(grams)
    least = 1
    while ratios.where(F.col("n") >= least).count() > most:
        least *= 2
    held = Ratios.of(ratios.where(F.col("n") >= least).select("gram", "ratio"))
    if least > 1:
        model = Model(held, Ratios(np.empty(0, np.uint64), np.empty(0)), 1.0, 0.0, (ratios, contexts))
    else:
        model = Model(held, Ratios.of(contexts.select("context", "ratio")), 1.0, 0.0)
        release(ratios, contexts)
    tune = _raw(join_labels(docs.select("doc_id", "text"), learn.where("fold = 4").select("doc_id", "y")).select("y", "text"), model)
    bins = sorted(tune.groupBy("y", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(20.0), "toxic_raw")), 3).alias("x")).count().collect())  # 42002 at most
    if len({r.y for r in bins}) < 2:
        return model._replace(a=4.0, b=-4.0)
    a, b = logistic(np.array([r.x for r in bins]), np.array([r.y for r in bins], float), np.array([r["count"] for r in bins], float))
    return model._replace(a=a, b=b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column toxic_score (any column of that name is replaced)."""
    line = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("toxic_raw") * model.a + model.b))
    return _raw(docs.drop("toxic_score"), model).withColumn("toxic_score", 1 / (1 + F.exp(-line))).drop("toxic_raw")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


