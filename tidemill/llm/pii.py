"""Personal data: fixed patterns first, then bootstrapped contextual extraction of identifiers that they don't know.

What the fixed patterns find (emails, IP addresses, card and phone numbers) are the seeds, with confidence 1. Strings
shaped like keys (LONG hexadecimal digits or more, letters and digits mixed) are weak seeds: their shape gives them
confidence WEAK, which is below THRESHOLD, so context has to say the rest. Every other token that holds a digit, and
every value in `key=value`, is a candidate, whatever its length. All of them induce lexical patterns: the word before,
the word after, the two together, and the key that a token carries or follows (`key=value`, `key: value`).

Patterns and instances form a graph that Spark scores by turns: a pattern's confidence is its instances' mean confidence,
against PRIOR doubtful ones and the ordinary words that stand in the same context in the documents that show it; only
patterns supported by SUPPORT different values that are seeds or were confident in the round before count. An
instance's confidence is that of its BEST best patterns (1 - the product of their doubts). So each round's confident
patterns bring new instances, and the contexts of those bring new patterns. Candidates of a card's or an address's full
shape and length that failed its check are refuted: they stay at 0 and speak against their patterns. After ROUNDS rounds,
candidates and weak seeds of confidence THRESHOLD and more are spans of kind `id`.

Defined cases: null texts are empty; rows that repeat each count as evidence once per row, but support counts different
values; documents without candidates skip the graph; empty tables give empty results; texts of any length are read
whole, in time that grows with their length; overlapping base spans of different kinds all stay; offsets are code points,
ends exclusive. find() returns all columns of docs, whatever their names: where they clash with its own, those get
underscores (common.fresh).
"""

from __future__ import annotations

import bisect
import collections
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import enter, fresh, materialize, release

KINDS = ("email", "ip", "card", "phone")
LEARNED = "id"
ROUNDS, SUPPORT, PRIOR, THRESHOLD, BEST = 4, 5, 4.0, 0.9, 4
LONG, WEAK = 32, 0.8

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits, so it isn't tried there
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT, _SPACE = re.compile(r"[0-9]"), re.compile(r"\s")
_KEY_BEFORE = re.compile(r"([^\s\"'=:]{2,40})[\"']?\s?[=:]\s?[\"']?$")
_VALUE = re.compile(r"=[ \t]?[\"']?([^\s\"'=]+)")
_KEYLIKE = re.compile(r"(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])(?:[0-9a-f]{%d,128}|[0-9A-F]{%d,128})" % (LONG, LONG))
_REFUTED = re.compile(r"[0-9](?:[ -]?[0-9]){11,18}|[0-9]+(?:\.[0-9]+){3}")  # what would be a card or an address, but for its check
_EDGE = "\"'`.,;:!?()[]{}<>|*"


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            done = m.end()
            yield Span("email", start, done)
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """By start, then kind."""
    found = list(_emails(text))
    if any(d in text for d in "0123456789"):
        found += [Span("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        found += [Span("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [Span("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def _around(text: str, start: int, end: int) -> tuple[str, str, list[str]]:
    """The words before and after a span, and its lexical patterns."""
    head, tail = text[max(0, start - 80) : start], text[end : end + 80]
    before = head.split()
    if len(head) == 80 and not head[0].isspace() and len(before) == 1:
        before = []  # a word that is longer than the context
    left, right = before[-1].lower()[-40:] if before else "^", (tail.split() or ["$"])[0].lower()[:40]
    found = [f"l:{left}", f"r:{right}", f"lr:{left} {right}"]
    if m := _KEY_BEFORE.search(head):
        found.append(f"k:{m[1].lower()}")
    return left, right, found


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what may be a candidate, by start: tokens that hold a digit, and values of keys."""
    spans, at = {m.span(1) for m in _VALUE.finditer(text)}, 0
    while m := _DIGIT.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = n.start() if (n := _SPACE.search(text, m.end())) else len(text)
        spans.add((start, end))
        at = end
    return iter(sorted(spans))


def occurrences(text: str, base: list[Span]) -> list[tuple[int, int, str, float, list[str]]]:
    """(start, end, value, prior confidence, patterns) of seeds and candidates."""
    found = [(s.start, s.end, text[s.start : s.end], 1.0, _around(text, s.start, s.end)[2]) for s in base]
    starts, reach = [s.start for s in base], list(itertools.accumulate((s.end for s in base), max))
    done = set()
    for start, end in _tokens(text):
        if key := re.search(r"[=:]", text[start : min(end, start + 60)]):  # key=value: the value
            start += key.end()
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        k = bisect.bisect_left(starts, end)
        if start < end and (start, end) not in done and not (k and reach[k - 1] > start):
            done.add((start, end))
            value = text[start:end]
            found.append((start, end, value, WEAK if _KEYLIKE.fullmatch(value) else 0.0, _around(text, start, end)[2]))
    return found


def ordinary(text: str, seen: list[tuple[int, int, str, float, list[str]]]) -> dict[str, int]:
    """How often ordinary words stand in the one-word contexts of what was seen, in this text."""
    if not seen:
        return {}
    words = text.lower().split()
    before, after = collections.Counter(w[-40:] for w in words[:-1]), collections.Counter(w[:40] for w in words[1:])
    own = collections.Counter(p for *_, patterns in seen for p in patterns)
    counts = {p: (before if p[0] == "l" else after)[p[2:]] - own[p] for p in own if p[:2] in ("l:", "r:")}
    return {p: n for p, n in counts.items() if n > 0}


_SCHEMA = "base array<struct<kind:string,start:int,end:int>>, seen array<struct<start:int,end:int,value:string,prior:double,patterns:array<string>>>, ordinary map<string,long>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SEEN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("prior", pa.float64()), ("patterns", pa.list_(pa.string()))]))


def _scan(docs: DataFrame) -> DataFrame:
    """docs (doc, text) with the columns of _SCHEMA."""
    schema = T.StructType([*docs.schema, *T.StructType.fromDDL(_SCHEMA)])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pii")
        for batch in batches:
            base, seen, plain = [], [], []
            for t in batch.column(at).to_pylist():
                spans = base_spans(t or "")
                found = occurrences(t or "", spans)
                base.append([s._asdict() for s in spans])
                seen.append([dict(zip(("start", "end", "value", "prior", "patterns"), o, strict=True)) for o in found])
                plain.append(list(ordinary(t or "", found).items()))
            columns = [pa.array(base, _SPANS), pa.array(seen, _SEEN), pa.array(plain, pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "base", "seen", "ordinary"])

    return docs.mapInArrow(run, schema)


def score_graph(edges: DataFrame, ordinary: DataFrame, *, rounds: int = ROUNDS, support: int = SUPPORT, prior: float = PRIOR, threshold: float = THRESHOLD) -> DataFrame:
    """(value, confidence) of the candidates in edges (pattern, value, prior), with ordinary (pattern, n)."""
    edges = edges.groupBy("pattern", "value").agg(F.max("prior").alias("prior"))
    # fewer values never support a pattern
    able = edges.groupBy("pattern").agg(F.count("*").alias("values")).where(F.col("values") >= support)
    able = able.join(ordinary.groupBy("pattern").agg(F.sum("n").alias("plain")), "pattern", "left").select("pattern", (F.col("values") + F.coalesce("plain", F.lit(0)) + prior).alias("weight"))
    edges = materialize(edges.join(able, "pattern"))
    sure = F.col("prior") == 1
    refuted = (F.col("prior") == 0) & F.col("value").rlike(f"^(?:{_REFUTED.pattern})$")
    confidence = materialize(edges.groupBy("value").agg(F.max("prior").alias("prior")).select("value", "prior", refuted.alias("refuted"), F.col("prior").alias("confidence")))
    for _ in range(rounds):
        firm = F.count_if((F.col("confidence") >= threshold) | (F.col("prior") > 0))
        patterns = edges.drop("prior").join(confidence, "value").groupBy("pattern").agg((F.sum("confidence") / F.first("weight")).alias("trust"), firm.alias("firm")).where(F.col("firm") >= support)
        # only BEST of them, as many as a place has: a short value stands at so many that their doubts would vanish
        best = F.slice(F.sort_array(F.collect_list("trust"), asc=False), 1, BEST)
        doubt = F.aggregate(best, F.lit(1.0), lambda d, t: d * (1 - t))
        found = edges.select("pattern", "value").join(patterns, "pattern").groupBy("value").agg((1 - doubt).alias("found"))
        scored = confidence.join(found, "value", "left").withColumn("found", F.coalesce("found", F.lit(0.0)))
        new = materialize(scored.select("value", "prior", "refuted", F.when(sure, 1.0).when(F.col("refuted"), 0.0).otherwise(F.greatest("prior", "found")).alias("confidence")))
        release(confidence)
        confidence = new
    release(edges)
    return confidence.where("prior < 1").select("value", "confidence")


def _find(docs: DataFrame, *, threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """docs (doc, text) with base, learned and row."""
    scanned = _scan(docs) if keep_text else _scan(docs).drop("text")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()))
    open_rows = F.exists("seen", lambda s: s["prior"] < 1)
    edges = scanned.select(F.explode("seen").alias("s")).select(F.explode("s.patterns").alias("pattern"), F.col("s.value").alias("value"), F.col("s.prior").alias("prior"))
    plain = scanned.select(F.explode("ordinary").alias("pattern", "n"))
    sure = score_graph(edges, plain, threshold=threshold).where(F.col("confidence") >= threshold).select("value")
    candidates = scanned.where(open_rows).select("row", F.explode("seen").alias("s")).where("s.prior < 1").select("row", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))
    learned = candidates.join(sure, "value", "left_semi").groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.lit(LEARNED).alias("kind"), "start", "end"))).alias("learned"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    # only rows with candidates take part in the join
    joined = scanned.where(open_rows).join(learned, "row", "left").withColumn("learned", F.coalesce("learned", none))
    return joined.unionByName(scanned.where(~open_rows).withColumn("learned", none)).drop("seen", "ordinary")


def _packed(docs: DataFrame) -> DataFrame:
    """The columns of docs but text as one, so that no name clashes."""
    return docs.select(F.struct(*[c for c in docs.columns if c.lower() != "text"], F.lit(0).alias("_")).alias("doc"), F.col("text").cast("string").alias("text"))


def find(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs with base (spans of the fixed patterns), learned (spans of kind id) and row, a number for each row."""
    own = [F.col("text").alias(c) if c.lower() == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return _find(_packed(docs), threshold=threshold).select(*own, *[F.col(c).alias(fresh(docs, c)) for c in ("base", "learned", "row")])


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind, as <EMAIL>; overlapping spans become one, of the first's kind."""
    found = _find(_packed(docs))
    spans = F.array_sort(F.concat("base", "learned"), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0)))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(s, span):
        cut = F.concat(s["out"], F.substr(text, s["at"] + 1, span["start"] - s["at"]), F.lit("<"), F.upper(span["kind"]), F.lit(">"))
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), F.when(span["start"] >= s["at"], cut).otherwise(s["out"]).alias("out"))

    done = F.aggregate(spans, state, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    changed = F.when(F.size(spans) > 0, done).otherwise(text)
    return found.select(*[changed.alias(c) if c.lower() == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digest(docs: DataFrame) -> DataFrame:
    found = _find(_packed(docs.select("doc_id", "text")), keep_text=False).withColumn("doc_id", F.col("doc.doc_id"))
    place = F.create_map(*[F.lit(x) for k, name in enumerate((*KINDS, LEARNED)) for x in (name, k)])
    every = F.array_sort(F.transform(F.concat("base", "learned"), lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"))
