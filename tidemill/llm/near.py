"""Near-duplicate links between shingle sets by a signature-coordinate inverted join, and their components.

Equal sets are one class from the start, so exact copies never meet in pairs. Each class is posted under the keys of its
signature: for whole documents each coordinate with its value (Lists.coordinates()), for paragraphs bands of coordinates.
Keys of one class are dropped. A class with fewer than `need` keys left has no partner; of the others

* prefix merging reads the shortest lists only: two classes with `need` keys in common share one of the first
  (keys left - need + 1) of each, whatever the order, as long as it is one for all. Keys are ordered by their lists'
  lengths, so what many documents share (a common line) comes last and is rarely read;
* collisions are counted for classes that meet: equal coordinates of both signatures. Pairs below `match` are skipped
  (the long lists that the prefix leaves out take part in this count without being read), the others are confirmed on
  their whole sets.

Only what connects is needed, so lists are read twice. First each list (in parts of BLOCK classes, if it is longer) links
each class to the most similar one of the leaders before it, which is a pair for each posting at most. Lists whose
classes are connected after that are done. In the others, all pairs of classes that aren't connected yet are looked at:
short lists give the pairs that reach `match`; long ones are cut into blocks, in which a class of the list's largest
component meets only those outside it, and the blocks' rows that reach `match` with some other meet their sets and give
a spanning forest. So no task holds an unbounded group, and no group of copies is written out as pairs.

Components come from large-star and small-star rounds on the links, or from one task if the links are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import enter, materialize, partitions, release
from tidemill.llm.shingles import COORDINATES, describe_texts, mix, unpack

SMALL, BLOCK, BLOCK_GRAMS = 32, 1536, 4_000_000
#: Lists of ids that are broadcast hold so many rows at most; longer ones are joined by a shuffle.
BROADCAST_ROWS = 4_000_000
#: Components of so many edges at most are made by one task.
LOCAL_EDGES = 1_000_000


class Lists(NamedTuple):
    """Which coordinates make up each key of a signature (64 keys at most), and the weights that hash their values."""

    choices: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, lists: int, run: int) -> Lists:
        """Bands of so many coordinates each, that overlap if they must."""
        choices = [np.sort(np.random.Generator(np.random.PCG64(7 + k)).permutation(COORDINATES)[:run]) for k in range(lists)]
        return cls._weighted(np.stack(choices))

    @classmethod
    def coordinates(cls) -> Lists:
        """Each coordinate by itself."""
        return cls._weighted(np.arange(COORDINATES)[:, None])

    @classmethod
    def _weighted(cls, choices: np.ndarray) -> Lists:
        return cls(choices, np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 63, choices.shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1))

    def keys(self, sig: np.ndarray) -> np.ndarray:
        """The keys of each signature, one for each list."""
        out = np.empty((len(sig), len(self.choices)), np.uint64)
        for k, (c, w) in enumerate(zip(self.choices, self.weights, strict=True)):
            out[:, k] = (sig[:, c].astype(np.uint64) * w).sum(1, dtype=np.uint64)
        return mix(out + np.arange(len(self.choices), dtype=np.uint64))


#: low: the lowest byte of each coordinate, enough to skip pairs.
SIGNED = "n long, k1 long, k2 long, sig binary, low binary, grams binary"


def signed_columns(texts: list[str | None]) -> list[pa.Array]:
    """The columns of SIGNED."""
    s = describe_texts(texts)
    sig = [row.tobytes() for row in s.signatures]
    low = [row.tobytes() for row in s.signatures.astype(np.uint8)]
    return [pa.array(s.sizes), pa.array(s.keys[:, 0].view(np.int64)), pa.array(s.keys[:, 1].view(np.int64)), pa.array(sig, pa.binary()), pa.array(low, pa.binary()), pa.array(s.grams, pa.binary())]


def sign(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns keep of docs, and SIGNED."""
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = T.StructType([*source.drop("_text").schema, *T.StructType.fromDDL(SIGNED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *signed_columns(part.columns[-1].to_pylist())], [*keep, "n", "k1", "k2", "sig", "low", "grams"])

    return source.mapInArrow(run, schema)


def _signatures(column: pa.Array, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, COORDINATES)


def postings(classes: DataFrame, lists: Lists) -> DataFrame:
    """(cid, list, key) from classes (cid, sig)."""
    many = len(lists.choices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for batch in batches:
            if len(batch):
                keys = lists.keys(_signatures(batch.column(1))).view(np.int64)
                arrays = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, many, dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), arrays], ["cid", "keys"])

    keyed = classes.select("cid", "sig").mapInArrow(run, "cid long, keys array<long>")
    return keyed.select("cid", F.posexplode("keys").alias("list", "key"))


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows with equal values in column key, which follow each other, are never parted."""
    rest: list[pa.RecordBatch] = []  # of one key
    for batch in batches:
        if not len(batch):
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if rest and (cut or rest[0].column(key)[0].as_py() != batch.column(key)[0].as_py()):
            yield pa.concat_batches([*rest, batch.slice(0, cut)])
            rest = []
        elif cut:
            yield batch.slice(0, cut)
        rest.append(batch.slice(cut))
    if rest:
        yield pa.concat_batches(rest)


def _starts(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct pairs, the lesser first."""
    x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], ["a", "b"])


def _follow(cid: np.ndarray, low: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes of one list, one for each class at most: it and the leader that it shares most with.

    A class leads if no leader before it shares `match` coordinates with it.
    """
    best, whom = np.zeros(len(cid), np.int64), np.full(len(cid), -1)
    left = np.arange(len(cid))
    while left.size > 1:
        head, rest = left[0], left[1:]
        same = (low[rest] == low[head]).sum(1)
        better = same > best[rest]
        best[rest[better]], whom[rest[better]] = same[better], head
        left = rest[same < match]
    some = np.flatnonzero(best >= match)
    return cid[some], cid[whom[some]]


def _led(parts: DataFrame, match: int) -> DataFrame:
    """(a, b) from rows (unit, cid, low), of which units lie side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for batch in _groups(batches, 0):
            unit, cid, low = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _signatures(batch.column(2), np.uint8)
            start = _starts(unit)
            size = np.diff(np.append(start, len(unit)))
            two = start[size == 2]
            two = two[(low[two] == low[two + 1]).sum(1) >= match]
            a, b = [cid[two]], [cid[two + 1]]
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                x, y = _follow(cid[s : s + n], low[s : s + n], match)
                a.append(x)
                b.append(y)
            yield _pairs(a, b)

    return parts.mapInArrow(run, "a long, b long")


def _small_pairs(lists: DataFrame, match: int) -> DataFrame:
    """(a, b) of the pairs in lists (key, cid, low, root) of up to SMALL classes that reach `match` across roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for batch in _groups(batches, 0):
            key, cid, low, root = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _signatures(batch.column(2), np.uint8), batch.column(3).to_numpy()
            start = _starts(key)
            size = np.diff(np.append(start, len(key)))
            end, a, b = np.repeat(start + size, size), [], []
            for apart in range(1, int(size.max())):  # all pairs that are so many places apart
                i = np.flatnonzero(np.arange(len(key)) + apart < end)
                i = i[root[i] != root[i + apart]]
                for at in range(0, len(i), 1 << 18):
                    p = i[at : at + (1 << 18)]
                    p = p[(low[p] == low[p + apart]).sum(1) >= match]
                    a.append(cid[p])
                    b.append(cid[p + apart])
            yield _pairs(a, b)

    return lists.mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, others: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each of others: den * intersection >= num * union with the sorted array x."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    both = np.add.reduceat((x[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return den * both >= num * (len(x) + sizes - both)


def _root(up: dict[int, int], i: int) -> int:
    while up[i] != i:
        up[i] = i = up[up[i]]
    return i


class _Block(NamedTuple):
    """The rows of a unit: classes of one list in one block, or in two (side 0 and 1)."""

    cid: np.ndarray
    side: np.ndarray
    mask: np.ndarray  # the keys before this list's in each class's prefix, by bits
    root: np.ndarray
    sig: np.ndarray
    one: bool

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Block:
        """From columns unit, bi, bj, block, cid, mask, root, sig."""
        bi, bj, block, cid, mask, root = (batch.column(k).to_numpy() for k in range(1, 7))
        return cls(cid, (block == bj).astype(int), mask, root, _signatures(batch.column(7)), bool(bi[0] == bj[0]))

    def others(self, i: int, match: int, choices: np.ndarray) -> np.ndarray:
        """Rows after i that are not of its root, reach `match` with it and meet it in no earlier list."""
        j = np.arange(i + 1, len(self.cid)) if self.one else np.flatnonzero(self.side == 1) if self.side[i] == 0 else np.empty(0, np.int64)
        j = j[self.root[j] != self.root[i]]
        same = self.sig[j] == self.sig[i]
        ok = same.sum(1) >= match
        j, same = j[ok], same[ok]
        if j.size:
            equal = same[:, choices].all(2)
            both = (self.mask[j] & self.mask[i])[:, None] >> np.arange(len(choices)) & 1
            j = j[~(equal & (both != 0)).any(1)]
        return j


def _taking_part(units: DataFrame, match: int, choices: np.ndarray) -> DataFrame:
    """(unit, cid) of the rows of units (see _Block.of) that reach `match` with some row of another root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for batch in _groups(batches, 0):
            unit = batch.column(0).to_numpy()
            start = _starts(unit)
            for s, e in zip(start, np.append(start[1:], len(unit)), strict=True):
                x = _Block.of(batch.slice(s, e - s))
                some = np.zeros(e - s, bool)
                for i in range(e - s):
                    j = x.others(i, match, choices)
                    some[i] |= bool(j.size)
                    some[j] = True
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(unit[s:e][some]), pa.array(x.cid[some])], ["unit", "cid"])

    return units.mapInArrow(run, "unit long, cid long")


def _forests(units: DataFrame, match: int, num: int, den: int, choices: np.ndarray) -> DataFrame:
    """(a, b) of spanning forests over the roots of each unit's rows (see _Block.of; then grams)."""

    def forest(x: _Block, grams: list[bytes]) -> Iterator[tuple[int, int]]:
        sets = [unpack(g) for g in grams]
        up = {int(r): int(r) for r in x.root}
        for i in range(len(sets)):
            j = x.others(i, match, choices)
            j = np.array([k for k in j.tolist() if _root(up, int(x.root[k])) != _root(up, int(x.root[i]))], np.int64)
            for at in range(0, len(j), 256):
                some = j[at : at + 256]
                for k in some[_linked(sets[i], [sets[k] for k in some], num, den)].tolist():
                    a, b = _root(up, int(x.root[i])), _root(up, int(x.root[k]))
                    if a != b:
                        up[a] = b
                        yield int(x.cid[i]), int(x.cid[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for batch in _groups(batches, 0):
            unit = batch.column(0).to_numpy()
            start = _starts(unit)
            for s, e in zip(start, np.append(start[1:], len(unit)), strict=True):
                part = batch.slice(s, e - s)
                if edges := list(forest(_Block.of(part), part.column(8).to_pylist())):
                    a, b = np.array(edges, np.int64).T
                    yield _pairs([a], [b])

    return units.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs whose sets (cid, grams) are linked. Each pair's second set travels to its first one's task."""
    members = pairs.select(F.col("a").alias("unit"), F.lit(1).alias("side"), F.col("b").alias("cid"))
    members = members.unionByName(pairs.select(F.col("a").alias("unit"), F.lit(0).alias("side"), F.col("a").alias("cid")).distinct())
    placed = members.join(_only(sets, members).select("cid", "grams").hint("merge"), "cid").select("unit", "side", "cid", "grams")
    placed = placed.repartition(partitions(pairs.sparkSession), "unit").sortWithinPartitions("unit", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        mine = np.empty(0, np.uint64)  # the set of the unit that a batch begins with
        for batch in batches:
            if not len(batch):
                continue
            unit, side, cid, grams = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist()
            linked = np.zeros(len(unit), bool)
            start = _starts(unit)
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(unit)], strict=True):
                if side[s] == 0:
                    mine, s = unpack(grams[s]), s + 1
                for at in range(s, e, 256):
                    linked[at : min(e, at + 256)] = _linked(mine, [unpack(g) for g in grams[at : min(e, at + 256)]], num, den)
            yield pa.RecordBatch.from_arrays([pa.array(unit[linked]), pa.array(cid[linked])], ["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


def small_enough(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if its rows (a few numbers each) are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _only(sets: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of sets whose cid is one of `of`, so that only those travel."""
    return sets.join(small_enough(of.select("cid").distinct()), "cid", "left_semi")


def _prefixes(firsts: DataFrame, lists: Lists, need: int) -> DataFrame:
    """(cid, n, low, key, size, mask): each class under the keys of its prefix. firsts: (cid, n, sig, low)."""
    keyed = postings(firsts, lists)
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = keyed.join(shared.hint("merge"), "key").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("size", "key", "list"))).alias("met")).where(F.size("met") >= need)
    met = met.withColumn("met", F.slice("met", F.lit(1), F.size("met") - (need - 1)))
    entries = met.join(firsts.select("cid", "n", "low").hint("merge"), "cid").select("cid", "n", "low", "met", F.posexplode("met").alias("at", "x"))
    return entries.select("cid", "n", "low", "x.key", "x.size", F.expr("aggregate(slice(met, 1, at), 0L, (m, y) -> m | shiftleft(1L, y.list))").alias("mask"))


def _blocks(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Units (see _Block.of) of the rows (key, cid, n, mask, root) of long lists: pairs of blocks, of which one is outside
    the list's largest component."""
    counted = rest.groupBy("key", "root").agg(F.count("*").alias("many"), F.sum("n").alias("weight"))
    shape = counted.groupBy("key").agg(F.max(F.struct("many", "weight", "root")).alias("big"), F.sum("many").alias("many"), F.sum("weight").alias("weight"))
    blocks = lambda many, weight: F.ceil(F.greatest(many / BLOCK, weight / BLOCK_GRAMS)).cast("int")
    outside = blocks(F.col("many") - F.col("big.many"), F.col("weight") - F.col("big.weight"))
    shape = shape.select("key", F.col("big.root").alias("giant"), blocks(F.col("big.many"), F.col("big.weight")).alias("p"), outside.alias("q"))
    rows = rest.join(shape, "key").withColumn("inside", F.col("root") == F.col("giant"))
    own = F.when(F.col("inside"), F.pmod(F.xxhash64("cid", "key"), "p")).otherwise(F.col("p") + F.pmod(F.xxhash64("cid", "key"), "q"))
    rows = rows.withColumn("block", own.cast("int")).withColumn("other", F.explode(F.sequence(F.when(F.col("inside"), F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)))
    rows = rows.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    rows = rows.select(F.xxhash64("key", "bi", "bj").alias("unit"), "bi", "bj", "block", "cid", "mask", "root")
    return rows.join(_only(sets, rest).select("cid", "sig"), "cid").select(*rows.columns, "sig")


def connected(signed: DataFrame, classes: DataFrame, *, num: int, den: int, match: int, lists: Lists, need: int) -> DataFrame:
    """(node, root) as components(), for classes (cid) and links where den * intersection >= num * union.

    signed: row and SIGNED; cid is a row. need: how many keys two linked classes have in common at least. The result is a
    table to release.
    """
    n = partitions(signed.sparkSession)
    beside = lambda df, key, *then: df.repartition(n, key).sortWithinPartitions(key, *then)
    sets = signed.withColumnRenamed("row", "cid")
    firsts = materialize(sets.where("n > 0").select("cid", "n", "sig", "low").join(classes.select("cid").hint("shuffle_hash"), "cid", "left_semi"))
    posted = materialize(_prefixes(firsts, lists, need))
    release(firsts)

    parts = posted.withColumn("unit", F.xxhash64("key", F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / BLOCK))))
    led = _led(beside(parts.select("unit", "cid", "low"), "unit", "cid"), match)
    tops = parts.where(F.col("size") > BLOCK).groupBy("key", "unit").agg(F.min("cid").alias("b"))
    across = tops.join(tops.groupBy("key").agg(F.min("b").alias("a")), "key").where("a < b").select("a", "b")
    pairs = materialize(led.unionByName(across).distinct())
    roots = materialize(components(_confirm(pairs, sets, num, den)))

    placed = posted.where("size > 2").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rest = materialize(placed.join(placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key"), "key"))
    again = _small_pairs(beside(rest.where(F.col("size") <= SMALL).select("key", "cid", "low", "root"), "key", "cid"), match)
    again = materialize(again.distinct().join(pairs, ["a", "b"], "left_anti"))
    more = [materialize(_confirm(again, sets, num, den))]
    long = rest.where(F.col("size") > SMALL)
    if not long.isEmpty():
        units = materialize(_blocks(long, sets))
        some = materialize(_taking_part(beside(units, "unit", "block", "cid"), match, lists.choices))
        chosen = units.join(some, ["unit", "cid"]).join(_only(sets, some).select("cid", "grams"), "cid").select(*units.columns, "grams")
        more.append(materialize(_forests(beside(chosen, "unit", "block", "cid"), match, num, den, lists.choices)))
        release(units, some)
    release(posted, pairs, rest, again)
    found = more[0] if len(more) == 1 else more[0].unionByName(more[1])
    if found.isEmpty():
        release(*more)
        return roots
    for side in ("a", "b"):  # links between the components so far
        found = found.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    over = materialize(components(found.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))))
    old = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = materialize(old.unionByName(over.join(roots, "node", "left_anti")))
    release(roots, over, *more)
    return out


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = _root(up, up.setdefault(u, u)), _root(up, up.setdefault(v, v))
            up[max(a, b)] = min(a, b)  # so roots are least nodes
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up)), pa.array([_root(up, n) for n in up])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes that have edges (a, b).

    Up to LOCAL_EDGES edges (two numbers each) are joined by one task; more take rounds of joins.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.count() <= LOCAL_EDGES:
        return now.repartition(1).mapInArrow(_joined_up, "node long, root long")
    before = None
    while True:
        measure = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if measure == before:
            break
        before = measure
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small)
        release(now, large)
        now = small
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
