"""Nearest neighbours by Euclidean distance: exact, approximate over navigable graphs, and neighbour graphs.

The queries are a stated set. They are taken in blocks of QUERY_BLOCK rows; a block goes to every task, which scores its
vectors against all of it by one matrix product and keeps k for each query and batch, so what is shuffled is k rows for
each query and batch. Neighbour graphs compare blocks of the table pair by pair and pass nothing through the driver.
Vectors whose length differs from the query's are infinitely far. Ties go to the smaller id. Of rows
with equal ids the nearest counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import vectors
from tidemill.sources import sinks

QUERY_BLOCK, QUERY_ROWS = 4096, 512
GRAPH_ROWS = 4096
PAIR_BLOCK, PAIR_FLOATS = 4, 1 << 20  # a block of neighbour graphs: so many times GRAPH_ROWS, or so many numbers, at most
TILE, PAIRS = 1024, 1 << 16
FOUND = "query_id long, id long, dist double"


def _query_blocks(queries: DataFrame, id: str, vec: str, block: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    ids, vecs = [], []
    for r in queries.select(id, vec).toLocalIterator():
        ids.append(r[0])
        vecs.append(np.array(r[1], np.float64))
        if len(ids) == block:
            yield np.array(ids), vecs
            ids, vecs = [], []
    if ids:
        yield np.array(ids), vecs


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the batch's rows, one matrix for each length."""
    ids, column = batch.column(0).to_numpy(), batch.column(1)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield ids[rows], flat[at[rows][:, None] + np.arange(n)]


def _vectors(base: DataFrame, id: str, vec: str) -> DataFrame:
    return base.where(F.col(vec).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vec"))


def _merge(parts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("dist", "id")
    return parts.groupBy("query_id", "id").agg(F.min("dist").alias("dist")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_rows(q: np.ndarray, x: np.ndarray, k: int, skip: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of q, rows of x, distances): the k nearest rows of x or more, where there are ties or nearly so.

    A matrix product picks them, with room for its rounding; their distances are then computed by themselves. skip: True
    for pairs that don't count.
    """
    squares = (x * x).sum(1)
    for at in range(0, len(q), QUERY_ROWS):
        some = q[at : at + QUERY_ROWS]
        d = squares - 2 * (some @ x.T)
        room = 1e-9 * (squares.max(initial=0.0) + (some * some).sum(1)) + 1e-300
        if skip is not None:
            d[skip[at : at + QUERY_ROWS]] = np.inf
        least = np.partition(d, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(some), np.inf)
        near = (d <= (least + room)[:, None]) & np.isfinite(d)
        for j in range(len(some)):
            rows = np.flatnonzero(near[j])
            yield at + j, rows, np.sqrt(((x[rows] - some[j]) ** 2).sum(1))


def _found(q_ids: np.ndarray, own: np.ndarray, near: Iterator[tuple[int, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    out = []
    for j, rows, d in near:
        best = np.lexsort((own[rows], d))[:k]
        out.append((np.full(len(best), q_ids[j]), own[rows[best]], d[best]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "id", "dist"])


def _least(q: np.ndarray, own: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(q, own, d, rank): of rows (q, own, d) the k least d of each q, by d and own; of equal (q, own) the least."""
    order = np.lexsort((d, own, q))
    q, own, d = q[order], own[order], d[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (own[1:] != own[:-1])
    q, own, d = q[new], own[new], d[new]
    order = np.lexsort((own, d, q))
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    order, rank = order[rank < k], rank[rank < k]
    return q[order], own[order], d[order], rank


def _best(parts: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """Of FOUND rows, the k nearest of each query; of equal ids the nearest."""
    best = _least(*(np.concatenate([p.column(c).to_numpy() for p in parts]) for c in range(3)), k)
    return pa.RecordBatch.from_arrays([pa.array(z) for z in best[:3]], ["query_id", "id", "dist"])


def _by_length(vecs: list[np.ndarray]) -> dict[int, np.ndarray]:
    """The places of vectors of each length."""
    sizes = np.array([len(v) for v in vecs])
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def exact(base: DataFrame, queries: DataFrame, k: int, *, id: str = "vec_id", vec: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, dist, rank): the k nearest rows of base for each row of queries."""
    rows, sc, out = _vectors(base, id, vec), base.sparkSession.sparkContext, None
    for ids, vecs in _query_blocks(queries, id, vec, block):
        shared = sc.broadcast((ids, vecs))  # `block` rows

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            places = _by_length(q)
            for batch in batches:
                for own, matrix in _arrays(batch):
                    at = places.get(matrix.shape[1])
                    if at is not None:
                        yield from _found(q_ids[at], own, _nearest_rows(np.stack([q[i] for i in at]), matrix, k), k)

        part = rows.mapInArrow(score, FOUND)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = base.sparkSession.createDataFrame([], FOUND)
    return _merge(out, k)


def nearest(base: DataFrame, query: list[float], k: int, *, id: str = "vec_id", vec: str = "embedding", distance: Callable[[Column, Column], Column] = vectors.l2) -> DataFrame:
    """(id, dist) of the k nearest rows to one vector, in the JVM, with any distance."""
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    return base.select(F.col(id).alias("id"), distance(F.col(vec), q).alias("dist")).orderBy("dist", "id").limit(k)


def search(base: DataFrame, query: list[float], k: int, **options) -> DataFrame:
    """nearest() with a score of 1 / (1 + distance)."""
    return nearest(base, query, k, **options).withColumn("score", vectors.score(F.col("dist")))


class _Side:
    """The rows of one block, and of each the m nearest found so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, m: int):
        self.ids, self.x, self.m = ids, x, m
        self.copies = int(np.unique(ids, return_counts=True)[1].max())
        self.own, self.d = np.zeros((len(ids), m), np.int64), np.full((len(ids), m), np.inf)

    def add(self, rows: np.ndarray, other: _Side, there: np.ndarray) -> None:
        """Takes the pairs (rows, rows of the other side); few of them at a time are compared and kept."""
        for at in range(0, len(rows), PAIRS):
            i, j = rows[at : at + PAIRS], there[at : at + PAIRS]
            d = np.sqrt(((other.x[j] - self.x[i]) ** 2).sum(1))
            old = np.unique(i)
            q, own, far = np.repeat(old, self.m), self.own[old].ravel(), self.d[old].ravel()
            held = np.isfinite(far)
            q, own, far, rank = _least(np.concatenate([q[held], i]), np.concatenate([own[held], other.ids[j]]), np.concatenate([far[held], d]), self.m)
            self.own[q, rank], self.d[q, rank] = own, far

    def found(self) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.d))
        return pa.RecordBatch.from_arrays([pa.array(z) for z in (self.ids[i], self.own[i, j], self.d[i, j])], ["query_id", "id", "dist"])


def _meet(a: _Side, b: _Side) -> None:
    """Each side's rows meet the other's (with a is b: its own, but for equal ids), tile by tile.

    A product in 4-byte numbers, of rows moved to their middle and scaled, picks the pairs; its rounding is bounded, and
    what could be among the m nearest is computed by itself. A tile of rows that hold fewer than m is sorted in part.
    """
    middle = (a.x.mean(0) + b.x.mean(0)) / 2
    most = max(np.abs(s.x - middle).max(initial=0.0) for s in (a, b))
    scale = 1 / most if most > 0 else 1.0
    sides = [(s.x - middle) * scale for s in ((a,) if a is b else (a, b))]
    squares = [(y * y).sum(1) for y in sides]
    dim, reach = a.x.shape[1], np.sqrt(max(q.max() for q in squares))
    whole = max(np.abs(s.x).max(initial=0.0) for s in (a, b)) * scale
    room = (dim + 8) * 2.0**-23 * (2 * reach) ** 2 + 16 * dim * 2.0**-52 * whole * (whole + reach) + 1e-30
    # rows (-2 y, |y|^2, 1) times rows (y, 1, |y|^2) are squared distances
    left = np.concatenate([-2 * sides[0], squares[0][:, None], np.ones((len(a.ids), 1))], 1).astype(np.float32)
    right = np.concatenate([sides[-1], np.ones((len(b.ids), 1)), squares[-1][:, None]], 1).astype(np.float32)

    def bound(side: _Side, rows: slice, other: _Side, d: np.ndarray) -> np.ndarray:
        """The distance beyond which no pair of these rows counts; d: theirs from the tile, by row."""
        far = (side.d[rows, -1] * scale) ** 2 + room
        new = np.flatnonzero(~np.isfinite(far))
        k = side.m * other.copies
        if len(new) and d.shape[1] > k:
            far[new] = np.partition(d[new], k - 1, axis=1)[:, k - 1].astype(np.float64) + 2 * room
        return (far * (1 + 1e-6)).astype(np.float32)

    for i in range(0, len(a.ids), TILE):
        here = slice(i, min(i + TILE, len(a.ids)))
        for j in range(0, len(b.ids), TILE):
            there = slice(j, min(j + TILE, len(b.ids)))
            d = left[here] @ right[there].T
            if a is b:
                d[a.ids[here][:, None] == b.ids[there][None, :]] = np.inf
            near = (d <= bound(a, here, b, d)[:, None]) & np.isfinite(d) if a is b else d <= bound(a, here, b, d)[:, None]
            rows, cols = np.divmod(np.flatnonzero(near), d.shape[1])
            a.add(rows + i, b, cols + j)
            if a is not b:
                rows, cols = np.divmod(np.flatnonzero(d <= bound(b, there, a, d.T)[None, :]), d.shape[1])
                b.add(cols + j, a, rows + i)


def _block_pairs(base: DataFrame, m: int, id: str, vec: str) -> DataFrame:
    """(query_id, id, dist): the m nearest others of each vector in each pair of blocks.

    Blocks are of about PAIR_BLOCK * GRAPH_ROWS rows or PAIR_FLOATS numbers; a row goes to as many tasks as there are blocks.
    """
    rows = _vectors(base, id, vec)
    many = rows.agg(F.count("*"), F.sum(F.size("vec"))).first()
    blocks = max(1, -(-many[0] // (PAIR_BLOCK * GRAPH_ROWS)), -(-(many[1] or 0) // PAIR_FLOATS))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("id", "vec", (F.least("block", "other").cast("long") * blocks + F.greatest("block", "other")).alias("pair"), "block")

    def score(group: pa.Table) -> pa.Table:
        found = [pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())], ["query_id", "id", "dist"])]
        batch = group.combine_chunks().to_batches()[0]
        every, place = np.unique(batch.column(0).to_numpy(), return_index=True)
        block = batch.column(3).to_numpy()[place]  # a block holds all rows of an id
        lone = batch.column(2)[0].as_py() // blocks == batch.column(2)[0].as_py() % blocks
        for ids, x in _arrays(batch.select(["id", "vec"])):
            known = np.isfinite(x).all(1)
            ids, x = ids[known], x[known]
            side = block[np.searchsorted(every, ids)]
            sides = [_Side(ids[side == s], x[side == s], m) for s in np.unique(side)]
            if sides and lone:
                _meet(sides[0], sides[0])
            elif len(sides) == 2:
                _meet(*sides)
            found += [s.found() for s in sides]
        return pa.Table.from_batches(found)

    return rows.groupBy("pair").applyInArrow(score, FOUND)


def graph(base: DataFrame, m: int, *, id: str = "vec_id", vec: str = "embedding", index: DataFrame | None = None) -> DataFrame:
    """(src, dst): edges from each vector to its m nearest others, and back; by an index, approximately."""
    near = search_index(index, base, m + 1, id=id, vec=vec) if index is not None else _merge(_block_pairs(base, m, id, vec), m)
    order = Window.partitionBy("query_id").orderBy("dist", "id")
    near = near.where("query_id <> id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m)
    out = near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"))
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def closest(candidates: Column, m: int) -> Column:
    """Of array<struct<dist, id>>, the m with the least distance."""
    return F.slice(F.array_sort(candidates), 1, m)


def level(id: Column, m: int, seed: int = 0) -> Column:
    """A level with probability 1/m of each step up, always the same for an id."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), id.cast("string"))), 1, 12)
    u = (F.conv(digits, 16, 10).cast("long") + 1) / float((1 << 48) + 1)
    return F.floor(-F.log(u) / F.log(F.lit(float(m)))).cast("int")


class SmallWorld:
    """A navigable graph over one task's vectors, built and searched with arrays, many queries at a time.

    Each node links to its m nearest others, is linked back (m0 links at most, the nearest ones), and has RANDOM links to
    anywhere. Nodes of levels above 0 are the entries: a query starts at those nearest to it. Of nodes with equal ids the
    first counts.
    """

    RANDOM, EXPAND = 2, 4

    def __init__(self, ids: np.ndarray, x: np.ndarray, entries: np.ndarray, links: np.ndarray):
        self.ids, self.x, self.entries, self.links = ids, x, entries, links

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, levels: np.ndarray, m: int, m0: int, seed: int = 0) -> SmallWorld:
        first = np.sort(np.unique(ids, return_index=True)[1])
        ids, x, levels = ids[first], x[first], levels[first]
        n = len(ids)
        a, b, d = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for j, rows, far in _nearest_rows(x, x, min(m + 1, n)):
            keep = rows != j
            rows, far = rows[keep], far[keep]
            best = np.argsort(far, kind="stable")[:m]
            a.append(np.full(len(best), j))
            b.append(rows[best])
            d.append(far[best])
        a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(d)
        a, b, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
        order = np.lexsort((b, d, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        a, b = a[new], b[new]
        rank = np.arange(len(a)) - np.searchsorted(a, a, side="left")
        a, b, rank = a[rank < m0], b[rank < m0], rank[rank < m0]
        links = np.repeat(np.arange(n, dtype=np.int32)[:, None], m0 + cls.RANDOM, axis=1)  # a link to itself is none
        links[a, rank] = b
        links[:, m0:] = np.random.default_rng(seed).integers(0, max(1, n), (n, cls.RANDOM))
        entries = np.flatnonzero(levels > 0)
        return cls(ids, x, entries if len(entries) else np.arange(min(n, m0)), links)

    def search(self, q: np.ndarray, k: int, ef: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row of q, nodes, distances), k of them at most."""
        ef = max(ef, k)
        for at in range(0, len(q), QUERY_ROWS):
            some = q[at : at + QUERY_ROWS]
            every = np.arange(len(some))[:, None]
            nodes = np.broadcast_to(self.entries, (len(some), len(self.entries)))
            seen = np.zeros((len(some), len(self.ids)), bool)
            seen[:, self.entries] = True
            far = np.sqrt(np.maximum(((self.x[self.entries] ** 2).sum(1) - 2 * (some @ self.x[self.entries].T)) + (some * some).sum(1)[:, None], 0.0))
            done = np.zeros(nodes.shape, bool)
            while True:
                keep = np.argsort(far, axis=1, kind="stable")[:, :ef]
                nodes, far, done = (np.take_along_axis(z, keep, 1) for z in (nodes, far, done))
                open_far = np.where(done | ~np.isfinite(far), np.inf, far)
                next_ = np.argsort(open_far, axis=1, kind="stable")[:, : self.EXPAND]
                live = np.isfinite(np.take_along_axis(open_far, next_, 1))
                if not live.any():
                    break
                np.put_along_axis(done, next_, True, 1)
                new = np.where(live[:, :, None], self.links[np.take_along_axis(nodes, next_, 1)], -1).reshape(len(some), -1)
                new = np.sort(new, axis=1)
                fresh = (new >= 0) & ~seen[every, new]
                fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
                seen[every, np.where(fresh, new, self.entries[0])] = True
                i, j = np.nonzero(fresh)
                more = np.full(new.shape, np.inf)
                more[i, j] = np.sqrt(((self.x[new[i, j]] - some[i]) ** 2).sum(1))
                nodes, far, done = np.concatenate([nodes, new], 1), np.concatenate([far, more], 1), np.concatenate([done, np.zeros(new.shape, bool)], 1)
            for j in range(len(some)):
                rows = nodes[j][np.isfinite(far[j])]
                d = np.sqrt(((self.x[rows] - some[j]) ** 2).sum(1))
                best = np.lexsort((self.ids[rows], d))[:k]
                yield at + j, rows[best], d[best]


_INDEX = "dim int, ids binary, vectors binary, entries binary, links binary"


def build_index(base: DataFrame, *, id: str = "vec_id", vec: str = "embedding", m: int = 16, m0: int | None = None) -> DataFrame:
    """_INDEX rows, a graph each of GRAPH_ROWS vectors at most. Write them as a table to search them many times.

    Rows are dealt by id into partitions of about one graph, and a task holds one graph of each length at a time.
    """
    rows = _vectors(base, id, vec).withColumn("level", level(F.col("id"), m))
    rows = rows.repartition(max(1, -(-10 * rows.count() // (9 * GRAPH_ROWS))), "id")

    def graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def close(dim: int) -> pa.RecordBatch:
            ids, x, levels = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            w = SmallWorld.build(ids, x, levels, m, m0 or 2 * m)
            small = w.x.astype(np.float32)
            parts = [w.ids, small if np.array_equal(small, w.x) else w.x, w.entries, w.links]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], ["dim", "ids", "vectors", "entries", "links"])

        for batch in batches:
            levels = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for own, matrix in _arrays(batch):
                dim = matrix.shape[1]
                for at in range(0, len(own), GRAPH_ROWS):
                    some = own[at : at + GRAPH_ROWS]
                    if dim in held and sum(len(h[0]) for h in held[dim]) + len(some) > GRAPH_ROWS:
                        yield close(dim)
                    held.setdefault(dim, []).append((some, matrix[at : at + GRAPH_ROWS], np.array([levels[i] for i in some.tolist()])))
        for dim in list(held):
            yield close(dim)

    return rows.mapInArrow(graphs, _INDEX)


def search_index(index: DataFrame, queries: DataFrame, k: int, *, id: str = "vec_id", vec: str = "embedding", ef_search: int = 64, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, dist, rank) like exact(), from the graphs of build_index(); their answers are merged."""
    sc, out = index.sparkSession.sparkContext, None
    for ids, vecs in _query_blocks(queries, id, vec, block):
        shared = sc.broadcast((ids, vecs))  # `block` rows

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            places, held = _by_length(q), []
            for batch in batches:
                for i in range(batch.num_rows):  # graph by graph, in the batch's own memory
                    dim, *parts = (c[i] for c in batch.columns)
                    own, x, entries, links = (np.frombuffer(p.as_buffer(), t) for p, t in zip(parts, (np.int64, np.uint8, np.int64, np.int32), strict=True))
                    at = places.get(dim.as_py())
                    if at is not None and len(own):
                        x = x.view(np.float32 if len(x) == 4 * dim.as_py() * len(own) else np.float64).astype(np.float64).reshape(len(own), -1)
                        world = SmallWorld(own, x, entries, links.reshape(len(own), -1))
                        held = [_best([*held, *_found(q_ids[at], own, world.search(np.stack([q[i] for i in at]), k, ef_search), k)], k)]
            yield from held

        part = index.mapInArrow(score, FOUND)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = index.sparkSession.createDataFrame([], FOUND)
    return _merge(out, k)


def ann(base: DataFrame, queries: DataFrame, k: int, *, id: str = "vec_id", vec: str = "embedding", m: int = 16, m0: int | None = None, ef_search: int = 64, block: int = QUERY_BLOCK) -> DataFrame:
    """search_index() on an index that is built for this search alone, once: a table of its own in the shared folder."""
    spark, folder = base.sparkSession, f"{sinks.shared_folder(base.sparkSession)}/ann-{uuid.uuid4().hex}"
    index = build_index(base, id=id, vec=vec, m=m, m0=m0)
    index.write.option("maxRecordsPerFile", 8).option("parquet.block.size", 16 << 20).parquet(folder)
    return search_index(spark.read.schema(_INDEX).parquet(folder), queries, k, id=id, vec=vec, ef_search=ef_search, block=block)
