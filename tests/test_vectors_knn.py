import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import vectors
from tidemill.operators import knn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vec(*xs):
    return F.array(*[F.lit(float(x)).cast("float") for x in xs])


def test_arithmetic(spark):
    assert one(spark, vectors.add(vec(1, 1, 1), vec(2, 2, 2))) == [3, 3, 3]
    assert one(spark, vectors.mul(vec(2, 2, 2), vec(3, 3, 3))) == [6, 6, 6]
    assert one(spark, vectors.dot(vec(*range(1, 9)), vec(*range(1, 9)))) == 204
    assert one(spark, vectors.l2(vec(0, 3), vec(4, 0))) == 5
    assert math.isinf(one(spark, vectors.l2(vec(1), vec(1, 2))))
    assert one(spark, F.size(vectors.pad(vec(1, 2, 3, 4, 5)))) == 8
    assert one(spark, vectors.show(vec(1, 2.5))) == "[1.0, 2.5]"
    assert one(spark, vectors.score(F.lit(0.0))) == 1
    assert one(spark, F.size(vectors.zeros(4))) == 4
    assert all(2 <= x < 3 for x in one(spark, vectors.uniform(50, 2.0, 3.0, F.lit(1))))
    with pytest.raises(Exception, match="differ in length"):
        one(spark, vectors.add(vec(1), vec(1, 2)))


@pytest.fixture(scope="module")
def base(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.random((300, 8)))]
    return spark.createDataFrame([*rows, (999, [1.0, 2.0]), (1000, None)], "vec_id long, embedding array<float>"), np.array([v for _, v in rows], np.float32).astype(float)


def test_exact(spark, base):
    df, x = base
    queries = df.where("vec_id < 20")
    got = {}
    for r in knn.exact(df, queries, 5, block=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for q in range(20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [i for _, i in sorted(got[q])] == np.lexsort((np.arange(len(d)), d))[:5].tolist()
    assert [r.id for r in knn.nearest(df.where("vec_id < 999"), x[3].tolist(), 2).collect()][0] == 3
    assert knn.search(df.where("vec_id < 999"), x[3].tolist(), 1).first().score > 0.99
    assert knn.exact(df, df.where("vec_id < 0"), 5).count() == 0


def test_unit_vectors(spark):
    unit = spark.createDataFrame([(i, [1.0 if i == j else 0.0 for j in range(4)]) for i in range(4)], "vec_id long, embedding array<float>")
    assert knn.nearest(unit, [0.9, 0.1, 0.1, 0.1], 2).first().id == 0
    points = [(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5), (0.2, 0.8), (0.8, 0.2)]
    flat = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(points)], "vec_id long, embedding array<float>")
    assert knn.nearest(flat, [0.6, 0.6], 1).first().id == 4


def test_ann_recall(spark, base):
    df, _ = base
    queries = df.where("vec_id % 20 = 0 AND vec_id < 300")
    true = {(r.query_id, r.id) for r in knn.exact(df, queries, 10).collect()}
    found = {(r.query_id, r.id) for r in knn.ann(df, queries, 10).collect()}
    assert len(true & found) >= 0.9 * len(true)
    doubled = df.where("vec_id < 300").unionByName(df.where("vec_id < 50").selectExpr("vec_id", "transform(embedding, x -> cast(x + 9 as float)) AS embedding"))
    again = knn.search_index(knn.build_index(doubled.coalesce(1)), queries, 3)
    assert again.where("id = query_id AND rank = 1").count() == queries.count()  # a repeated id keeps its first vector
    assert knn.ann(df, df.where("vec_id < 0"), 5).count() == 0 and knn.ann(df.limit(0), queries, 5).count() == 0


def test_ann_of_one_file(spark, base, monkeypatch):
    """A table that is read by one task is indexed and searched by many, and each hands on k rows for each query."""
    monkeypatch.setattr(knn, "GRAPH_ROWS", 70)
    df = base[0].where("vec_id < 300").coalesce(1)
    queries = df.where("vec_id % 20 = 0")
    index = knn.build_index(df)
    graphs = index.select(F.spark_partition_id().alias("task"), (F.length("ids") / 8).alias("n")).collect()
    assert len({r.task for r in graphs}) >= 4 and sum(r.n for r in graphs) == 300 and all(r.n <= 70 for r in graphs)
    true = {(r.query_id, r.id) for r in knn.exact(df, queries, 10).collect()}
    found = {(r.query_id, r.id) for r in knn.ann(df, queries, 10).collect()}
    assert len(found) == len(true) and len(true & found) >= 0.9 * len(true)


def test_graph_over_blocks(spark, base, monkeypatch):
    """Edges don't depend on how the table is cut into blocks."""
    df, x = base
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:3]}
    want = near | {(b, a) for a, b in near}
    for rows in (4096, 70):
        monkeypatch.setattr(knn, "GRAPH_ROWS", rows)
        assert {(r.src, r.dst) for r in knn.graph(df.where("vec_id < 300"), 3).collect()} == want


@pytest.mark.parametrize("shift, spread", [(0, 1), (1000, 1e-2), (0, 1e20), (7, 0)])
def test_pairs_of_blocks(monkeypatch, shift, spread):
    """Both directions of a pair of blocks come from one product; far from the origin, in any scale and with ties."""
    monkeypatch.setattr(knn, "TILE", 37)
    monkeypatch.setattr(knn, "PAIRS", 100)
    x = (shift + spread * np.random.default_rng(2).normal(size=(200, 8))).astype(np.float32).astype(float)
    x[50:60] = x[40]
    ids = np.arange(200)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)

    def want(rows, others):
        return {(i, int(j)) for i in rows for j in others[np.lexsort((others, d[i, others]))[:4]]}

    a, b, own = knn._Side(ids[:90], x[:90], 4), knn._Side(ids[90:], x[90:], 4), knn._Side(ids, x, 4)
    knn._meet(a, b)
    knn._meet(own, own)
    got = [{(r["query_id"], r["id"]) for r in side.found().to_pylist()} for side in (a, b, own)]
    assert got == [want(ids[:90], ids[90:]), want(ids[90:], ids[:90]), want(ids, ids)]


def test_graph_of_blocks_by_size(spark, base, monkeypatch):
    """Blocks are as large as a task can hold, so a vector travels to few of them; one that isn't finite has no edges."""
    df = base[0].where("vec_id < 300").unionByName(spark.sql("SELECT 400L AS vec_id, array_repeat(cast('NaN' AS float), 8) AS embedding"))
    whole = {(r.src, r.dst) for r in knn.graph(df, 3).collect()}
    assert len({a for a, _ in whole}) == 300
    monkeypatch.setattr(knn, "PAIR_FLOATS", 800)  # 4 blocks
    assert {(r.src, r.dst) for r in knn.graph(df, 3).collect()} == whole


def test_graph(spark, base):
    df, x = base
    edges = {(r.src, r.dst) for r in knn.graph(df.where("vec_id < 300"), 3).collect()}
    assert all((b, a) in edges for a, b in edges) and not any(a == b for a, b in edges)
    assert all(sum(s == i for s, _ in edges) >= 3 for i in range(300))
    levels = [r.level for r in spark.range(10_000).select(knn.level(F.col("id"), 4).alias("level")).collect()]
    assert len(set(levels)) >= 2 and 0.7 < levels.count(0) / 10_000 < 0.8
    assert one(spark, F.size(knn.closest(F.array(F.struct(F.lit(2.0).alias("dist"), F.lit(1).alias("id")), F.struct(F.lit(1.0).alias("dist"), F.lit(2).alias("id"))), 1))) == 1
