import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import kv, objects, scan, tasks

LOG = "seq long, op string, key binary, value binary"


def rows(df, *columns):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*columns).collect())


def test_last_write_wins(spark):
    log = spark.createDataFrame([(1, "P", b"key1", b"value1"), (2, "P", b"key1", b"value2"), (3, "P", b"key2", b""), (4, "P", b"", b"x"), (5, "D", b"key1", None), (6, "D", b"gone", None)], LOG)
    assert rows(kv.latest(log), "key", "value") == [(b"", b"x"), (b"key2", b"")]
    assert rows(kv.latest(log, keep_tombstones=True), "key") == [(b"",), (b"gone",), (b"key1",), (b"key2",)]
    assert kv.get(log, b"key1").isEmpty() and rows(kv.get(log, b"key2"), "value") == [(b"",)]
    assert [r.previous_value for r in kv.previous(log).where(F.col("key") == b"key1").orderBy("seq").collect()] == [None, b"value1", b"value2"]
    assert kv.latest(log.limit(0)).isEmpty()


def test_sizes(spark):
    steps = [((1, "P", b"key1", b"value1"), 10), ((2, "P", b"key1", b"value2"), 10), ((3, "P", b"key1", b"value3-old"), 14), ((4, "D", b"key1", None), 5)]
    for k, (_, size) in enumerate(steps):
        assert kv.size_bytes(spark.createDataFrame([r for r, _ in steps[: k + 1]], LOG)).first()[0] == size
    assert kv.size_bytes(spark.createDataFrame([], LOG)).first()[0] == 0


def test_overlay(spark):
    puts = spark.createDataFrame([(i, "P", b"key_%04d" % i, b"value_%d" % i) for i in range(1000)], LOG)
    gone = spark.createDataFrame([(1000 + i, "D", b"key_%04d" % i, None) for i in range(0, 1000, 2)], LOG)
    assert kv.overlay(puts, gone).count() == 500
    assert [bytes(r.key) for r in kv.ordered(gone).limit(2).collect()] == [b"key_0000", b"key_0002"]


def test_append(spark, tmp_path):
    one = spark.createDataFrame([(1, "P", b"a", b"1")], LOG)
    kv.append(one, str(tmp_path / "log"), run=1)
    kv.append(one.withColumn("seq", F.lit(2).cast("long")), str(tmp_path / "log"), run=2)
    assert kv.latest(spark.read.parquet(str(tmp_path / "log"))).first().seq == 2


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k.encode(), f"value-{k}".encode()) for k in ("c2", "a1", "b1", "a2", "c1", "b2")], "key binary, value binary")


@pytest.mark.parametrize(("start", "end", "want"), [(None, None, "a1 a2 b1 b2 c1 c2"), ("a2", "b2", "a2 b1 b2"), ("b1", None, "b1 b2 c1 c2"), (None, "b1", "a1 a2 b1"), ("x", "z", ""), ("b1", "b1", "b1"), ("A", "a1", "a1")])
def test_ranges(table, start, end, want):
    got = scan.between(table, "key", *(x and x.encode() for x in (start, end))).collect()
    assert [bytes(r.key).decode() for r in got] == want.split()


def test_points_and_prefixes(spark, table):
    assert bytes(scan.require(table, "key", b"a1").value) == b"value-a1"
    with pytest.raises(scan.KeyNotFoundError):
        scan.require(table, "key", b"zz")
    trie = spark.createDataFrame([("apple", "fruit"), ("app", "short"), ("banana", "yellow"), ("orange", "orange")], "key string, value string")
    assert rows(scan.prefix(trie, "key", "app"), "key") == [("app",), ("apple",)]
    assert scan.prefix(trie, "key", "xyz").isEmpty()
    assert [r.key for r in scan.traverse(trie, "key", "", 2).collect()] == ["app", "apple"]


def test_sorted_files(spark, table, tmp_path):
    path = str(tmp_path / "t")
    scan.write_sorted(table, "key", path, files=2)
    assert scan.between(spark.read.parquet(path), "key").count() == 6
    with pytest.raises(Exception, match="already exists"):
        scan.write_sorted(table, "key", path)


def test_floor_block(spark):
    rnd = random.Random(3)
    starts = sorted(rnd.sample(range(100, 10_000), 40))
    index = spark.createDataFrame(list(enumerate(starts)), "block int, first_key long")
    keys = [rnd.randrange(0, 10_500) for _ in range(400)]
    got = scan.floor_block(spark.createDataFrame([(k,) for k in keys], "k long"), "k", index, "block").collect()
    assert sorted((r.k, r.block) for r in got) == sorted((k, max((i for i, s in enumerate(starts) if s <= k), default=0)) for k in keys)


def test_floor_block_of_a_larger_table(spark):
    """The ranges of both uses agree where the shuffle's sample of keys would differ between them."""
    index = spark.range(3000).select(F.col("id").alias("block"), (F.col("id") * 100 + 50).alias("first_key"))
    keys = spark.range(300_000).select("id", (F.col("id") * 7919 % 300_007).alias("k"))
    got = scan.floor_block(keys, "k", index, "block")
    wrong = F.sum((F.col("block") != F.greatest(F.floor((F.col("k") - 50) / 100), F.lit(0))).cast("int"))
    assert got.agg(F.count("*"), F.countDistinct("id"), wrong).first() == (300_000, 300_000, 0)


def test_pack_blocks(spark):
    rnd = random.Random(4)
    data = [(f"{i:05d}", "x" * rnd.choice([0, 10, 500, 4000, 5000])) for i in range(300)]
    got = {r.k: r.block for r in scan.pack_blocks(spark.createDataFrame(data, "k string, v string").withColumn("one", F.lit(0)), "k", "v", range_key="one").collect()}
    block, used = 0, 0
    for k, v in data:
        size = 8 + len(k) + len(v)
        if used and used + size > 4096:
            block, used = block + 1, 0
        used += size
        assert got[k] == block


CHANGES = "seq long, op string, bucket string, key string, content binary, content_type string, metadata map<string,string>, at timestamp"


def test_objects(spark):
    import datetime

    at = [datetime.datetime(2024, 1, d) for d in range(1, 6)]
    c = spark.createDataFrame([], CHANGES)
    c = objects.put_object(c, 1, "test-bucket", "test-object", b"old", at=at[0])
    c = objects.put_object(c, 2, "test-bucket", "test-object", b"test data", content_type="text/plain", metadata={"key": "value"}, at=at[1])
    c = objects.put_object(c, 3, "test-bucket", "a/b", b"", at=at[2])
    c = objects.delete_object(c, 4, "test-bucket", "a/b", at=at[3])
    c = objects.delete_object(c, 5, "test-bucket", "never", at=at[3])
    live = objects.current(c)
    row = objects.get_object(live, "test-bucket", "test-object").first()
    assert (bytes(row.content), row.content_type, row.metadata, row["size"], row.created_at, row.modified_at) == (b"test data", "text/plain", {"key": "value"}, 9, at[0], at[1])
    assert [objects.list_objects(live, "test-bucket", p).count() for p in ("", "test-", "non-matching")] == [1, 1, 0]
    assert objects.list_objects(live, "unknown").isEmpty()
    assert '"size":9' in objects.describe(live).first().json
    buckets = objects.create_bucket(spark.createDataFrame([], "name string"), "test-bucket")
    assert objects.list_buckets(buckets).count() == 1
    for call in (lambda: objects.create_bucket(buckets, "test-bucket"), lambda: objects.delete_bucket(buckets, live, "test-bucket"), lambda: objects.delete_bucket(buckets, live, "none")):
        with pytest.raises(objects.BucketError):
            call()
    assert objects.delete_bucket(buckets, live.limit(0), "test-bucket").isEmpty()
    assert objects.with_body(live.drop("content"), live).count() == 1


def test_tasks(spark):
    ledger = spark.createDataFrame([("echo", "2024-01-01 00:00:00", "a", ""), ("echo", "2024-01-01 00:10:00", "b", "failed"), ("ls", "2024-01-01 00:09:00", "c", "")], "task string, run_at string, output string, error string").withColumn("run_at", F.col("run_at").cast("timestamp"))
    status = tasks.status(ledger)
    echo = status.where("task = 'echo'").first()
    assert (echo.execution_count, echo.last_output, echo.last_error) == (2, "b", "failed")
    assert [r.task for r in tasks.due(status, "2024-01-01 00:14:30").collect()] == ["ls"]
