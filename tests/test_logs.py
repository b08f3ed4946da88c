import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import txlog, wal
from tidemill.sources import codecs, files

START = datetime.datetime(2024, 1, 1)


def write(path, *chunks):
    path.mkdir(parents=True, exist_ok=True)
    for name, raw in chunks:
        (path / name).write_bytes(raw)
    return str(path)


def test_wal_visibility(spark, tmp_path):
    a = b"".join([codecs.encode_wal(1, 0, wal.WRITE, b"k0", b"v0"), codecs.encode_wal(0, 1, wal.TXN_BEGIN), codecs.encode_wal(2, 1, wal.WRITE, b"k1", b"v1"), codecs.encode_wal(3, 1, wal.TXN_COMMIT)])
    b = b"".join([codecs.encode_wal(4, 2, wal.WRITE, b"k2", b"v2"), codecs.encode_wal(5, 2, wal.TXN_ROLLBACK), codecs.encode_wal(6, 3, wal.WRITE, b"k3", b""), codecs.encode_wal(7, 0, wal.CHECKPOINT)])
    path = write(tmp_path / "log", ("9.wal", a), ("10.wal", b + codecs.encode_wal(8, 0, wal.WRITE, b"torn", b"x" * 20)[:-3]))
    log = codecs.read_wal(spark, path)
    assert [bytes(r.key) for r in wal.read_all(log).collect()] == [b"k0", b"k1", b""]
    assert [r.tx_id for r in wal.active_transactions(log).collect()] == [3]
    assert tuple(wal.last_ids(log).first()) == (7, 3)
    assert wal.corrupt(log).isEmpty()
    assert tuple(wal.last_ids(log.limit(0)).first()) == (0, 0)


def test_wal_corruption(spark, tmp_path):
    good = codecs.encode_wal(1, 0, wal.WRITE, b"a", b"b")
    with pytest.raises(codecs.CorruptFileError):
        list(codecs.decode_wal(good[:-1] + b"x" + good))
    with pytest.raises(codecs.CorruptFileError):
        list(codecs.decode_wal(good[:-1], last=False))
    assert list(codecs.decode_wal(good + good[:5])) == list(codecs.decode_wal(good))
    with pytest.raises(ValueError, match="65535"):
        codecs.encode_wal(1, 0, 1, b"x" * 70_000)


def test_sorted_files(spark, tmp_path):
    entries = [(f"k{i:04d}".encode(), bytes([i % 256]) * (i % 300)) for i in range(500)] + [(b"big", b"z" * 9000), (b"", b"")]
    path = write(tmp_path / "t", ("1.sst", codecs.encode_blocks(entries)))
    got = codecs.read_sorted(spark, path).collect()
    assert sorted((bytes(r.key), bytes(r.value)) for r in got) == sorted(entries) and len({r.place for r in got}) > 10
    run = [(b"a", b"1"), (b"b", None), (b"c", b"")]
    path = write(tmp_path / "r", ("1.sst", codecs.encode_run(run)))
    assert [(bytes(r.key), r.value if r.value is None else bytes(r.value), r.deleted) for r in codecs.read_sorted(spark, path, "run").orderBy("key").collect()] == [(b"a", b"1", False), (b"b", None, True), (b"c", b"", False)]
    for decode in (codecs.decode_blocks, codecs.decode_run):
        for bad in (b"", b"not a valid sstable", b"\0" * 100):
            with pytest.raises(codecs.CorruptFileError):
                list(decode(bad))


def test_ops(spark, tmp_path):
    raw = codecs.encode_op("P", b"key1", b"v" * 300) + codecs.encode_op("P", b"key2", b"value2") + codecs.encode_op("D", b"key1")
    path = write(tmp_path / "o", ("db.wal", raw + b"\x09\0\0"))
    assert [(r.op, bytes(r.key)) for r in codecs.read_ops(spark, path).orderBy("file", "seq").collect()] == [("P", b"key1"), ("P", b"key2"), ("D", b"key1")]


def test_tree(spark, tmp_path):
    write(tmp_path / "src" / "a", ("x.py", b"print(1)"), ("big.py", b"x" * 200))
    write(tmp_path / "src" / "node_modules", ("y.py", b""))
    got = files.read_tree(spark, str(tmp_path / "src"), extensions=[".py"], most_bytes=100).collect()
    assert [(r.path.rpartition("/")[2], r.language) for r in got] == [("x.py", "python")]


LOG = "topic string, partition int, offset long, tx_id string, is_marker boolean, tx_state string, value string"


def simulate(rows):
    """Polls one partition in order: (value, where it was seen)."""
    state, held, out = {}, {}, []
    for topic, part, offset, tx, marker, st, value in rows:
        if tx is None:
            out.append((value, offset))
        elif marker:
            state[tx] = st
            out += [(v, offset) for v in held.pop(tx, [])] if st == "COMMITTED" else []
            held.pop(tx, None)
        elif tx in state:
            if state[tx] == "COMMITTED":
                out.append((value, offset))
        else:
            held.setdefault(tx, []).append(value)
    return out


def test_read_committed(spark):
    rnd = random.Random(9)
    rows = []
    for part in range(12):
        for o in range(40):
            tx = rnd.choice([None, "1", "2", "3", "4"])
            marker = tx is not None and rnd.random() < 0.2
            rows.append(("t", part, o, tx, marker, rnd.choice(["COMMITTED", "ABORTED"]) if marker else None, f"{part}.{o}"))
    df = spark.createDataFrame(rows, LOG)
    got = [(r.value, r.emit_offset) for r in txlog.read_committed(df).collect()]
    want = [x for part in range(12) for x in simulate([r for r in rows if r[1] == part])]
    assert got == want
    assert txlog.read_committed(df, from_offset=39, limit=3).count() <= 3
    assert txlog.read(df, "t", 0, 5, 3).count() == 3 and txlog.read(df, "t", 0, 50, 3).isEmpty()


def test_positions(spark):
    rows = spark.createDataFrame([("t", 0, 1, "a"), ("t", 0, 2, "b"), ("t", 1, 3, "c")], "topic string, partition int, seq long, value string")
    log = txlog.with_offsets(rows)
    assert [(r.value, r.offset) for r in log.orderBy("seq").collect()] == [("a", 0), ("b", 1), ("c", 0)]
    assert txlog.seek(log, "t", 0, 2) == 2
    for bad in ((0, 3), (7, 0)):
        with pytest.raises(ValueError):
            txlog.seek(log, "t", *bad)
    positions = spark.createDataFrame([("g", "t", 0, 5, 1), ("g", "t", 0, 2, 2)], "group string, topic string, partition int, offset long, seq long")
    assert txlog.commit_offsets(positions).first().offset == 2
    more = spark.range(1).select(txlog.add_partitions(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))[1].alias("new")).first().new
    assert more == [2]


def test_coordinator(spark):
    at = lambda ms: START + datetime.timedelta(milliseconds=ms)
    parts = [("t", 0), ("t", 1)]
    commands = [
        (1, "begin", "a", 100, None, at(0)), (2, "add", "a", None, parts, at(1)), (3, "add", "a", None, parts, at(2)), (4, "prepare", "a", None, None, at(3)), (5, "add", "a", None, parts, at(4)), (6, "commit", "a", None, None, at(5)), (7, "abort", "a", None, None, at(6)),
        (8, "begin", "b", 0, None, at(0)), (9, "begin", "c", 50, None, at(0)), (10, "commit", "c", None, None, at(10)), (11, "prepare", "c", None, None, at(60)), (12, "abort", "d", None, None, at(0)), (13, "begin", "e", 10, None, at(0)), (14, "add", "e", None, [], at(1)), (15, "abort", "e", None, None, at(2)),
    ]
    df = spark.createDataFrame(commands, "seq long, cmd string, tx_id string, timeout_ms long, partitions array<struct<topic:string,partition:int>>, at timestamp")
    got = {r.seq: r for r in txlog.replay_commands(df).collect()}
    assert [got[k].accepted for k in range(1, 16)] == [True, True, True, True, False, True, False, False, True, False, False, False, True, False, True]
    assert (got[2].added, got[3].added, got[6].state, got[11].state, got[15].state) == (2, 0, "COMMITTED", "ABORTED", "ABORTED")
    tx = spark.createDataFrame([("x", "BEGIN", at(0), 50), ("y", "COMMITTED", at(0), 50), ("z", "PREPARED", at(80), 50)], "tx_id string, state string, start_ts timestamp, timeout_ms long")
    assert [r.tx_id for r in txlog.expired(tx, at(100)).collect()] == ["x"]


def test_streams(spark, tmp_path):
    from tidemill.streaming import streams

    rows = [("t", 0, o, tx, marker, st, f"v{o}") for o, (tx, marker, st) in enumerate([("1", False, None), ("2", False, None), (None, False, None), ("1", True, "COMMITTED"), ("1", False, None), ("2", True, "ABORTED"), ("3", False, None), ("2", True, "COMMITTED"), ("2", False, None)])]
    for k in range(3):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], LOG).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = streams.read_committed(stream).writeStream.format("memory").queryName("delivered").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = txlog.read_committed(spark.createDataFrame(rows, LOG))
    assert sorted((r.value, r.emit_offset) for r in spark.table("delivered").collect()) == sorted((r.value, r.emit_offset) for r in batch.collect())


def test_stream_of_many_transactions(spark, tmp_path):
    """State has a row for each bucket, not one for each transaction, and answers as the batch operator does."""
    from tidemill.streaming import streams

    rnd = random.Random(5)
    rows = []
    for o in range(600):
        marker = rnd.random() < 0.2
        rows.append(("t", 0, o, str(rnd.randrange(150)), marker, rnd.choice(["COMMITTED", "ABORTED"]) if marker else None, None if marker or rnd.random() < 0.1 else f"v{o}"))
    for k in range(3):
        spark.createDataFrame(rows[200 * k : 200 * k + 200], LOG).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = streams.read_committed(stream, buckets=3).writeStream.format("memory").queryName("many").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    shown = lambda df: sorted((r.offset, r.emit_offset, r.tx_id, str(r.value)) for r in df.collect())
    assert shown(spark.table("many")) == shown(txlog.read_committed(spark.createDataFrame(rows, LOG)))
    assert sum(op["numRowsTotal"] for op in q.recentProgress[-1]["stateOperators"]) <= 3


def test_timeouts(spark, tmp_path):
    from tidemill.streaming import streams

    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [[("a", "begin", at(0), 5000), ("b", "begin", at(0), 60_000)], [("b", "commit", at(20), None), ("c", "begin", at(21), 1000)], [("z", "begin", at(300), 1)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "tx_id string, cmd string, at timestamp, timeout_ms long").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("tx_id string, cmd string, at timestamp, timeout_ms long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withWatermark("at", "1 second")
    q = streams.timed_out(stream).writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.tx_id: r.state for r in spark.table("ended").collect()}
    assert got["b"] == "COMMITTED" and got["a"] == "ABORTED" and got.get("c", "ABORTED") == "ABORTED"


def test_sinks(spark, tmp_path):
    from tidemill.sources import sinks

    rows = spark.createDataFrame([(k, 0, wal.WRITE, 0, b"k%04d" % k, b"v" * (k % 50)) for k in range(400)], "lsn long, tx_id long, type byte, flags byte, key binary, value binary")
    path = f"file://{tmp_path}/wal"
    made = sinks.write_wal(rows, path, segment_bytes=1024).collect()
    assert sum(r.records for r in made) == 400 and max(r.bytes for r in made) <= 1024 and len(made) > 5
    assert [r.lsn for r in codecs.read_wal(spark, path).orderBy("pos").collect()] == list(range(400))
    ops = spark.createDataFrame([(1, "P", b"a", b"1"), (2, "D", b"a", None), (3, "P", b"b", b"")], "seq long, op string, key binary, value binary")
    path = f"file://{tmp_path}/ops"
    sinks.write_ops(ops, path, segment_bytes=1)
    sinks.write_ops(ops.where("seq = 1"), path, run=1)
    assert [(r.op, bytes(r.key)) for r in codecs.read_ops(spark, path).orderBy("file", "seq").collect()] == [("P", b"a"), ("D", b"a"), ("P", b"b"), ("P", b"a")]
    sinks.clear(path)
    assert not sinks.exists(path)
    entries = spark.createDataFrame([(b"b", None), (b"a", b"x"), (b"", b"y")], "key binary, value binary")
    path = f"file://{tmp_path}/run"
    sinks.write_table(entries, path, layout="run")
    with pytest.raises(FileExistsError):
        sinks.write_table(entries, path, layout="run")
    sinks.write_table(entries.where("value IS NOT NULL"), path, layout="run", mode="overwrite")
    assert sorted(bytes(r.key) for r in codecs.read_sorted(spark, path, "run").collect()) == [b"", b"a"]


def test_transactions(spark):
    commands = [(1, "begin", 1), (2, "write", 1), (3, "write", 0), (4, "commit", 2), (5, "commit", 1), (6, "abort", 1), (7, "begin", 1), (8, "begin", 3), (9, "abort", 3), (10, "write", 9)]
    df = spark.createDataFrame([(s, c, t, f"k{s}", "v") for s, c, t in commands], "seq long, cmd string, tx_id long, key string, value string")
    assert {r.seq for r in wal.from_commands(df).where("NOT accepted").collect()} == {4, 6, 7}
    log = wal.write(df)
    assert [(r.lsn, r.tx_id, r.type) for r in log.orderBy("pos").collect()] == [(1, 1, wal.WRITE), (2, 0, wal.WRITE), (3, 1, wal.TXN_COMMIT), (4, 3, wal.TXN_ROLLBACK), (5, 9, wal.WRITE)]
    assert wal.corrupt(log).isEmpty() and [bytes(r.key) for r in wal.read_all(log).collect()] == [b"k2", b"k3"]


def test_markers_take_offsets(spark):
    rows = spark.createDataFrame([("t", 0, 1, "1", "a"), ("t", 1, 2, "1", "b"), ("t", 0, 3, "2", "c")], "topic string, partition int, seq long, tx_id string, value string").withColumn("is_marker", F.lit(False)).withColumn("tx_state", F.lit(None).cast("string"))
    log = txlog.with_offsets(rows)
    marks = txlog.markers(log, spark.createDataFrame([("1", "COMMITTED"), ("2", "ABORTED")], "tx_id string, tx_state string")).withColumn("seq", F.col("tx_id").cast("long") + 10)
    full = txlog.append_markers(log, marks)
    assert sorted((r.partition, r.offset, r.tx_id) for r in full.where("is_marker").collect()) == [(0, 2, "1"), (0, 3, "2"), (1, 1, "1")]
    assert [r.value for r in txlog.read_committed(full).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="no partition t-7"):
        txlog.append_markers(log, marks.withColumn("partition", F.lit(7))).collect()


def test_row_numbers(spark):
    """Numbers within ranges join up to one count for each group, hot ones included."""
    from tidemill.operators import ranges

    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), f"{rnd.randrange(10**6):07d}") for _ in range(900)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "g string, k string")
    got = {(r.g, r.k): r.n for r in ranges.row_numbers(df, "k", "n", ("g",), n=7).collect()}
    for g in ("a", "b", None):
        assert [got[g, k] for k in sorted(k for x, k in rows if x == g)] == list(range(sum(x == g for x, _ in rows)))
    assert ranges.with_range(df, "k", "p", 7).select("p").distinct().count() == 7
    assert ranges.row_numbers(df.limit(0), "k", "n").isEmpty()
