"""The queries of the engine, by name, and the SQL that each must equal.

The driver's tables stand in for the inputs that the operators are meant for: events are a changelog, a write-ahead log
and a transactional log; pages are objects; orders and part are sorted tables; documents are files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.functions import vectors
from tidemill.operators import chunks, knn, kv, objects, scan, tasks, txlog, wal
from tidemill.plans import sql
from tidemill.registry_base import ORACLES, QUERIES, query, table
from tidemill.sources import files, sinks
from tidemill.streaming import streams

def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_select_where(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidemill import registry_io  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from tidemill import registry_io  # noqa: F401

    return dict(ORACLES)


def _sql(spark: SparkSession, sf_dir: str, text: str, **options) -> DataFrame:
    name = sql.parse(text, **options).table
    return sql.to_df(spark, text, tables={name: table(spark, sf_dir, name)}, **options)


# --- SQL ---


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def sql_select_where(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")


@query("SELECT * FROM part WHERE p_size < 5")
def sql_select_star(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT * FROM part WHERE p_size < 5")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice - l_extendedprice * l_discount > 30000 + 2 * l_quantity AND l_extendedprice / l_quantity >= 1000.5")
def sql_arith(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice - l_extendedprice * l_discount > 30000 + 2 * l_quantity AND l_extendedprice / l_quantity >= 1000.5")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND true")
def sql_string_bool(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT orders.o_orderkey, o_orderpriority FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND true")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' OR l_linenumber = 1) AND l_quantity > 40")
def sql_flat_precedence(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' OR l_linenumber = 1 AND l_quantity > 40", bool_precedence="flat")


@query("SELECT p_partkey FROM part WHERE NOT (p_brand = 'it''s' OR p_size <= -1) AND p_name IS NOT NULL AND p_retailprice <> 1e3")
def sql_not_null_minus(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT p_partkey FROM part WHERE NOT (p_brand = 'it''s' OR p_size <= -1) AND p_name IS NOT NULL AND p_retailprice <> 1e3")


_TREE = ["Select", "  fields: k, w", "  table: t", "  where:", "    OR", "      AND", "        =", "          column k", "          literal 1", "        NOT", "          <", "            column v", "            -", "              literal 2", "      IS NOT NULL", "        column w"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{x}')" for k, x in enumerate(_TREE)) + ") t(line, shown)")
def sql_explain(spark, sf_dir):
    """The syntax tree of a statement, line by line."""
    shown = sql.explain("SELECT k, w FROM t WHERE k = 1 AND NOT v < -2 OR w IS NOT NULL").split("\n")
    return spark.createDataFrame(list(enumerate(shown)), "line int, shown string")


# --- vectors ---


def _pairs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


_PAIRS = "pairs AS (SELECT x.vec_id, CAST(x.embedding AS DOUBLE[]) AS a, CAST(y.embedding AS DOUBLE[]) AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"


def _each(df: DataFrame, v: Column) -> DataFrame:
    return df.select("vec_id", F.posexplode(v).alias("pos", "v")).select("vec_id", "pos", (F.round(F.col("v").cast("double"), 4) + F.lit(0.0)).alias("v"))


@query(f"WITH {_PAIRS} SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(CAST(CAST(a[i] AS FLOAT) + CAST(b[i] AS FLOAT) AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS v FROM pairs, unnest(range(1, len(a) + 1)) AS t(i)")
def vec_add(spark, sf_dir):
    return _each(_pairs(spark, sf_dir), vectors.add(F.col("a"), F.col("b")))


@query(f"WITH {_PAIRS} SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(CAST(CAST(a[i] AS FLOAT) * CAST(b[i] AS FLOAT) AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS v FROM pairs, unnest(range(1, len(a) + 1)) AS t(i)")
def vec_mul(spark, sf_dir):
    return _each(_pairs(spark, sf_dir), vectors.mul(F.col("a"), F.col("b")))


@query(f"WITH {_PAIRS} SELECT vec_id, round(list_dot_product(a, b), 6) AS dot FROM pairs")
def vec_dot(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(vectors.dot(F.col("a"), F.col("b")), 6).alias("dot"))


@query(f"WITH {_PAIRS} SELECT vec_id, round(list_distance(a, b), 6) AS dist FROM pairs")
def vec_l2(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(vectors.l2(F.col("a"), F.col("b")), 6).alias("dist"))


# --- nearest neighbours ---

_KNN = """
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), d AS (
  SELECT query_id, vec_id AS id, list_distance(CAST(embedding AS DOUBLE[]), v) AS dist FROM embeddings, q
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM d)
"""


def _queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")


@query(f"{_KNN} SELECT id, round(dist, 6) AS dist FROM r WHERE query_id = 0 AND rank <= 10")
def knn_exact(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 0").first()["embedding"]
    return knn.nearest(e, first, 10).withColumn("dist", F.round("dist", 6))


@query(f"{_KNN} SELECT query_id, id, round(dist, 6) AS dist, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def knn_batch(spark, sf_dir):
    return knn.exact(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 5).withColumn("dist", F.round("dist", 6))


@query(f"{_KNN} SELECT id, round(1 / (1 + dist), 6) AS score FROM r WHERE query_id = 0 AND rank <= 10")
def similarity_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return knn.search(e, e.where("vec_id = 0").first()["embedding"], 10).select("id", F.round("score", 6).alias("score"))


@query("""
WITH d AS (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS r
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), e AS (SELECT src, dst FROM d WHERE r <= 4)
SELECT src, dst FROM e UNION SELECT dst, src FROM e
""")
def knn_graph(spark, sf_dir):
    return knn.graph(table(spark, sf_dir, "embeddings"), 4)


@query()
def knn_ann(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return knn.ann(e, e.where("vec_id % 20 = 0"), 10)


@query("SELECT vec_id, CAST(floor(-ln((CAST('0x' || left(md5('0:' || CAST(vec_id AS VARCHAR)), 12) AS BIGINT) + 1) / CAST(281474976710657 AS DOUBLE)) / ln(16)) AS INT) AS level FROM embeddings")
def knn_levels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", knn.level(F.col("vec_id"), 16).alias("level"))


# --- key-value tables ---


def _log(spark, sf_dir) -> DataFrame:
    op = F.when(F.col("event_type") == "error", kv.DELETE).otherwise("P")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.col("props").alias("value"))


_LOG = "log AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op, props AS value FROM events), last AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, max(seq) AS seq FROM log GROUP BY key)"


@query(f"WITH {_LOG} SELECT key, value, seq FROM last WHERE op <> 'D'")
def kv_latest(spark, sf_dir):
    return kv.latest(_log(spark, sf_dir)).select("key", "value", "seq")


@query(f"WITH {_LOG} SELECT key, value, seq FROM last WHERE op <> 'D' AND key = 7")
def kv_get(spark, sf_dir):
    return kv.get(_log(spark, sf_dir), 7).select("key", "value", "seq")


@query(f"WITH {_LOG} SELECT CAST(sum(strlen(CAST(key AS VARCHAR)) + CASE WHEN op = 'D' THEN 1 ELSE strlen(value) END) AS BIGINT) AS size_bytes FROM last")
def kv_size(spark, sf_dir):
    return kv.size_bytes(_log(spark, sf_dir).withColumn("key", F.col("key").cast("string")))


@query(f"WITH {_LOG} SELECT key, seq, op, lag(op) OVER w AS previous_op, lag(value) OVER w AS previous_value FROM log WINDOW w AS (PARTITION BY key ORDER BY seq)")
def kv_previous(spark, sf_dir):
    return kv.previous(_log(spark, sf_dir)).select("key", "seq", "op", "previous_op", "previous_value")


@query(f"WITH {_LOG} SELECT key, op, seq FROM last")
def kv_ordered(spark, sf_dir):
    return kv.ordered(_log(spark, sf_dir)).select("key", "op", "seq")


@query(f"WITH {_LOG} SELECT key, value FROM last WHERE op <> 'D'")
def kv_overlay(spark, sf_dir):
    log = _log(spark, sf_dir)
    return kv.overlay(log.where("seq % 3 = 0"), log.where("seq % 3 = 1"), log.where("seq % 3 = 2")).select("key", "value")


# --- sorted tables ---


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def sst_get(spark, sf_dir):
    return scan.point(table(spark, sf_dir, "orders"), "o_orderkey", 42).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 10 AND 20")
def sst_range(spark, sf_dir):
    return scan.between(table(spark, sf_dir, "orders"), "o_orderkey", 10, 20).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <= 33")
def sst_range_open(spark, sf_dir):
    return scan.between(table(spark, sf_dir, "orders"), "o_orderkey", end=33).select("o_orderkey", "o_custkey")


@query("""
WITH b AS (SELECT o_orderkey // 100 AS block, min(o_orderkey) AS first_key FROM orders GROUP BY 1), k AS (SELECT o_orderkey, o_custkey * 11 - 500 AS k FROM orders)
SELECT o_orderkey, k, coalesce(block, (SELECT arg_min(block, first_key) FROM b)) AS block FROM k ASOF LEFT JOIN b ON k.k >= b.first_key
""")
def sst_floor_block(spark, sf_dir):
    """The block where each of as many keys as there are orders, some below all blocks and some above, would be found."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    index = scan.block_index(orders.withColumn("block", F.expr("o_orderkey div 100")), "block", "o_orderkey")
    return scan.floor_block(orders.select("o_orderkey", (F.col("o_custkey") * 11 - 500).alias("k")), "k", index, "block")


@query("SELECT o_orderkey // 100 AS block, min(o_orderkey) AS first_key, lead(min(o_orderkey)) OVER (ORDER BY min(o_orderkey)) AS next_first_key, count(*) AS entries FROM orders GROUP BY 1")
def sst_block_index(spark, sf_dir):
    return scan.block_index(table(spark, sf_dir, "orders").withColumn("block", F.expr("o_orderkey div 100")), "block", "o_orderkey")


@query("""
WITH RECURSIVE e AS (SELECT p_brand, CAST(p_partkey AS VARCHAR) AS k, 8 + strlen(CAST(p_partkey AS VARCHAR)) + strlen(p_name) AS size, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(p_partkey AS VARCHAR)) AS i FROM part),
p AS (SELECT p_brand, k, i, size AS used, 0 AS block FROM e WHERE i = 1
  UNION ALL SELECT e.p_brand, e.k, e.i, CASE WHEN p.used + e.size > 4096 THEN e.size ELSE p.used + e.size END, CASE WHEN p.used + e.size > 4096 THEN p.block + 1 ELSE p.block END FROM p JOIN e ON e.p_brand = p.p_brand AND e.i = p.i + 1)
SELECT p_brand, k, CAST(block AS BIGINT) AS block FROM p
""")
def sst_block_pack(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").cast("string").alias("k"), "p_name")
    return scan.pack_blocks(rows, "k", "p_name", range_key="p_brand").select("p_brand", "k", "block")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')")
def trie_prefix(spark, sf_dir):
    return scan.prefix(table(spark, sf_dir, "part"), "p_name", "red").select("p_partkey", "p_name")


@query("SELECT p_name FROM part WHERE starts_with(p_name, 'blue') ORDER BY p_name LIMIT 25")
def trie_traverse(spark, sf_dir):
    return scan.traverse(table(spark, sf_dir, "part").select("p_name"), "p_name", "blue", 25)


# --- objects ---


def _changes(spark, sf_dir) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    page = F.col("page_id")
    base = table(spark, sf_dir, "pages").select(host.alias("bucket"), F.col("url").alias("key"), F.col("html").cast("binary").alias("content"), page)
    row = [F.lit("text/html").alias("content_type"), F.create_map(F.lit("page"), page.cast("string")).alias("metadata"), F.timestamp_seconds(page).alias("at")]
    puts = base.select((2 * page).alias("seq"), F.lit(objects.PUT).alias("op"), "bucket", "key", "content", *row)
    gone = base.where("page_id % 3 = 0").select((2 * page + 1).alias("seq"), F.lit(objects.DELETE).alias("op"), "bucket", "key", F.lit(None).cast("binary").alias("content"), *row)
    return puts.unionByName(gone)


_LIVE = """
c AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS bucket, url AS key, page_id, html FROM pages),
g AS (SELECT bucket, key, coalesce(max(2 * page_id + 1) FILTER (page_id % 3 = 0), -1) AS gone FROM c GROUP BY ALL),
live AS (SELECT bucket, key, strlen(arg_max(html, page_id)) AS size, make_timestamp(min(page_id) * 1000000) AS created_at, make_timestamp(max(page_id) * 1000000) AS modified_at
  FROM c JOIN g USING (bucket, key) WHERE 2 * page_id > gone GROUP BY ALL)
"""


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://m.')")
def obj_list_prefix(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("web").alias("bucket"), F.col("url").alias("key"))
    return objects.list_objects(pages, "web", "https://m.").select("page_id", F.col("key").alias("url"))


@query(f"WITH {_LIVE} SELECT bucket, key, size, created_at, modified_at FROM live")
def obj_latest(spark, sf_dir):
    return objects.current(_changes(spark, sf_dir)).select("bucket", "key", "size", "created_at", "modified_at")


@query("WITH b AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS bucket FROM pages) SELECT bucket, sha256(bucket)[1:2] || '/' || sha256(bucket)[3:4] || '/' || sha256(bucket) AS path FROM b")
def obj_bucket_path(spark, sf_dir):
    return _changes(spark, sf_dir).select("bucket").distinct().select("bucket", tx.bucket_path(F.col("bucket")).alias("path"))


# --- write-ahead log ---


def _wal(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", wal.TXN_COMMIT).when(F.col("event_type") == "error", wal.TXN_ROLLBACK).otherwise(wal.WRITE)
    tx_id = F.when(F.col("event_id") % 5 == 0, 0).otherwise(1 + F.expr("event_id div 8"))
    return e.select((F.col("event_id") + 1).alias("pos"), (F.col("event_id") + 1).alias("lsn"), tx_id.cast("long").alias("tx_id"), kind.alias("type"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"))


_WAL = """
w AS (SELECT event_id + 1 AS lsn, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 + event_id // 8 END AS tx_id,
  CASE event_type WHEN 'purchase' THEN 6 WHEN 'error' THEN 7 ELSE 1 END AS type FROM events),
o AS (SELECT tx_id, arg_max(type, lsn) AS type FROM w WHERE type IN (6, 7) AND tx_id <> 0 GROUP BY tx_id)
"""


@query(f"WITH {_WAL} SELECT lsn, tx_id FROM w WHERE type = 1 AND (tx_id = 0 OR tx_id IN (SELECT tx_id FROM o WHERE type = 6))")
def wal_read_all(spark, sf_dir):
    return wal.read_all(_wal(spark, sf_dir)).select("lsn", "tx_id")


@query(f"WITH {_WAL} SELECT tx_id FROM w WHERE tx_id <> 0 GROUP BY tx_id HAVING coalesce(max(lsn) FILTER (type = 1), -2) > coalesce(max(lsn) FILTER (type IN (6, 7)), -1)")
def wal_active_tx(spark, sf_dir):
    return wal.active_transactions(_wal(spark, sf_dir))


@query(f"WITH {_WAL} SELECT max(lsn) AS last_lsn, max(tx_id) AS last_tx_id FROM w")
def wal_last_lsn(spark, sf_dir):
    return wal.last_ids(_wal(spark, sf_dir))


@query("""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
h AS (SELECT doc_id, hex(encode(CAST(doc_id AS VARCHAR) || text)) AS h FROM documents),
b AS (SELECT doc_id, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS bytes FROM h)
SELECT doc_id, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b, t
""")
def wal_crc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.checksum(F.col("doc_id").cast("string"), F.col("text")).alias("crc"))


# --- transactional log ---


def _txlog(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "purchase", txlog.COMMITTED).when(F.col("event_type") == "error", txlog.ABORTED)
    rows = e.select(F.lit("t").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.expr("event_id div 16").cast("string").alias("tx_id"), state.isNotNull().alias("is_marker"), state.alias("tx_state"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    return txlog.with_offsets(rows)


_TX = """
l AS (SELECT CAST(user_id % 4 AS INT) AS part, event_id // 16 AS tx, event_type IN ('purchase', 'error') AS is_marker, event_id,
  CASE event_type WHEN 'purchase' THEN 'COMMITTED' WHEN 'error' THEN 'ABORTED' END AS st, props,
  row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS "offset" FROM events),
v AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY part, tx ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known,
  first_value(st IGNORE NULLS) OVER (PARTITION BY part, tx ORDER BY "offset" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later,
  first_value(CASE WHEN is_marker THEN "offset" END IGNORE NULLS) OVER (PARTITION BY part, tx ORDER BY "offset" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS marked_at FROM l),
seen AS (SELECT part, tx, "offset", CASE WHEN known IS NULL THEN marked_at ELSE "offset" END AS emit_offset, props FROM v WHERE NOT is_marker AND coalesce(known, later) = 'COMMITTED')
"""
_SEEN = f'WITH {_TX} SELECT part AS "partition", CAST(tx AS VARCHAR) AS tx_id, CAST("offset" AS BIGINT) AS "offset", CAST(emit_offset AS BIGINT) AS emit_offset, props AS value FROM seen'


@query(_SEEN)
def tx_read_committed(spark, sf_dir):
    return txlog.read_committed(_txlog(spark, sf_dir)).select("partition", "tx_id", "offset", "emit_offset", "value")


@query(f'WITH {_TX} SELECT part AS "partition", CAST(max("offset") + 1 AS BIGINT) AS latest FROM l GROUP BY part')
def tx_offsets(spark, sf_dir):
    return txlog.latest_offsets(_txlog(spark, sf_dir)).select("partition", "latest")


@query(f'WITH {_TX} SELECT DISTINCT CAST(tx AS VARCHAR) AS tx_id, part AS "partition" FROM l WHERE NOT is_marker')
def tx_partitions(spark, sf_dir):
    return txlog.touched_partitions(_txlog(spark, sf_dir)).select("tx_id", "partition")


@query("""
WITH t AS (SELECT event_id // 16 AS tx, min(ts) AS start_ts, bool_or(event_type = 'purchase') AS done FROM events GROUP BY 1)
SELECT CAST(tx AS VARCHAR) AS tx_id FROM t WHERE NOT done AND (SELECT max(ts) FROM events) - start_ts > INTERVAL 3600 SECOND
""")
def tx_expired(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    done = F.max((F.col("event_type") == "purchase").cast("int")) == 1
    tx_rows = e.groupBy(F.expr("event_id div 16").cast("string").alias("tx_id")).agg(F.min("ts").alias("start_ts"), F.when(done, txlog.COMMITTED).otherwise("BEGIN").alias("state"))
    return txlog.expired(tx_rows.withColumn("timeout_ms", F.lit(3_600_000).cast("long")), e.agg(F.max("ts")).first()[0]).select("tx_id")


@query("""
WITH RECURSIVE c AS (
  SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'begin' WHEN 'view' THEN 'add' WHEN 'click' THEN 'prepare' WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'abort' END AS cmd,
    event_id // 16 AS tx, ts AS at, CAST(user_id % 4 AS INT) AS part, row_number() OVER (PARTITION BY event_id // 16 ORDER BY event_id) AS k FROM events
), f AS (
  SELECT DISTINCT tx, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS TIMESTAMP) AS began, CAST([] AS INT[]) AS parts, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS cmd, CAST(NULL AS VARCHAR) AS reason, 0 AS added FROM c
  UNION ALL
  SELECT c.tx, c.k, CASE WHEN r.reason IS NULL THEN r.goal WHEN r.reason = 'it timed out' THEN 'ABORTED' ELSE f.state END, CASE WHEN c.cmd = 'begin' AND r.reason IS NULL THEN c.at ELSE f.began END,
    CASE WHEN c.cmd = 'add' AND r.reason IS NULL AND NOT list_contains(f.parts, c.part) THEN list_append(f.parts, c.part) ELSE f.parts END, c.seq, c.cmd, r.reason,
    CASE WHEN c.cmd = 'add' AND r.reason IS NULL AND NOT list_contains(f.parts, c.part) THEN 1 ELSE 0 END
  FROM f JOIN c ON c.tx = f.tx AND c.k = f.k + 1,
  LATERAL (SELECT f.state IN ('BEGIN', 'PREPARED') AND epoch_us(c.at) - epoch_us(f.began) > 3600000000 AS late) l,
  LATERAL (SELECT CASE
      WHEN c.cmd = 'begin' THEN CASE WHEN f.state IS NOT NULL THEN 'it exists' END
      WHEN f.state IS NULL THEN 'it doesn''t exist'
      WHEN l.late THEN CASE WHEN c.cmd <> 'abort' THEN 'it timed out' END
      WHEN c.cmd IN ('add', 'prepare') AND f.state = 'BEGIN' OR c.cmd = 'commit' AND f.state = 'PREPARED' OR c.cmd = 'abort' AND f.state IN ('BEGIN', 'PREPARED') THEN NULL
      ELSE 'it is ' || f.state END AS reason,
    CASE c.cmd WHEN 'begin' THEN 'BEGIN' WHEN 'add' THEN 'BEGIN' WHEN 'prepare' THEN 'PREPARED' WHEN 'commit' THEN 'COMMITTED' ELSE 'ABORTED' END AS goal) r
)
SELECT seq, CAST(tx AS VARCHAR) AS tx_id, cmd, reason IS NULL AS accepted, reason, coalesce(state, 'UNKNOWN') AS state, added FROM f WHERE k > 0
""")
def tx_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cmd = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "begin", "view", "add", "click", "prepare", "purchase", "commit", "error", "abort")]), F.col("event_type"))
    where = F.array(F.struct(F.lit("t").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition")))
    return txlog.replay_commands(e.select(F.col("event_id").alias("seq"), cmd.alias("cmd"), F.expr("event_id div 16").cast("string").alias("tx_id"), F.lit(3_600_000).cast("long").alias("timeout_ms"), where.alias("partitions"), F.col("ts").alias("at")))


# --- chunks and text ---


def _files(spark, sf_dir) -> DataFrame:
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"))


@query("""
WITH f AS (SELECT 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text FROM documents WHERE text <> '')
SELECT path, sha256(path) AS document_id, sha256(path || ':1:' || CAST(len(string_split(text, chr(10))) AS VARCHAR) || ':0:' || CAST(strlen(text) AS VARCHAR)) AS chunk_id FROM f
""")
def chunk_ids(spark, sf_dir):
    return chunks.chunk_files(_files(spark, sf_dir), split=False).select("path", "document_id", "chunk_id")


@query("""
WITH p AS (SELECT doc_id, 'a.b/' || source || CASE doc_id % 6 WHEN 0 THEN '.go' WHEN 1 THEN '.PY' WHEN 2 THEN '.tsx' WHEN 3 THEN '.md' WHEN 4 THEN '' ELSE '.hpp' END AS path FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' WHEN 5 THEN 'cpp' ELSE '' END AS language FROM p
""")
def lang_detect(spark, sf_dir):
    ends = F.element_at(F.array(*[F.lit(x) for x in (".go", ".PY", ".tsx", ".md", "", ".hpp")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.language(F.concat(F.lit("a.b/"), F.col("source"), ends)).alias("language"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE CAST(len(string_split(text, chr(10))) AS INT) END AS lines, left(text, 20) AS head FROM documents")
def text_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.line_count(F.col("text")).alias("lines"), tx.truncate(F.col("text"), 20).alias("head"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: lpad(CAST(i AS VARCHAR), CAST(greatest(3, len(CAST(i AS VARCHAR))) AS INT), ' ') || ' | ' || x), chr(10)) AS numbered FROM documents")
def text_numbered(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.numbered(F.col("text")).alias("numbered"))


@query("SELECT 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, CAST(strlen(text) AS BIGINT) AS length FROM documents WHERE strlen(text) <= 2000")
def files_select(spark, sf_dir):
    """Small files of one ending; those in folders of dependencies and with other endings don't count."""
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    rows = table(spark, sf_dir, "documents").select(path.alias("path"), F.octet_length("text").cast("long").alias("length"))
    others = rows.withColumn("path", F.concat(F.lit("a/node_modules/"), "path")).unionByName(rows.withColumn("path", F.concat("path", F.lit(".txt"))))
    return files.select_files(rows.unionByName(others), extensions=[".MD"], most_bytes=2000)


# --- run ledger ---


@query("""
SELECT CAST(user_id AS VARCHAR) AS task, count(*) AS execution_count, max(ts) AS last_execution_time, arg_max(props, (ts, event_id)) AS last_output,
  arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END, (ts, event_id)) AS last_error FROM events GROUP BY user_id
""")
def task_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ledger = e.select(F.col("user_id").cast("string").alias("task"), F.col("ts").alias("run_at"), F.col("props").alias("output"), F.when(F.col("event_type") == "error", "failed").otherwise("").alias("error"), "event_id")
    return tasks.status(ledger, tie="event_id")


# --- streams ---


def _streamed(spark: SparkSession, rows: DataFrame, order: str, start, pieces: int = 3) -> str:
    """Writes rows in so many pieces by order and runs start(stream, folder) to its end after each, on one checkpoint, so
    that each piece is a micro-batch. Returns the folder, which is the query's own."""
    folder = f"{sinks.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/rows")  # computed once
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    bounds = rows.approxQuantile(order, [i / pieces for i in range(1, pieces)], 0.01)
    rows = rows.withColumn("_piece", sum((F.col(order) > b).cast("int") for b in bounds))
    schema = rows.drop("_piece").schema
    for k in range(pieces):
        rows.where(F.col("_piece") == k).drop("_piece").write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        start(stream, folder).awaitTermination()
    return folder


@query(_SEEN)
def stream_read_committed(spark, sf_dir):
    def start(stream, folder):
        return streams.read_committed(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()

    folder = _streamed(spark, _txlog(spark, sf_dir), "seq", start)
    return spark.read.schema(streams.DELIVERED).parquet(f"{folder}/out").select("partition", "tx_id", "offset", "emit_offset", "value")


@query(f"WITH {_LOG} SELECT key, value, seq FROM last WHERE op <> 'D'")
def stream_kv_latest(spark, sf_dir):
    folder = _streamed(spark, _log(spark, sf_dir), "seq", lambda stream, folder: streams.upsert_latest(stream, f"{folder}/out", f"{folder}/checkpoint"))
    return streams.latest_version(spark, f"{folder}/out").where(F.col("op") != kv.DELETE).select("key", "value", "seq")
