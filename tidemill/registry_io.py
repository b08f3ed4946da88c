"""Queries of the engine that write and read back, and those of objects, collections and code; see registry.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.functions import vectors
from tidemill.operators import chunks, collections, knn, kv, objects, txlog, wal
from tidemill.registry_base import query, table
from tidemill.sources import codecs, files, sinks


def _folder(spark: SparkSession) -> str:
    return f"{sinks.shared_folder(spark)}/io-{uuid.uuid4().hex}"


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# --- binary tables and logs ---


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS value FROM part")
def sst_file_roundtrip(spark, sf_dir):
    """Sorted tables of blocks, written in ranges and read back."""
    path = _folder(spark)
    sinks.write_table(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("value")), path, file_bytes=32 << 10)
    return _text(codecs.read_sorted(spark, path).select("key", "value"), "key", "value")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE o_orderstatus WHEN 'P' THEN 'updated' ELSE o_orderpriority END AS value FROM orders WHERE o_orderstatus <> 'F'")
def run_file_overlay(spark, sf_dir):
    """A run of all orders and one of tombstones and updates over it; the newest run with a key decides."""
    path = _folder(spark)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), "o_orderstatus", F.col("o_orderpriority").alias("value"))
    sinks.write_table(orders.select("key", "value"), path, layout="run", mode="append", run=0)
    later = orders.where("o_orderstatus IN ('F', 'P')").select("key", F.when(F.col("o_orderstatus") == "P", "updated").alias("value"))
    sinks.write_table(later, path, layout="run", mode="append", run=1)
    rows = codecs.read_sorted(spark, path, "run").select("key", "value", F.when(F.col("deleted"), kv.DELETE).otherwise("P").alias("op"), F.substring("file", 1, 6).cast("long").alias("seq"))
    return _text(kv.latest(rows).select("key", "value"), "key", "value")


_COMMANDS = """
c AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'begin' WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'abort' ELSE 'write' END AS cmd,
  CASE WHEN event_type IN ('click', 'view') AND event_id % 5 = 0 THEN 0 ELSE 1 + event_id // 16 END AS tx_id, CAST(user_id AS VARCHAR) AS key, props AS value FROM events),
b AS (SELECT *, min(CASE WHEN cmd = 'begin' THEN seq END) OVER (PARTITION BY tx_id) AS begun FROM c),
e AS (SELECT *, min(CASE WHEN cmd IN ('commit', 'abort') AND seq > begun THEN seq END) OVER (PARTITION BY tx_id) AS ended FROM b),
a AS (SELECT *, CASE WHEN cmd = 'begin' THEN seq = begun WHEN cmd = 'write' THEN true ELSE coalesce(seq = ended, false) END AS accepted FROM e),
l AS (SELECT *, row_number() OVER (ORDER BY seq) AS lsn, CASE cmd WHEN 'write' THEN 1 WHEN 'commit' THEN 6 ELSE 7 END AS type FROM a WHERE accepted AND cmd <> 'begin')
"""


def _commands(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cmd = F.when(F.col("event_type") == "signup", "begin").when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "abort").otherwise("write")
    tx_id = F.when((cmd == "write") & (F.col("event_id") % 5 == 0), 0).otherwise(1 + F.expr("event_id div 16"))
    return e.select(F.col("event_id").alias("seq"), cmd.alias("cmd"), tx_id.cast("long").alias("tx_id"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"))


@query(f"WITH {_COMMANDS} SELECT seq, cmd, tx_id, accepted FROM a")
def wal_tx_commands(spark, sf_dir):
    return wal.from_commands(_commands(spark, sf_dir)).select("seq", "cmd", "tx_id", "accepted")


@query(f"WITH {_COMMANDS} SELECT lsn, tx_id, CAST(type AS TINYINT) AS type, CASE WHEN type = 1 THEN key ELSE '' END AS key, CASE WHEN type = 1 THEN value ELSE '' END AS value FROM l")
def wal_file_roundtrip(spark, sf_dir):
    """Accepted commands as segments of a log, read back in order of segments and places."""
    path = _folder(spark)
    sinks.write_wal(wal.write(_commands(spark, sf_dir)), path, segment_bytes=8192)
    log = codecs.read_wal(spark, path)
    return _text(log.select("lsn", "tx_id", "type", "key", "value"), "key", "value")


@query(f"WITH {_COMMANDS}, d AS (SELECT tx_id FROM l WHERE type = 6) SELECT lsn, tx_id, key FROM l WHERE type = 1 AND (tx_id = 0 OR tx_id IN (SELECT tx_id FROM d))")
def wal_file_visible(spark, sf_dir):
    """What a reader of the segments sees."""
    path = _folder(spark)
    sinks.write_wal(wal.write(_commands(spark, sf_dir)), path, segment_bytes=8192)
    return _text(wal.read_all(codecs.read_wal(spark, path)).select("lsn", "tx_id", "key"), "key")


@query(f"WITH {_COMMANDS} SELECT count(*) AS records, true AS rotated, true AS bounded, true AS in_order, CAST(0 AS BIGINT) AS corrupt FROM l")
def wal_file_segments(spark, sf_dir):
    """Segments stay below their size; their numbers and places give the order in which records were written."""
    path = _folder(spark)
    written = sinks.write_wal(wal.write(_commands(spark, sf_dir)), path, segment_bytes=8192)
    log = codecs.read_wal(spark, path)
    ordered = log.groupBy("segment").agg(F.min("lsn").alias("low"), F.max("lsn").alias("high"), F.count("*").alias("n")).where("high - low + 1 <> n")
    bad = wal.corrupt(log).agg(F.count("*").alias("corrupt"))
    sizes = written.agg(F.sum("records").alias("records"), (F.count("*") > 1).alias("rotated"), (F.max("bytes") <= 8192).alias("bounded"))
    return sizes.join(ordered.agg((F.count("*") == 0).alias("in_order"))).join(bad)  # a row each


@query("WITH log AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, event_type, props FROM events), last AS (SELECT key, arg_max(event_type, seq) AS t, arg_max(props, seq) AS value FROM log GROUP BY key) SELECT key, value FROM last WHERE t <> 'error'")
def kv_log_replay(spark, sf_dir):
    """A key-value log in two runs of files, replayed in order of file and place."""
    path = _folder(spark)
    op = F.when(F.col("event_type") == "error", kv.DELETE).otherwise("P")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"))
    middle = log.agg(F.avg("seq")).first()[0]
    for run, part in enumerate((log.where(F.col("seq") <= middle), log.where(F.col("seq") > middle))):
        sinks.write_ops(part, path, segment_bytes=16 << 10, run=run)
    rows = codecs.read_ops(spark, path).withColumn("at", F.struct("file", "seq"))
    return _text(kv.latest(rows, seq="at").select("key", "value"), "key", "value")


@query("SELECT n_name AS name, n_name || ' ' || CAST(n_regionkey AS VARCHAR) AS content, CASE WHEN n_nationkey % 2 = 0 THEN 'python' ELSE 'go' END AS language FROM nation")
def files_tree(spark, sf_dir):
    """A folder of code, with files that are ignored for their folder, their ending or their size."""
    path = _folder(spark)
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows by definition of the table
        name = f"{r.n_name}.{'go' if r.n_nationkey % 2 else 'PY'}"
        for folder, file, body in (("src", name, f"{r.n_name} {r.n_regionkey}"), ("node_modules/x", name, "hidden"), ("src", f"{r.n_name}.bin", "other"), ("src", f"big-{name}", "x" * 2000)):
            sinks._put(f"{path}/{folder}", file, body.encode())
    found = files.read_tree(spark, path, extensions=[".go", ".py"], most_bytes=1000)
    return found.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("name"), F.col("content").cast("string").alias("content"), "language").withColumn("name", F.replace("name", F.lit("%20"), F.lit(" ")))


# --- transactional log ---

_LOG = """
m AS (SELECT CAST(user_id % 4 AS INT) AS part, event_id // 16 AS tx, event_id, event_type IN ('purchase', 'error') AS is_marker, props FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY event_id) - 1 AS "offset" FROM m)
"""


def _txlog(spark, sf_dir, messages_only: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "purchase", txlog.COMMITTED).when(F.col("event_type") == "error", txlog.ABORTED)
    rows = e.select(F.lit("t").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.expr("event_id div 16").cast("string").alias("tx_id"), state.isNotNull().alias("is_marker"), state.alias("tx_state"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    return txlog.with_offsets(rows.where("NOT is_marker") if messages_only else rows)


@query(f'WITH {_LOG} SELECT "offset", props AS value FROM l WHERE part = 1 AND "offset" BETWEEN 10 AND 59')
def tx_read_slice(spark, sf_dir):
    return txlog.read(_txlog(spark, sf_dir), "t", 1, 10, 50).select("offset", "value")


@query(f'WITH {_LOG} SELECT part AS "partition", least(CAST(5 AS BIGINT), max("offset") + 1) AS position, max("offset") + 1 AS latest FROM l GROUP BY part')
def tx_seek(spark, sf_dir):
    """Positions that are sought in each partition, checked against its end."""
    log = _txlog(spark, sf_dir)
    latest = {r.partition: r.latest for r in txlog.latest_offsets(log).collect()}  # a row for each partition
    rows = [(p, txlog.seek(log, "t", p, min(5, n)), n) for p, n in latest.items()]
    return spark.createDataFrame(rows, "partition int, position long, latest long")


@query('SELECT event_type AS "group", CAST(user_id % 4 AS INT) AS "partition", arg_max(event_id // 3, event_id) AS "offset" FROM events GROUP BY ALL')
def tx_commit_offsets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    positions = e.select(F.col("event_type").alias("group"), F.lit("t").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.expr("event_id div 3").alias("offset"), F.col("event_id").alias("seq"))
    return txlog.commit_offsets(positions).select("group", "partition", "offset")


@query(f"""
WITH {_LOG}, n AS (SELECT part, tx, row_number() OVER (PARTITION BY part ORDER BY event_id) - 1 AS "offset" FROM m WHERE NOT is_marker),
s AS (SELECT event_id // 16 AS tx, bool_or(event_type = 'purchase') AS done FROM events GROUP BY 1),
k AS (SELECT DISTINCT part, tx FROM n), t AS (SELECT part, max("offset") + 1 AS latest FROM n GROUP BY part)
SELECT part AS "partition", "offset", CAST(tx AS VARCHAR) AS tx_id, false AS is_marker, CAST(NULL AS VARCHAR) AS tx_state FROM n
UNION ALL SELECT part, latest + row_number() OVER (PARTITION BY part ORDER BY tx) - 1, CAST(tx AS VARCHAR), true, CASE WHEN done THEN 'COMMITTED' ELSE 'ABORTED' END FROM k JOIN s USING (tx) JOIN t USING (part)
""")
def tx_append_markers(spark, sf_dir):
    """Each transaction's outcome is appended to every partition that it touches and takes the next offsets there."""
    log = _txlog(spark, sf_dir, messages_only=True)
    e = table(spark, sf_dir, "events")
    results = e.groupBy(F.expr("event_id div 16").cast("string").alias("tx_id")).agg(F.when(F.max((F.col("event_type") == "purchase").cast("int")) == 1, txlog.COMMITTED).otherwise(txlog.ABORTED).alias("tx_state"))
    marks = txlog.markers(log, results).withColumn("seq", F.col("tx_id").cast("long"))
    return txlog.append_markers(log, marks).select("partition", "offset", "tx_id", "is_marker", "tx_state")


@query(f'WITH {_LOG}, n AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY event_id) - 1 AS "offset", props FROM m WHERE NOT is_marker) SELECT "offset", props AS value FROM n WHERE part = 0 AND "offset" >= 100 ORDER BY "offset" LIMIT 200')
def tx_poll_limit(spark, sf_dir):
    """The first messages of one partition from an offset on: all are committed by a marker at the end."""
    log = _txlog(spark, sf_dir, messages_only=True).where('"t" = topic AND partition = 0')
    marks = log.select("tx_id", "topic", "partition").distinct().withColumn("tx_state", F.lit(txlog.COMMITTED)).withColumn("seq", F.col("tx_id").cast("long"))
    full = txlog.append_markers(log, marks)
    seen = txlog.with_state(full).where((F.col("state") == txlog.COMMITTED) & (F.col("offset") >= 100))
    return seen.orderBy("offset").limit(200).select("offset", "value")


@query("SELECT event_id // 16 AS tx, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS started FROM events GROUP BY 1")
def tx_started(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 16").alias("tx")).agg(F.min("ts").alias("ts"))
    return e.select("tx", tx.rfc3339(F.col("ts").cast("timestamp")).alias("started"))


# --- objects ---

_HOST = r"regexp_extract(url, '^https?://([^/]+)', 1)"


def _objects(spark, sf_dir) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return table(spark, sf_dir, "pages").groupBy(host.alias("bucket"), F.col("url").alias("key")).agg(F.max_by("html", "page_id").cast("binary").alias("content"), F.max("page_id").alias("page_id"))


@query("SELECT url AS key, arg_max(html, page_id) AS content FROM pages WHERE url = (SELECT min(url) FROM pages) GROUP BY url")
def obj_get(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    first = pages.agg(F.min("url")).first()[0]
    rows = _objects(spark, sf_dir)
    bucket = first.split("/")[2]
    return _text(objects.get_object(rows, bucket, first).select("key", "content"), "content")


@query(f"SELECT DISTINCT {_HOST} AS name FROM pages")
def obj_buckets(spark, sf_dir):
    return objects.list_buckets(_objects(spark, sf_dir).select(F.col("bucket").alias("name")))


@query(f"WITH b AS (SELECT DISTINCT {_HOST} AS name FROM pages) SELECT name, name = (SELECT min(name) FROM b) AS known FROM b WHERE name = (SELECT min(name) FROM b) UNION ALL SELECT 'none.example', false")
def obj_bucket_exists(spark, sf_dir):
    buckets = _objects(spark, sf_dir).select(F.col("bucket").alias("name"))
    first = buckets.agg(F.min("name")).first()[0]
    return spark.createDataFrame([(n, objects.bucket_exists(buckets, n)) for n in (first, "none.example")], "name string, known boolean")


@query(f"WITH b AS (SELECT DISTINCT {_HOST} AS name FROM pages) SELECT name || '.spare' AS name FROM b")
def obj_empty_buckets(spark, sf_dir):
    rows = _objects(spark, sf_dir)
    names = rows.select(F.col("bucket").alias("name")).distinct()
    return objects.empty_buckets(names.unionByName(names.select(F.concat("name", F.lit(".spare")).alias("name"))), rows)


@query("SELECT url AS key, max(page_id) AS page_id, strlen(arg_max(html, page_id)) AS size FROM pages GROUP BY url")
def obj_with_body(spark, sf_dir):
    rows = _objects(spark, sf_dir)
    joined = objects.with_body(rows.select("bucket", "key", "page_id"), rows)
    return joined.select("key", "page_id", F.octet_length("content").cast("long").alias("size"))


@query(f"""SELECT '{{"bucket":"' || {_HOST} || '","key":"' || url || '","page_id":' || CAST(max(page_id) AS VARCHAR) || '}}' AS json FROM pages GROUP BY url""")
def obj_describe(spark, sf_dir):
    return objects.describe(_objects(spark, sf_dir))


@query("SELECT DISTINCT url AS key, url_encode(url) AS file FROM pages")
def obj_key_path(spark, sf_dir):
    return _objects(spark, sf_dir).select("key", objects.key_path(F.col("key")).alias("file"))


@query(f"""
WITH b AS (SELECT min({_HOST}) AS bucket FROM pages), o AS (SELECT {_HOST} AS bucket, url AS key FROM pages GROUP BY ALL)
SELECT key, 'page' AS what FROM o WHERE bucket = (SELECT bucket FROM b) AND key <> (SELECT min(key) FROM o WHERE bucket = (SELECT bucket FROM b)) UNION ALL SELECT 'new', 'put'
""")
def obj_put_delete(spark, sf_dir):
    """A bucket's objects after a put, a second put, a delete and a delete of what isn't there."""
    rows = _objects(spark, sf_dir)
    bucket = rows.agg(F.min("bucket")).first()[0]
    key = rows.where(F.col("bucket") == bucket).agg(F.min("key")).first()[0]
    own = rows.where(F.col("bucket") == bucket)
    changes = own.select(F.col("page_id").alias("seq"), F.lit(objects.PUT).alias("op"), "bucket", "key", F.lit(b"page").alias("content"), F.lit("text/html").alias("content_type"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(None).cast("timestamp").alias("at"))
    seq = 1 << 40
    changes = objects.put_object(changes, seq, bucket, "new", b"first")
    changes = objects.put_object(changes, seq + 1, bucket, "new", b"put")
    changes = objects.delete_object(changes, seq + 2, bucket, key)
    changes = objects.delete_object(changes, seq + 3, bucket, "never")
    return _text(objects.current(changes).select("key", F.col("content").alias("what")), "what")


@query("SELECT page_id, CAST(page_id AS VARCHAR) AS page, url AS source FROM pages")
def obj_user_metadata(spark, sf_dir):
    """Metadata from request headers: the prefix goes, the first value counts, other headers don't."""
    one = lambda c: F.array(c.cast("string"), F.lit("second"))
    headers = F.create_map(F.lit("X-Amz-Meta-page"), one(F.col("page_id")), F.lit("x-amz-meta-source"), one(F.col("url")), F.lit("Host"), one(F.lit("h")))
    meta = tx.user_metadata(headers)
    rows = table(spark, sf_dir, "pages").select("page_id", meta.alias("m"))
    return rows.where(F.size("m") == 2).select("page_id", F.col("m.page").alias("page"), F.col("m.source").alias("source"))


# --- code and collections ---

_CODE = """
src AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.go' ELSE '.ts' END AS ext, left(regexp_replace(text, '[^a-z ]', '', 'g'), 150) AS s FROM documents)
"""


def _code(spark, sf_dir) -> DataFrame:
    """A file of code for each document: Python, Go or TypeScript, whose function holds a string of the document's words."""
    s, own = F.left(F.regexp_replace("text", "[^a-z ]", ""), F.lit(150)), F.col("doc_id").cast("string")
    bodies = [
        F.concat(F.lit("import os\nimport sys\n\n@memo\ndef f"), own, F.lit("(x):\n    s = '"), s, F.lit("'\n    return s\n\nclass C"), own, F.lit(":\n    def g(self):\n        return 1\n")),
        F.concat(F.lit("package p\n\nimport (\n\t\"fmt\"\n)\n\n// a note {\ntype T"), own, F.lit(" struct {\n\tX int\n}\n\nfunc (t T"), own, F.lit(") Show() string {\n\treturn \""), s, F.lit("\"\n}\n\nvar v = 1\n")),
        F.concat(F.lit("import a from 'a'\nimport b from 'b'\n\nexport async function f"), own, F.lit("() {\n  return `} "), s, F.lit("`\n}\n\nclass C"), own, F.lit(" {\n  m() {}\n}\n\nconst k = () => {\n  return 1\n}\n")),
    ]
    ends = F.element_at(F.array(*[F.lit(x) for x in (".py", ".go", ".ts")]), (F.col("doc_id") % 3 + 1).cast("int"))
    body = F.when(F.col("doc_id") % 3 == 0, bodies[0]).when(F.col("doc_id") % 3 == 1, bodies[1]).otherwise(bodies[2])
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("src/"), own, ends).alias("path"), body.alias("content"))


_DECLARED = f"""
{_CODE}, d AS (
  SELECT doc_id, ext, unnest([
    {{'kind': 'import', 'name': '', 'start_line': 1, 'end_line': 1, 'content': 'import os'}},
    {{'kind': 'function', 'name': 'f' || doc_id, 'start_line': 4, 'end_line': 7, 'content': '@memo' || chr(10) || 'def f' || doc_id || '(x):' || chr(10) || '    s = ''' || s || '''' || chr(10) || '    return s'}},
    {{'kind': 'class', 'name': 'C' || doc_id, 'start_line': 9, 'end_line': 11, 'content': 'class C' || doc_id || ':' || chr(10) || '    def g(self):' || chr(10) || '        return 1'}}]) AS c FROM src WHERE ext = '.py'
  UNION ALL SELECT doc_id, ext, unnest([
    {{'kind': 'package', 'name': 'p', 'start_line': 1, 'end_line': 1, 'content': 'package p'}},
    {{'kind': 'import', 'name': '', 'start_line': 3, 'end_line': 5, 'content': 'import (' || chr(10) || chr(9) || '"fmt"' || chr(10) || ')'}},
    {{'kind': 'struct', 'name': 'T' || doc_id, 'start_line': 8, 'end_line': 10, 'content': 'type T' || doc_id || ' struct {{' || chr(10) || chr(9) || 'X int' || chr(10) || '}}'}},
    {{'kind': 'method', 'name': 'Show', 'start_line': 12, 'end_line': 14, 'content': 'func (t T' || doc_id || ') Show() string {{' || chr(10) || chr(9) || 'return "' || s || '"' || chr(10) || '}}'}},
    {{'kind': 'var', 'name': 'v', 'start_line': 16, 'end_line': 16, 'content': 'var v = 1'}}]) FROM src WHERE ext = '.go'
  UNION ALL SELECT doc_id, ext, unnest([
    {{'kind': 'import', 'name': '', 'start_line': 1, 'end_line': 1, 'content': 'import a from ''a'''}},
    {{'kind': 'function', 'name': 'f' || doc_id, 'start_line': 4, 'end_line': 6, 'content': 'export async function f' || doc_id || '() {{' || chr(10) || '  return `}} ' || s || '`' || chr(10) || '}}'}},
    {{'kind': 'class', 'name': 'C' || doc_id, 'start_line': 8, 'end_line': 10, 'content': 'class C' || doc_id || ' {{' || chr(10) || '  m() {{}}' || chr(10) || '}}'}},
    {{'kind': 'declaration', 'name': 'k', 'start_line': 12, 'end_line': 14, 'content': 'const k = () => {{' || chr(10) || '  return 1' || chr(10) || '}}'}}]) FROM src WHERE ext = '.ts')
, u AS (SELECT 'src/' || doc_id || ext AS path, c.kind AS kind, c.name AS name, CAST(c.start_line AS BIGINT) AS start_line, CAST(c.end_line AS BIGINT) AS end_line, c.content AS content,
  row_number() OVER (PARTITION BY doc_id, ext ORDER BY c.start_line) AS k FROM d)
"""


@query(f"WITH {_DECLARED} SELECT path, kind, name, start_line, end_line, content FROM u")
def chunk_code(spark, sf_dir):
    """Declarations of three languages; none is small enough to merge with min_size 0."""
    return chunks.chunk_files(_code(spark, sf_dir), min_size=0).select("path", "kind", "name", "start_line", "end_line", "content")


@query(f"""
WITH RECURSIVE {_DECLARED}, f AS (
  SELECT path, k, kind, start_line, end_line, content, 1 AS piece FROM u WHERE k = 1
  UNION ALL SELECT u.path, u.k, CASE WHEN m THEN f.kind ELSE u.kind END, CASE WHEN m THEN f.start_line ELSE u.start_line END, u.end_line,
    CASE WHEN m THEN f.content || chr(10) || u.content ELSE u.content END, CASE WHEN m THEN f.piece ELSE f.piece + 1 END
  FROM f JOIN (SELECT * FROM u) u ON u.path = f.path AND u.k = f.k + 1, LATERAL (SELECT strlen(u.content) < 100 AND strlen(f.content) < 100 AS m))
SELECT path, CAST(piece - 1 AS BIGINT) AS chunk_index, arg_max(kind, k) AS kind, arg_max(start_line, k) AS start_line, arg_max(end_line, k) AS end_line, arg_max(content, k) AS content FROM f GROUP BY path, piece
""")
def chunk_merge(spark, sf_dir):
    """Small neighbours become one chunk."""
    return chunks.chunk_files(_code(spark, sf_dir)).select("path", "chunk_index", "kind", "start_line", "end_line", "content")


_PIECES = """
l AS (SELECT doc_id, 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, strlen(text) AS total, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''),
n AS (SELECT path, total, i, lines[i] AS line FROM l, unnest(range(1, len(lines) + 1)) AS t(i)),
p AS (SELECT path, i, line, strlen(line) AS used, 0 AS piece, total FROM n WHERE i = 1
  UNION ALL SELECT n.path, n.i, n.line, CASE WHEN p.used >= 2000 AND p.total > 2000 THEN strlen(n.line) ELSE p.used + 1 + strlen(n.line) END, CASE WHEN p.used >= 2000 AND p.total > 2000 THEN p.piece + 1 ELSE p.piece END, n.total
  FROM p JOIN n ON n.path = p.path AND n.i = p.i + 1),
g AS (SELECT path, piece, min(i) AS start_line, max(i) AS end_line, string_agg(line, chr(10) ORDER BY i) AS content FROM p GROUP BY path, piece)
"""


def _files(spark, sf_dir) -> DataFrame:
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"))


@query(f"WITH RECURSIVE {_PIECES} SELECT path, CAST(piece AS BIGINT) AS chunk_index, count(*) OVER (PARTITION BY path) AS chunk_total, start_line, end_line, content FROM g")
def chunk_split(spark, sf_dir):
    """Large chunks are split by whole lines."""
    return chunks.chunk_files(_files(spark, sf_dir)).select("path", "chunk_index", "chunk_total", "start_line", "end_line", "content")


@query(f"WITH RECURSIVE {_PIECES} SELECT sha256(path) AS document_id, count(*) AS chunks FROM g GROUP BY path")
def chunk_counts(spark, sf_dir):
    return chunks.chunk_counts(chunks.chunk_files(_files(spark, sf_dir)))


@query(f"WITH {_DECLARED} SELECT sha256(path) AS document_id, sha256(path || ':' || start_line || ':' || end_line || ':0:' || strlen(content)) AS chunk_id, content, '2024-05-06T07:08:09Z' AS indexed_at FROM u WHERE k = 1 AND start_line = 1")
def chunk_get(spark, sf_dir):
    """The first chunk of each file, looked up by its id in all chunks."""
    every = chunks.chunk_files(_code(spark, sf_dir), min_size=0, indexed_at="2024-05-06 07:08:09")
    firsts = _code(spark, sf_dir).select("path", F.split("content", "\n")[0].alias("line"))
    place = tx.chunk_id(F.col("path"), F.lit(1), F.lit(1), F.lit(0), F.octet_length("line"))
    wanted = firsts.select(place.alias("chunk_id"))
    return every.join(wanted, "chunk_id", "left_semi").select("document_id", "chunk_id", "content", "indexed_at")


@query("""
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'fr' THEN 'second ' || text ELSE text END AS content, lang, CASE WHEN lang = 'fr' THEN '["2"]' ELSE '["' || source || '"]' END AS tags
FROM documents WHERE lang <> 'de'
""")
def collection_add_delete(spark, sf_dir):
    """Documents are added, some again, some deleted; metadata are scalars or JSON."""
    path, docs = _folder(spark), table(spark, sf_dir, "documents")
    for _ in range(2):
        collections.create(spark, path)
    rows = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "lang", F.array("source").alias("tags"))
    collections.add(rows, path, 1, metadata=("lang", "tags"))
    collections.add(rows.where("lang = 'fr'").withColumn("content", F.concat(F.lit("second "), "content")).withColumn("tags", F.array(F.lit("2"))), path, 2, metadata=("lang", "tags"))
    collections.delete(docs.where("lang = 'de'").select(F.col("doc_id").alias("id")), path, 3)
    return collections.read(spark, path).select("id", "content", F.col("metadata.lang").alias("lang"), F.col("metadata.tags").alias("tags"))


@query("WITH q AS (SELECT arg_min(text, item_id) AS text FROM benchmark) SELECT item_id AS id, CAST(1 AS DOUBLE) AS score FROM benchmark WHERE text = (SELECT text FROM q)")
def text_search(spark, sf_dir):
    """The items whose embedding is that of a text: the item itself, with score 1."""
    items = table(spark, sf_dir, "benchmark")
    text = items.agg(F.min_by("text", "item_id")).first()[0]
    rows = items.select(F.col("item_id").alias("id"), chunks.embed(F.col("text")).alias("embedding"))
    return collections.search(rows, text, 5).where("score > 0.9999").select("id", F.round("score", 3).alias("score"))


@query("SELECT * FROM (VALUES ('go'), ('python'), ('javascript'), ('typescript'), ('java'), ('c'), ('cpp'), ('rust'), ('ruby')) t(language)")
def lang_supported(spark, sf_dir):
    return tx.languages(spark)


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN '' ELSE '  ' || x END), chr(10)) AS dedented FROM documents")
def text_dedent(spark, sf_dir):
    """Lines that are indented by four blanks more than two, but for empty ones, lose what all share."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("      "), x)))
    shared = F.concat(F.lit("    top\n"), F.array_join(lines, "\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.dedent(shared).alias("d"))
    return rows.select("doc_id", F.substr("d", F.lit(5)).alias("dedented"))


@query("SELECT doc_id, lang, source || '!' AS source, CAST(n_chars AS VARCHAR) AS size FROM documents")
def meta_merge(spark, sf_dir):
    meta = tx.with_entries(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), source=F.concat("source", F.lit("!")), size=F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", meta.alias("m")).select("doc_id", F.col("m.lang").alias("lang"), F.col("m.source").alias("source"), F.col("m.size").alias("size"))


@query("SELECT p_partkey, '[\"' || p_brand || '\"]' AS brands, CAST(p_size AS VARCHAR) AS size, '{\"a\":' || CAST(p_partkey AS VARCHAR) || '}' AS nested FROM part")
def meta_scalars(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.array("p_brand").alias("brands"), F.col("p_size").alias("size"), F.struct(F.col("p_partkey").alias("a")).alias("nested"), F.lit(None).cast("string").alias("none"))
    names = ("brands", "size", "nested", "none")
    rows = parts.select("p_partkey", tx.scalars({c: F.col(c) for c in names}, dict(parts.dtypes)).alias("m")).where(F.size("m") == 3)
    return rows.select("p_partkey", *[F.col(f"m.{c}").alias(c) for c in names[:3]])


@query('SELECT o_orderkey, o_orderkey * 4096 AS "offset", o_custkey AS size FROM orders')
def block_locations(spark, sf_dir):
    text = F.concat_ws(":", (F.col("o_orderkey") * 4096).cast("string"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.block_location(text).alias("b")).select("o_orderkey", "b.*")


# --- vectors ---


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(CAST(x AS DOUBLE), 3) AS DECIMAL(10,3)) AS VARCHAR)), ', ') || ']' AS shown FROM embeddings")
def vec_show(spark, sf_dir):
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 3).cast("decimal(10,3)"))
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.show(rounded).alias("shown"))


@query("""
WITH e AS (SELECT vec_id, embedding[1:1 + vec_id % 64] AS v FROM embeddings)
SELECT vec_id, CAST(i - 1 AS INT) AS pos, CASE WHEN i <= len(v) THEN round(CAST(v[i] AS DOUBLE), 5) + CAST(0 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS v FROM e, unnest(range(1, len(v) + (8 - len(v) % 8) % 8 + 1)) AS t(i)
""")
def vec_pad(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.pad(F.slice("embedding", F.lit(1), (1 + F.col("vec_id") % 64).cast("int"))).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("pos", "v")).select("vec_id", "pos", (F.round(F.col("v").cast("double"), 5) + F.lit(0.0)).alias("v"))


@query("SELECT vec_id, 16 AS n, true AS inside, true AS zero, true AS varied FROM embeddings")
def vec_generate(spark, sf_dir):
    """Vectors of zeros, and of values within bounds that differ by seed."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.uniform(16, -2.0, 3.0, F.col("vec_id")).alias("u"), vectors.zeros(5).alias("z"))
    return rows.select("vec_id", F.size("u").alias("n"), F.forall("u", lambda x: (x >= -2) & (x < 3)).alias("inside"), (F.size("z") == 5).__and__(F.forall("z", lambda x: x == 0)).alias("zero"), (F.size(F.array_distinct("u")) > 10).alias("varied"))


_PAIRS = "pairs AS (SELECT x.vec_id, CAST(x.embedding AS DOUBLE[]) AS a, CAST(y.embedding AS DOUBLE[]) AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"


@query(f"WITH {_PAIRS} SELECT vec_id, round(1 - list_distance(a, b), 6) AS similarity FROM pairs")
def vec_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(vectors.similarity(vectors.l2(F.col("a"), F.col("b"))), 6).alias("similarity"))


@query("WITH q AS (SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT vec_id AS id, -list_dot_product(CAST(embedding AS DOUBLE[]), v) AS dist FROM embeddings, q) SELECT id, round(dist, 6) AS dist FROM d ORDER BY dist, id LIMIT 10")
def knn_distance(spark, sf_dir):
    """Nearest by another distance than the Euclidean: the negative dot product."""
    e = table(spark, sf_dir, "embeddings")
    first = e.agg(F.min_by("embedding", "vec_id")).first()[0]
    return knn.nearest(e, first, 10, distance=lambda a, b: -vectors.dot(a, b)).withColumn("dist", F.round("dist", 6))


@query("WITH d AS (SELECT label, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), vec_id) AS r FROM embeddings) SELECT label, id FROM d WHERE r <= 4")
def knn_closest(spark, sf_dir):
    """Of each label's candidates, the 4 nearest to the origin."""
    zero = vectors.zeros(64)
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.collect_list(F.struct(vectors.l2(F.col("embedding"), zero).alias("dist"), F.col("vec_id").alias("id"))).alias("c"))
    return e.select("label", F.explode(knn.closest(F.col("c"), 4)).alias("x")).select("label", F.col("x.id").alias("id"))


@query("SELECT p_name AS key, max(p_partkey) AS value FROM part GROUP BY p_name")
def trie_search(spark, sf_dir):
    """A map of names, where a later insert of a name overwrites."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.lit("P").alias("op"), F.col("p_name").alias("key"), F.col("p_partkey").alias("value"))
    return kv.latest(rows).select("key", "value")
