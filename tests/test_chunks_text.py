from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.operators import chunks, knn

GO = 'package main\n\nimport (\n\t"fmt"\n)\n\n// Point is a place.\ntype Point struct {\n\tX int\n}\n\nfunc (p Point) Show() string {\n\treturn fmt.Sprint(p.X)\n}\n\nfunc main() {\n\tfmt.Println("}")\n}\n\nvar a = 1\nconst b = 2\n'
PY = "import os\nimport sys\n\n@deco\ndef f(x):\n    return x\n\nclass A:\n    def g(self):\n        pass\n"
JS = "import a from 'a'\nimport b from 'b'\nexport async function go() {\n  return `}`\n}\nclass C {\n  m() {}\n}\nconst x = () => {\n  return 1\n}\n"


def test_languages():
    assert [(c.kind, c.name) for c in chunks.split_file(GO, "go")] == [("package", "main"), ("import", ""), ("struct", "Point"), ("method", "Show"), ("function", "main"), ("var", "a"), ("const", "b")]
    assert [(c.kind, c.name, c.start_line, c.end_line) for c in chunks.split_file(PY, "python")] == [("import", "", 1, 1), ("function", "f", 4, 6), ("class", "A", 8, 10)]
    assert [(c.kind, c.name) for c in chunks.split_file(JS, "javascript")] == [("import", ""), ("function", "go"), ("class", "C"), ("declaration", "x")]
    assert chunks.split_file("", "go") == [] and [c.kind for c in chunks.split_file("a\nb", "rust")] == ["file"]
    assert [c.kind for c in chunks.split_file("def (", "python")] == ["file"]


def sized(*sizes):
    out, line, at = [], 1, 0
    for n in sizes:
        out.append(chunks.Chunk("x", "", "a" * n, line, line, at, at + n))
        line, at = line + 1, at + n + 1
    return out


def test_fold():
    assert [c.size for c in chunks.fold(sized(99, 99))] == [199]
    assert [c.size for c in chunks.fold(sized(99, 100, 99))] == [99, 100, 99]
    assert [c.size for c in chunks.fold(sized(2000))] == [2000]
    assert [c.size for c in chunks.fold(sized(3000))] == [3000]  # one line stays whole
    lines = chunks.Chunk("x", "", "\n".join(["b" * 99] * 30), 5, 34, 0, 2999)
    parts = chunks.fold([lines])
    assert [c.size for c in parts] == [2099 - 100, 999] or sum(c.size for c in parts) + len(parts) - 1 == 2999
    assert "\n".join(c.content for c in parts) == lines.content and parts[0].start_line == 5 and parts[-1].end_line == 34
    assert all(b.start_byte == a.end_byte + 1 and b.start_line == a.end_line + 1 for a, b in zip(parts, parts[1:], strict=False))


def test_chunk_files(spark):
    df = spark.createDataFrame([("a/m.go", GO.encode()), ("e.py", b""), ("x.unknown", b"hello")], "path string, content binary")
    got = chunks.chunk_files(df, min_size=10)
    rows = {(r.path, r.chunk_index): r for r in got.collect()}
    assert rows["x.unknown", 0].kind == "file" and rows["x.unknown", 0].language == "" and not any(p == "e.py" for p, _ in rows)
    first = rows["a/m.go", 0]
    assert first.chunk_total == sum(p == "a/m.go" for p, _ in rows) and len(first.chunk_id) == 64
    assert chunks.chunk_counts(got).count() == 2
    gone = got.where("path = 'x.unknown'").select("chunk_id")
    assert chunks.delete_chunks(got, gone).count() == got.count() - 1
    assert chunks.get_chunk(got, first.chunk_id).first().content == first.content


def test_search(spark):
    docs = spark.createDataFrame([(1, "Go is a programming language"), (2, "The weather is fine"), (3, "Python is another programming language")], "vec_id long, text string")
    base = docs.withColumn("embedding", chunks.embed(F.col("text")))
    q = spark.range(1).select(chunks.embed(F.lit("programming language")).alias("e")).first().e
    assert {r.id for r in knn.search(base, q, 2).collect()} == {1, 3}


def test_text(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    s = F.lit("    def f():\n        pass\n\n    x")
    assert one(tx.dedent(s)) == "def f():\n    pass\n\nx"
    assert one(tx.dedent(F.lit("a\n  b"))) == "a\n  b"
    assert one(tx.line_count(F.lit(""))) == 0 and one(tx.line_count(F.lit("a\n"))) == 2
    assert one(tx.numbered(F.lit("a\nb"))) == "  1 | a\n  2 | b"
    assert one(tx.lines_between(F.lit("a\nb\nc"), 2, 3)) == "b\nc"
    assert one(tx.unquote(F.lit("it''s"))) == "it's" and one(tx.leading_space(F.lit("\t x"))) == "\t "
    assert one(tx.language(F.lit("a.b/X.CPP"))) == "cpp" and one(tx.language(F.lit("a.go/none"))) == ""
    assert one(tx.checksum(F.lit("123456789"))) == 0xCBF43926
    assert tuple(one(tx.block_location(F.lit("16:4096")))) == (16, 4096)
    h = one(tx.bucket_path(F.lit("b"))).split("/")
    assert h[0] == h[2][:2] and h[1] == h[2][2:4]
    headers = F.create_map(F.lit("x-amz-meta-Color"), F.array(F.lit("red"), F.lit("blue")), F.lit("Host"), F.array(F.lit("h")))
    assert one(tx.user_metadata(headers)) == {"Color": "red"}
    assert one(tx.with_entries(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), b=F.lit(3))) == {"a": "1", "b": "3"}
    assert one(tx.rfc3339(F.timestamp_seconds(F.lit(0)))) == "1970-01-01T00:00:00Z"
    assert one(tx.truncate(F.lit("héllo"), 2)) == "hé"
