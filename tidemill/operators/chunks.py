"""Files to chunks: whole declarations of Go, Python, JavaScript and TypeScript, merged and split by size.

Chunk rows: document_id, path, language, chunk_id, kind, name, content, start_line, end_line, start_byte, end_byte,
chunk_index, chunk_total. Lines count from 1, bytes from 0 with the end exclusive.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import text as tx

MIN_SIZE, MAX_SIZE = 100, 2000
_SPLIT = [("kind", T.StringType()), ("name", T.StringType()), ("content", T.StringType()), ("start_line", T.LongType()), ("end_line", T.LongType()), ("start_byte", T.LongType()), ("end_byte", T.LongType()), ("chunk_index", T.LongType()), ("chunk_total", T.LongType())]


@dataclass(frozen=True)
class Chunk:
    kind: str
    name: str
    content: str
    start_line: int
    end_line: int
    start_byte: int
    end_byte: int

    @property
    def size(self) -> int:
        return len(self.content.encode())


class _Lines:
    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.at = [0]
        for x in self.lines:
            self.at.append(self.at[-1] + len(x.encode()) + 1)

    def chunk(self, kind: str, name: str, first: int, last: int) -> Chunk:
        """Lines first to last, from 1."""
        content = "\n".join(self.lines[first - 1 : last])
        start = self.at[first - 1]
        return Chunk(kind, name, content, first, last, start, start + len(content.encode()))


def _python(text: str, lines: _Lines) -> list[Chunk] | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out, imported = [], False
    for node in tree.body:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        if isinstance(node, ast.Import | ast.ImportFrom):
            if not imported:
                out.append(lines.chunk("import", "", first, node.end_lineno))
            imported = True
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(lines.chunk("function", node.name, first, node.end_lineno))
        elif isinstance(node, ast.ClassDef):
            out.append(lines.chunk("class", node.name, first, node.end_lineno))
    return out


_SKIP = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.DOTALL)


def _bare(text: str) -> str:
    """text with comments and strings blanked, line for line."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _end_of(bare: list[str], first: int) -> int:
    """The line (from 0) where what starts on `first` has closed all its brackets."""
    depth = 0
    for k in range(first, len(bare)):
        for c in bare[k]:
            depth += (c in "({[") - (c in ")}]")
        if depth <= 0 and not bare[k].rstrip().endswith((",", "=", "(", "{")):
            return k
    return len(bare) - 1


_GO = [("package", re.compile(r"package\s+(\w+)")), ("import", re.compile(r"import\b()")), ("method", re.compile(r"func\s*\([^)]*\)\s*(\w+)")), ("function", re.compile(r"func\s+(\w+)")), ("struct", re.compile(r"type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b")), ("interface", re.compile(r"type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b")), ("type", re.compile(r"type\b\s*(\w*)")), ("var", re.compile(r"var\b\s*(\w*)")), ("const", re.compile(r"const\b\s*(\w*)"))]
_JS = [("import", re.compile(r"import\b()")), ("function", re.compile(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w*)")), ("class", re.compile(r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)")), ("declaration", re.compile(r"(?:export\s+)?(?:const|let)\s+(\w*)"))]


def _declared(text: str, lines: _Lines, kinds: list[tuple[str, re.Pattern]], once: tuple[str, ...]) -> list[Chunk]:
    """Declarations that start in the first column."""
    bare, out, seen, k = _bare(text).split("\n"), [], set(), 0
    while k < len(bare):
        found = next(((kind, m[1]) for kind, p in kinds if (m := p.match(bare[k]))), None)
        if found is None:
            k += 1
            continue
        end = _end_of(bare, k)
        if found[0] not in once or found[0] not in seen:
            out.append(lines.chunk(*found, k + 1, end + 1))
        seen.add(found[0])
        k = end + 1
    return out


def split_file(text: str, language: str) -> list[Chunk]:
    """An empty file has no chunk; one of unknown language, or without declarations that are known, is one."""
    if not text:
        return []
    lines = _Lines(text)
    found: list[Chunk] | None = None
    if language == "python":
        found = _python(text, lines)
    elif language == "go":
        found = _declared(text, lines, _GO, ())
    elif language in ("javascript", "typescript"):
        found = _declared(text, lines, _JS, ("import",))
    return found or [lines.chunk("file", "", 1, len(lines.lines))]


def pieces_of(c: Chunk, most: int) -> list[Chunk]:
    """Whole lines, a piece closing once it has `most` bytes."""
    out, begin, size, at = [], 0, 0, c.start_byte
    lines = c.content.split("\n")
    for k, x in enumerate(lines):
        size += len(x.encode()) + (k > begin)
        if size >= most or k == len(lines) - 1:
            content = "\n".join(lines[begin : k + 1])
            out.append(replace(c, content=content, start_line=c.start_line + begin, end_line=c.start_line + k, start_byte=at, end_byte=at + size))
            at, begin, size = at + size + 1, k + 1, 0
    return out


def fold(chunks: list[Chunk], least: int = MIN_SIZE, most: int = MAX_SIZE) -> list[Chunk]:
    """Small neighbours merged, large chunks split."""
    out: list[Chunk] = []
    for c in chunks:
        if out and c.size < least and out[-1].size < least:
            p = out[-1]
            out[-1] = replace(p, content=p.content + "\n" + c.content, end_line=c.end_line, end_byte=c.end_byte)
        elif c.size > most:
            out += pieces_of(c, most)
        else:
            out.append(c)
    return out


def chunk_files(files: DataFrame, *, path: str = "path", content: str = "content", min_size: int = MIN_SIZE, max_size: int = MAX_SIZE, split: bool = True, indexed_at=None) -> DataFrame:
    """Chunk rows of files (path, content as text or UTF-8 bytes), with the time indexed_at as RFC 3339 text if it is given."""
    source = files.select(F.col(path).alias("path"), F.col(content).cast("string").alias("content"), tx.language(F.col(path)).alias("language"))
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), *(T.StructField(n, t) for n, t in _SPLIT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, text, language in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = split_file(text or "", language)
                found = fold(found, min_size, max_size) if split else found
                rows += [(p, language, c.kind, c.name, c.content, c.start_line, c.end_line, c.start_byte, c.end_byte, k, len(found)) for k, c in enumerate(found)]
            if rows:
                kinds = [pa.string()] * 5 + [pa.int64()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

    out = source.mapInArrow(run, schema)
    place = [F.col(c) for c in ("path", "start_line", "end_line", "start_byte", "end_byte")]
    when = [] if indexed_at is None else [tx.rfc3339(F.lit(indexed_at).cast("timestamp")).alias("indexed_at")]
    return out.select(tx.document_id(F.col("path")).alias("document_id"), "path", "language", tx.chunk_id(*place).alias("chunk_id"), *[n for n, _ in _SPLIT], *when)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))


def delete_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def get_chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("chunk_id") == chunk_id)


def embed(text, dim: int = 64):
    """A stand-in for an embedding model: hashed words, counted into dim places and scaled to length 1."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    # the outer array of one makes places a variable, so that they are computed once
    counted = F.transform(F.array(places), lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(ps, lambda p: p == i)).cast("double")))
    scaled = F.transform(counted, _unit)
    return F.element_at(scaled, 1)


def _unit(counts):
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float"))), 1)
