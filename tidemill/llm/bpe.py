"""Byte-level BPE encoding and decoding by DuckDB, one connection for each Python worker.

A text is cut by the tokenizer's pattern; each different piece is encoded once and remembered (two generations of up to
KEPT pieces, so memory is bounded). New pieces go to a recursive query: token-position rows join the merge table with
their right neighbour, and each round contracts the leftmost pair of least rank of every piece, until none has a pair
left. Pieces that are whole tokens take that token, as the library does; those of more than LONG bytes, which would take
as many rounds as they have tokens, are contracted by a heap in the same order. The ids of each document are then decoded:
token-position rows join the vocabulary and an aggregation ordered by position puts their bytes together.

Texts of more than SLICE characters are cut before a line feed that follows a printing character, where no piece can
span, so memory doesn't grow with a text's length.

Defined cases: null texts are empty and have no tokens; a merge file that lacks some single byte raises ValueError; rows
that repeat each give a row; empty tables give empty results; columns of docs stay, whatever their names: where one is
called as a result is, the result gets underscores (common.fresh).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import enter, fresh

KEPT, LONG, BATCH, SLICE, SPLIT, DECODED = 400_000, 200, 5_000, 4_000_000, 4_000_000, 2_000_000

# a round: token-position rows of every piece that isn't done, the best pair of each, and the list with that pair as one token
ENCODE = """
WITH RECURSIVE steps AS (
  SELECT piece, tokens FROM bytes_of_pieces
  UNION ALL
  SELECT piece, tokens[:pos - 1] || [token] || tokens[pos + 2:]
  FROM (SELECT piece, any_value(tokens) AS tokens, min(rank * 4096 + pos) AS best, CAST(best // 4096 AS INT) AS token, best % 4096 AS pos
        FROM (SELECT piece, tokens, unnest(tokens[:-2]) AS a, unnest(tokens[2:]) AS b, unnest(range(1, len(tokens))) AS pos FROM steps)
        JOIN merges USING (a, b) GROUP BY piece)
), done AS (SELECT piece, min_by(tokens, len(tokens)) AS tokens FROM steps GROUP BY piece)
SELECT piece, tokens AS ids FROM done
"""

# a token's bytes are spelled as the code points of the same numbers
DECODE = "SELECT row, string_agg(spelled, '' ORDER BY pos) AS spelled FROM tokens JOIN vocabulary ON token = id GROUP BY row"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _small_pattern(pattern: str, limit: int) -> re.Pattern:
    """The pattern with its classes spelled out below limit, for the faster module; right for texts below limit only."""

    def spelled(test) -> str:
        return "".join(re.escape(chr(c)) for c in range(limit) if test(chr(c)))

    letters, numbers = (spelled(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
    spaces = "".join(re.escape(chr(c)) for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0))
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(inside.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))


class Splitter:
    LIMIT = 0x250

    def __init__(self, pattern: str):
        import regex

        self.any = regex.compile(pattern)
        plain = not re.search(r"\\(?![spS]|p\{[LN]\})", pattern)
        self.small = _small_pattern(pattern, self.LIMIT) if plain else None
        self.outside = re.compile(f"[^\x00-{chr(self.LIMIT - 1)}]")
        self.cut = re.compile(r"\S(?=\n)")

    def slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE and (m := self.cut.search(text, at + SLICE)):
            yield text[at : m.end()]
            at = m.end()
        yield text[at:] if at else text

    def __call__(self, text: str) -> list[str]:
        if self.small and (text.isascii() or not self.outside.search(text)):
            return self.small.findall(text)
        return self.any.findall(text)


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for bytes {missing}")
        self.ranks, self.split = ranks, Splitter(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False})
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        for name, columns, rows in (("merges", ("a", "b", "rank"), pairs), ("vocabulary", ("id", "spelled"), [(r, t.decode("latin-1")) for t, r in ranks.items()])):
            kinds = {"spelled": pa.string(), "rank": pa.int64()}
            loaded = pa.table([pa.array(x, kinds.get(c, pa.int32())) for c, x in zip(columns, zip(*rows, strict=True), strict=True)] if rows else [pa.array([], kinds.get(c, pa.int32())) for c in columns], list(columns))
            self.db.register("loaded", loaded)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM loaded")
            self.db.unregister("loaded")

    def _heap(self, piece: bytes) -> list[int]:
        """The leftmost pair of least rank first, in n log n."""
        tokens: list[int | None] = self.single[np.frombuffer(piece, np.uint8)].tolist()
        text = [bytes([b]) for b in piece]
        after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        get = self.ranks.get
        heap = [(r, i, 2) for i in range(len(piece) - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, size = heapq.heappop(heap)
            if tokens[i] is None or (j := after[i]) >= len(piece) or len(text[i]) + len(text[j]) != size or get(text[i] + text[j]) != rank:
                continue
            tokens[i], text[i], tokens[j] = rank, text[i] + text[j], None
            after[i] = k = after[j]
            if k < len(piece):
                before[k] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < len(piece) and (r := get(both := text[left] + text[right])) is not None:
                    heapq.heappush(heap, (r, left, len(both)))
        return [t for t in tokens if t is not None]

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes pieces that self.young doesn't have."""
        todo: list[tuple[str, bytes]] = []
        for p in pieces:
            if (known := self.old.get(p)) is not None:
                self.young[p] = known
                continue
            raw = p.encode("utf-8", "surrogatepass")
            if (r := self.ranks.get(raw)) is not None:
                self.young[p] = r.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.young[p] = np.array(self._heap(raw), "<u4").tobytes()
            else:
                todo.append((p, raw))
        for at in range(0, len(todo), BATCH):
            some = todo[at : at + BATCH]
            sizes = np.array([len(r) for _, r in some])
            raw = np.frombuffer(b"".join([r for _, r in some]), np.uint8)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            rows = pa.table([pa.array(np.arange(len(some), dtype=np.int32)), pa.ListArray.from_arrays(ends, self.single[raw])], ["piece", "tokens"])
            self.db.register("bytes_of_pieces", rows)
            found = self.db.sql(ENCODE).to_arrow_table().combine_chunks()
            self.db.unregister("bytes_of_pieces")
            ids = found.column("ids").combine_chunks()
            flat, ends = np.asarray(ids.flatten(), dtype="<u4").tobytes(), (np.asarray(ids.offsets) * 4).tolist()
            for k, a, z in zip(found.column("piece").to_pylist(), ends[:-1], ends[1:], strict=True):
                self.young[some[k][0]] = flat[a:z]

    def encode(self, texts: list[str | None]) -> list[list[bytes]]:
        """For each text, the ids of its slices as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if len(self.young) > KEPT:
                self.young, self.old = {}, self.young
            known = self.young
            self.learn([p for p in set().union(*[pieces for _, pieces in held]) if p not in known])
            for k, pieces in held:
                out[k].append(b"".join(map(known.__getitem__, pieces)))
            held, size = [], 0

        for k, t in enumerate(texts):
            for part in self.split.slices(t or ""):
                held.append((k, self.split(part)))
                size += len(part)
                if size >= SPLIT:
                    flush()
        flush()
        return out

    def decode(self, parts: list[bytes]) -> Iterator[bytes]:
        """The bytes of each list of ids (little-endian unsigned 32-bit integers), up to DECODED ids or one list at a time."""
        at = 0
        while at < len(parts):
            end, size = at + 1, len(parts[at])
            while end < len(parts) and size + len(parts[end]) <= 4 * DECODED:
                size += len(parts[end])
                end += 1
            some = parts[at:end]
            ids = np.frombuffer(b"".join(some), "<u4").astype(np.int32)
            row = np.repeat(np.arange(len(some), dtype=np.int32), [len(p) // 4 for p in some])
            self.db.register("tokens", pa.table([pa.array(row), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["row", "pos", "token"]))
            found = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("tokens")
            by_row = dict(zip(found.column("row").to_pylist(), found.column("spelled").to_pylist(), strict=True))
            yield from (by_row.get(k, "").encode("latin-1") for k in range(len(some)))
            at = end


_coders: dict[bytes, Coder] = {}


def coder(ranks: dict[bytes, int], pattern: str, key: bytes) -> Coder:
    """The worker's coder for this vocabulary; workers keep it from task to task."""
    enter("bpe", _coders.clear)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(ranks, pattern)
    return _coders[key]


def _shared(df: DataFrame, path: str, pattern: str):
    ranks = load_ranks(path)
    key = hashlib.sha256(pattern.encode() + b"".join(b"%d %s\n" % (r, t.hex().encode()) for t, r in ranks.items())).digest()
    return df.sparkSession.sparkContext.broadcast((ranks, pattern, key))  # a vocabulary file, not data


def _groups(batch: pa.RecordBatch, at: int, most: int = 8 << 20) -> Iterator[tuple[int, list[str | None]]]:
    column, begin, size = batch.column(at).to_pylist(), 0, 0
    for k, t in enumerate(column):
        size += len(t or "")
        if size >= most:
            yield begin, column[begin : k + 1]
            begin, size = k + 1, 0
    if begin < len(column):
        yield begin, column[begin:]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with n_tokens long, ids (binary, little-endian unsigned 32-bit integers) and decoded_sha256 string."""
    shared, at = _shared(docs, path, pattern), docs.columns.index("text")
    names = [fresh(docs, c) for c in ("n_tokens", "ids", "decoded_sha256")]
    schema = docs.select("*", *[F.lit(x).alias(c) for c, x in zip(names, (0, b"", ""), strict=True)]).withColumn(names[0], F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*shared.value)
        for batch in batches:
            for begin, texts in _groups(batch, at):
                slices = c.encode(texts)
                decoded = c.decode([ids for parts in slices for ids in parts])
                hashes = []
                for parts in slices:
                    h = hashlib.sha256()
                    for _ in parts:
                        h.update(next(decoded))
                    hashes.append(h.hexdigest())
                ids = [b"".join(parts) for parts in slices]
                part = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(hashes, pa.string())], [*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, *, ids: str = "ids") -> DataFrame:
    """rows with a column decoded (binary) from ids (binary as encode() makes them; null: none)."""
    shared, at, name = _shared(rows, path, pattern), rows.columns.index(ids), fresh(rows, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(*shared.value)
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                decoded = list(c.decode([i or b"" for i in part.column(at).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, name])

    return rows.mapInArrow(run, rows.select("*", F.lit(b"").alias(name)).schema)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    done = encode(docs.select("doc_id", "text"), path, pattern)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")
