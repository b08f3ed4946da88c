import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidemill.llm import bits, minhash, near, paragraphs, repeats, shingles


def sets_of(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs, num=85, den=100):
    sets = [sets_of(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None]
        low = min(ids) if ids else None
        out.append((d, len(sets[i]), low, d == low))
    return sorted(out, key=str)


def family(seed, size):
    """Copies of one text with one to many words changed."""
    rnd = random.Random(seed)
    base = prose(seed, 120).split()
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 6, 12])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [32, 3])
def test_minhash(spark, documents, nothing, small, monkeypatch):
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "LOCAL_EDGES", 1_000_000 if small == 32 else 0)
    monkeypatch.setattr(near, "BLOCK", 20 if small == 3 else 1536)
    docs = [(r.doc_id, r.text) for r in documents.collect()] + [(1000 + k, t) for k, t in enumerate(family(1, 60) + family(2, 25))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.digest(df).collect()), key=str)
    assert got == brute_components(docs)


def test_keep_one(spark, documents, nothing):
    kept = minhash.keep_one(documents)
    assert kept.columns == documents.columns
    got = sorted((r.doc_id for r in kept.collect()), key=str)
    assert len(got) == len({minhash_root for minhash_root in [r.root for r in minhash.find(documents).collect()]})
    assert 12 not in got and got.count(2) == 1
    assert minhash.keep_one(nothing).count() == 0 and minhash.digest(nothing).count() == 0


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_components(spark, local, monkeypatch):
    monkeypatch.setattr(near, "LOCAL_EDGES", local)
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
    loops = {a for a, b in edges if a == b and up[a] == a and not any(a in e and e[0] != e[1] for e in edges)}
    assert got == {k: v for k, v in up.items() if k not in loops}


def test_shingles():
    texts = ["a b c", "A  B\tC", "one two three four five six", "", None, "x " * 400, "\x0b\x1f é"]
    s = shingles.describe_texts(texts)
    assert s.sizes.tolist() == [len(sets_of(t.replace("\x0b", " ") if t else t)) for t in texts]
    assert (s.keys[0] == s.keys[1]).all() and (s.signatures[0] == s.signatures[1]).all() and not (s.keys[0] == s.keys[2]).all()
    h = np.array([5, 1 << 47, 9], np.uint64)
    assert shingles.unpack(shingles.pack(h)).tolist() == sorted(h.tolist())


def test_bit_table(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 63), 1 << 63, 5000)
    table = bits.build(spark.createDataFrame([(int(x),) for x in h], "owner long"), "owner")
    assert bits.holds(table, h.view(np.uint64)).all()
    assert bits.holds(table, rng.integers(0, 1 << 63, 5000).astype(np.uint64)).mean() < 0.02
    assert not bits.holds(bits.build(spark.createDataFrame([], "owner long"), "owner"), h.view(np.uint64)).any()


def brute_repeats(docs):
    """{(doc_id, text): result}; rows with equal doc_id and text are one document."""
    seen, out = set(), {}
    order = sorted({(d is not None, d or 0, t or "") for d, t in docs})
    for known, d, t in order:
        raw = t.encode()
        covered = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                covered[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, c in zip(raw, covered, strict=True) if not c)
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out[d if known else None, t] = (len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4000, 1])
def test_repeats(spark, documents, nothing, hot, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 3000)
    monkeypatch.setitem(repeats.find.__kwdefaults__, "hot", hot)
    docs = [(r.doc_id, r.text) for r in documents.collect()] + [(100 + k, t) for k, t in enumerate(family(3, 12))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute_repeats(docs)
    got = sorted(((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in repeats.digest(df).collect()), key=str)
    assert got == sorted(((d, want[d, t or ""]) for d, t in docs), key=str)
    for r in repeats.remove(df).collect():
        assert len(r.kept) + sum(b - a for a, b in r.spans) in {len((t or "").encode()) for d, t in docs if d == r.doc_id}
    assert repeats.digest(nothing).count() == 0


def test_columns_that_clash(spark, documents):
    """Operators don't read other columns, whatever their names."""
    plain = documents.select("doc_id", "text")
    clash = plain.withColumns({c: F.lit("x") for c in ("row", "hash", "n", "owner", "start", "found", "spans", "cid", "k1", "size", "key")})
    for digest in (minhash.digest, repeats.digest, paragraphs.digest):
        assert sorted(map(str, digest(clash).collect())) == sorted(map(str, digest(plain).collect()))


def test_equal_windows():
    """Windows are equal by their bytes, whatever their hashes."""
    rng = np.random.default_rng(2)
    b = np.concatenate([rng.integers(97, 99, 130, dtype=np.uint8)] * 3 + [rng.integers(0, 255, 200, dtype=np.uint8)])
    at = np.arange(len(b) - repeats.LENGTH + 1)
    raw = b.tobytes()
    seen, want = {}, []
    for k in at.tolist():
        want.append(seen.setdefault(raw[k : k + repeats.LENGTH], k))
    for h in (repeats.rolling(b, repeats.LENGTH), repeats.rolling(b, repeats.LENGTH) % np.uint64(7), np.zeros(len(at), np.uint64)):
        assert repeats._first_equal(h, at, b).tolist() == want


def test_paragraphs(spark, documents, nothing):
    got = {}
    for r in paragraphs.digest(documents).collect():
        got.setdefault(r.doc_id, r)
    docs = {r.doc_id: r.text for r in documents.collect()}
    passage = len(prose(77, 60).split())
    assert got[12].n_removed > 0 and got[12].earlier_docs == [0]
    assert got[13].n_removed > 0 and got[13].earlier_docs == [3]
    assert got[20].n_removed >= passage // 3 and got[20].earlier_docs == [8, 9, 19]  # set into 20 words of 8 and 25 of 9
    assert all(got[k].n_removed == 0 for k in (*range(1, 12), 14, 15, 16, 17, 18, 21))
    for k, r in got.items():
        if k is not None and not r.n_removed:
            assert r.kept_sha256 == hashlib.sha256((docs[k] or "").encode()).hexdigest()
    assert paragraphs.digest(nothing).count() == 0
    left = {r.doc_id: r.kept for r in paragraphs.remove(documents).collect()}
    assert len(left[20]) < len(docs[20]) and left[1] == docs[1]


def brute_paragraphs(rows):
    """{(doc_id, text): (words, words that go)} by the definition: word tuples in place of hashes, all pairs of paragraphs."""
    docs = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    units, runs, words_of = [], [], {}
    for place, (_, _, t) in enumerate(docs):
        lines = [line_words(x) for x in t.split("\n")]
        words = [w for x in lines for w in x]
        words_of[place] = words
        at, open_at = 0, None
        for x in [*lines, []]:
            short = 0 < len(x) < paragraphs.LEAST
            if not short:
                if open_at is not None and at - open_at >= paragraphs.LEAST:
                    units.append((place, open_at, at))
                open_at = None
                if len(x) >= paragraphs.LEAST:
                    units.append((place, at, at + len(x)))
            elif open_at is None:
                open_at = at
            at += len(x)
        if len(words) >= paragraphs.RUN:
            h = shingles.word_hashes(" ".join(words).encode())[0]
            two = shingles.mix(h[:-1] + h[1:] * paragraphs._TURN).tolist()
            r = paragraphs.REACH
            cuts = sorted({0, len(words)} | {k for k in range(len(two)) if two[k] == min(two[max(0, k - r) : k + r + 1])})
            runs.append((place, [(a, b, tuple(words[a:b])) for a, b in zip(cuts, cuts[1:])]))
    gone = {p: set() for p in words_of}
    sets = [{tuple(words_of[p][k : k + 5]) for k in range(a, b - 4)} for p, a, b in units]
    up = list(range(len(units)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(units)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    for i, (p, a, b) in enumerate(units):
        if root(i) != i:
            gone[p] |= set(range(a, b))
    seen, again = set(), {p: set() for p in words_of}
    for p, some in runs:
        for a, b, key in some:
            if key in seen:
                again[p] |= set(range(a, b))
            seen.add(key)
    for p, marks in again.items():
        run = []
        for k in range(len(words_of[p]) + 1):
            if k in marks:
                run.append(k)
            elif run:
                gone[p] |= set(run) if len(run) >= paragraphs.RUN else set()
                run = []
    return {(docs[p][1] if docs[p][0] else None, docs[p][2]): (len(words_of[p]), len(gone[p])) for p in words_of}


def line_words(line):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).replace("\t", " ")
    return [w for w in folded.split(" ") if w]


def test_paragraphs_by_definition(spark):
    """Paragraphs well above or below the threshold, hard-wrapped ones, passages in other words, repeated rows, null ids."""
    rnd = random.Random(12)
    passages = [prose(700 + k, 30).replace("\n", " ") for k in range(6)]
    wrapped = [" ".join(prose(800 + k, 48).split()) for k in range(3)]
    rows = []
    for k in range(60):
        lines = [prose(1000 + k, rnd.randrange(5, 40)).replace("\n", " "), "", rnd.choice(passages), prose(2000 + k, 9).replace("\n", " ")]
        if k % 3 == 0:
            w = rnd.choice(wrapped).split()
            if k % 2:
                w[rnd.choice([0, 47])] = f"edit{k}"
            lines += ["", *(" ".join(w[a : a + 8]) for a in range(0, 48, 8)), ""]
        if k % 4 == 0:
            lines.append(f"{prose(3000 + k, 7)} {rnd.choice(passages)} {prose(4000 + k, 6)}".replace("\n", " "))
        rows.append((k, "\n".join(lines)))
    rows += [rows[5], rows[9], (None, rows[7][1]), (None, None), (None, ""), (61, None), (62, passages[0]), (63, "short"), (63, passages[1] + "\nother")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_paragraphs(rows)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in paragraphs.digest(df).collect())
    assert got == sorted((str(d), *want[d, t or ""]) for d, t in rows)
    assert sum(n for _, _, n in got) > 1500


def test_paragraph_pairs(spark):
    """Paragraphs of similarity 0.8 and more are one component, others aren't."""
    base = prose(9, 90).replace("\n", " ").split()
    close, far = list(base), list(base)
    close[0], close[-1] = "first", "last"
    far[::7] = ["other"] * len(far[::7])
    rows = [(1, " ".join(base)), (2, " ".join(close)), (3, " ".join(far)), (4, "short line\nshort line")]
    got = {r.doc_id: r.n_removed for r in paragraphs.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 90, 3: 0, 4: 0}


@pytest.mark.parametrize("hot", [4000, 1])
def test_paragraph_runs(spark, hot):
    """Words that repeat in turn are found in other lines and inside one line, whatever their period."""
    rows = []
    for period in range(1, 8):
        slogan = " ".join((prose(900 + period, period).lower().replace("\n", " ").replace(".", "").split() * 60)[:60])
        rows += [(10 * period + k, f"{prose(100 * period + k, 30)} {slogan} {prose(100 * period + 50 + k, 30)}".replace("\n", " ")) for k in range(3)]
    rows.append((1000, "buy now " * 400))
    found = paragraphs.find(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    gone = {r.doc_id: paragraphs.cut(r.text, r.found and [f.asDict() for f in r.found])[1] for r in found}
    for period in range(1, 8):
        # a slogan's first copy keeps what doesn't repeat in itself
        assert all(30 <= gone[10 * period + k] <= 60 + 2 * paragraphs.REACH for k in range(3)), (period, gone)
    assert 780 <= gone[1000] < 800
