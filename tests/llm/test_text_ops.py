import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tests.llm.conftest import prose
from pyspark.sql import functions as F

from tidemill.llm import bpe, chat, decontaminate, fingerprint, pii, quality, suffix, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts_of(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


# --- suffix arrays and FM-index ---


@pytest.mark.parametrize("size", [1, 2, 50, 400])
def test_suffix_array(size):
    rng = np.random.default_rng(size)
    t = rng.integers(0, 3, size)
    sa, rank = suffix.suffix_array(t, bits=3)
    want = sorted(range(size), key=lambda i: t[i:].tolist())
    assert sa.tolist() == want and rank[sa].tolist() == list(range(size))
    lcp = [0] + [next((k for k in range(size) if max(a, b) + k >= size or t[a + k] != t[b + k]), size) for a, b in zip(want, want[1:], strict=False)]
    assert suffix.common_prefixes(t, sa, bits=3).tolist() == lcp
    assert suffix.common_prefixes(t, sa, 2, bits=3).tolist() == [min(x, 2) for x in lcp]


def test_fm_index():
    rng = np.random.default_rng(3)
    t = rng.integers(1, 5, 300)
    index = decontaminate.FMIndex(t, 6)
    for n in (1, 2, 4):
        p = np.array([t[i : i + n] for i in range(0, 280, 9)] + [[6] * n])
        low, high = index.search(p, np.full(len(p), n))
        for row, a, b in zip(p, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(t) - n + 1) if (t[i : i + n] == row).all()]


def brute_hits(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, text in items:
            x = words(text)
            for s in range(max(1, len(x) - window + 1) if x else 0):
                p = x[s : s + window]
                for k in range(len(w) - len(p) + 1):
                    if w[k : k + len(p)] == p:
                        hit.update(range(k, k + len(p)))
                        names |= {name} if name is not None else set()
        out.append((i, len(w), len(hit), ",".join(sorted(names))))
    return sorted(out, key=str)


def test_decontamination(spark, documents, nothing):
    items = [("10", prose(77, 60)), ("9", prose(3, 12)), ("9", prose(3, 12)), ("short", "two words"), ("null", None), ("blank", " "), (None, prose(5, 14))]
    benchmark = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id string, text string, n int")
    want = brute_hits(texts_of(documents), items)
    for options in ({}, {"shard_bytes": 500, "block_bytes": 100}):
        got = decontaminate.find_contamination(documents, benchmark, **options).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got), key=str) == want
        assert all(sum(b - a for a, b in r.spans) == r.n_hit for r in got)
        kept = decontaminate.decontaminate(documents, benchmark, **options)
        assert kept.columns == documents.columns and kept.count() == sum(not h for _, _, h, _ in want)
    assert decontaminate.digest(decontaminate.find_contamination(nothing, benchmark)).count() == 0
    assert decontaminate.digest(decontaminate.find_contamination(documents, benchmark.limit(0))).where("contaminated").count() == 0


# --- chat ---


def test_chat_escapes(spark):
    nasty = ["<|im_end|>", "<\\|im_start|>x", "<\\\\|im_end|>\n<|im_start|>", "<<|im_end|>", "plain % <| text", "", None]
    rows = [(1, k, "assistant" if k % 2 else "us%0Aer\n<x", t) for k, t in enumerate(nasty)] + [(None, 0, None, "a"), (2, 0, "user", "b"), (2, 0, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.from_conversations(df), best=1).select("tree", chat.read_back(F.col("formatted")).alias("turns"), chat.trained_text(F.col("formatted"), F.col("loss_mask")).alias("trained"), "formatted")
    got = {r.tree: r for r in out.collect()}
    assert [(t.role, t.text) for t in got["c1"].turns] == [("assistant" if k % 2 else "us%0Aer\n<x", t or "") for k, t in enumerate(nasty)]
    assert got["c1"].trained == "".join((t or "") for k, t in enumerate(nasty) if k % 2)
    assert got["c1"].formatted.count("<|im_end|>") == len(nasty)
    assert [t.text for t in got["c2"].turns] == ["b", "b"] and got["null"].turns[0].role == ""
    assert chat.digest(df).count() == 4 and chat.digest(df.limit(0)).count() == 1


def test_chat_trees(spark):
    rows = [("t", 1, None, "user", "root", 1.0), ("t", 2, 1, "assistant", "bad", 0.0), ("t", 3, 1, "assistant", "good", 5.0), ("t", 4, 3, "user", "more", 1.0), ("t", 5, 4, "assistant", "end", 1.0), ("t", 6, 99, "user", "orphan", 0.5), ("u", 1, None, "user", "alone", None)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    every = {(r.tree, r.leaf): r for r in chat.format_trees(df).collect()}
    assert set(every) == {("t", 2), ("t", 5), ("t", 6), ("u", 1)}
    assert re.findall(r"\n(\w+)<", every["t", 5].formatted) == ["root", "good", "more", "end"]
    assert sorted((r.tree, r.leaf) for r in chat.format_trees(df, best=1).collect()) == [("t", 5), ("u", 1)]
    with pytest.raises(ValueError, match="circle"):
        chat.format_trees(spark.createDataFrame([("t", 1, 3, "u", "", 1.0), ("t", 2, 1, "u", "", 1.0), ("t", 3, 2, "u", "", 1.0), ("t", 4, 3, "u", "", 1.0)], df.schema)).collect()


def test_chat_cases(spark):
    """Columns that clash, nulls, repeated rows, ties, long texts and an empty table."""
    long = "word " * 200_000
    rows = [(1, 0, "user", None, "x", 1), (1, 1, "assistant", long, "y", 2), (None, 0, "user", "a", "z", 3), (2, 0, None, "same", "t", 4), (2, 0, None, "same", "t", 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string, node int")
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    assert got.keys() == {1, None, 2, -1} and got[2].n_turns == 2 and got[1].loss_chars == len(long)
    assert got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert [r.conv_id for r in chat.digest(df.limit(0)).collect()] == [-1]


# --- fingerprints ---


def test_fingerprints(spark, documents, nothing):
    got = fingerprint.digest(documents).collect()
    docs = sorted(texts_of(documents), key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    want = []
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        q = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    by_text = {}
    for i, t in texts_of(documents):
        by_text.setdefault(t or "", set()).update(r.fingerprint for r in got if r.doc_id == i and r.n_chars == len(t or ""))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert {r.fingerprint for r in got if r.doc_id in (0, 12)} == {next(r.fingerprint for r in got if r.doc_id == 0)}
    # a row that repeats is followed by its equal
    assert all(r.near_edited > r.near_next for r in got if int(r.fingerprint.split(":")[1]) >= 8 and r.doc_id != 2)
    assert fingerprint.digest(nothing).count() == 0
    clash = fingerprint.digest(documents.withColumn("bucket", F.lit(1)).withColumn("extra", F.lit(2)).withColumn("fingerprint", F.lit("x")))
    assert sorted(map(str, clash.collect())) == sorted(map(str, got))
    assert fingerprint.digest(documents.where("doc_id = 3")).first().near_next == 1


def test_merkle_edits(spark):
    a, b = "one\ntwo\n\nthree\nfour", "one\n2\n\nthree\nfour\nfive"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(fingerprint.differing(fingerprint.tree(F.col("a")), fingerprint.tree(F.col("b"))).alias("d"), (fingerprint.root(fingerprint.tree(F.col("a"))) == fingerprint.root(fingerprint.tree(F.col("b")))).alias("same")).first()
    assert [(d.section, d.paragraph) for d in got.d] == [(0, 1)] and not got.same


def test_located_edits(spark):
    """An inserted paragraph marks itself only; moved sections and paragraphs are none; near copies stay near."""
    rnd = random.Random(3)
    lines = [prose(k, 12).replace("\n", " ") for k in range(30)]
    texts = ["\n\n".join("\n".join(lines[k : k + 3]) for k in range(0, 30, 3))]
    texts.append("\n\n".join("\n".join(lines[k : k + 3]) for k in (*range(3, 30, 3), 0)))  # the first section moves
    texts.append(texts[0].replace(lines[4], f"new line\n{lines[4]}"))
    texts.append(texts[0].replace(lines[4], f"less {lines[4]}").replace(lines[17], lines[17] + " more"))
    word = texts[0].split(" ", 1)
    texts.append(f"{word[0]} inserted {word[1]}".replace("\n", " "))
    texts.append(prose(99, 360))
    df = spark.createDataFrame([(k, texts[0], t) for k, t in enumerate(texts)], "k int, a string, b string")
    df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "a", "x", "ta"), "b", "y", "tb")
    got = {r.k: r for r in df.select("k", fingerprint.differing(F.col("tb"), F.col("ta")).alias("d"), fingerprint.differing(F.col("ta"), F.col("tb")).alias("e"), fingerprint.likeness("x", "y").alias("near")).collect()}
    places = lambda ds: [(d.section, d.paragraph) for d in ds]
    assert [places(got[k].d) for k in range(4)] == [[], [], [(1, 1)], [(1, 1), (5, 2)]]
    assert [places(got[k].e) for k in range(4)] == [[], [], [], [(1, 1), (5, 2)]]
    assert got[0].near == 1 and got[1].near == 1 or got[1].near > 0.9
    assert got[2].near > 0.9 and 0.8 < got[3].near < 1 and got[4].near > 0.8 and got[5].near < 0.1 and rnd


# --- personal data ---

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            out += [(m.start(), k, kind, m.end())] if ok else []
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def test_base_spans():
    rnd = random.Random(2)
    parts = ["a.b@c.d", "@", "x@y", "..@a-b.c.d.", "10.0.0.1", "999.1.1.1", "1.2.3.4.5", "+1 (555) 555-1234", "+12", "4111 1111 1111 1111", "4111-1111-1111-1112", "0", " ", "é", "%+-", ".", "٣"]
    for _ in range(2000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert [tuple(s) for s in pii.base_spans(t)] == brute_spans(t), t


def test_personal_data(spark, documents, nothing):
    got = pii.digest(documents).collect()
    want = []
    for i, t in texts_of(documents):
        spans = brute_spans(t or "")
        want.append((i, *(sum(s[0] == k for s in spans) for k in PATTERNS), hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=str) == sorted(want, key=str)
    clean = pii.redact(documents)
    assert clean.columns == documents.columns and clean.count() == documents.count()
    row = clean.where("doc_id = 25").first()
    assert row.text == "<EMAIL> or <PHONE>, host <IP>, card <CARD>" and row.row == "kept"
    assert pii.digest(nothing).count() == 0 and pii.redact(nothing).count() == 0


def test_learned_identifiers(spark):
    """Badge numbers, which no fixed pattern knows, stand where addresses do; version numbers don't."""
    rnd = random.Random(4)
    rows = []
    for k in range(120):
        who = f"user{k}@mail.example.org" if k % 3 else f"badge-{rnd.randrange(10**8):08d}"
        rows.append((k, f"{prose(k, 5)} contact: {who} please. Release version-{rnd.randrange(10**8):08d} out."))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = [r.text[s.start : s.end] for r in found for s in r.learned]
    assert len(seen) == 40 and all(x.startswith("badge-") for x in seen)


def brute_graph(edges, plain, rounds=pii.ROUNDS, support=pii.SUPPORT, prior=pii.PRIOR, threshold=pii.THRESHOLD, best=pii.BEST):
    """{value: confidence} by the definition, with dictionaries."""
    given = {}
    for _, v, p in edges:
        given[v] = max(given.get(v, 0.0), p)
    of = {}
    for pattern, v, _ in edges:
        of.setdefault(pattern, set()).add(v)
    of = {p: vs for p, vs in of.items() if len(vs) >= support}
    now = {v: given[v] for vs in of.values() for v in vs}
    refuted = {v for v in now if given[v] == 0 and re.fullmatch(pii._REFUTED.pattern, v)}
    for _ in range(rounds):
        trust = {p: sum(now[v] for v in vs) / (len(vs) + prior + sum(n for x, n in plain if x == p)) for p, vs in of.items() if sum(now[v] >= threshold or given[v] > 0 for v in vs) >= support}
        new = {}
        for v in now:
            doubts = sorted(1 - trust[p] for p, vs in of.items() if v in vs and p in trust)[:best]
            new[v] = 1.0 if given[v] == 1 else 0.0 if v in refuted else max(given[v], 1 - float(np.prod(doubts)) if doubts else 0.0)
        now = new
    return {v: c for v, c in now.items() if given[v] < 1}


def test_score_graph(spark):
    rnd = random.Random(8)
    values = [f"v{k}" for k in range(60)] + ["4111111111111112", "300.1.1.1"]
    priors = {v: rnd.choice([0.0, 0.0, 0.0, pii.WEAK, 1.0]) if v[0] == "v" else 0.0 for v in values}
    edges = [(f"l:{rnd.randrange(9) * rnd.randrange(3)}", v, priors[v]) for v in values for _ in range(4)] + [("k:id", v, priors[v]) for v in values[:40]]
    edges += edges[:20]
    plain = [("l:0", 7), ("l:2", 30), ("l:2", 1), ("l:99", 5)]
    for case in (edges, edges[:3], []):
        got = pii.score_graph(spark.createDataFrame(case, "pattern string, value string, prior double"), spark.createDataFrame(plain, "pattern string, n long"))
        got = {r.value: r.confidence for r in got.collect()}
        want = brute_graph(case, plain)
        assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v]) for v in want)
        assert len(got) > 30 if case is edges else True


def test_secrets(spark, documents):
    """Keys and what stands where they do, of any shape, in rounds; hashes in other places and ordinary values stay."""
    rnd = random.Random(6)
    key = lambda: "".join(rnd.choices("0123456789abcdef", k=40))
    rows, want = [], set()
    for k in range(60):
        value = key() if k % 4 else f"hunter{k}"
        want.add(value)
        rows.append((k, f"{prose(k, 9)} token = \"{value}\" {prose(k + 500, 9)}"))
    loose = [key() for _ in range(30)]
    rows += [(100 + k, f"{prose(200 + k, 30)} the {x} {prose(700 + k, 1)}{k} and the rest of the {prose(k, 4)}") for k, x in enumerate(loose)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.text[s.start : s.end] for r in found for s in r.learned} == want
    clash = documents.withColumn("base", F.lit("mine")).withColumn("learned", F.lit(3))
    got = pii.find(clash)
    assert got.columns == [*clash.columns, "_base", "_learned", "_row"] and got.where("base = 'mine' AND learned = 3 AND row = 'kept'").count() == clash.count()


def test_scan_is_linear():
    """Long runs without digits or blanks, and many tokens beside many addresses."""
    for text in ("x" * 1_000_000, "x" * 500_000 + "7" + "y" * 500_000, "a@b.co k1 " * 20_000, "=" * 300_000, "1" * 300_000):
        base = pii.base_spans(text)
        seen = pii.occurrences(text, base)
        assert pii.ordinary(text, seen) is not None
    assert len(pii.occurrences("a@b.co k1 " * 20_000, pii.base_spans("a@b.co k1 " * 20_000))) == 40_000


# --- byte-pair encoding ---


def test_byte_pairs(spark, documents, nothing):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})
    done = bpe.encode(documents, VOCABULARY, public_tokenizers.PATTERN)
    for r in done.collect():
        ids = memoryview(bytes(r.ids)).cast("I").tolist()
        assert ids == own.encode_ordinary(r.text or "") and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode(done, VOCABULARY, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert bpe.digest(nothing, VOCABULARY, public_tokenizers.PATTERN).count() == 0
    clash = bpe.encode(documents.withColumn("ids", F.lit("mine")), VOCABULARY, public_tokenizers.PATTERN)
    assert clash.columns == [*documents.columns, "ids", "n_tokens", "_ids", "decoded_sha256"] and clash.where("ids <> 'mine' OR n <> 7").isEmpty()


def test_splitter_and_coder():
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})
    coder = bpe.Coder(bpe.load_ranks(VOCABULARY), public_tokenizers.PATTERN)
    rnd = random.Random(1)
    alphabet = "ab  \n\t'stré²ªº½Ⅷ一 \x1c\x85\xa0‘…🙂É12३é\x0b."
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + ["a" * 700, "é" * 300, "=-" * 200]
    old = bpe.SLICE, bpe.DECODED
    bpe.SLICE, bpe.DECODED = 15, 40
    try:
        for t, slices in zip(texts, coder.encode(texts), strict=True):
            assert memoryview(b"".join(slices)).cast("I").tolist() == own.encode_ordinary(t)
            assert b"".join(coder.decode(slices)) == t.encode()
    finally:
        bpe.SLICE, bpe.DECODED = old
    with pytest.raises(ValueError, match="no token"):
        bpe.Coder({b"a": 0}, public_tokenizers.PATTERN)


# --- classifiers ---


def labelled(spark, seed, bad):
    rows, marks = [], []
    for k in range(400):
        t = prose(seed * 1000 + k, 80)
        y = int(k % 4 == 0)
        rows.append((k, bad(t) if y else t))
        marks.append((k, 1 - y, y))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def accuracy(rows, want):
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    return np.mean([r.predicted == want(r.doc_id) for r in held])


def test_quality(spark, documents, nothing, labels):
    docs, marks = labelled(spark, 1, lambda t: " ".join(w + "%%%" for w in t.split()))
    assert accuracy(quality.digest(docs, marks).collect(), lambda i: int(i % 4 != 0)) > 0.95
    got = quality.digest(documents, labels).collect()
    assert len(got) == documents.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.digest(nothing, labels).count() == 0
    for few in (labels.limit(0), labels.where("quality = 1"), labels.where("quality = 0")):
        assert all(0 <= r.score <= 1 for r in quality.digest(documents, few).collect())
    assert quality.keep_good(documents, labels.limit(0)).count() == documents.count()


def test_quality_differences(spark):
    """Compressed sizes by the definition, over whole texts; dictionaries read whole rows up to their bound."""
    good, bad = ([prose(k, 60) + f" {word}" * 40 for k in range(100)] for word in ("lantern harbour", "spam%%% zip###"))
    rows = [(y, t, k) for y, texts in ((1, good), (0, bad)) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "y int, text string, place long")
    made = quality.dictionaries(frame)
    assert made.keys() == {0, 1} and made == quality.dictionaries(frame.repartition(7))
    few = quality.dictionaries(frame, 2000)
    assert all(len(few[y]) <= 2000 for y in (0, 1)) and quality.dictionaries(frame.limit(0)) == {}
    model = quality.Model(made[1], made[0], 1.0, 0.0)
    texts = ["lantern harbour " * 5, prose(3, 6000) + " spam%%% zip###", "", None]
    got = {r.n: r.x for r in quality.differences(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), model, "x").collect()}
    g, b = quality.compressor(made[1]), quality.compressor(made[0])
    for n, text in enumerate(texts):
        raw = (text or "").encode()
        sizes = [sum(len(c.compress(raw[i : i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK)) for c in (b, g)]
        assert got[n] == pytest.approx((sizes[0] - sizes[1]) / max(1, len(raw)))
    assert got[0] > 0 and got[2] == got[3] == 0


def test_toxicity(spark, documents, nothing, labels):
    docs, marks = labelled(spark, 2, lambda t: t + " you xoxic zumbag")
    assert accuracy(toxicity.digest(docs, marks).collect(), lambda i: int(i % 4 == 0)) > 0.95
    got = toxicity.digest(documents, labels).collect()
    assert len(got) == documents.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.digest(nothing, labels).count() == 0
    assert all(r.score < 0.5 for r in toxicity.digest(documents, labels.limit(0)).collect())
    few = toxicity.fit(docs, marks, most=50)
    assert 0 < len(few.grams.code) <= 50


def test_toxicity_rare_groups(spark, documents):
    """No letter group is left out, however few of them the workers hold."""
    docs, marks = labelled(spark, 3, lambda t: t + " you xoxic zumbag")
    every = docs.unionByName(documents.selectExpr("doc_id + 10000 AS doc_id", "text"))
    few, many = toxicity.fit(docs, marks, most=50), toxicity.fit(docs, marks)
    assert few.rest[0].count() == len(many.grams.code) > 50 and (few.a, few.b) == pytest.approx((many.a, many.b), rel=1e-3)
    got, want = (sorted((str(r.doc_id), r.toxic_raw) for r in toxicity._raw(every, m).collect()) for m in (few, many))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], atol=1e-9)


def brute_kneser_ney(words):
    """{letter group: log ratio} from {(word, class): count}, by the definition: p(letter | context) of each class backs off
    to continuation counts over both classes, order by order."""
    d, top = toxicity.DISCOUNT, toxicity.ORDER
    counts = {}
    for (w, y), n in words.items():
        spelled = "^" * (top - 1) + w + "$"
        for i in range(len(w) + 1):
            counts.setdefault(spelled[i : i + top], [0, 0])[y] += n

    def groups(n):
        """The groups of n letters that end some group of the top order, each with the letters before it."""
        return {g: {x[-n - 1] for x in counts if x.endswith(g)} for g in {x[-n:] for x in counts}}

    below = {n: groups(n) for n in range(1, top)}

    def shared(g):
        here = below[len(g)]
        beside = [x for x in here if x[:-1] == g[:-1]]
        total = sum(len(here[x]) for x in beside)
        rest = shared(g[1:]) if len(g) > 1 else 1 / len(beside)
        return (len(here[g]) - d + d * len(beside) * rest) / total

    def p(g, y):
        beside = [c[y] for x, c in counts.items() if x[:-1] == g[:-1]]
        if not sum(beside):
            return shared(g[1:])
        return (max(counts[g][y] - d, 0) + d * sum(n > 0 for n in beside) * shared(g[1:])) / sum(beside)

    return {g: np.log(p(g, 1) / p(g, 0)) for g in counts}


def test_kneser_ney(spark):
    rnd = random.Random(4)
    words = {("".join(rnd.choices("abc", k=rnd.randrange(1, 6))), y): rnd.randrange(1, 9) for _ in range(20) for y in (0, 1)}
    ratios, contexts = toxicity.log_ratios(toxicity.count_grams(spark.createDataFrame([(w, y, n) for (w, y), n in words.items()], "word string, y int, n long")))
    want = brute_kneser_ney(words)
    got = {r.gram: r.ratio for r in ratios.collect()}
    assert got.keys() == want.keys() and np.allclose([got[g] for g in want], list(want.values()))
    scorer = toxicity.Scorer(toxicity.Ratios.of(ratios.select("gram", "ratio")), toxicity.Ratios.of(contexts))
    other = {r.context: r.ratio for r in contexts.collect()}
    texts = ["abc cab aaaa", "zzz ab ABC", "", None, "b " * 300]
    for text, x in zip(texts, scorer.texts(texts), strict=True):
        adds = []
        for w in (text or "").lower().split():
            spelled = "^" * 4 + w + "$"
            r = sum(want.get(spelled[i : i + 5], other.get(spelled[i : i + 4], 0.0)) for i in range(len(w) + 1))
            adds.append(np.log(1 - toxicity.MIX + toxicity.MIX * np.exp(r)))
        assert x == pytest.approx(sum(adds) / max(1, len(adds)) ** toxicity.NORM)


def test_identifiers_of_any_shape(spark):
    """Context decides on short and digit-only values too; failed cards and values at many weak places are none."""
    rnd = random.Random(5)
    shapes = [lambda: f"{rnd.randrange(100, 999)}-{rnd.randrange(10, 99)}-{rnd.randrange(1000, 9999)}", lambda: f"{rnd.randrange(10**9, 10**10)}", lambda: f"555-{rnd.randrange(100, 999)}-{rnd.randrange(1000, 9999)}", lambda: f"X{rnd.randrange(10**6, 10**7)}"]
    failed = [c for c in map(str, range(4111111111111111, 4111111111111140)) if not pii.luhn(c)]
    rows, ids = [], set()
    for k in range(240):
        who = f"user{k}@mail.example.org"
        if k % 3 == 0:
            who = failed[k // 12 % len(failed)] if k % 12 == 0 else shapes[k // 3 % 4]()
            ids |= {who} - set(failed)
        rows.append((k, f"{prose(k, 5)} contact: {who} please."))
    for k in range(300):  # each word before has 5 addresses among 25 other values, and the same 7
        word = f"word{chr(97 + k % 12)}"
        rows.append((1000 + k, f"{word} a{k}@b.org x{k} {word} {k * 31 + 100000} y" if k // 12 < 5 else f"{word} {k * 31 + 100000} y{k} {word} 7 z"))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.text[s.start : s.end] for r in found for s in r.learned} == ids
