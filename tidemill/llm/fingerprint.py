"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame operations only.

A text is cut into sections at blank lines and into paragraphs at line ends; both cuts can be undone, so the root, a hash
of the sections' hashes, which hash their paragraphs' hashes, is equal for equal texts only. differing() locates edits: it
descends only into sections that the other tree doesn't have, and finds the paragraphs that those of the other tree
don't have, wherever they stand, so an inserted paragraph marks itself and not what follows.

A fingerprint is `root:n:branches:pieces:words`, of bounded size. branches are the SKETCH least hashes of the tree's
paragraphs, each with its length. pieces are the SKETCH least distinct hashes of the runs of words (n of them in all) that
the text is cut into after each word with one of the endings CUTS, about every fourth, and after 16 words at the latest;
so the cuts move along with what is inserted or wrapped before them. Texts of fewer than FEW pieces carry the hashes of
single words too. likeness() of texts with different roots is the larger of two shares: that of the equal branches in
both trees by length, and the Jaccard index of the pieces (halved with that of the words, where either text has few),
which sees what differing branches share.

Defined cases: a null text is empty; an empty text has one empty section and no pieces; its likeness to any other text
is 0, as is that of texts without words unless they are equal; rows with equal doc_id are ordered by text, and rows that
repeat follow each other; a null doc_id comes first; an empty table gives an empty result; texts of any length are read
whole; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import partitions

SKETCH, FEW, CUTS = 64, 8, "eoEO.!?:;"
BLANKS, WORDS = r"[ \t\n\r]+", "[^ ]+"
PIECES = f"(?:[^ ]*[^ {CUTS}] ){{0,15}}[^ ]+"


def tree(text: Column) -> Column:
    """array<array<(hash, length)>>: each paragraph, by section."""
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), lambda p: F.struct(F.sha2(p.cast("binary"), 256).alias("hash"), F.length(p).alias("length"))))


def section_hashes(tree: Column) -> Column:
    return F.transform(tree, _section)


def _section(paragraphs: Column) -> Column:
    return F.sha2(F.array_join(paragraphs["hash"], "").cast("binary"), 256)


def root(tree: Column) -> Column:
    return F.sha2(F.array_join(section_hashes(tree), "").cast("binary"), 256)


def changed(a: Column, b: Column) -> Column:
    """The hashes of the paragraphs in sections of tree a that tree b doesn't have, but for those in such sections of b."""

    def open_paragraphs(x: Column, y: Column) -> Column:
        own = F.array_except(section_hashes(x), section_hashes(y))
        return F.flatten(F.transform(F.filter(x, lambda s: F.array_contains(own, _section(s))), lambda s: s["hash"]))

    return F.array_except(open_paragraphs(a, b), open_paragraphs(b, a))


def differing(a: Column, b: Column) -> Column:
    """(section, paragraph), from 0, of the paragraphs of tree a that changed() names, in sections that tree b doesn't have."""
    names, equal = changed(a, b), F.array_intersect(section_hashes(a), section_hashes(b))

    def places(paragraphs: Column, s: Column) -> Column:
        found = F.transform(paragraphs, lambda p, k: F.when(F.array_contains(names, p["hash"]), F.struct(s.alias("section"), k.alias("paragraph"))))
        return F.when(F.array_contains(equal, _section(paragraphs)), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.filter(found, lambda p: p.isNotNull()))

    return F.flatten(F.transform(a, places))


def _least(hashes: Column) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, SKETCH)


def _short(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def with_fingerprint(df: DataFrame, text: str, name: str, tree_name: str = "_tree") -> DataFrame:
    """df with the fingerprint of a column, and its tree."""
    df = df.withColumn(tree_name, tree(F.col(text))).withColumn("_plain", F.regexp_replace(text, BLANKS, " "))
    df = df.withColumn("_pieces", F.regexp_extract_all("_plain", F.lit(PIECES), F.lit(0)))
    n = F.size("_pieces")
    words = F.when(n < FEW, F.array_join(_least(F.transform(F.regexp_extract_all("_plain", F.lit(WORDS), F.lit(0)), _short)), ",")).otherwise("")
    paragraphs = F.filter(F.flatten(tree_name), lambda p: p["length"] > 0)
    branches = F.array_join(_least(F.transform(paragraphs, lambda p: F.concat_ws(".", F.substring(p["hash"], 1, 8), p["length"].cast("string")))), ",")
    return df.withColumn(name, F.concat_ws(":", root(F.col(tree_name)), n.cast("string"), branches, F.array_join(_least(F.transform("_pieces", _short)), ","), words)).drop("_plain", "_pieces")


def _shared(a: Column, b: Column, weight) -> Column:
    """From two lists of hashes, comma-joined: the share, by weight, of the least hashes of both that are in either."""
    x, y = (F.filter(F.split(c, ","), lambda h: h != "") for c in (a, b))
    least = F.slice(F.array_sort(F.array_union(x, y)), 1, SKETCH)
    total = lambda hs: F.aggregate(hs, F.lit(0).cast("long"), lambda s, h: s + weight(h))
    return F.coalesce(total(F.array_intersect(F.array_intersect(x, y), least)) / F.nullif(total(least), F.lit(0).cast("long")), F.lit(0.0))


def likeness(a: str, b: str) -> Column:
    """0 to 1, from two columns with fingerprints."""
    x, y = F.split(a, ":"), F.split(b, ":")
    one, length = (lambda h: F.lit(1).cast("long")), (lambda h: F.substring_index(h, ".", -1).cast("long"))
    pieces = _shared(x[3], y[3], one)
    few = F.least(x[1].cast("int"), y[1].cast("int")) < FEW
    pieces = F.when(few, (pieces + _shared(x[4], y[4], one)) / 2).otherwise(pieces)
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(_shared(x[2], y[2], length), pieces))


def with_bucket(df: DataFrame, key: str, n: int) -> DataFrame:
    """A column `bucket`, growing with key, of about n values with as many rows each (a key's rows share one)."""
    asked = [i / n for i in range(1, n)]
    found = df.select(F.percentile_approx(key, asked, 10_000)).first()[0] if asked else None
    bounds = sorted(set(found or []))
    bits = max(1, len(bounds).bit_length())
    padded = F.array(*[F.lit(x).cast("long") for x in bounds + [2**63 - 1] * (2**bits - len(bounds))])
    steps = F.array(*[F.lit(2**i) for i in range(bits - 1, -1, -1)])
    # binary search: as many bounds as are at most the key
    return df.withColumn("bucket", F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.col(key) >= F.element_at(padded, at + step), step).otherwise(0)))


def neighbours(docs: DataFrame) -> tuple[DataFrame, Window]:
    """docs (doc_id, text) dealt into buckets of neighbouring ids, each closed by a copy (extra = 1) of the document
    that follows its last one (after the last bucket: the first document); and the window that orders a bucket."""
    docs = with_bucket(docs, "doc_id", 2 * partitions(docs.sparkSession))
    first = docs.groupBy("bucket").agg(F.min(F.struct("doc_id")).alias("least")).select("bucket", F.col("least.doc_id").alias("doc_id"))
    order = Window.orderBy("bucket")  # a row for each bucket
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = first.select(F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(whole)).alias("bucket"), "doc_id")
    heads = docs.drop("bucket").join(F.broadcast(after.withColumnRenamed("doc_id", "head")), F.col("doc_id").eqNullSafe(F.col("head")))
    heads = heads.groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    both = docs.select("bucket", F.lit(0).alias("extra"), "doc_id", "text").unionByName(heads.select("bucket", F.lit(1).alias("extra"), "doc_id", "text"))
    return both, Window.partitionBy("bucket").orderBy("extra", "doc_id", "text")


def digest(documents: DataFrame) -> DataFrame:
    """The columns of the query; n_changed: how many different paragraphs of the edited text its tree locates as edits."""
    both, order = neighbours(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    both = both.withColumn("next_text", F.lead("text").over(order))
    both = with_fingerprint(both, "text", "fingerprint")
    both = both.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("extra = 0")
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 4)), left(next_text, int(n_chars div 4)))"))
    both = with_fingerprint(both, "edited", "edited_fingerprint", "_edited_tree")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
        F.size(changed(F.col("_edited_tree"), F.col("_tree"))).cast("long").alias("n_changed"),
    )
