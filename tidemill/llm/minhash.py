"""MinHash near-dedup of whole documents; see near.py for the join.

MATCH of 64 coordinates are asked for before full sets are compared: of pairs at exactly NUM / DEN, 6 in 10^7 share fewer,
and 4 in 10^8 at 0.87. That is the only way to lose a link: the lists themselves lose none. With match=1 and need=1 the
search is exact but for pairs that share no coordinate at all.

Defined cases: documents without words or text are linked with nothing; rows with equal texts (and rows that repeat) are
linked; a component's id is its least doc_id, null if it has none but null; a null id's row is kept if that is so; an
empty table gives an empty result; texts of any length are signed whole, one at a time; other columns of docs are not
read by find() and digest(), and kept by keep_one(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import near
from tidemill.llm.common import fresh, materialize, release

NUM, DEN, MATCH = 85, 100, 39


def _find(docs: DataFrame, num: int, den: int, match: int) -> tuple[DataFrame, list[DataFrame]]:
    """find(), and the tables to release once its result has been used."""
    signed = materialize(near.sign(docs, "doc_id").withColumn("row", F.monotonically_increasing_id()))
    classes = materialize(signed.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("cid"), F.min("doc_id").alias("low")))
    roots = near.connected(signed, classes, num=num, den=den, match=match, lists=near.Lists.coordinates(), need=match)
    placed = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    placed = placed.join(lows, "root").select("k1", "k2", "root", "component_id")
    full = signed.where("n > 0").select("row", "doc_id", "n", "k1", "k2").join(placed, ["k1", "k2"]).drop("k1", "k2")
    empty = signed.where("n = 0").select("row", "doc_id", "n", F.col("row").alias("root"), F.col("doc_id").alias("component_id"))
    return full.select("row", "doc_id", "n", "root", "component_id").unionByName(empty), [signed, classes, roots]


def find(docs: DataFrame, *, num: int = NUM, den: int = DEN, match: int = MATCH) -> DataFrame:
    """(row, doc_id, n, root, component_id) for each row (doc_id, text) of docs; root is a row's number, too."""
    return _find(docs, num, den, match)[0]


def digest(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of docs, that with the least doc_id (and then the first); same columns."""
    row = fresh(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    result, used = _find(numbered.select(F.struct("doc_id", row).alias("doc_id"), "text"), NUM, DEN, MATCH)
    found = materialize(result.select("root", "doc_id"))
    release(*used)
    kept = found.groupBy("root").agg(F.min("doc_id").alias("first"))
    gone = found.join(kept, "root").where(F.col("doc_id") != F.col("first")).select(F.col(f"doc_id.{row}").alias(row))
    return numbered.join(near.small_enough(gone), row, "left_anti").select(*docs.columns)
