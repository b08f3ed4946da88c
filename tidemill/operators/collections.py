"""Collections of texts with embeddings: tables that are added to, searched by text, and deleted from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.operators import chunks, knn

SCHEMA = "id string, content string, metadata map<string,string>, embedding array<float>, seq long, deleted boolean"


def create(spark: SparkSession, path: str) -> None:
    """An empty collection; nothing happens if there is one."""
    spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(path)


def add(rows: DataFrame, path: str, seq: int, *, id: str = "chunk_id", content: str = "content", metadata: tuple[str, ...] = (), dim: int = 64) -> None:
    """Adds rows, as of seq, with their embeddings and the columns `metadata` as scalars or JSON; the last row of an id counts."""
    entries = tx.scalars({c: rows[c] for c in metadata}, dict(rows.dtypes)) if metadata else F.create_map().cast("map<string,string>")
    made = rows.select(F.col(id).cast("string").alias("id"), F.col(content).alias("content"), entries.alias("metadata"), chunks.embed(F.col(content), dim).alias("embedding"), F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("deleted"))
    made.write.mode("append").parquet(path)


def delete(ids: DataFrame, path: str, seq: int) -> None:
    """Deletes the rows with these ids (column id), as of seq."""
    gone = ids.select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(seq).cast("long").alias("seq"), F.lit(True).alias("deleted"))
    gone.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The live rows (id, content, metadata, embedding)."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    last = rows.groupBy("id").agg(F.max(F.struct("seq", "deleted", F.xxhash64("content").alias("which"))).alias("last"))
    kept = rows.withColumn("which", F.xxhash64("content")).join(last.select("id", "last.*").where("NOT deleted"), ["id", "seq", "deleted", "which"])
    return kept.select("id", "content", "metadata", "embedding").dropDuplicates(["id"])


def search(rows: DataFrame, text: str, n: int, *, dim: int = 64) -> DataFrame:
    """(id, dist, score) of the n rows nearest to a text."""
    query = rows.sparkSession.range(1).select(chunks.embed(F.lit(text), dim).alias("e")).first()["e"]
    return knn.search(rows, query, n, id="id", vec="embedding")
