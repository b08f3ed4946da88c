"""Code trees as rows (path, content, length, language)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as tx

# fixed values: folders that are no sources
IGNORED = (".git", "node_modules", "vendor", "dist", "build")


def select_files(files: DataFrame, *, extensions: Iterable[str] = (), ignore: Iterable[str] = IGNORED, most_bytes: int = 10 << 20) -> DataFrame:
    """Rows (path, length, ...) of files that are small enough, of the extensions (any if none), and in no ignored folder."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    out = files.where(F.col("length") <= most_bytes).where(~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in ignore]))) if list(ignore) else files.where(F.col("length") <= most_bytes)
    wanted = [x.lower() for x in extensions]
    return out.where(tx.extension(F.col("path")).isin(wanted)) if wanted else out


def read_tree(spark: SparkSession, path: str, **options) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return select_files(files, **options).withColumn("language", tx.language(F.col("path")))
