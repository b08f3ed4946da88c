"""What the operators of this subpackage share: reading tables, cutting lineage, column hygiene."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = f"file://{tempfile.gettempdir()}/tidemill-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_resident: dict[str, Callable[[], None]] = {}


def enter(name: str, forget: Callable[[], None] | None = None) -> None:
    """Called by a task in its worker: what tasks of other names keep there from task to task is forgotten.

    Workers are reused, so a cache would else take memory from whatever runs next.
    """
    for other in [x for x in _resident if x != name]:
        _resident.pop(other)()
    if forget is not None:
        _resident[name] = forget


_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, lost executors lose nothing.

    Call release() on the result once nothing that is still to run reads it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemill_path = path  # type: ignore[attr-defined]
    return out


def release(*dfs: DataFrame) -> None:
    """Deletes what materialize() wrote."""
    for df in dfs:
        if path := getattr(df, "_tidemill_path", None):
            _delete(path)


def _delete(path: str) -> None:
    if spark := _written.pop(path, None):
        drop_folder(spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session may have ended
            _written.pop(path, None)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
