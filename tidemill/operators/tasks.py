"""A run ledger (task, run_at, output, error) and its status. Commands are data here and never run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status(ledger: DataFrame, *, task: str = "task", run_at: str = "run_at", output: str = "output", error: str = "error", tie: str | None = None) -> DataFrame:
    """(task, execution_count, last_execution_time, last_output, last_error) of each task."""
    order = F.struct(run_at, tie) if tie else F.col(run_at)
    return ledger.groupBy(task).agg(
        F.count("*").alias("execution_count"), F.max(run_at).alias("last_execution_time"), F.max_by(output, order).alias("last_output"), F.max_by(error, order).alias("last_error")
    )


def due(status_rows: DataFrame, as_of, *, minutes: int = 5) -> DataFrame:
    """Tasks whose last run is so many minutes ago or more."""
    return status_rows.where(F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis(F.col("last_execution_time").cast("timestamp")) >= minutes * 60_000)
