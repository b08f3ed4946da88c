"""Order over tables of any size: rows are dealt into ranges of a key, and what crosses ranges is carried by a row for each.

The bounds are literals from a bounded, deterministic sample of keys, so all uses of a table agree on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLED = 32  # keys for each range


def with_range(df: DataFrame, key: str, name: str, n: int | None = None) -> DataFrame:
    """df with the number of each row's range, growing with the key; equal keys share one, null is in the first."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    sample = df.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(SAMPLED * n).collect()
    keys = sorted({r[0] for r in sample})
    bounds = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    if not bounds:
        return df.withColumn(name, F.lit(0))
    kind, bits = df.schema[key].dataType, len(bounds).bit_length()
    padded = F.array(*[F.lit(bytes(b) if isinstance(b, bytearray) else b).cast(kind) for b in bounds])
    steps = F.array(*[F.lit(2**i) for i in range(bits - 1, -1, -1)])
    # binary search: as many bounds as are at most the key
    return df.withColumn(name, F.aggregate(steps, F.lit(0), lambda at, step: at + F.when((at + step <= len(bounds)) & (F.col(key) >= F.try_element_at(padded, at + step)), step).otherwise(0)))


def row_numbers(df: DataFrame, key: str, name: str, by: tuple[str, ...] = (), n: int | None = None) -> DataFrame:
    """df with each row's number from 0 in its group, in order of key: numbers within ranges, after the counts before them."""
    part, before = f"_{name}_part", f"_{name}_before"
    rows = with_range(df, key, part, n)
    counts = rows.groupBy(*by, part).agg(F.count("*").alias("_many"))
    order = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, part, F.coalesce(F.sum("_many").over(order), F.lit(0)).alias(before))
    inside = Window.partitionBy(*by, part).orderBy(key)
    numbered = rows.withColumn(name, (F.row_number().over(inside) - 1).cast("long"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, part)]
    both = numbered.alias("a").join(counts.alias("b"), same)
    return both.select(*[F.col(f"a.{c}") for c in df.columns], (F.col(f"a.{name}") + F.col(f"b.{before}")).alias(name))
