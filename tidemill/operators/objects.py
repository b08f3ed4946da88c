"""An object store as a changelog (seq, op, bucket, key, content, content_type, metadata, at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, DELETE = "put", "delete"


class BucketError(ValueError):
    pass


def current(changes: DataFrame) -> DataFrame:
    """Live objects: the last put of each that no delete follows; created_at is the first put's since the last delete.

    Who wins is decided without contents; only the winners' rows are then joined with them.
    """
    deletes = F.max(F.when(F.col("op") == DELETE, F.col("seq")))
    gone = changes.groupBy("bucket", "key").agg(F.coalesce(deletes, F.lit(-1)).alias("_gone"))
    puts = changes.where(F.col("op") == PUT).select("bucket", "key", "seq", "at").join(gone, ["bucket", "key"]).where(F.col("seq") > F.col("_gone"))
    live = puts.groupBy("bucket", "key").agg(F.max("seq").alias("seq"), F.min_by("at", "seq").alias("created_at"), F.max_by("at", "seq").alias("modified_at"))
    bodies = changes.where(F.col("op") == PUT).select("bucket", "key", "seq", "content", "content_type", "metadata")
    out = bodies.join(live, ["bucket", "key", "seq"])
    return out.select("bucket", "key", "content", "content_type", "metadata", F.octet_length("content").cast("long").alias("size"), "created_at", "modified_at")


def get_object(objects: DataFrame, bucket: str, key: str) -> DataFrame:
    return objects.where((F.col("bucket") == bucket) & (F.col("key") == key))


def list_objects(objects: DataFrame, bucket: str, prefix: str = "") -> DataFrame:
    """An unknown bucket lists nothing; prefixes compare as bytes."""
    return objects.where(F.col("bucket") == bucket).where(F.col("key").startswith(prefix))


def key_path(key) -> Column:
    """A file name for a key, different for different keys."""
    return F.url_encode(key)


def empty_buckets(buckets: DataFrame, objects: DataFrame) -> DataFrame:
    """The buckets (name) without objects."""
    return buckets.join(objects.select(F.col("bucket").alias("name")).distinct(), "name", "left_anti")


def list_buckets(buckets: DataFrame) -> DataFrame:
    return buckets.select("name").distinct()


def bucket_exists(buckets: DataFrame, name: str) -> bool:
    return not buckets.where(F.col("name") == name).isEmpty()


def with_body(metadata: DataFrame, bodies: DataFrame) -> DataFrame:
    """Metadata rows with their content, by bucket and key."""
    return metadata.join(bodies.select("bucket", "key", "content"), ["bucket", "key"])


def _change(df: DataFrame, seq: int, op: str, bucket: str, key: str, content, content_type, metadata, at) -> DataFrame:
    row = df.sparkSession.createDataFrame([(seq, op, bucket, key, content, content_type, metadata, at)], "seq long, op string, bucket string, key string, content binary, content_type string, metadata map<string,string>, at timestamp")
    return df.unionByName(row)


def put_object(changes: DataFrame, seq: int, bucket: str, key: str, content: bytes, *, content_type: str = "application/octet-stream", metadata: dict[str, str] | None = None, at=None) -> DataFrame:
    return _change(changes, seq, PUT, bucket, key, content, content_type, metadata or {}, at)


def delete_object(changes: DataFrame, seq: int, bucket: str, key: str, *, at=None) -> DataFrame:
    """No error if there is no such object."""
    return _change(changes, seq, DELETE, bucket, key, None, None, None, at)


def create_bucket(buckets: DataFrame, name: str) -> DataFrame:
    if bucket_exists(buckets, name):
        raise BucketError(f"bucket {name} exists")
    return buckets.unionByName(buckets.sparkSession.createDataFrame([(name,)], "name string"), allowMissingColumns=True)


def delete_bucket(buckets: DataFrame, objects: DataFrame, name: str) -> DataFrame:
    if not bucket_exists(buckets, name):
        raise BucketError(f"no bucket {name}")
    if not objects.where(F.col("bucket") == name).isEmpty():
        raise BucketError(f"bucket {name} isn't empty")
    return buckets.where(F.col("name") != name)


def describe(objects: DataFrame) -> DataFrame:
    """Each object without its content, as JSON."""
    return objects.select(F.to_json(F.struct(*[c for c in objects.columns if c != "content"])).alias("json"))
