"""The local cache's index: upserts, totals, candidates and eviction of the least recently used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = ("filename", "rel_path", "size_bytes", "last_accessed_at")
#: Seconds of access time that one window of the running sum holds.
BUCKET_SECONDS = 3600


def upsert(index: DataFrame | None, writes: DataFrame) -> DataFrame:
    """The index after ``writes``: the last write of a key wins, its creation time stays.

    ``writes`` has content_id, FIELDS and ``seq``, any number or null, which orders writes of one second.
    """
    rows = writes.select("content_id", *FIELDS, F.col("last_accessed_at").alias("created_at"), "seq", F.lit(True).alias("new"))
    if index is not None:
        rows = rows.unionByName(index.select("content_id", *FIELDS, "created_at", F.lit(None).cast("long").alias("seq"), F.lit(False).alias("new")))
    last = F.max_by(F.struct(*FIELDS), F.struct("new", "last_accessed_at", "seq")).alias("last")
    return rows.groupBy("content_id").agg(last, F.min("created_at").alias("created_at")).select("content_id", "last.*", "created_at")


def touch(index: DataFrame, touches: DataFrame) -> DataFrame:
    """The index with access times raised to those of ``touches`` (content_id, at); unknown keys are passed over."""
    latest = touches.groupBy("content_id").agg(F.max("at").alias("_at"))
    return index.join(latest, "content_id", "left").withColumn("last_accessed_at", F.coalesce("_at", "last_accessed_at")).drop("_at")


def delete(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The index without the keys; a null key is one key as well."""
    gone = keys.select(F.col("content_id").alias("_gone"))
    return index.join(gone, F.col("content_id").eqNullSafe(F.col("_gone")), "left_anti")


def lookup(index: DataFrame, content_id: str) -> DataFrame:
    """The entry of one key, if there is one."""
    return index.where(F.col("content_id") == content_id.strip().lower())


def total_size(index: DataFrame) -> DataFrame:
    """One row: the sum of all sizes, 0 for an empty index."""
    return index.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"))


def candidates(index: DataFrame, protected: DataFrame, limit: int = 25) -> DataFrame:
    """The ``limit`` entries used longest ago that are not protected; keys order ties."""
    return delete(index, protected).orderBy("last_accessed_at", "content_id").limit(limit)


def evictions(index: DataFrame, max_bytes: int, protected: DataFrame | None = None) -> DataFrame:
    """The entries that go, oldest first, until the total is at most ``max_bytes``; none if that is not positive.

    The running sum has two levels: totals of hours, a small table, and sums
    inside each hour, so the index is never ordered in one task.
    """
    total = index.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total"))
    free = (index if protected is None else delete(index, protected)).withColumn("bucket", F.floor(F.col("last_accessed_at") / BUCKET_SECONDS))
    outer = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = free.groupBy("bucket").agg(F.sum("size_bytes").alias("n")).select("bucket", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base"))
    inner = Window.partitionBy("bucket").orderBy("last_accessed_at", "content_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = free.withColumn("own", F.coalesce(F.sum("size_bytes").over(inner), F.lit(0))).join(base, "bucket")
    gone = summed.crossJoin(F.broadcast(total)).where((F.lit(max_bytes) > 0) & (F.col("total") - F.col("base") - F.col("own") > max_bytes))  # total is one row
    return gone.drop("bucket", "own", "base", "total")


def hits(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``wanted`` (content_id, expected_size) with ``hit``: the file is there and, if a size is given, of that size."""
    have = files.select("content_id", F.col("size_bytes").alias("_size"))
    ok = F.col("_size").isNotNull() & (F.col("expected_size").isNull() | (F.col("expected_size") == F.col("_size")))
    return wanted.join(have, "content_id", "left").withColumn("hit", ok).drop("_size")
