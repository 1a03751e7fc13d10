"""Content-addressed storage: existence, missing uploads, reads and reuse statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.hashing import normalized_id


def exists(ids: DataFrame, store: DataFrame) -> DataFrame:
    """``ids`` with the column present: whether the store has the content id."""
    have = store.select(normalized_id("content_id").alias("_id")).distinct()
    return ids.join(have, normalized_id("content_id") == F.col("_id"), "left").withColumn("present", F.col("_id").isNotNull()).drop("_id")


def missing(files: DataFrame, store: DataFrame) -> DataFrame:
    """(content_id, doc_id, size): one row for each content that the store lacks, from its first file."""
    new = files.join(store.select("content_id"), "content_id", "left_anti")
    return new.groupBy("content_id").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"))


def upload(files: DataFrame, store_path: str, spread: int = 64) -> DataFrame:
    """Appends to the Parquet store what it lacks, in folders by hash prefix; returns what was appended.

    A prefix is written by up to ``spread`` tasks, so that the 256 prefixes do not
    bound how many tasks write; adaptive execution joins small ones.
    """
    spark = files.sparkSession
    try:
        have = spark.read.parquet(store_path).select("content_id")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = files.select("content_id").limit(0)
    new = files.join(have, "content_id", "left_anti").dropDuplicates(["content_id"]).withColumn("prefix", F.substring("content_id", 1, 2))
    new.repartition("prefix", F.pmod(F.xxhash64("content_id"), F.lit(spread))).write.mode("append").partitionBy("prefix").parquet(store_path)
    return new.drop("prefix")


def prefix_read(files: DataFrame, max_bytes: int) -> DataFrame:
    """``files`` with ``prefix``, at most so many first bytes of the body."""
    return files.withColumn("prefix", F.substring("body", 1, max_bytes))


def range_read(files: DataFrame, start: int, end: int) -> DataFrame:
    """``files`` with ``part``, the bytes from start up to end; empty if end is not beyond start."""
    return files.withColumn("part", F.substring("body", start + 1, max(0, end - start)))


def sizes(ids: DataFrame, store: DataFrame) -> DataFrame:
    """``ids`` with the stored size, or null where the store lacks the content."""
    return ids.join(store.select("content_id", F.col("size").alias("stored_size")), "content_id", "left")


def reuse(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: distinct contents on either side, those shared, their bytes on the right and the share in percent.

    ``left`` and ``right`` have content_hash and size; each distinct hash of the
    right side counts once for the shared bytes, every row for the whole.
    """
    a = left.select("content_hash").distinct()
    b = right.groupBy("content_hash").agg(F.min("size").alias("size"))
    shared = b.join(a, "content_hash", "left_semi").agg(F.count(F.lit(1)).alias("reused_hashes"), F.coalesce(F.sum("size"), F.lit(0)).alias("reused_bytes"))
    total = right.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("right_bytes"))
    counts = a.agg(F.count(F.lit(1)).alias("left_hashes")).crossJoin(b.agg(F.count(F.lit(1)).alias("right_hashes")))  # single rows
    both = counts.crossJoin(shared).crossJoin(total)
    return both.withColumn("dedup_pct", F.col("reused_bytes") / F.greatest(F.lit(1), "right_bytes") * 100)


def chunk_reuse(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Chunks, reused chunks and bytes for each group: the first chunk of a hash is stored, all others reuse it.

    ``chunks`` has doc_id, offset, size, content_hash and the columns ``by``. The
    first holder is a minimum that combines map-side, so a hash that very many
    chunks share does not order them in one task.
    """
    first = chunks.groupBy("content_hash").agg(F.min(F.struct("doc_id", "offset")).alias("first"))
    marked = chunks.join(first, "content_hash").withColumn("reused", F.struct("doc_id", "offset") != F.col("first"))
    out = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.col("reused").cast("long")).alias("n_reused"),
        F.sum("size").alias("total_bytes"),
        F.sum(F.when(F.col("reused"), F.col("size")).otherwise(0)).alias("reused_bytes"),
    )
    return out.withColumn("reused_pct", F.round(F.col("reused_bytes") / F.greatest(F.lit(1), "total_bytes") * 100, 6))
