"""Shard stores: nothing lost, sizes, versions and competing writers."""

import pytest
from pyspark.sql import functions as F

from lodestack.llm import shards


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("shard").collect()), key=str)


def table(spark, n, start=0):
    df = spark.range(start, start + n, 1, 3).select(F.when(F.col("id") % 50 != 7, F.col("id")).alias("doc_id"), F.expr("repeat(md5(string(id)), int(id % 60))").alias("text"), F.lit("x").alias("path"), F.lit(1).alias("run"))
    return df.union(df.limit(5)).union(df.select(F.lit(9).cast("long"), F.lit(None).cast("string"), "path", "run").limit(2))


def test_compaction_keeps_every_row(spark, tmp_path):
    first, second = table(spark, 900), table(spark, 300, 5000)
    store = shards.ShardStore(spark, str(tmp_path / "s"), first.schema)
    assert store.append(first, 100) == 1 and store.append(second, 50) == 2
    want = rows_of(first.union(second))
    assert rows_of(store.read()) == want
    sizes = [r.bytes for r in store.manifest().collect()]
    target = max(sizes) * 4
    assert store.compact(target) == 3
    merged = [(r.bytes, r.rows) for r in store.manifest().collect()]
    assert len(merged) < len(sizes) / 2 and sum(n for _, n in merged) == len(want)
    assert all(b < target * 1.5 for b, _ in merged)
    assert rows_of(store.read()) == want and rows_of(store.read(1)) == rows_of(first)
    assert store.vacuum() > 0 and rows_of(store.read()) == want
    assert store.append(second, 50) == 4 and store.compact(target) == 5
    assert rows_of(store.read()) == sorted(want + rows_of(second), key=str)


def test_only_one_writer_commits_a_version(spark, tmp_path):
    df = table(spark, 20)
    store = shards.ShardStore(spark, str(tmp_path / "s"), df.schema)
    store.append(df)
    with pytest.raises(Exception, match="exist"):
        store._commit(store.manifest(), 0)
    assert store.version() == 1 and rows_of(store.read()) == rows_of(df)


def test_clashing_names(spark, tmp_path):
    df = spark.range(40).select(*(F.col("id").cast("string").alias(c) for c in ("doc_id", "path", "run", "shard", "bytes", "_metadata", "rows")))
    store = shards.ShardStore(spark, str(tmp_path / "s"), df.schema)
    store.append(df, 5)
    store.append(df, 5)
    store.compact(1 << 20)
    out = store.read()
    assert out.columns == [*df.columns, "_shard"] and sorted(tuple(r)[:-1] for r in out.collect()) == sorted([tuple(r) for r in df.collect()] * 2)


def test_empty_table(spark, tmp_path):
    df = table(spark, 20).limit(0)
    store = shards.shard(df, str(tmp_path / "s"))
    assert store.version() == 1 and store.read().collect() == [] and store.manifest().collect() == []


def test_query_places_every_document_once(spark):
    rows = shards.op3_sharding(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == list(range(1000))
    counts = {}
    for r in rows:
        counts[r.shard] = counts.get(r.shard, 0) + 1
    assert all(counts[r.shard] == r.shard_rows for r in rows)


def test_numbers_are_dense_and_of_one_file_each(spark):
    paths = [(f"d/{k}/part-00000-c{k % 3:03d}.parquet",) for k in range(40)]
    got = sorted(r.shard for r in shards.numbered(spark.createDataFrame(paths, "path string")).collect())
    assert got == list(range(40))
