"""Sharding by size-tiered compaction under a versioned manifest, with DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestack.llm.workspace import shared_dir, unused

#: Bytes that a merged file should have, and rows that an arriving shard has at most.
TARGET_BYTES = 64 << 20
ARRIVAL_ROWS = 4_000
#: Sizes within this factor are of one tier; so many files of a tier are merged.
TIER_FACTOR = 4
FAN_IN = 2
#: Buckets that shards are numbered in.
NUMBER_BUCKETS = 1024
#: A merge plan of at most so many files is broadcast; a larger one is joined by shuffling.
PLAN_BROADCAST_FILES = 50_000

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("rows", T.LongType())])


class ShardStore:
    """Immutable Parquet shards under ``root`` and the manifests that name those of each version.

    Shards are never changed. A version is a manifest folder, written aside and
    then renamed to its number; the rename fails if that number is taken, so of
    two writers one commits and the other must start again from its version.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def version(self) -> int:
        """The latest committed version; 0 if there is none."""
        fs, at = self._fs(f"{self.root}/manifest")
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max([int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, rows) of the shards of a version, by default the latest."""
        v = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{v:08d}") if v else self.spark.createDataFrame([], MANIFEST)

    def _commit(self, rows: DataFrame, after: int) -> int:
        """Makes ``rows`` version ``after`` + 1 in one rename; fails if another writer was first."""
        aside, to = f"{self.root}/manifest/.new-{uuid.uuid4().hex}", f"{self.root}/manifest/v{after + 1:08d}"
        rows.coalesce(1).write.parquet(aside)  # names of files, not rows of data
        fs, source = self._fs(aside)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(source, self._jvm.org.apache.hadoop.fs.Path(to), none)
        except Exception:
            fs.delete(source, True)
            raise
        return after + 1

    def _files(self, folder: str) -> DataFrame:
        """(path, bytes, rows) of the shards in a data folder; files without rows are left out."""
        read = self.spark.read.schema(self.schema).parquet(folder)
        about = read.metadataColumn("_metadata")
        files = read.select(about["file_path"].alias("path"), about["file_size"].alias("bytes"))
        return files.groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("rows")).select("path", "bytes", "rows")

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Writes arriving rows as small shards, without a shuffle, and commits them; returns the version."""
        at, folder = self.version(), f"{self.root}/data/append-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.option("maxRecordsPerFile", arrival_rows).option("compression", "zstd").parquet(folder)
        return self._commit(self.manifest(at).unionByName(self._files(folder)), at)

    def plan(self, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
        """(path, run): which shards are merged, run numbers counting from 0.

        Shards under the target are put in tiers by size. Along a tier, a run
        ends where the sum of sizes passes a multiple of the target; runs of
        fewer than ``fan_in`` shards are left as they are. One row per shard.
        """
        small = self.manifest().where(F.col("bytes") < target_bytes)
        tier = F.floor(F.log(float(TIER_FACTOR), F.lit(float(target_bytes)) / F.greatest("bytes", F.lit(1).cast("long"))))
        along = Window.partitionBy("tier").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        runs = small.withColumn("tier", tier).withColumn("part", F.floor((F.sum("bytes").over(along) - 1) / target_bytes))
        full = runs.groupBy("tier", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fan_in)
        numbered = full.select("tier", "part", (F.row_number().over(Window.orderBy("tier", "part")) - 1).cast("int").alias("run"))
        return runs.join(numbered, ["tier", "part"]).select("path", "run")

    def compact(self, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> int:
        """Merges runs of similarly sized shards, each into one file, and commits; returns the version.

        Each run is one task's partition, so its file is of about the target's
        size however the rows are distributed. Merged shards leave the manifest
        but stay on disk until ``vacuum``.
        """
        at = self.version()
        plan = self.plan(target_bytes, fan_in)
        paths = [tuple(r) for r in plan.collect()]  # names of files
        if not paths:
            return at
        count = max(run for _, run in paths) + 1
        read = self.spark.read.schema(self.schema).parquet(*[p for p, _ in paths])
        path, run = unused(read, "path"), unused(read, "run")
        plan = self.spark.createDataFrame(paths, f"`{path}` string, `{run}` int")
        rows = read.select("*", read.metadataColumn("_metadata")["file_path"].alias(path))
        if len(paths) <= PLAN_BROADCAST_FILES:
            plan = F.broadcast(plan)
        folder = f"{self.root}/data/run-{uuid.uuid4().hex}"
        merged = rows.join(plan, path).repartitionById(count, F.col(run)).select(*self.schema.names)
        merged.write.option("compression", "zstd").parquet(folder)
        kept = self.manifest(at).join(self.spark.createDataFrame(paths, "path string, _run int").select("path"), "path", "left_anti")
        return self._commit(kept.unionByName(self._files(folder)), at)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with a last column, the file that each is in: shard, or _shard if the rows have one."""
        paths = [r.path for r in self.manifest(version).select("path").collect()]  # names of files
        if not paths:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumn(unused(empty, "shard"), F.lit(None).cast("string"))
        read = self.spark.read.schema(self.schema).parquet(*paths)
        return read.select("*", read.metadataColumn("_metadata")["file_path"].alias(unused(read, "shard")))

    def vacuum(self) -> int:
        """Deletes data files that the latest version does not name; returns their number."""
        named = {r.path.rsplit("/", 2)[-2] + "/" + r.path.rsplit("/", 1)[-1] for r in self.manifest().select("path").collect()}
        fs, data = self._fs(f"{self.root}/data")
        gone = 0
        for folder in fs.listStatus(data) if fs.exists(data) else []:
            for f in fs.listStatus(folder.getPath()):
                name = f.getPath().getName()
                if name.endswith(".parquet") and f"{folder.getPath().getName()}/{name}" not in named:
                    gone += bool(fs.delete(f.getPath(), False))
        return gone


def shard(docs: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES, arrival_rows: int = ARRIVAL_ROWS) -> ShardStore:
    """A store that has taken ``docs`` in and merged them; by default in the shared folder.

    All columns and rows are kept as they are: nulls, repeated rows and empty
    texts included. An empty table commits a version without shards.
    """
    store = ShardStore(docs.sparkSession, root or shared_dir(docs.sparkSession), docs.schema)
    store.append(docs, arrival_rows)
    store.compact(target_bytes)
    store.vacuum()
    return store


def numbered(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with ``shard``, a number of its own for each path, from 0 without gaps.

    Numbers are ranks inside buckets of a path's hash on top of the counts of
    the buckets before, so no task orders all paths.
    """
    files = files.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(NUMBER_BUCKETS)).cast("int"))
    sizes = files.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))  # NUMBER_BUCKETS rows at most
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("path")) - 1
    return files.join(F.broadcast(base), "bucket").withColumn("shard", (F.col("base") + rank).cast("int")).drop("bucket", "base")


def op3_sharding(spark, sf_dir):
    store = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    files = numbered(store.manifest()).select("shard", F.col("rows").alias("shard_rows"), F.col("path").alias("_path"))
    rows = store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.col("shard").alias("_path"))
    return rows.join(F.broadcast(files) if store.manifest().count() <= PLAN_BROADCAST_FILES else files, "_path").select("doc_id", "n_bytes", "shard", "shard_rows", F.lit(store.version()).cast("long").alias("version"))
