"""Files put together again from their manifests and a store of blobs, every blob and file checked."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import manifests
from lodestack.functions.hashing import content_id, normalized_id
from lodestack.operators.ingest import unpatch

#: Tasks among which the uses of one blob are dealt out; a blob goes only to those that use it.
FAN = 64


def all_segments(m: Column) -> Column:
    """Segments of any version: those of v3, and the chunks of v1 and v2 as raw segments."""
    fields = [f.split(":") for f in manifests.SEGMENT.removeprefix("struct<").removesuffix(">").split(",")]
    of = lambda c, name, kind: {"kind": F.lit("raw_chunk"), "hash": c["hash"], "size": c["size"]}.get(name, F.lit(None).cast(kind))
    raw = F.transform(m["chunks"], lambda c: F.struct(*(of(c, n, k).alias(n) for n, k in fields)))
    return F.when(m["schema"].endswith(".v3"), m["segments"]).otherwise(raw)


def _needs(parsed: DataFrame) -> DataFrame:
    """(file_id, pos, size, uncompressed_size, role, hash, part): a row for each blob that a segment takes."""
    each = parsed.where("problem is null").select("file_id", F.posexplode(all_segments(F.col("m"))).alias("pos", "s"))
    use = lambda role, h: F.struct(F.lit(role).alias("role"), normalized_id(h).alias("hash"))
    uses = F.when(F.col("s.kind") == "raw_chunk", F.array(use("body", F.col("s.hash")))).otherwise(F.array(use("dict", F.col("s.dict_hash")), use("patch", F.col("s.patch_hash"))))
    rows = each.select("file_id", "pos", "s.size", "s.uncompressed_size", F.inline(uses))
    return rows.withColumn("part", F.pmod(F.xxhash64("file_id", "pos"), F.lit(FAN)))


def _held(needs: DataFrame, store: DataFrame, algo: str) -> DataFrame:
    """(hash, part, body, intact): each blob once for every part that uses it; of copies of one hash an intact one."""
    rows = store.select(normalized_id("hash").alias("hash"), "body")
    rows = rows.select("hash", F.struct((content_id("body", algo) == F.col("hash")).alias("intact"), "body").alias("b"))
    wanted = needs.select("hash", "part").distinct()
    return rows.groupBy("hash").agg(F.max("b").alias("b")).join(wanted, "hash").select("hash", "part", "b.body", "b.intact")


def _unpatched(dictionary: Column, packed: Column, size: Column) -> Column:
    """The bytes that a patch stands for; null without one, or where it can't be unpacked."""

    def one(d, p, n):
        try:
            return None if d is None or p is None or pd.isna(n) else unpatch(bytes(d), bytes(p), int(n))
        except (zstandard.ZstdError, ValueError, MemoryError):
            return None

    @F.pandas_udf("binary")
    def run(dicts: pd.Series, patches: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(dicts, patches, sizes)], dtype=object)

    return run(dictionary, packed, size)


def from_manifests(listed: DataFrame, store: DataFrame, algo: str = "sha2") -> DataFrame:
    """(file_id, filename, size, content_id, body, error) of files whose manifests are v1, v2 or v3.

    ``listed`` has file_id (one row each) and manifest, ``store`` has hash and
    body. A file that fails a check has null in size, content_id and body, and in
    error the first of: the manifest's problem, ``no_whole_hash``; of its segments
    in order ``blob_not_found``, ``chunk_hash``, ``chunk_size`` or ``bad_patch``;
    ``size_mismatch`` (a size of 0 or none is not compared), ``hash_mismatch``.
    A null manifest is ``not_an_object``; no segments make an empty file; repeated
    blobs count once; a file_id of null gives ``no_file_id``.

    Each blob is hashed once. Its uses are dealt out to FAN parts and it is sent
    to those that have some, so a blob that a third of all files share is no hot
    key, and no blob is sent more often than it is used. Only the assembly has
    all of a file in one task, since the file is one value of the result.
    """
    m = F.col("m")
    text = F.coalesce("manifest", F.lit(""))
    parsed = listed.select("file_id", manifests.parsed("manifest").alias("m"), manifests.problem(text).alias("problem"))
    needs = _needs(parsed)
    got = needs.join(_held(needs, store, algo), ["hash", "part"], "left")
    wrong_size = (F.col("role") == "body") & (F.octet_length("body") != F.col("size"))
    got = got.withColumn("error", F.when(F.col("body").isNull(), "blob_not_found").when(~F.col("intact"), "chunk_hash").when(wrong_size, "chunk_size"))
    pick = lambda role: F.max(F.when(F.col("role") == role, F.col("body")))
    by_part = got.repartition("file_id").groupBy("file_id", "pos").agg(pick("body").alias("raw"), pick("dict").alias("dict"), pick("patch").alias("patch"), F.max("uncompressed_size").alias("n"), F.min("error").alias("error"))
    sound = F.col("error").isNull()
    made = by_part.withColumn("body", F.coalesce("raw", _unpatched(F.when(sound, F.col("dict")), F.when(sound, F.col("patch")), F.col("n"))))
    made = made.select("file_id", "pos", "body", F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("body").isNull(), "bad_patch").alias("error"))
    whole = made.groupBy("file_id").agg(F.expr("listagg(body) within group (order by pos)").alias("body"), F.min(F.when(F.col("error").isNotNull(), F.struct("pos", "error")))["error"].alias("part_error"))
    heads = parsed.select("file_id", m["filename"].alias("filename"), m["size_bytes"].alias("said_size"), manifests.whole_hash(m).alias("said"), "problem")
    full = heads.join(whole, "file_id", "left").withColumn("body", F.coalesce("body", F.lit(b"")))
    full = full.withColumn("content_id", content_id("body", algo)).withColumn("size", F.octet_length("body").cast("long"))
    error = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("file_id").isNull(), "no_file_id")
        .when(F.col("said") == "", "no_whole_hash")
        .when(F.col("part_error").isNotNull(), F.col("part_error"))
        .when((F.coalesce("said_size", F.lit(0)) != 0) & (F.col("said_size") != F.col("size")), "size_mismatch")
        .when(F.col("content_id") != F.col("said"), "hash_mismatch")
    )
    full = full.withColumn("error", error)
    ok = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return full.select("file_id", "filename", ok("size"), ok("content_id"), ok("body"), "error")
