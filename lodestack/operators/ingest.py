"""Publishing files: chunks or entropy segments, patches, manifests, and putting files together again."""

from __future__ import annotations

import hashlib

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import chunking, entropy, manifests, scenes
from lodestack.functions.chunking import ChunkingConfig
from lodestack.functions.entropy import EntropyConfig

LEVEL = 19
LEAST_DICT, MOST_DICT = 1024, 131072
SEGMENTS = f"array<struct<segment:{manifests.SEGMENT},bodies:array<struct<hash:string,body:binary>>>>"


def training_step(n: int) -> tuple[int, int]:
    """(samples wanted, bytes of a sample) for a parent of n bytes."""
    target = min(256, max(8, n // 4096))
    return target, min(256 << 10, max(1, n // target))


def training_samples(parent: bytes) -> list[bytes]:
    """Slices of the parent that a dictionary is trained on; none for less than two bytes."""
    if len(parent) < 2:
        return []
    step = training_step(len(parent))[1]
    out = [parent[i : i + step] for i in range(0, len(parent), step)]
    half = len(parent) // 2
    return out if len(out) > 1 else [parent[:half], parent[half:]]


def patch(parent: bytes, data: bytes) -> tuple[bytes, bytes] | None:
    """(dictionary, patch) that make ``data`` from its parent's range; None where none can be trained."""
    if not parent or not data:
        return None
    try:
        trained = zstandard.train_dictionary(min(MOST_DICT, max(LEAST_DICT, len(parent))), training_samples(parent))
    except (zstandard.ZstdError, ValueError):
        return None
    packed = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained).compress(data)
    return trained.as_bytes(), packed


def unpatch(dictionary: bytes, packed: bytes, size: int) -> bytes:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(packed, max_output_size=max(1, size))


def raw_segment(h: str, size: int) -> dict:
    return {"kind": "raw_chunk", "hash": h, "size": size}


def file_segments(data: bytes, runs: list[dict], parent: bytes | None, parent_id: str | None, config: ChunkingConfig, forced: list[int]) -> list[dict]:
    """Segments of a file with the blobs that each needs, run by run.

    A run of high entropy becomes a patch on the same range of the parent where
    there is one; all other runs are chunked, with the forced cuts inside them.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for run in runs:
        a, b = int(run["start"]), int(run["end"])
        part = data[a:b]
        made = patch(parent[a : min(b, len(parent))], part) if parent and run["mode"] == "high" and a < len(parent) else None
        if made:
            d, p = made
            fields = {"kind": "zstd_dict_patch", "parent_content_id": parent_id or "", "range_start": a, "range_end": b, "dict_hash": sha(d), "patch_hash": sha(p), "patch_size": len(p), "uncompressed_size": len(part)}
            out.append({"segment": fields, "bodies": [{"hash": sha(d), "body": d}, {"hash": sha(p), "body": p}]})
            continue
        at = 0
        for c in chunking.chunk_list(part, config, [f - a for f in forced if a < f <= b]):
            body = part[at : at + c["size"]]
            at += c["size"]
            out.append({"segment": raw_segment(c["content_hash"], c["size"]), "bodies": [{"hash": c["content_hash"], "body": body}]})
    return out


def segments(body: Column, parent: Column, parent_id: Column, config: ChunkingConfig, entropies: EntropyConfig, forced: bool = False) -> Column:
    """Segments of each file, and their blobs, as an array column."""
    runs = entropy.segments(body, entropies)

    @F.pandas_udf(SEGMENTS)
    def run(data: pd.Series, parts: pd.Series, parents: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series(
            [None if d is None else file_segments(d, [dict(r) if isinstance(r, dict) else r.asDict() for r in rs], p, i, config, scenes.anchor_offsets(d) if forced else []) for d, rs, p, i in zip(data, parts, parents, ids)],
            dtype=object,
        )

    return run(body, runs, parent, parent_id)


def ingest(files: DataFrame, config: ChunkingConfig, entropies: EntropyConfig, forced: bool = False) -> DataFrame:
    """(file columns, segments, manifest, manifest_id) of files with filename, body, parent and parent_id.

    The manifest is v3; its whole hash is that of ``body``, the canonical bytes.
    """
    made = files.withColumn("_made", segments(F.col("body"), F.col("parent"), F.col("parent_id"), config, entropies, forced))
    listed = F.transform("_made", lambda s: s["segment"])
    thresholds = F.struct(F.lit(entropies.high).alias("high"), F.lit(entropies.low).alias("low"))
    omni = F.struct(F.lit(None).cast("string").alias("dcc"), F.lit(False).alias("dcc_canonical"), F.lit("omni-v2").alias("engine_version"), thresholds.alias("entropy_thresholds"), F.sha2("body", 256).alias("source_blake3"), F.octet_length("body").cast("long").alias("source_size_bytes"), F.lit(entropies.window_size).cast("long").alias("window_size"))
    text = manifests.build(F.col("filename"), F.octet_length("body"), F.sha2("body", 256), manifests.chunking_struct(config.min_size, config.avg_size, config.max_size), "v3", segments=listed, omni=omni)
    return made.withColumn("manifest", text).withColumn("manifest_id", manifests.manifest_id("manifest"))


def new_blobs(ingested: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """(hash, body): each blob of the ingested files once, without those of the store."""
    rows = ingested.select(F.explode("_made").alias("s")).select(F.explode("s.bodies").alias("b")).select("b.hash", "b.body").dropDuplicates(["hash"])
    return rows if store is None else rows.join(store.select("hash"), "hash", "left_anti")


def publish(files: DataFrame, config: ChunkingConfig, store: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_count, uploaded_chunks, manifest, manifest_id) of files published as v2.

    A chunk is uploaded by the first file that holds it, unless the store has
    it; its repeats, in that file or in others, are not.
    """
    made = files.withColumn("_chunks", chunking.chunks("body", config))
    listed = F.transform("_chunks", lambda c: F.struct(c["content_hash"].alias("hash"), c["size"].alias("size")))
    text = manifests.build(F.col("filename"), F.octet_length("body"), F.sha2("body", 256), manifests.chunking_struct(config.min_size, config.avg_size, config.max_size), "v2", chunks=listed)
    hashes = made.select("doc_id", F.explode("_chunks").alias("c")).select("doc_id", F.col("c.content_hash").alias("hash"))
    first = hashes.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    if store is not None:
        first = first.join(store.select("hash"), "hash", "left_anti")
    uploads = first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("uploaded_chunks"))
    out = made.select("doc_id", F.size("_chunks").cast("long").alias("chunk_count"), text.alias("manifest")).join(uploads, "doc_id", "left")
    return out.select("doc_id", "chunk_count", F.coalesce("uploaded_chunks", F.lit(0)).alias("uploaded_chunks"), "manifest", manifests.manifest_id("manifest").alias("manifest_id"))


def dual_artifact(files: DataFrame, ingested: DataFrame) -> DataFrame:
    """Version rows whose content is the raw file and whose metadata names the chunked artifact."""
    dedup = F.struct(F.col("manifest_id").alias("content_id"), F.lit(f"{manifests.SCHEMA_PREFIX}.v3").alias("schema"), F.lit(True).alias("dcc_canonical"))
    raw = files.select("doc_id", F.sha2("raw", 256).alias("content_id"), F.octet_length("raw").cast("long").alias("size"))
    return raw.join(ingested.select("doc_id", dedup.alias("dedup_artifact")), "doc_id")


def materialize(listed: DataFrame, store: DataFrame) -> DataFrame:
    """(file_id, body, size, content_id): chunks put together in order.

    ``listed`` has file_id, pos and hash; ``store`` has hash and body. Files with
    a chunk that the store lacks have a null body.
    """
    parts = listed.join(store, "hash", "left")
    whole = parts.groupBy("file_id").agg(F.expr("listagg(body) within group (order by pos)").alias("joined"), F.count(F.lit(1)).alias("n"), F.count("body").alias("found"))
    body = F.when(F.col("n") == F.col("found"), F.col("joined"))
    return whole.select("file_id", body.alias("body")).withColumns({"size": F.octet_length("body").cast("long"), "content_id": F.sha2("body", 256)})


def restored(made: Column) -> Column:
    """The bytes that a file's segments stand for: chunks as they are, patches applied to their dictionaries."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        def one(parts):
            out = []
            for p in parts:
                s, bodies = p["segment"], [bytes(b["body"]) for b in p["bodies"]]
                out.append(unpatch(*bodies, s["uncompressed_size"]) if s["kind"] == "zstd_dict_patch" else bodies[0])
            return b"".join(out)

        return pd.Series([None if r is None else one(r) for r in rows], dtype=object)

    return run(made)
