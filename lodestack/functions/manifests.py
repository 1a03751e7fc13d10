"""Manifests: deterministic JSON of a file's chunks or segments, and their validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_PREFIX = "asset.manifest"
VERSIONS = ("v1", "v2", "v3")

CHUNKING = "struct<algo:string,avg:bigint,max:bigint,min:bigint>"
SEGMENT = "struct<dict_hash:string,hash:string,kind:string,parent_content_id:string,patch_hash:string,patch_size:bigint,range_end:bigint,range_start:bigint,size:bigint,uncompressed_size:bigint>"
OMNI = "struct<dcc:string,dcc_canonical:boolean,engine_version:string,entropy_thresholds:struct<high:double,low:double>,source_blake3:string,source_size_bytes:bigint,window_size:bigint>"
#: Fields of every level stand in alphabetical order, which is the order that they are written in.
MANIFEST = f"struct<chunking:{CHUNKING},chunks:array<struct<hash:string,size:bigint>>,filename:string,hash_algo:string,omni:{OMNI},schema:string,segments:array<{SEGMENT}>,size_bytes:bigint,whole_file_blake3:string,whole_file_sha256:string>"


def chunking_struct(min_size: int, avg_size: int, max_size: int, algo: str = "fastcdc") -> Column:
    return F.struct(F.lit(algo).alias("algo"), F.lit(avg_size).cast("long").alias("avg"), F.lit(max_size).cast("long").alias("max"), F.lit(min_size).cast("long").alias("min"))


def build(filename: Column, size: Column, whole: Column, chunking: Column, version: str = "v2", chunks: Column | None = None, segments: Column | None = None, omni: Column | None = None, hash_algo: str = "sha2") -> Column:
    """The JSON text of a manifest: keys in order, no blanks, fields that are null left out.

    v1 names the whole file's hash twice; v3 has segments in place of chunks.
    """
    if version not in VERSIONS or (version == "v3") != (segments is not None):
        raise ValueError("v1 and v2 have chunks, v3 has segments")
    fields = {"chunking": chunking, "filename": filename, "hash_algo": F.lit(hash_algo), "schema": F.lit(f"{SCHEMA_PREFIX}.{version}"), "size_bytes": size.cast("long"), "whole_file_blake3": whole}
    fields |= {"chunks": chunks} if chunks is not None else {}
    fields |= {"segments": segments} if segments is not None else {}
    fields |= {"omni": omni} if omni is not None else {}
    fields |= {"whole_file_sha256": whole} if version == "v1" else {}
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def manifest_id(text: Column | str, algo: str = "sha2") -> Column:
    """The content id of a manifest's bytes."""
    from lodestack.functions.hashing import content_id

    return content_id(F.encode(text, "UTF-8"), algo)


def parsed(text: Column | str) -> Column:
    """The manifest of a JSON text; null if that is no object."""
    return F.from_json(text, MANIFEST, {"mode": "PERMISSIVE"})


def whole_hash(m: Column) -> Column:
    """The whole file's hash under its name, its older name, or blank."""
    name = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(name(m["whole_file_blake3"]), name(m["whole_file_sha256"]), F.lit(""))


def defaulted_chunking(m: Column) -> Column:
    """The chunking of a manifest, with missing or zero values as usual."""
    c = m["chunking"]
    num = lambda x, d: F.coalesce(F.nullif(x, F.lit(0).cast("long")), F.lit(d).cast("long"))
    return F.struct(F.coalesce(F.nullif(c["algo"], F.lit("")), F.lit("fastcdc")).alias("algo"), num(c["avg"], 1 << 20).alias("avg"), num(c["max"], 4 << 20).alias("max"), num(c["min"], 256 << 10).alias("min"))


def all_chunks(m: Column) -> Column:
    """Chunks of any version: those listed, and the raw segments of v3 in order."""
    raw = F.transform(F.filter(F.coalesce(m["segments"], F.array().cast(f"array<{SEGMENT}>")), lambda s: s["kind"] == "raw_chunk"), lambda s: F.struct(s["hash"].alias("hash"), s["size"].alias("size")))
    return F.when(m["schema"].endswith(".v3"), raw).otherwise(m["chunks"])


def problem(text: Column | str) -> Column:
    """Why a text is no valid manifest, or null: the first failed check of a fixed order."""
    m = parsed(text)
    t = F.col(text) if isinstance(text, str) else text
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad_chunk = F.exists(m["chunks"], lambda c: blank(c["hash"]) | F.coalesce(c["size"] < 0, F.lit(True)))
    known = [F.lit(f"{SCHEMA_PREFIX}.{v}") for v in VERSIONS]
    raw = lambda s: s["kind"] == "raw_chunk"
    patch = lambda s: s["kind"] == "zstd_dict_patch"
    bad_kind = F.exists(m["segments"], lambda s: ~F.coalesce(raw(s) | patch(s), F.lit(False)))
    bad_raw = F.exists(m["segments"], lambda s: F.coalesce(raw(s), F.lit(False)) & (blank(s["hash"]) | F.coalesce(s["size"] < 0, F.lit(True))))
    negative = lambda s: (s["range_start"] < 0) | (s["range_end"] < s["range_start"]) | (s["patch_size"] < 0) | (s["uncompressed_size"] < 0)
    bad_patch = F.exists(m["segments"], lambda s: F.coalesce(patch(s), F.lit(False)) & (blank(s["parent_content_id"]) | blank(s["dict_hash"]) | blank(s["patch_hash"]) | F.coalesce(negative(s), F.lit(True))))
    v3 = m["schema"].endswith(".v3")
    return (
        F.when(F.try_parse_json(t).isNull() | ~F.ltrim(t).startswith("{"), "not_an_object")
        .when(~F.coalesce(m["schema"].isin(*known), F.lit(False)), "unknown_schema")
        .when(v3 & m["segments"].isNull(), "no_segments")
        .when(~v3 & m["chunks"].isNull(), "no_chunks")
        .when(v3 & bad_kind, "unknown_kind")
        .when(v3 & bad_raw, "bad_chunk")
        .when(v3 & bad_patch, "bad_patch")
        .when(~v3 & bad_chunk, "bad_chunk")
    )
