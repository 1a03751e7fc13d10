"""Queries that build, check and follow manifests; a conversation is a file, its turns the chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import manifests
from lodestack.operators import ingest
from lodestack.plans.registry import query
from lodestack.sources import tables

P = manifests.SCHEMA_PREFIX
FILES_SQL = """f AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS body,
    string_agg('{"hash":"' || sha256(text) || '","size":' || strlen(text) || '}', ',' ORDER BY turn) AS chunks FROM conversations GROUP BY 1)"""
TEXT_SQL = f"""'{{"chunking":{{"algo":"fastcdc","avg":256,"max":1024,"min":64}},"chunks":[' || chunks || '],"filename":"conv_' || conv_id || '.txt","hash_algo":"sha2","schema":"{P}.v2","size_bytes":' || strlen(body) || ',"whole_file_blake3":"' || sha256(body) || '"}}'"""


def _files(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("body"))
    part = F.struct("turn", F.sha2("body", 256).alias("hash"), F.octet_length("body").cast("long").alias("size"), "body")
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["body"])), ""))
    return listed.select("conv_id", whole.alias("body"), F.transform("parts", lambda p: F.struct(p["hash"].alias("hash"), p["size"].alias("size"))).alias("chunks"))


def _manifests(spark, sf_dir):
    name = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".txt"))
    text = manifests.build(name, F.octet_length("body"), F.sha2("body", 256), manifests.chunking_struct(64, 256, 1024), "v2", chunks=F.col("chunks"))
    return _files(spark, sf_dir).select("conv_id", text.alias("manifest"))


@query("manifest_v2_build", f"WITH {FILES_SQL} SELECT conv_id, {TEXT_SQL} AS manifest, sha256({TEXT_SQL}) AS manifest_id FROM f")
def manifest_v2_build(spark, sf_dir):
    return _manifests(spark, sf_dir).select("conv_id", "manifest", manifests.manifest_id("manifest").alias("manifest_id"))


BAD = (
    ("not json", "not_an_object"),
    ("[1]", "not_an_object"),
    ('{"schema":"other.v1","chunks":[]}', "unknown_schema"),
    (f'{{"schema":"{P}.v1"}}', "no_chunks"),
    (f'{{"schema":"{P}.v3","chunks":[]}}', "no_segments"),
    (f'{{"schema":"{P}.v2","chunks":[{{"hash":" ","size":1}}]}}', "bad_chunk"),
    (f'{{"schema":"{P}.v2","chunks":[{{"hash":"ab","size":-1}}]}}', "bad_chunk"),
    (f'{{"schema":"{P}.v3","segments":[{{"kind":"odd"}}]}}', "unknown_kind"),
    (f'{{"schema":"{P}.v3","segments":[{{"kind":"zstd_dict_patch","dict_hash":"a","patch_hash":"b","range_start":0,"range_end":1,"patch_size":1,"uncompressed_size":1}}]}}', "bad_patch"),
    (f'{{"schema":"{P}.v3","segments":[{{"kind":"zstd_dict_patch","parent_content_id":"p","dict_hash":"a","patch_hash":"b","range_start":5,"range_end":1,"patch_size":1,"uncompressed_size":1}}]}}', "bad_patch"),
    (f'{{"schema":"{P}.v3","segments":[{{"kind":"raw_chunk","hash":"ab","size":3}}]}}', None),
    (f'{{"schema":"{P}.v1","chunks":[],"whole_file_sha256":" AB "}}', None),
)
_quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query("manifest_parse_validate", f"SELECT conv_id, ([{', '.join(_quoted(p) for _, p in BAD)}])[1 + conv_id % {len(BAD) + 1}] AS problem FROM (SELECT DISTINCT conv_id FROM conversations)")
def manifest_parse_validate(spark, sf_dir):
    bad = F.element_at(F.array(*(F.lit(t) for t, _ in BAD)), (F.col("conv_id") % (len(BAD) + 1) + 1).cast("int"))
    rows = _manifests(spark, sf_dir).select("conv_id", F.when(F.col("conv_id") % (len(BAD) + 1) == len(BAD), F.col("manifest")).otherwise(F.when(F.col("conv_id") % (len(BAD) + 1) < len(BAD), bad)).alias("t"))
    return rows.select("conv_id", manifests.problem("t").alias("problem"))


@query(
    "manifest_fields",
    f"""WITH {FILES_SQL} SELECT conv_id, 'conv_' || conv_id || '.txt' AS filename, strlen(body) AS size_bytes, sha256(body) AS whole_hash, 256 AS avg, (SELECT count(*) FROM conversations c WHERE c.conv_id = f.conv_id) AS n_chunks FROM f""",
)
def manifest_fields(spark, sf_dir):
    m = _manifests(spark, sf_dir).select("conv_id", manifests.parsed("manifest").alias("m"))
    return m.select("conv_id", "m.filename", "m.size_bytes", manifests.whole_hash(F.col("m")).alias("whole_hash"), manifests.defaulted_chunking(F.col("m"))["avg"].cast("int").alias("avg"), F.size(manifests.all_chunks(F.col("m"))).cast("long").alias("n_chunks"))


@query(
    "manifest_materialize",
    f"""WITH {FILES_SQL} SELECT conv_id, CASE WHEN ok THEN strlen(body) END AS size, CASE WHEN ok THEN sha256(body) END AS content_id, ok AS verified
    FROM (SELECT *, NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = f.conv_id AND sha256(c.text) IN (SELECT sha256(text) FROM conversations WHERE conv_id = 3)) AS ok FROM f)""",
)
def manifest_materialize(spark, sf_dir):
    turns = tables.read(spark, sf_dir, "conversations").select("conv_id", "text")
    store = turns.select(F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"), F.encode("text", "UTF-8").alias("body")).dropDuplicates(["hash"])
    lost = turns.where("conv_id = 3").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))
    m = _manifests(spark, sf_dir).select("conv_id", manifests.parsed("manifest").alias("m"))
    listed = m.select(F.col("conv_id").alias("file_id"), F.posexplode(manifests.all_chunks(F.col("m"))).alias("pos", "c")).select("file_id", "pos", "c.hash")
    whole = ingest.materialize(listed, store.join(lost, "hash", "left_anti"))
    said = m.select("conv_id", manifests.whole_hash(F.col("m")).alias("said"))
    return said.join(whole, said.conv_id == whole.file_id).select("conv_id", "size", "content_id", F.coalesce(F.col("content_id") == F.col("said"), F.lit(False)).alias("verified"))
