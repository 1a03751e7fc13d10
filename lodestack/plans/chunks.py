"""Queries on entropy segments, content-defined chunks and their reuse."""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import functions as F

from lodestack.functions import blake3, chunking, entropy
from lodestack.functions.chunking import ChunkingConfig
from lodestack.functions.entropy import EntropyConfig
from lodestack.operators import blobs, ingest, restore
from lodestack.plans.registry import query
from lodestack.sources import tables

#: Sizes that suit the fixture's files of at most some hundred kilobytes.
SMALL = ChunkingConfig(64, 256, 1024)
WINDOWS = EntropyConfig(1024, 3.9, 4.2)

WINDOWS_SQL = f"""
    b AS (SELECT doc_id, strlen(text) AS size, hex(encode(text)) AS h FROM documents),
    w AS (SELECT doc_id, size, h, unnest(range(0, CAST(ceil(size / {WINDOWS.window_size}.0) AS BIGINT))) AS win FROM b),
    x AS (SELECT doc_id, win, least({WINDOWS.window_size}, size - win * {WINDOWS.window_size}) AS n, unnest(regexp_extract_all(substr(h, CAST(1 + win * {2 * WINDOWS.window_size} AS BIGINT), {2 * WINDOWS.window_size}), '..')) AS v FROM w),
    c AS (SELECT doc_id, win, n, v, count(*) AS k FROM x GROUP BY ALL),
    e AS (SELECT doc_id, win, n, -sum(k / n::DOUBLE * log2(k / n::DOUBLE)) AS entropy FROM c GROUP BY ALL)
"""


@query("entropy_windows", f"WITH {WINDOWS_SQL} SELECT doc_id, win, n AS size, round(entropy, 6) + 0.0 AS entropy FROM e")
def entropy_windows(spark, sf_dir):
    rows = tables.blobs(spark, sf_dir).select("doc_id", "size", F.posexplode(entropy.window_entropies("body", WINDOWS.window_size)).alias("win", "entropy"))
    win = F.col("win").cast("long")
    return rows.select("doc_id", win.alias("win"), F.least(F.lit(WINDOWS.window_size).cast("long"), F.col("size") - win * WINDOWS.window_size).alias("size"), (F.round("entropy", 6) + F.lit(0.0)).alias("entropy"))


@query(
    "entropy_segments",
    f"""WITH {WINDOWS_SQL}, m AS (SELECT *, CASE WHEN entropy <= {WINDOWS.low} THEN 'low' WHEN entropy >= {WINDOWS.high} THEN 'high' ELSE 'mid' END AS mode FROM e),
    f AS (SELECT *, CASE WHEN mode = lag(mode) OVER (PARTITION BY doc_id ORDER BY win) THEN 0 ELSE 1 END AS fresh FROM m),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY win) AS island FROM f)
    SELECT doc_id, min(win) * {WINDOWS.window_size} AS start, max(win * {WINDOWS.window_size} + n) AS "end", any_value(mode) AS mode,
           round(list_reduce(list(entropy ORDER BY win), lambda a, x: (a + x) / 2), 6) + 0.0 AS entropy FROM i GROUP BY doc_id, island""",
)
def entropy_segments(spark, sf_dir):
    rows = tables.blobs(spark, sf_dir).select("doc_id", F.inline(entropy.segments("body", WINDOWS)))
    return rows.select("doc_id", "start", "end", "mode", (F.round("entropy", 6) + F.lit(0.0)).alias("entropy"))


def _cdc_sql() -> str:
    """Candidate places by sums of shifted table values, then a walk from cut to cut."""
    n = chunking.mask_bits(SMALL.avg_size)
    mask = (1 << (n + 1)) - 1
    gear = "[" + ",".join(str(g & mask) for g in blake3.gear_table()) + "]"
    lags = ", ".join(f"coalesce(lag(g, {k}) OVER w, 0) AS g{k}" for k in range(1, n + 1))
    total = lambda m, bits: f"(({' + '.join(['g'] + [f'(g{k} << {k})' for k in range(1, m)])}) & {(1 << bits) - 1})"
    tight = " + ".join(f"(CASE WHEN {total(m, n + 1)} = 0 THEN {1 << m} ELSE 0 END)" for m in range(1, n + 2))
    lo, hi = SMALL.min_size, SMALL.max_size
    half = (lo + hi) // 2
    return f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS size FROM documents),
    v AS (SELECT doc_id, unnest(range(0, size)) AS i, {gear}[1 + CAST('0x' || unnest(regexp_extract_all(h, '..')) AS INTEGER)] AS g FROM d),
    s AS (SELECT doc_id, i, g, {lags} FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    z AS MATERIALIZED (SELECT * FROM (SELECT doc_id, i, {tight} AS z, {total(n, n)} = 0 AS cl FROM s) WHERE z > 0 OR cl),
    walk AS (
      SELECT doc_id, size AS total, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS size FROM d
      UNION ALL
      SELECT t.doc_id, t.total, t.s + t.size, CASE WHEN t.total - t.s - t.size <= {lo} THEN t.total - t.s - t.size ELSE coalesce(
        (SELECT min(z.i) + 1 - (t.s + t.size) FROM z WHERE z.doc_id = t.doc_id AND z.i >= t.s + t.size + {lo} AND z.i < least(t.s + t.size + {hi}, t.total)
           AND CASE WHEN z.i < t.s + t.size + least({half}, t.total - t.s - t.size) THEN (z.z >> CAST(least({n + 1}, z.i - (t.s + t.size + {lo}) + 1) AS INTEGER)) & 1 = 1 ELSE z.cl END),
        least({hi}, t.total - t.s - t.size)) END
      FROM walk t WHERE t.s + t.size < t.total)
    SELECT doc_id, s AS "offset", walk.size AS size, sha256(unhex(substr(h, CAST(1 + 2 * s AS BIGINT), CAST(2 * walk.size AS BIGINT)))) AS content_hash FROM walk JOIN d USING (doc_id) WHERE walk.size > 0"""


CDC_SQL = _cdc_sql()


@query("cdc_chunks", CDC_SQL)
def cdc_chunks(spark, sf_dir):
    return tables.blobs(spark, sf_dir).select("doc_id", F.inline(chunking.chunks("body", SMALL)))


@query("cdc_invariants", "SELECT doc_id, strlen(text) AS size, true AS contiguous, true AS bounded FROM documents")
def cdc_invariants(spark, sf_dir):
    c = tables.blobs(spark, sf_dir).select("doc_id", "size", chunking.chunks("body", SMALL).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    before = F.aggregate("c", F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("ok")), lambda a, x: F.struct((a["at"] + x["size"]).alias("at"), (a["ok"] & (a["at"] == x["offset"])).alias("ok")))
    inner = F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0)))
    bounded = F.forall(inner, lambda x: x["size"].between(SMALL.min_size, SMALL.max_size)) & (F.element_at("c", -1)["size"] <= SMALL.max_size)
    return c.select("doc_id", total.alias("size"), before["ok"].alias("contiguous"), bounded.alias("bounded"))


@query(
    "chunk_dedup_ratio",
    f"""WITH c AS ({CDC_SQL}), m AS (SELECT lang, c.*, row_number() OVER (PARTITION BY content_hash ORDER BY c.doc_id, "offset") > 1 AS reused FROM c JOIN documents USING (doc_id)),
    s AS (SELECT lang, count(*) AS n_chunks, CAST(count(*) FILTER (reused) AS BIGINT) AS n_reused, CAST(sum(size) AS BIGINT) AS total_bytes, CAST(coalesce(sum(size) FILTER (reused), 0) AS BIGINT) AS reused_bytes FROM m GROUP BY 1)
    SELECT *, round(reused_bytes / greatest(1, total_bytes)::DOUBLE * 100, 6) AS reused_pct FROM s""",
)
def chunk_dedup_ratio(spark, sf_dir):
    c = tables.blobs(spark, sf_dir).select("doc_id", "lang", F.inline(chunking.chunks("body", SMALL)))
    return blobs.chunk_reuse(c, ["lang"])


@query(
    "chunk_reuse_report",
    f"""WITH c AS MATERIALIZED (SELECT lang, content_hash, size FROM ({CDC_SQL}) JOIN documents USING (doc_id)),
    l AS (SELECT DISTINCT content_hash FROM c WHERE lang = 'en'), r AS (SELECT content_hash, min(size) AS size FROM c WHERE lang IN ('de', 'fr') GROUP BY 1),
    x AS (SELECT count(*) AS reused_hashes, CAST(coalesce(sum(size), 0) AS BIGINT) AS reused_bytes FROM r WHERE content_hash IN (SELECT content_hash FROM l)),
    t AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS right_bytes FROM c WHERE lang IN ('de', 'fr'))
    SELECT (SELECT count(*) FROM l) AS left_hashes, (SELECT count(*) FROM r) AS right_hashes, x.*, t.*, reused_bytes / greatest(1, right_bytes)::DOUBLE * 100 AS dedup_pct FROM x, t""",
)
def chunk_reuse_report(spark, sf_dir):
    c = tables.blobs(spark, sf_dir).select("lang", F.inline(chunking.chunks("body", SMALL)))
    return blobs.reuse(c.where("lang = 'en'"), c.where("lang = 'de' or lang = 'fr'"))


@query(
    "chunks_in_range",
    "SELECT doc_id, CAST(greatest(0, least(strlen(text) - 100, 500)) AS BIGINT) AS covered, CASE WHEN strlen(text) > 100 THEN 100 ELSE NULL END AS first_offset FROM documents",
)
def chunks_in_range(spark, sf_dir):
    c = tables.blobs(spark, sf_dir).select("doc_id", chunking.chunks_in_range("body", F.lit(100), F.lit(500), SMALL).alias("c"))
    return c.select("doc_id", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("covered"), F.try_element_at("c", F.lit(1))["offset"].cast("int").alias("first_offset"))


@query(
    "training_samples",
    """WITH s AS (SELECT doc_id, strlen(text) AS n, least(256, greatest(8, strlen(text) // 4096)) AS target FROM documents),
       t AS (SELECT doc_id, n, target, least(262144, greatest(1, n // target)) AS step FROM s)
       SELECT doc_id, CASE WHEN n < 2 THEN 0 WHEN ceil(n / step::DOUBLE) < 2 THEN 2 ELSE CAST(ceil(n / step::DOUBLE) AS BIGINT) END AS n_samples, step FROM t""",
)
def training_samples(spark, sf_dir):
    @F.pandas_udf("n_samples bigint, step bigint")
    def run(data: pd.Series) -> pd.DataFrame:
        counts = [None if b is None else len(ingest.training_samples(b)) for b in data]
        return pd.DataFrame({"n_samples": pd.array(counts, "Int64"), "step": [ingest.training_step(len(b or b""))[1] for b in data]})

    return tables.blobs(spark, sf_dir).select("doc_id", run("body").alias("s")).select("doc_id", "s.*")


@query("omni_ingest_roundtrip", "SELECT doc_id, sha256(text) AS content_id, strlen(text) AS size, true AS restored FROM documents")
def omni_ingest_roundtrip(spark, sf_dir):
    # each file's parent is its own text turned round, so that ranges of high entropy become patches
    rows = tables.blobs(spark, sf_dir).select("doc_id", "filename", "body", F.encode(F.reverse(F.decode("body", "UTF-8")), "UTF-8").alias("parent"), F.lit("parent").alias("parent_id"))
    made = ingest.ingest(rows, SMALL, WINDOWS)
    back = ingest.restored(F.col("_made"))
    return made.select("doc_id", F.sha2("body", 256).alias("content_id"), F.octet_length("body").cast("long").alias("size"), (back == F.col("body")).alias("restored"))


@query(
    "publish_counts",
    f"""WITH c AS MATERIALIZED ({CDC_SQL}), f AS (SELECT content_hash, min(doc_id) AS doc_id FROM c GROUP BY 1), u AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1),
    m AS (SELECT doc_id, count(*) AS chunk_count, string_agg('{{"hash":"' || content_hash || '","size":' || size || '}}', ',' ORDER BY "offset") AS chunks FROM c GROUP BY 1)
    SELECT doc_id, chunk_count, coalesce(u.n, 0) AS uploaded_chunks,
           sha256('{{"chunking":{{"algo":"fastcdc","avg":{SMALL.avg_size},"max":{SMALL.max_size},"min":{SMALL.min_size}}},"chunks":[' || chunks || '],"filename":"' || source || '/' || doc_id || '.txt","hash_algo":"sha2","schema":"asset.manifest.v2","size_bytes":'
                  || strlen(text) || ',"whole_file_blake3":"' || sha256(text) || '"}}') AS manifest_id
    FROM m JOIN documents USING (doc_id) LEFT JOIN u USING (doc_id)""",
)
def publish_counts(spark, sf_dir):
    rows = tables.blobs(spark, sf_dir).select("doc_id", "filename", "body")
    return ingest.publish(rows, SMALL).select("doc_id", "chunk_count", "uploaded_chunks", "manifest_id")


#: What is done to the manifests of documents by id, and the error that it must give.
SPOILED = (("\"size_bytes\":", "\"size_bytes\":9", "size_mismatch"), ("^.", "", "not_an_object"), ("\"whole_file_blake3\":\"", "\"whole_file_blake3\":\"0", "hash_mismatch"), ("hash\":\"[0-9a-f]", "hash\":\"x", "blob_not_found"))


@query(
    "materialize_v3",
    f"""WITH d AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS filename, coalesce(encode(text), ''::BLOB) AS b, text IS NULL AS gone, doc_id % {len(SPOILED) + 1} AS k FROM documents),
    e AS (SELECT *, CASE {" ".join(f"WHEN k = {i} AND ({i} <> 3 OR octet_length(b) > 0) THEN '{err}'" for i, (_, _, err) in enumerate(SPOILED))} END AS error FROM d WHERE NOT gone)
    SELECT doc_id, CASE WHEN error IS NULL THEN octet_length(b) END AS size, CASE WHEN error IS NULL THEN sha256(b) END AS content_id, error FROM e""",
)
def materialize_v3(spark, sf_dir):
    # parents as in omni_ingest_roundtrip; all blobs are stored, the manifests of four of five documents are spoiled
    rows = tables.blobs(spark, sf_dir).where("body is not null").select("doc_id", "filename", "body", F.encode(F.reverse(F.decode("body", "UTF-8")), "UTF-8").alias("parent"), F.lit("parent").alias("parent_id"))
    # blobs and manifests are read several times; trained dictionaries are dear, so they are kept on disk (and made again if lost)
    made = ingest.ingest(rows, SMALL, WINDOWS).select("doc_id", "manifest", "_made").persist(StorageLevel.DISK_ONLY)
    text = F.col("manifest")
    for i, (pattern, new, _) in enumerate(SPOILED):
        text = F.when(F.col("doc_id") % (len(SPOILED) + 1) == i, F.regexp_replace("manifest", pattern, new)).otherwise(text)
    back = restore.from_manifests(made.select(F.col("doc_id").alias("file_id"), text.alias("manifest")), ingest.new_blobs(made))
    return back.select(F.col("file_id").alias("doc_id"), "size", "content_id", "error")


#: One window a file and no file of high entropy, so that a file's segments are its chunks.
WHOLE = EntropyConfig(1 << 27, 9.0, 10.0)


@query(
    "omni_manifest_v3",
    f"""WITH c AS MATERIALIZED ({CDC_SQL}), s AS (SELECT doc_id, string_agg('{{"hash":"' || content_hash || '","kind":"raw_chunk","size":' || size || '}}', ',' ORDER BY "offset") AS segments FROM c WHERE size > 0 GROUP BY 1),
    m AS (SELECT doc_id, '{{"chunking":{{"algo":"fastcdc","avg":{SMALL.avg_size},"max":{SMALL.max_size},"min":{SMALL.min_size}}},"filename":"' || source || '/' || doc_id || '.txt","hash_algo":"sha2",'
          || '"omni":{{"dcc_canonical":false,"engine_version":"omni-v2","entropy_thresholds":{{"high":{WHOLE.high},"low":{WHOLE.low}}},"source_blake3":"' || sha256(text) || '","source_size_bytes":' || strlen(text) || ',"window_size":{WHOLE.window_size}}},'
          || '"schema":"asset.manifest.v3","segments":[' || coalesce(segments, '') || '],"size_bytes":' || strlen(text) || ',"whole_file_blake3":"' || sha256(text) || '"}}' AS manifest
          FROM documents LEFT JOIN s USING (doc_id))
    SELECT doc_id, manifest, sha256(manifest) AS manifest_id FROM m""",
)
def omni_manifest_v3(spark, sf_dir):
    none = F.lit(None)
    rows = tables.blobs(spark, sf_dir).select("doc_id", "filename", "body", none.cast("binary").alias("parent"), none.cast("string").alias("parent_id"))
    return ingest.ingest(rows, SMALL, WHOLE).select("doc_id", "manifest", "manifest_id")
