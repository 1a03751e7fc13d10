"""Files put together from manifests and blobs: every check, odd rows, shared blobs."""

import hashlib
import json

from lodestack.functions.manifests import SCHEMA_PREFIX
from lodestack.operators import ingest, restore


def sha(b):
    return hashlib.sha256(b).hexdigest()


def manifest(body, segments=None, chunks=None, version="v3", **other):
    fields = {"schema": f"{SCHEMA_PREFIX}.{version}", "filename": "f", "size_bytes": len(body), "whole_file_blake3": sha(body)}
    fields |= {"segments": segments} if segments is not None else {}
    return json.dumps(fields | ({"chunks": chunks} if chunks is not None else {}) | other)


def raw(b, size=None):
    return {"kind": "raw_chunk", "hash": sha(b), "size": len(b) if size is None else size}


def patch(d, p, n):
    return {"kind": "zstd_dict_patch", "parent_content_id": "p", "dict_hash": sha(d), "patch_hash": sha(p), "range_start": 0, "range_end": n, "patch_size": len(p), "uncompressed_size": n}


def restored(spark, listed, store):
    rows = spark.createDataFrame(listed, "file_id long, manifest string")
    out = restore.from_manifests(rows, spark.createDataFrame(store, "hash string, body binary"))
    assert out.columns == ["file_id", "filename", "size", "content_id", "body", "error"]
    return {r.file_id: (None if r.body is None else bytes(r.body), r.size, r.error) for r in out.collect()}


def test_every_check(spark):
    a, b, lost, torn = b"alpha" * 9, b"beta" * 7, b"lost", b"torn"
    base = b"".join(hashlib.sha256(bytes([i % 40])).digest() for i in range(900))
    new = base[:5000] + b"!" + base[5000:]
    d, p = ingest.patch(base, new)
    store = [(sha(x), x) for x in (a, b, d, p, b"")] + [(sha(torn), b"other"), (sha(a), b"a torn copy"), (f" {sha(b).upper()} ", b)]
    cases = [
        (manifest(a + b, [raw(a), raw(b)]), a + b, None),
        (manifest(a + b + a, chunks=[{"hash": sha(x).upper(), "size": len(x)} for x in (a, b, a)], version="v2"), a + b + a, None),
        (manifest(a, chunks=[{"hash": sha(a), "size": len(a)}], version="v1", whole_file_blake3=None, whole_file_sha256=sha(a)), a, None),
        (manifest(a + new + b, [raw(a), patch(d, p, len(new)), raw(b)]), a + new + b, None),
        (manifest(b"", []), b"", None),
        (manifest(b"", [raw(b"")]), b"", None),
        (manifest(a, [raw(a)], size_bytes=0), a, None),
        (manifest(a, [raw(a), raw(lost)]), None, "blob_not_found"),
        (manifest(torn, [raw(torn)]), None, "chunk_hash"),
        (manifest(a, [raw(a, 3), raw(lost)]), None, "chunk_size"),
        (manifest(new, [patch(d, a, len(new))]), None, "bad_patch"),
        (manifest(a, [raw(a)], size_bytes=4), None, "size_mismatch"),
        (manifest(a, [raw(b)], size_bytes=len(b)), None, "hash_mismatch"),
        (manifest(a, [raw(a)], whole_file_blake3=" "), None, "no_whole_hash"),
        (manifest(a, [{"kind": "odd"}]), None, "unknown_kind"),
        ("[", None, "not_an_object"),
        (None, None, "not_an_object"),
    ]
    got = restored(spark, [(i, text) for i, (text, _, _) in enumerate(cases)], store)
    assert got == {i: (body, None if body is None else len(body), error) for i, (_, body, error) in enumerate(cases)}


def test_shared_blobs_empty_tables_and_null_ids(spark):
    zero = bytes(512)
    listed = [(i, manifest(zero * (i % 5), [raw(zero)] * (i % 5))) for i in range(300)]
    got = restored(spark, [*listed, (None, listed[1][1])], [(sha(zero), zero)] * 3)
    assert got.pop(None)[2] == "no_file_id"
    assert got == {i: (zero * (i % 5), 512 * (i % 5), None) for i in range(300)}
    assert restored(spark, [], [(sha(zero), zero)]) == {}
    assert restored(spark, listed[:2], []) == {0: (b"", 0, None), 1: (None, None, "blob_not_found")}


def test_ingested_files_come_back(spark):
    from lodestack.functions.chunking import ChunkingConfig
    from lodestack.functions.entropy import EntropyConfig

    base = b"".join(hashlib.sha256(bytes([i % 50])).digest() for i in range(1500))
    rows = [(1, "a", base, base[::-1], "p"), (2, "b", base + b"z" * 5000, None, None), (3, "c", b"", None, None)]
    made = ingest.ingest(spark.createDataFrame(rows, "doc_id long, filename string, body binary, parent binary, parent_id string"), ChunkingConfig(64, 256, 1024), EntropyConfig(4096, 1.0, 6.0))
    out = restore.from_manifests(made.selectExpr("doc_id AS file_id", "manifest"), ingest.new_blobs(made))
    assert {r.file_id: (r.filename, bytes(r.body), r.error) for r in out.collect()} == {i: (f, body, None) for i, f, body, _, _ in rows}
