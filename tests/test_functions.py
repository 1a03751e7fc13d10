"""Byte-level functions on built inputs: chunking, entropy, patches, scenes, block files and stages."""

import gzip
import hashlib
import io
import random
import struct
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from lodestack.functions import blake3, chunking, entropy, hashing, scenes
from lodestack.functions.chunking import ChunkingConfig, Cutter
from lodestack.operators import blobs, cache, ingest


def test_published_digests_and_table():
    assert blake3.digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.digest(b"\0").hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    table = b"".join(g.to_bytes(8, "big") for g in blake3.gear_table())
    assert hashlib.sha256(table).hexdigest() == "4e14e8fcb3ae3160efe49f8c94d3beaf174d9caab24a5793efd3bf3206c4062b"
    assert len({blake3.digest(bytes(n)) for n in (1023, 1024, 1025, 2048, 2049, 5000)}) == 6


def test_digests_do_not_depend_on_what_is_mixed_beside_them(monkeypatch):
    rng = random.Random(9)
    items = [rng.randbytes(n) for n in (0, 1, 64, 65, 1024, 1025, 2049, 3072, 3073, 5000, 8193, 16385, 31744)]
    alone = [blake3.digest(x) for x in items]
    assert blake3.digests(items) == alone and blake3.digests(items[::-1]) == alone[::-1] and blake3.digests([]) == []
    monkeypatch.setattr(blake3, "SIDE_BYTES", 4096)
    assert blake3.digests(items) == alone
    ring = bytes(range(251)) * 130
    # Fixed values, which a block-by-block version in plain Python gave as well
    assert blake3.digest(ring[:2049]).hex() == "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"
    assert blake3.digest(ring[:3072]).hex() == "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2"
    assert blake3.digest(ring[:31744]).hex() == "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47"


def plain_sizes(data, config, forced=()):
    """Chunk sizes by rolling the hash byte by byte."""
    bits, gear, out, at = chunking.mask_bits(config.avg_size), blake3.gear_table(), [], 0
    while at < len(data):
        n = min(config.max_size, len(data) - at)
        size = n
        if n > config.min_size:
            mid = min(n, (config.min_size + config.max_size) // 2)
            near = [f - at for f in sorted(forced) if config.min_size <= f - at <= n]
            h = 0
            for i in range(config.min_size, n):
                h = ((h << 1) + gear[data[at + i]]) % 2**64
                if not h % 2 ** (bits + (i < mid)):
                    size = i + 1
                    break
            size = near[0] if near else size
        out.append(size)
        at += size
    return out


def test_cuts_equal_a_rolling_hash():
    rng = random.Random(3)
    for config in (ChunkingConfig(64, 256, 1024), ChunkingConfig(10, 300, 40), ChunkingConfig(256, 1024, 4096), ChunkingConfig(1, 256, 300)):
        for n in (0, 1, 5, 63, 64, 65, 300, 5000):
            data = rng.randbytes(n)
            forced = {rng.randrange(1, n) for _ in range(3)} if n > 2 else set()
            assert Cutter(data, config).sizes() == plain_sizes(data, config)
            assert Cutter(data, config, forced).sizes() == plain_sizes(data, config, forced)


def test_forced_cuts():
    data = b"A" * 1024 + b"B" * 1024 + b"C" * 1024
    assert Cutter(data, ChunkingConfig(256, 1024, 4096), {1024}).sizes()[0] == 1024
    assert Cutter(b"A" * 2000, ChunkingConfig(256, 512, 2048), {32}).sizes()[0] >= 256


def test_an_insertion_leaves_later_chunks():
    rng = random.Random(1)
    base = rng.randbytes(256 << 10)
    config = ChunkingConfig(4 << 10, 16 << 10, 64 << 10)
    a, b = ({c["content_hash"] for c in chunking.chunk_list(d, config)} for d in (base, base[:200] + b"XX" + base[200:]))
    assert len(a & b) >= len(a) - 2


def test_column_chunks_of_odd_files(spark):
    df = spark.createDataFrame([(1, b""), (2, None), (3, b"x" * 700)], "id long, body binary").withColumn("forced", F.array(F.lit(300).cast("long")))
    config = ChunkingConfig(64, 256, 1024)
    got = {r.id: r.c for r in df.select("id", chunking.chunks("body", config, F.col("forced")).alias("c")).collect()}
    assert [(c.offset, c.size) for c in got[1]] == [(0, 0)] and got[2] is None and got[3][0].size == 300
    part = {r.id: r.c for r in df.select("id", chunking.chunks_in_range("body", F.lit(650), F.lit(100), config).alias("c")).collect()}
    assert part[1] == [] and part[2] is None and [(c.offset, c.size) for c in part[3]] == [(650, 50)]
    ids = {r.id: r.h for r in df.select("id", hashing.content_id("body", "blake3").alias("h")).collect()}
    assert ids[2] is None and ids[1] == blake3.digest(b"").hex()
    with pytest.raises(ValueError):
        hashing.content_id("body", "md5")


def test_entropy_segments(spark):
    data = bytes(65536) + bytes(range(256)) * 256
    assert entropy.shannon(b"") == 0 and entropy.shannon(bytes(range(256))) == 8
    df = spark.createDataFrame([(data,), (b"",), (None,)], "body binary")
    got = [r.s for r in df.select(entropy.segments("body", entropy.EntropyConfig(4096, 1.0, 7.0)).alias("s")).collect()]
    assert [(s.start, s.end, s.mode) for s in got[0]] == [(0, 65536, "low"), (65536, 131072, "high")]
    assert got[1] == [] and got[2] is None


def test_patches_restore():
    rng = random.Random(2)
    words = [rng.randbytes(8) for _ in range(60)]
    base = b"".join(rng.choice(words) for _ in range(4000))
    new = base[:9000] + b"changed" + base[9000:]
    d, p = ingest.patch(base, new)
    assert ingest.unpatch(d, p, len(new)) == new and len(p) < len(new)
    assert ingest.patch(b"", new) is None and ingest.patch(base, b"") is None
    assert ingest.training_samples(b"x") == [] and ingest.training_samples(b"xy") == [b"x", b"y"]


def test_ingest_with_parents_restores_every_file(spark):
    rng = random.Random(4)
    words = [rng.randbytes(6) for _ in range(80)]
    base = b"".join(rng.choice(words) for _ in range(6000))
    rows = [(1, "a", base, base[::-1], "p"), (2, "b", base + b"z" * 5000, None, None), (3, "c", b"", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, filename string, body binary, parent binary, parent_id string")
    made = ingest.ingest(df, ChunkingConfig(64, 256, 1024), entropy.EntropyConfig(4096, 1.0, 6.0))
    back = {r.doc_id: (bytes(r.b), r._made) for r in made.select("doc_id", "_made", ingest.restored(F.col("_made")).alias("b")).collect()}
    assert all(back[i][0] == body for i, _, body, _, _ in rows)
    assert {p.segment.kind for p in back[1][1]} >= {"zstd_dict_patch"} and {p.segment.kind for p in back[2][1]} == {"raw_chunk"}
    new = ingest.new_blobs(made)
    assert new.count() == new.select("hash").distinct().count() > 10 and ingest.new_blobs(made, new).count() == 0


SCENE = '//Maya ASCII 2024\n// Created by Maya 1\n//Last modified: x\nrequires maya "2024";\nfileInfo "os" "Win";\nfileInfo "customStudio" "x";\ncreateNode transform;\n\trename -uid "AB";'


def test_text_scenes():
    scene = scenes.TextScene()
    want = f'//Maya ASCII scene\n// Created by Maya\nrequires maya "{scenes.PLACEHOLDER}";\nfileInfo "os" "{scenes.PLACEHOLDER}";\nfileInfo "customStudio" "x";\ncreateNode transform;\n\trename -uid "{scenes.ZERO_UUID}";'
    assert scene.canonical(SCENE.encode()).decode() == want
    assert scene.canonical(b"\xef\xbb\xbf" + SCENE.replace("\n", "\r\n").encode()).decode() == want
    with pytest.raises(UnicodeDecodeError):
        scene.canonical(b"\xff")
    numeric = scenes.TextScene(quantize=5).canonical(b'setAttr ".vt" -type "pointArray" 2 1.49999998 2.124 "3.1" 4. ;').decode()
    assert numeric == 'setAttr ".vt" -type "pointArray" 2 1.50000 2.12400 "3.1" 4.00000 ;'
    assert scenes.quantized("1.25 x", -1) == "1.25 x" and scenes.quantized("0.25 0.35", 1) == "0.2 0.3"
    payload = b'setAttr ".d" -type "ngst2SkinLayerDataStorage" "abc\ndef";\nnext'
    assert scene.canonical(payload).decode() == f'setAttr ".d" -type "ngst2SkinLayerDataStorage" "{scenes.PLACEHOLDER}";\nnext'
    assert scenes.TextScene(payloads=False).canonical(payload) == payload
    text = 'x\ncreateNode animCurveTL;\n\tsetAttr ".ktv[0]" 1;\né -type "pointArray"\n'
    assert scenes.anchor_offsets(text.encode()) == [2, 26, 48]


def block_file(pointer=8, little=True, new=False):
    order = "<" if little else ">"
    head = b"BLENDER17-01" + (b"v" if little else b"V") + b"0500" if new else b"BLENDER" + (b"-" if pointer == 8 else b"_") + (b"v" if little else b"V") + b"400"
    block = lambda code, body, ptr: code + struct.pack(order + "I", len(body)) + ptr + struct.pack(order + "II", 1, 1) + body
    full = head + block(b"OB\0\0", b"data", b"\x11" * pointer) + block(b"ENDB", b"", b"\x22" * pointer)
    return full, full.replace(b"\x11" * pointer, bytes(pointer))


def test_block_files():
    for pointer, little, new in ((8, True, False), (4, False, False), (4, True, False), (8, True, True)):
        raw, zeroed = block_file(pointer, little, new)
        assert scenes.block_layout(raw) == (pointer, little, 17 if new else 12)
        assert scenes.zero_pointers(raw) == (zeroed, 1) and scenes.canonical_blocks(raw) == raw
    raw, zeroed = block_file()
    for packed in (zstandard.compress(raw), raw[:12] + gzip.compress(raw[12:]), raw[:12] + zstandard.compress(raw[12:])):
        assert scenes.canonical_blocks(packed, zero=True) == zeroed
    short = raw[: raw.index(b"ENDB")]
    assert scenes.zero_pointers(short + b"tail")[0] == zeroed[: len(short)]  # a rest shorter than a header goes
    assert scenes.zero_pointers(short[:-1])[0] == short[:-1]  # a block that is cut short stays
    for bad in (b"BLEND", b"not a block file at all"):
        with pytest.raises(ValueError):
            scenes.canonical_blocks(bad)


def test_stages(spark):
    heads = {b"#usda 1.0\n": "usda", b" \n#usda": "usda", b"PXR-USDC\0": "usdc", b"PK\x03\x04": "usdz", b"zz": "unknown", b"": "unknown"}
    assert {h: scenes.stage_format(h) for h in heads} == heads
    df = spark.createDataFrame([(h,) for h in heads], "body binary")
    assert {bytes(r.body): r.f for r in df.select("body", scenes.stage_format_column("body").alias("f")).collect()} == heads

    def packed(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(zipfile.ZipInfo(n, (2021, 2, 3, 4, 5, 6)), n * 3)
        return out.getvalue()

    a, b = packed(["b.usdc", "a.png"]), packed(["a.png", "b.usdc"])
    assert a != b and scenes.canonical_stage(a, True) == scenes.canonical_stage(b, True) and scenes.canonical_stage(a) == a
    with pytest.raises(ValueError):
        scenes.repack(b"PK\x03\x04 broken")


def test_long_strings_close_at_an_unescaped_quote():
    ends = {'";': True, 'a";  ': True, 'a\\";': False, 'a\\\\";': True, 'a"; b': False, "": False, "a": False, '\\";': False}
    assert {line: scenes.closes(line) for line in ends} == ends
    assert scenes.quantized('1.5 "1.5 x" -2.25e1 "open 1.5', 0) == '2 "1.5 x" -22 "open 1.5'


def test_options_of_canonicalisers_and_bad_files(spark):
    assert [scenes.enabled(f, True) for f in (None, "", "0", " YES ", "on", "2")] == [True, False, False, True, True, False]
    raw, zeroed = block_file()
    numeric, rounded = (f'setAttr ".vt" -type "pointArray" 1 {x};'.encode() for x in ("1.26", "1.3"))
    rows = [(1, raw, "blocks"), (2, numeric, "text"), (3, b"\xff", "text"), (4, b"nothing", "blocks"), (5, b"PK\x03\x04 broken", "stage"), (6, None, "text"), (7, b"x", "other"), (8, b"x", None)]
    df = spark.createDataFrame(rows, "id long, body binary, kind string")
    asked = scenes.Options(decimals=1, zero_pointers=True, repack_archives=True)
    got = {r.id: (r.o.body and bytes(r.o.body), r.o.error) for r in df.select("id", scenes.canonical_outcome("body", "kind", asked).alias("o")).collect()}
    assert got[1] == (zeroed, None) and got[2] == (rounded, None)
    assert all(got[i][0] is None and got[i][1] for i in (3, 4, 5)) and all(got[i] == (None, None) for i in (6, 7, 8))
    plain = {r.id: r.b and bytes(r.b) for r in df.select("id", scenes.canonical("body", "kind").alias("b")).collect()}
    assert plain == {1: raw, 2: numeric, 5: rows[4][1]} | dict.fromkeys((3, 4, 6, 7, 8))


def test_eviction_takes_the_oldest_first(spark):
    rows = [(k, f"f{k}", "p", s, t, 0) for k, s, t in (("a", 10, 1), ("b", 10, 5000), ("c", 10, 5000), ("d", 5, 9000))]
    index = spark.createDataFrame(rows, "content_id string, filename string, rel_path string, size_bytes long, last_accessed_at long, created_at long")
    gone = lambda cap, keep=None: sorted(r.content_id for r in cache.evictions(index, cap, keep).collect())
    assert gone(35) == [] and gone(0) == [] and gone(34) == ["a"] and gone(15) == ["a", "b"] and gone(1) == ["a", "b", "c", "d"]
    assert gone(15, index.where("content_id = 'a'")) == ["b", "c"]
    assert [r.content_id for r in cache.candidates(index, index.where("content_id = 'a'"), 2).collect()] == ["b", "c"]
    assert cache.lookup(index, " A ").first().filename == "fa" and cache.total_size(index.limit(0)).first().total_size == 0


def test_upload_appends_only_what_is_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, "aa", b"x"), (2, "aa", b"x"), (3, "bb", b"y")], "doc_id long, content_id string, body binary")
    store = str(tmp_path / "store")
    blobs.upload(df.where("doc_id < 3"), store)
    blobs.upload(df, store)
    assert sorted(r.content_id for r in spark.read.parquet(store).collect()) == ["aa", "bb"]
