"""Near copies of five-word similarity 0.8 or more against all pairs."""

import itertools

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lodestack.llm import similar
from tests.llm.test_simhash import plain_fp


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    """The least id of each row's component."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if comp[i] != comp[j] and alike(sets[i], sets[j]):
            a, b = comp[i], comp[j]
            comp = [a if c == b else c for c in comp]
    return sorted((r[0], min(rows[k][0] for k in range(len(rows)) if comp[k] == comp[i])) for i, r in enumerate(rows))


def made_rows():
    rng = np.random.default_rng(15)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(25):
        base = [str(x) for x in rng.choice(vocab, 200)]
        for _ in range(5):
            new = list(base)
            for k in rng.integers(0, 200, rng.integers(0, 9)):
                new[k] = f"edit{rng.integers(1000)}"
            rows.append((len(rows), " ".join(new)))
    return rows + [(900, None), (901, " \n"), (902, "Ab c"), (903, "ab  C"), (904, "ab c d"), (905, rows[7][1].upper())]


def test_components_match_all_pairs(spark):
    rows = made_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    want = brute(rows)
    for sizes in ({}, {"slice_texts": 2}):  # whole groups, and groups cut into slices
        got = similar.similar_components(df, **sizes).select("doc_id", "component_id").collect()
        assert sorted(map(tuple, got)) == want
    assert similar.similar_components(df.limit(0)).count() == 0


def test_stage_drops_copies_that_differ_in_many_bits(spark):
    rows = made_rows()
    far = [(a, b) for a, b in itertools.combinations(rows, 2) if alike(shingles(a[1]), shingles(b[1])) and (plain_fp(a[1]) ^ plain_fp(b[1])).bit_count() > 4]
    assert len(far) > 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == sorted({c for _, c in brute(rows)})


def test_fingerprints_nominate_without_bands(spark):
    rows = [r for r in made_rows() if r[1] and len(r[1].split()) > 5]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tagged = df.select("doc_id", F.xxhash64("text").alias("tag"), F.encode("text", "UTF-8").alias("body"))
    sketched = tagged.mapInArrow(similar._sketches, "doc_id long, tag long, node long, n long, fp long, bands array<long>")
    # a band of their own each, so that bands nominate nothing
    nodes = sketched.groupBy("node").agg(F.min(F.struct("doc_id", "tag")).alias("at"), F.first("n").alias("n"), F.first("fp").alias("fp")).withColumn("bands", F.array("node"))
    at = {r.node: r["at"].doc_id for r in nodes.collect()}
    fp = {r.node: r.fp & (1 << 64) - 1 for r in nodes.collect()}
    sets = {d: shingles(t) for d, t in rows}
    links = similar.similar_links(tagged.select(F.struct("doc_id", "tag").alias("at"), "body"), nodes).collect()
    assert all(alike(sets[at[r.src]], sets[at[r.dst]]) for r in links)

    comp = {n: n for n in at}
    for a, b in [(r.src, r.dst) for r in links]:
        comp = {n: comp[a] if c == comp[b] else c for n, c in comp.items()}
    near = [(a, b) for a, b in itertools.combinations(at, 2) if (fp[a] ^ fp[b]).bit_count() <= similar.RADIUS and alike(sets[at[a]], sets[at[b]])]
    assert len(near) > 10 and all(comp[a] == comp[b] for a, b in near)
    assert any((fp[a] ^ fp[b]).bit_count() > 4 for a, b in near)


def test_fingerprint_links_hold_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 64, 12, dtype=np.uint64)]
    fps = [b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (0, 0, 3, 6, 9)]
    df = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(fps)], "node long, fp long")
    comp = list(range(len(fps)))
    for r in similar.fingerprint_links(df).collect():
        comp = [comp[r.src] if c == comp[r.dst] else c for c in comp]
    want = list(range(len(fps)))
    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= similar.RADIUS:
            want = [want[a] if c == want[b] else c for c in want]
    assert [comp.index(c) for c in comp] == [want.index(c) for c in want] and len(set(want)) > 12
