"""SimHash groups against all pairs on small tables."""

import itertools

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestack.llm import simhash


def plain_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [plain_fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4 and comp[i] != comp[j]:
            a, b = comp[i], comp[j]
            comp = [a if c == b else c for c in comp]
    low = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in comp}
    return sorted(((r[0], f"{fps[k]:016x}", low[comp[k]]) for k, r in enumerate(rows)), key=str)


def made(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    out = simhash.near_components(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [str(x) for x in rng.choice(words, 300)]
        for _ in range(4):
            new = list(base)
            for k in rng.integers(0, 300, rng.integers(0, 4)):
                new[k] = "edit"
            rows.append((len(rows), " ".join(new)))
    rows += [(None, None), (500, ""), (501, " \n "), (501, " \n "), (7, rows[7][1]), (None, "A b"), (600, "x" * 200_000), (601, "Ä a b C d")]
    assert made(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert made(spark, []) == []


def test_crowded_buckets_are_dealt_out_without_loss(spark):
    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 1 << 62, 6)
    fps = {int(s) ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 7))) for s in seeds for _ in range(60)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = {tuple(r) for r in simhash.near_links(df, len(fps), limit=20).collect()}
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in edges)

    def groups(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(g for g in fps if find(g) == find(f)) for f in fps}

    assert groups(edges) == groups((a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4)


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(3, long, 1), (3, "other words stand here now", 1), (2, long + " x", 1), (2, "a", 1), (5, "a", 1), (5, "a", 1), (9, None, 1), (8, "", 1), (1, "lone text of six words", 1), (1, "lone text of six words", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep int").withColumn("tag", F.lit("clash")).withColumn("of", F.lit("clash"))
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "lone text of six words"), (2, "a"), (2, long + " x"), (3, "other words stand here now"), (8, "")]
