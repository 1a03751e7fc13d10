"""Contained items against shingle sets, with every item on every document."""

import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import decontaminate as dc


def brute(docs, items):
    out = []
    for d, text in docs:
        words = dc.words_of((text or "").encode())
        for i, item in items:
            own = dc.words_of((item or "").encode())
            if own:
                w = min(5, len(own))
                a, b = dc.shingles_of(own, w), dc.shingles_of(words, w)
                if 5 * len(a & b) >= 4 * len(a):
                    out.append((d, i, len(a), len(a & b), len(a & b) / len(a)))
    return sorted(out, key=str)


def test_pairs_match_brute_force(spark):
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 50, n))
    items = [(i, say(int(rng.integers(6, 40)))) for i in range(30)] + [(90, "Tiny item"), (91, None), (92, " \n"), (93, "one"), (None, say(12)), (5, "w1 w2 w3 w4 w5 w6")]
    docs = []
    for k in range(80):
        words = items[k % 30][1].split()
        for x in rng.integers(0, len(words), k % 4):
            words[x] = "other"
        docs.append((k, (say(int(rng.integers(0, 300))) + " " + " ".join(words).title() + "\t" + say(20))))
    docs += [(200, None), (201, ""), (202, "a TINY\x0bitem here"), (None, items[3][1]), (7, docs[7][1]), (203, say(30_000) + " " + items[4][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    for block in (1 << 20, 200):
        assert sorted((tuple(r) for r in dc.contaminated(d, b, block_bytes=block).collect()), key=str) == brute(docs, items)
    left = dc.drop_contaminated(d, b)
    bad = {r[0] for r in brute(docs, items)}
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((k for k, _ in docs if k not in bad), key=str)
    assert dc.contaminated(d.limit(0), b).collect() == [] and dc.contaminated(d, b.limit(0)).collect() == []


def test_sketches_cannot_miss():
    for n in range(1, 60):
        k = dc.least_shared(n)
        assert k * 5 >= 4 * n and (k == 1 or (k - 1) * 5 < 4 * n)


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, "clean"), (None, f"{item} z"), (None, "clean too"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(map(str, (r.text for r in dc.drop_contaminated(docs, items).collect()))) == ["None", "clean", "clean too"]
