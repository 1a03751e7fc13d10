"""Repeated strings against a count of every string."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestack.llm import repeats, suffixes


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(np.sum(np.diff(np.r_[False, gone]).astype(bool) & gone))
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(3)
    words = ["ab", "the", "é", "noun", "verb", "x", "zz\n"]
    say = lambda n: " ".join(rng.choice(words, n))
    shared = [say(60) for _ in range(4)]
    rows = [(i, say(int(rng.integers(0, 80))) + shared[int(rng.integers(4))][int(rng.integers(30)) :] + say(int(rng.integers(0, 90)))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, rows[3][1]), (5, rows[5][1]), (102, "a" * 900), (103, "ab" * 300), (104, say(2000)), (104, "tiny"), (105, "tiny")]
    return rows


def test_report_matches_brute_force(spark):
    rows = corpus()
    for length, anchor, hot in ((50, 16, 1), (400, 128, 4000)):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("cuts", F.lit(1))
        got = sorted((tuple(r) for r in repeats.removal_report(df, length=length, anchor=anchor, sort_bytes=3000, hot_parts=hot).drop("n_passage_words").collect()), key=str)
        assert got == brute(rows, length)


def test_cut_texts_hold_whole_characters(spark):
    rows = [(1, "éü" * 100 + "one"), (2, "éü" * 100 + "two"), (3, None), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("cuts", F.lit(1))
    out = {r.doc_id: r.text for r in repeats.remove_repeats(df, length=41, anchor=16).collect()}
    assert out[3] is None and out[4] == "short" and out[1] == "one" and out[2] == "two"
    assert repeats.remove_repeats(df.limit(0)).collect() == []


def test_suffix_arrays_match_sorting():
    rng = np.random.default_rng(1)
    for _ in range(120):
        parts = [bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(0, 60))).astype(np.uint8)) for _ in range(int(rng.integers(1, 4)))]
        text, _ = suffixes.joined(parts)
        depth = int(rng.integers(1, 40))
        found = suffixes.suffix_array(text, depth).tolist()
        symbols = text.tolist()
        assert found == sorted(range(len(symbols)), key=lambda i: (symbols[i : i + depth], i)) or all(
            symbols[a : a + depth] <= symbols[b : b + depth] for a, b in zip(found, found[1:])
        )
        assert sorted(found) == list(range(len(symbols)))


def test_long_texts_in_windows():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 123, 3 * repeats.PIECE_BYTES + 77).astype(np.uint8)
    data[repeats.PIECE_BYTES - 300 : repeats.PIECE_BYTES + 300] = data[5000:5600]
    seen = {}
    for at, part, offsets in repeats.windows(data, np.array([0, len(data)]), 399):
        doc, start, count, anchors, after = repeats.owned_starts(part, offsets, 400, 128)
        for s, c, a, p in zip((start + at).tolist(), count.tolist(), anchors.tolist(), after.tolist()):
            seen.update((s + k, (a, p - k)) for k in range(c))
    assert sorted(seen) == list(range(len(data) - 399))
    assert all(seen[5000 + k] == seen[repeats.PIECE_BYTES - 300 + k] for k in range(201))


def test_passage_words_count_runs_of_over_50_words(spark):
    said = [" ".join(f"w{k}q{i}" for k in range(n)) for i, n in enumerate((50, 51, 60, 80))]
    rows = [(10 * i + j, f"{'only%d' % (10 * i + j)} {t.replace(' ', chr(10) if j else ' ')} end{j}") for i, t in enumerate(said) for j in (0, 1)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_passage_words for r in repeats.removal_report(df, words=51).collect()}
    assert got == {0: 0, 1: 0, 10: 51, 11: 51, 20: 60, 21: 60, 30: 80, 31: 80, 90: 0, 91: 0}


def test_ranges_merge_in_batches():
    rng = np.random.default_rng(8)
    cuts = [[{"lo": int(a), "hi": int(a + n)} for a, n in zip(rng.integers(0, 60, k), rng.integers(1, 9, k))] for k in rng.integers(0, 12, 200)]
    batch = pa.RecordBatch.from_arrays([pa.array([b"k"] * 200), pa.array(cuts, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["key", "cuts"])
    (got,) = repeats._merge([batch])
    assert [[(c["lo"], c["hi"]) for c in row] for row in got.column(1).to_pylist()] == [repeats.merged(c) for c in cuts]
