"""Repeated passages of over 50 words against a count of every run of words."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lodestack.llm import repeats


def brute(texts, words):
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    run = lambda t, s, k: tuple(t[a:b] for a, b in s[k : k + words])
    seen = Counter(run(t, s, k) for t, s in zip(texts, spans) for k in range(len(s) - words + 1))
    out = []
    for t, s in zip(texts, spans):
        gone = np.zeros(len(t), bool)
        for k in range(len(s) - words + 1):
            if seen[run(t, s, k)] > 1:
                gone[s[k][0] : s[k + words - 1][1]] = True
        out.append(bytes(b for b, g in zip(t, gone) if not g).decode())
    return out


def test_passages_match_brute_force(spark):
    rng = np.random.default_rng(21)
    say = lambda n: " ".join(rng.choice(["ab", "the", "é", "noun", "verb", "x", "zz\n"], n))
    shared = [say(int(n)) for n in rng.integers(19, 40, 5)]
    rows = [(k, f"{say(int(rng.integers(0, 60)))} {shared[int(rng.integers(5))]}\t{say(int(rng.integers(0, 60)))}") for k in range(40)]
    rows += [(100, None), (101, ""), (102, "a b c " * 30), (103, rows[3][1]), (104, "one " * 20), (105, "one " * 19), (106, "é " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("of", F.lit("clash"))
    got = {r.doc_id: r.text for r in repeats.remove_repeats(df, length=100_000, words=20).collect()}
    want = brute([(t or "").encode() for _, t in rows], 20)
    assert got == {k: None if t is None else w for (k, t), w in zip(rows, want)}
    assert want != [t or "" for _, t in rows]
    assert repeats.remove_repeats(df.limit(0), words=20).collect() == []


def test_stage_cuts_short_words_and_keeps_shorter_passages(spark):
    rng = np.random.default_rng(22)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1000, n))
    long, short = say(52), say(50)
    assert len(long) < 400
    rows = [(k, f"{say(30)} a{k} {(long, short)[k // 2]} b{k} {say(30)}") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, df, "").collect()}
    assert out == {k: t.replace(long, "") for k, t in rows}
