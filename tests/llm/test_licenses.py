"""License scans against planted notices, and alignments against longest common subsequences."""

import re

import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import licenses as lic


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + 1 if x == y else 0, row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignments_rise_and_match():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 12, int(rng.integers(0, 15)))] for _ in range(2))
        pairs = lic.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
        c = [str(x) for x in rng.permutation(12)]
        d = [w for w in c if rng.random() < 0.6] + ["new"] * int(rng.integers(3))
        assert len(lic.align(d, c)) == lcs(d, c)  # all words unique: exact


def test_longest_rising_run():
    rng = np.random.default_rng(2)
    for _ in range(100):
        ys = rng.permutation(9).tolist()
        got = lic.increasing(list(enumerate(ys)))
        assert len(got) == lcs(ys, sorted(ys))


def test_planted_notices(spark):
    rng = np.random.default_rng(3)
    filler = lambda n: " ".join(rng.choice(["the", "of", "soup", "copy", "to", "grün", "use"], n))
    rows, want = [], []
    for k, (name, text) in enumerate(lic.TEMPLATES.items()):
        body = f"{filler(300)}\n* {text.upper()} \n{filler(400)} {text} {filler(50)}"
        rows.append((k, body))
        want += [(k, name, text.strip().upper()), (k, name, text)]
    rows += [(100, None), (101, ""), (None, lic.TEMPLATES["MIT"]), (7, rows[7][1]), (102, filler(5000)), (103, "İ " * 3 + lic.TEMPLATES["MIT"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    out = lic.scan_licenses(df).collect()
    text = dict(rows)
    found = sorted((r.doc_id, r.license) for r in out if r.doc_id is not None and r.doc_id < 100)
    expected = sorted([(k, n) for k, n, _ in want] + [(k, n) for k, n, _ in want if k == 7])
    assert found == expected
    assert all(r.coverage >= 0.8 for r in out)
    twice = spark.createDataFrame([(1, f"x {lic.TEMPLATES['MIT']} {lic.TEMPLATES['MIT']}\n{lic.TEMPLATES['MIT']} y")], "doc_id long, text string")
    assert [r.license for r in lic.scan_licenses(twice).collect()] == ["MIT"] * 3
    for r in out:
        if r.doc_id == 9:
            words = lic.WORD.findall(text[9][r.start_char : r.end_char].lower())
            assert words == lic.WORD.findall(lic.TEMPLATES[r.license].lower())
    assert [r.license for r in out if r.doc_id == 103] == ["MIT"] and [r.license for r in out if r.doc_id is None] == ["MIT"]
    assert not [r for r in out if r.doc_id in (100, 101, 102)]
    assert lic.scan_licenses(df.limit(0)).collect() == []


def test_whole_table_finds_every_notice_line(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    lines = r"Licensed under the Apache License, Version 2|Released under the MIT License|licensed under the GNU General Public License, version 3|Licensed under CC BY-NC 4"
    want = sorted(d for d, t in docs.items() for _ in re.findall(lines, t))
    assert sorted(r.doc_id for r in lic.op1_license_scans(spark, "/root/testdata/sf0.01").collect()) == want
