"""Rule statistics against plain Python, and the forest's verdicts."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestack.llm import quality
from lodestack.llm.batches import raw_text

ODD = [None, "", "\n\n", "a", "a\na\n a\na", "x y " * 6, "é é é é é é é é", "a b c d e\na b c d e", " \n", "same\nsame", "b c d e\na b c d e b c", "#1 $2 <3>", "w\x0bx\x0cy\rz\tq\x1fr", "long " * 30_000]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if count[tuple(words[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def test_statistics_match_plain_python(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert quality.statistics(*raw_text(pa.array(texts))).tolist() == [plain(t) for t in texts]


def test_verdicts_follow_labels(spark):
    rng = np.random.default_rng(4)
    words = ["ja", "nein", "haus", "baum", "und", "dort", "einer", "wolke"]
    say = lambda mark: " ".join(str(w) + mark for w in rng.choice(words, 40))
    rows = [(i, say("")) for i in range(600)] + [(600 + i, say("###")) for i in range(40)]
    rows += [(None, None), (5, ""), (5, rows[5][1]), (7, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("quality", F.lit(3))
    labels = spark.createDataFrame([(i, int(i < 600)) for i in range(0, 640, 2)] + [(None, 1), (1, None)], "doc_id long, quality int")
    out = quality.quality_verdicts(df, labels).collect()
    assert len(out) == len(rows)
    good = [r.kept for r in out if r.n_words == 40 and r.n_symbols == 0]
    bad = [r.kept for r in out if r.n_symbols]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1
    assert all(r.base_failed and not r.kept for r in out if r.n_words < 10)
    bare = quality.quality_verdicts(df, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in bare)
    assert quality.quality_verdicts(df.limit(0), labels).collect() == []


def test_paths_are_short_for_the_odd_one_out():
    x = np.r_[np.random.default_rng(0).normal(size=(300, 2)), [[9.0, 9.0]]]
    a = quality.anomaly(quality.grow(x), x)
    assert a.argmax() == 300 and quality.anomaly(quality.grow(x[:0]), x).tolist() == [0.0] * 301


def test_unequal_lines_of_one_rolling_hash_are_not_repeats():
    a = "0"
    for _ in range(10):
        a += a.translate(str.maketrans("01", "10"))
    b = a.translate(str.maketrans("01", "10"))
    for text in (f"{a}\n{b}", f"{a} u v w x {b} u v w x"):
        assert quality.statistics(*raw_text(pa.array([text])))[0].tolist() == plain(text)
