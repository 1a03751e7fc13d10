"""Language ID: held-out accuracy, odd rows, and the fit's parts."""

import binascii

import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import language


def test_held_out_accuracy(spark):
    rows = language.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(i, "uno dos tres " + "ñ" * (i % 3), "es") for i in range(30)] + [(i, "one two the " + "w" * (i % 4), "en") for i in range(30)]
    rows += [(None, None, "en"), (1, "", "es"), (2, "123 !?", "en"), (2, "the one", None), (2, "the one", None), (3, "the two " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language.train(df)
    out = language.predict(df, model).collect()
    assert len(out) == len(rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.text in (None, "", "123 !?"))
    assert {r.lang_pred for r in out if r.text and r.text.startswith("the")} == {"en"}
    nothing = language.train(df.limit(0))
    assert {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"}
    assert language.predict(df.limit(0), model).collect() == []


def test_ngrams_stay_inside_a_text():
    both, at = language.features_of(["ab", "cd"])
    assert both.tolist() == language.features_of(["ab"])[0].tolist() + language.features_of(["cd"])[0].tolist()
    assert at.tolist() == [0, 4, 8]


def test_penalty_zeroes_weights_and_temperature_calibrates():
    rng = np.random.default_rng(2)
    rows = [(np.array([i % 2, 5 + int(rng.integers(50))]), np.ones(2), i % 2) for i in range(400)]
    w, _ = language.fit_ftrl(rows, 2, l1=5.0)
    assert (w == 0).mean() > 0.99 and w[0, 0] > w[0, 1]
    scores = np.repeat([[4.0, 0.0]], 100, axis=0)
    assert 2 < language.fit_temperature(scores, np.r_[np.zeros(73, int), np.ones(27, int)]) < 6
