"""The pipeline against a brute-force version of its stages on a small folder of tables."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from lodestack.llm import decontaminate as dc
from tests.llm.test_simhash import brute as simhash_brute


def cut(texts, length=400):
    raw = [t.encode() for t in texts]
    seen = Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append(bytes(b for b, g in zip(t, gone) if not g).decode())
    return out


def test_run_matches_brute_force(spark, tmp_path):
    rng = np.random.default_rng(12)
    vocab = {"en": ["the", "with", "house", "thing", "water", "would"], "de": ["der", "und", "nicht", "haus", "wasser", "ging"]}
    say = lambda lang, n: " ".join(f"{w}{rng.integers(30)}x" for w in rng.choice(vocab[lang], n))
    shared, items = say("en", 110), [(1, say("en", 20)), (2, say("de", 18))]
    rows = []
    for k in range(60):
        lang = ("en", "de")[k % 2]
        text = say(lang, 60)
        if k % 10 == 3:
            text += " " + items[k % 2][1] + " " + say(lang, 30)
        if k % 12 == 5:
            text = say(lang, 150) + " " + shared + " " + say(lang, 150)
        rows.append((k, text, lang, f"s{k % 3}", len(text)))
    rows += [(100, rows[4][1], "en", "s", 1), (101, rows[4][1] + " one", "en", "s", 1), (102, None, "en", "s", 0), (103, "12 %%", "de", "s", 5), (104, "", None, None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    kept = {r.doc_id for r in first.collect()}
    assert kept == {r[0] for r in rows if r[0] < 102}
    left = [(r[0], r[1]) for r in rows if r[0] in kept]
    one = {d for d, _, c in simhash_brute(left) if d == c}
    left = [r for r in left if r[0] in one]
    left = list(zip([d for d, _ in left], cut([t for _, t in left])))
    clean = []
    for d, t in left:
        have = dc.shingles_of(dc.words_of(t.encode()), 5)
        own = [dc.shingles_of(dc.words_of(x.encode()), 5) for _, x in items]
        if not any(5 * len(o & have) >= 4 * len(o) for o in own):
            clean.append((d, t))
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((d, len(lib.encode(t)), lib.encode(t), hashlib.sha256(t.encode()).hexdigest(), True) for d, t in clean)
    got = sorted((r.doc_id, r.n_pieces, list(r.piece_ids), r.decoded_sha256, r.same) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and 20 < len(got) < 60
