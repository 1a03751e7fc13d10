"""Token counts against the library that the vocabulary file belongs to."""

import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestack.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "aaaaaaa" * 300, "It's I'll THE they'd", "a<|endoftext|>b <|startoftext|>", "ÀÉÎ é Σίσυφος ΣΑΣ", "日本語 12345 ½ ٣", " x y\x1c\x85z\x0b", "🙂🙂 #$%^&*()__ !!!!", "İstanbul ẞ", "\x00\x01", "<|endoftext|", "x" * 50_000]


def test_counts_match_library():
    texts = ODD + [r[0] for r in duckdb.connect().execute("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    lib = Tokenizer.from_file(PATH)
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.WordBpe(PATH).count(texts) == want


def test_rows(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, None), (3, ""), (4, "a " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    out = sorted((tuple(r) for r in token_counts.count_tokens(df, PATH).collect()), key=str)
    assert out == sorted([(1, 11, 2, False), (1, 11, 2, False), (None, 0, 0, False), (3, 0, 0, False), (4, 6000, 3000, True)], key=str)
    assert token_counts.count_tokens(df.limit(0), PATH).collect() == []


def test_every_code_point_counts_as_in_the_library():
    lib, own = Tokenizer.from_file(PATH), token_counts.WordBpe(PATH)
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}1" for c in every[at : at + 8]) for at in range(0, len(every), 8)]
    texts += ["x\u0558y", "a\u208f\u209db", "\ua7cbx \ua7dc", "e\u0301\u0558E\u0301"]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = own.count(texts)
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []
