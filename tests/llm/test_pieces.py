"""SentencePiece ids against the library's, and exact round trips."""

import duckdb
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from lodestack.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a  b\n\tc  ", "aaaaaaaa" * 50, "日本語テスト ☃ é é ﬁ", "🙂🙂x", "    def f(x):\n        return  x", " " * 40, "x" + " " * 17 + "y", " " * 33 + "1", "http://www.example.com/path?x=1&y=2", "x" * 30_000, "▁x ▁▁"]


def test_ids_match_library_and_round_trip():
    texts = ODD + [r[0] for r in duckdb.connect().execute("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.PieceBpe(PATH)
    got = own.encode(texts)
    assert got == [lib.encode(t or "") for t in texts]
    assert [own.decode(i) for i in got] == [lib.decode(i) for i in got]
    assert all(own.decode(i) == t for i, t in zip(got, texts) if t and "▁" not in t)


def test_rows(spark):
    rows = [(1, "one two"), (1, "one two"), (None, None), (2, ""), (3, "mark ▁")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece_ids", F.lit("clash")).withColumn("same", F.lit(0))
    out = pieces.round_trip(df, PATH).collect()
    assert len(out) == 5 and all(r.same == (r.doc_id != 3) and r.n_pieces == len(r.piece_ids) for r in out)
    wide = pieces.decode(pieces.encode(df, PATH), PATH).collect()
    assert {(r.doc_id, r.decoded) for r in wide} == {(1, "one two"), (None, ""), (2, ""), (3, "mark  ")}
    assert pieces.round_trip(df.limit(0), PATH).collect() == []


def test_long_texts_in_parts_and_forgotten_units(monkeypatch):
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.PieceBpe(PATH)
    monkeypatch.setattr(pieces, "PIECE_BYTES", 64)
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 500)
    texts = ["alpha  beta ▁ gamma▁ delta\n eps é  " * 20, "one two three " * 30, "x" * 500]
    for t in texts * 3:
        assert own.encode([t]) == [lib.encode(t)]
    assert own.held <= 500 + pieces.ENTRY_BYTES + 200
