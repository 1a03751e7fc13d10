"""Arrow pieces, rolling hashes and components."""

import numpy as np
import pyarrow as pa

from lodestack.llm import rolling
from lodestack.llm.batches import raw_text, text_pieces
from lodestack.llm.components import connected_components


def test_pieces_hold_every_row_once():
    texts = ["a" * 10, None, "", "b" * 50, "cé", None, "d" * 7]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"]).slice(1)
    for limit in (1, 12, 1000):
        pieces = list(text_pieces(batch, "text", limit))
        assert [x for p in pieces for x in p.column(1).to_pylist()] == texts[1:]
        for p in pieces:
            data, at = raw_text(p.column(1))
            assert [bytes(data[a:b]).decode() for a, b in zip(at, at[1:])] == [t or "" for t in p.column(1).to_pylist()]
    assert list(text_pieces(batch.slice(0, 0), "text")) == []
    for kind in (pa.large_string(), pa.binary()):
        data, at = raw_text(pa.array([None, b"x" if kind == pa.binary() else "x"], kind))
        assert bytes(data) == b"x" and at.tolist() == [0, 0, 1]


def test_equal_stretches_have_equal_hashes():
    data = np.frombuffer(b"abcabcabd" * 40, np.uint8)
    sums = rolling.prefix_sums(data)
    a, n = np.arange(300), 9
    h = rolling.stretches(sums, a, a + n)
    words = [bytes(data[i : i + n]) for i in a]
    assert len(set(h.tolist())) == len(set(words)) and all((h[i] == h[j]) == (words[i] == words[j]) for i in range(20) for j in range(300))


def test_components_of_paths_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 299), (299, 300), (None, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {299: 299, 300: 299}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
