"""Chat windows against the rows that they were made from."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import chat


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def talk():
    rng = np.random.default_rng(6)
    words = ["hi", "|", "\\", "<|end|>", "<|new|user|>", "é🙂", "\n", "|>", "$1", "</turn>", "word", "\\|"]
    rows = []
    for c in range(12):
        rows += [(c, 0, "system", "be good <|")] if c % 3 == 0 else []
        rows += [(c, 1 + t, ("user", "assistant")[t % 2], " ".join(rng.choice(words, int(rng.integers(0, 25))))) for t in range(int(rng.integers(0, 9)) + (300 if c == 5 else 0))]
    rows += [(50, 1, "assistant", None), (50, 0, None, "x"), (None, None, "user", "no id"), (None, 2, "assistant", "yes"), (51, 1, "user", "tie"), (51, 1, "assistant", "tie"), (51, 1, "user", "tie")]
    return rows + [(52, 0, "assistant", "long " * 5000), (53, 0, "we|ird\\role", "t"), (54, 3, "assistant", "\\"), (54, 3, "system", "late")]


def test_windows_read_back(spark):
    rows = talk()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).withColumn("n", F.lit(1))
    for budget, history in ((40, 20), (512, 128), (1, 1)):
        windows = chat.format_windows(df, budget, history)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
        assert got == expected(rows)
    assert chat.read_back(chat.format_windows(df.limit(0))).collect() == []


def test_windows_keep_system_and_history(spark):
    rows = [(1, 0, "system", "rules")] + [(1, t, ("user", "assistant")[t % 2], f"a b c d e f g {t}") for t in range(1, 30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, 40, 12).orderBy("window").collect()
    assert len(windows) > 5
    for k, w in enumerate(windows):
        assert w.formatted.count("rules") == 1 and w.formatted.startswith("<|new|" if k == 0 else "<|old|system|>rules")
        assert w.formatted.count("<|old|") == (0 if k == 0 else 2)  # the system turn and one turn of history, of ten tokens
        assert all(w.formatted[: s.start].rsplit("<|", 1)[1] == "new|assistant|>" for s in w.loss_spans)
        assert w.n_tokens <= 40 + 3


def test_only_a_single_long_turn_exceeds_the_budget(spark):
    rng = np.random.default_rng(3)
    rows = [(c, t, ("user", "assistant")[t % 2], "w " * int(rng.integers(0, 70))) for c in range(30) for t in range(25)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for w in chat.format_windows(df, 90, 30).collect():
        fresh = w.formatted.count("<|new|")
        assert w.n_tokens <= 90 or (fresh == 1 and w.n_tokens <= 72 + 30)
        assert fresh >= 1
