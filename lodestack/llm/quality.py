"""Quality rules: statistics of whole texts, and an isolation forest over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import rolling
from lodestack.llm.batches import raw_text, released, text_pieces
from lodestack.llm.workspace import materialise

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Trees of the forest, and rows that each is split from; few rows keep common junk from hiding itself.
TREES, TREE_ROWS = 200, 64
#: Rows that the forest is grown from, as drawn over the whole table.
SAMPLE_ROWS = 12_000
#: Share of the documents labelled as good that the threshold keeps at least.
KEEP_GOOD = 0.998
SCORE_BINS = 2000
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
WORD = re.compile(rb"[^\x20\x09-\x0D]")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATS of each text, given the bytes of all and their offsets; one row a text."""
    n, docs = len(data), len(offsets) - 1
    out = np.zeros((docs, len(STATS)), np.int64)
    if not n:
        return out
    head = np.zeros(n + 1, bool)
    head[offsets] = True  # texts begin and end words
    solid = ~SPACE[data]
    start = np.flatnonzero(solid & np.r_[True, ~solid[:-1] | head[1:-1]])
    end = np.flatnonzero(solid & (np.r_[~solid[1:], True] | head[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    out[:, 0] = np.bincount(doc, minlength=docs)
    out[:, 1] = _true_in_each(solid & ((data & 0xC0) != 0x80), offsets)
    out[:, 2] = _true_in_each(SYMBOL[data], offsets)
    # lines: a new line ends one, and so does the end of a text
    breaks = data == 0x0A
    cut = np.union1d(np.flatnonzero(breaks), offsets[1:])  # a text's end may be the next one's start
    first = np.r_[0, cut[:-1] + (cut[:-1] < n) * np.where(cut[:-1] < n, breaks[np.minimum(cut[:-1], n - 1)], False)]
    full = np.searchsorted(start, cut) > np.searchsorted(start, first)
    first, last = first[full], cut[full]
    owner = np.searchsorted(offsets, first, side="right") - 1
    out[:, 3] = _later_equals(rolling.hashed(data, first, last), owner, docs)
    if len(start) >= WINDOW:
        h = rolling.hashed(data, start, end)
        m = len(start) - WINDOW + 1
        key = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            key = rolling.mixed(key * np.uint64(3) + h[k : k + m])
        inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
        tagged = rolling.mixed(key[inside] ^ rolling.mixed(doc[inside].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(tagged)
        ranked = tagged[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(inside), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(start) + 1, np.int64)
        at = inside[twice]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        out[:, 4] = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=docs)
    return out


def _true_in_each(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many values of ``mask`` are true in each text."""
    return np.where(np.diff(offsets) > 0, np.add.reduceat(mask, np.minimum(offsets[:-1], len(mask) - 1), dtype=np.int64), 0)


def _later_equals(h: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """For each document, its hashes that an earlier place of it holds already."""
    pair = np.unique(np.rec.fromarrays([owner, h]))
    return np.bincount(owner, minlength=docs) - np.bincount(pair.f0, minlength=docs)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, STATS, base_failed) for every whole text; a null text has no words."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch):
                s = statistics(*raw_text(piece.column(1)))
                bad = (s[:, 0] < 10) | (100 * s[:, 4] > 20 * s[:, 0])
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(np.ascontiguousarray(c)) for c in s.T), pa.array(bad)], ["doc_id", *STATS, "base_failed"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, {', '.join(f'{c} long' for c in STATS)}, base_failed boolean")


def ratios(s: np.ndarray) -> np.ndarray:
    """What the forest splits on, from STATS: symbols a character and characters a word.

    Repeated runs of words are judged by the base rules; repeated lines are
    reported and not judged. As forest columns they would make
    harmless rare values, such as one repeated heading, the shortest paths.
    """
    return np.column_stack([s[:, 2] / np.maximum(s[:, 1], 1), s[:, 1] / np.maximum(s[:, 0], 1)])


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: split column (-1 at a leaf), value, and the path length where a row ends."""

    column: np.ndarray
    value: np.ndarray
    path: np.ndarray
    rows: int


def expected_path(n: np.ndarray | int) -> np.ndarray:
    """The mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 5) -> Forest:
    """Random splits of random rows until rows are alone or equal, or the usual depth is reached."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    deep = max(1, int(np.ceil(np.log2(max(rows, 2)))))
    size = (1 << (deep + 1)) - 1
    column, value, path = np.full((trees, size), -1, np.int8), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, 0, rng.choice(len(x), rows, replace=False))] if rows else []
        while todo:
            at, depth, who = todo.pop()
            low, high = (x[who].min(axis=0), x[who].max(axis=0)) if len(who) else (np.zeros(x.shape[1]),) * 2
            free = np.flatnonzero(high > low)
            path[t, at] = depth + expected_path(len(who))
            if depth == deep or len(who) <= 1 or not len(free):
                continue
            c = rng.choice(free)
            v = rng.uniform(low[c], high[c])
            column[t, at], value[t, at] = c, v
            left = x[who, c] <= v
            todo += [(2 * at + 1, depth + 1, who[left]), (2 * at + 2, depth + 1, who[~left])]
    return Forest(column, value, path, rows)


def anomaly(forest: Forest, x: np.ndarray) -> np.ndarray:
    """2 ** -(mean path / expected path): near 1 for rows that few splits set apart."""
    if not forest.rows or not len(x):
        return np.zeros(len(x))
    total, every = np.zeros(len(x)), np.arange(len(x))
    for column, value, path in zip(forest.column, forest.value, forest.path):
        at = np.zeros(len(x), np.int64)
        while True:
            c = column[at]
            inner = c >= 0
            if not inner.any():
                break
            at = np.where(inner, 2 * at + 1 + (x[every, np.maximum(c, 0)] > value[at]), at)
        total += path[at]
    return 2.0 ** (-total / len(forest.column) / max(float(expected_path(forest.rows)), 1e-9))


def fit_forest(stats: DataFrame, sample: int = SAMPLE_ROWS) -> Forest:
    """A forest over about ``sample`` rows that pass the base rules, drawn by a hash of all they hold."""
    rows = stats.where(~F.col("base_failed"))
    n = rows.count()
    place = F.pmod(F.xxhash64(*stats.columns), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(place < min(1.0, sample / max(n, 1))).select(*STATS, F.xxhash64(*stats.columns).alias("place")).orderBy("place", *STATS).limit(2 * sample)
    got = np.array([r[: len(STATS)] for r in drawn.collect()], np.int64).reshape(-1, len(STATS))
    return grow(ratios(got))


def with_anomaly(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with the column anomaly."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)  # of fixed size

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in STATS])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anomaly(shared.value, ratios(s)))], [*batch.schema.names, "anomaly"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(run, f"{kinds}, anomaly double")


def threshold(scored: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """The anomaly above which documents go, from all labelled rows that pass the base rules.

    Among the bins of scores, it is the one that sets most bad rows apart from
    good ones (by share), but never one that would lose more than
    ``1 - keep_good`` of the good. Without good and bad rows nothing goes.
    """
    named = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    pairs = scored.where(~F.col("base_failed")).join(named, "doc_id")
    counted = pairs.groupBy(F.floor(F.col("anomaly") * SCORE_BINS).cast("int").alias("bin"), (F.col("quality") > 0).alias("good")).agg(F.count(F.lit(1)).alias("n"))
    good, bad = np.zeros(SCORE_BINS + 2), np.zeros(SCORE_BINS + 2)
    for bin_, is_good, n in counted.collect():  # two rows a bin at most
        (good if is_good else bad)[bin_] += n
    if not good.sum() or not bad.sum():
        return float("inf")
    lost, caught = np.cumsum(good[::-1])[::-1] / good.sum(), np.cumsum(bad[::-1])[::-1] / bad.sum()
    gain = np.where(lost <= 1 - keep_good, caught - lost, -1.0)
    return int(gain.argmax()) / SCORE_BINS if gain.max() > 0 else float("inf")


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_good: float = KEEP_GOOD) -> DataFrame:
    """(doc_id, STATS, base_failed, anomaly, kept) for every row of ``docs``.

    Null texts have no words and fail the base rules, as do texts of fewer than
    ten words. Repeated rows get equal verdicts. A document that several labels
    name counts as good if one says so; labels with nulls are left out. Empty
    tables give no rows; without labels the base rules decide. Other columns of
    either table are not looked at.
    """
    stats = materialise(with_statistics(docs, id_col, text_col))
    scored = materialise(with_anomaly(stats, fit_forest(stats)))
    limit = threshold(scored, labels, keep_good)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(limit)))


def op8_quality_rules(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_verdicts(docs, labels)
