"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import rolling
from lodestack.llm.batches import raw_text, released, text_pieces
from lodestack.llm.workspace import unused

SHINGLE = 5
CONTAINMENT = 0.8
#: Bytes of item texts that are searched for in one pass over the documents.
BLOCK_BYTES = 8 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in lower case (A-Z only)."""
    return WORD.findall(text.lower())


def shingles_of(words: list[bytes], width: int) -> set[bytes]:
    """The distinct shingles of ``width`` words, space-joined."""
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def least_shared(n: int, containment: float = CONTAINMENT) -> int:
    """The fewest of n shingles that reach the containment."""
    k = max(1, int(np.floor(n * containment)))
    return k if k >= containment * n - 1e-9 else k + 1


@dataclass
class Partition:
    """Items of one shingle width and one class of sizes, with their MinHash sketches.

    A sketch holds the n - least_shared(n) + 1 smallest of the n hashes of an
    item, so a document that contains enough of the item holds one of them.
    """

    width: int
    least_words: int
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    items: list[list[int]] = field(default_factory=list)


@dataclass
class Index:
    """Partitions of a block of items, and the exact shingles of each item."""

    partitions: list[Partition]
    ids: list
    shingles: list[set[bytes]]
    widths: list[int]


def hashed_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``width`` words of all texts and the text that each is in."""
    n = len(data)
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    solid = ~SPACE[data]
    start = np.flatnonzero(solid & np.r_[True, ~solid[:-1] | head[1:-1]]) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(solid & (np.r_[~solid[1:], True] | head[1:])) + 1 if n else start
    doc = np.searchsorted(offsets, start, side="right") - 1
    m = len(start) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = rolling.hashed(LOWER[data], start, end)
    key = np.zeros(m, np.uint64)
    for k in range(width):
        key = rolling.mixed(key * np.uint64(3) + h[k : k + m])
    inside = doc[:m] == doc[width - 1 :]
    return key[inside], doc[:m][inside]


def build_index(items: list[tuple], width: int = SHINGLE, containment: float = CONTAINMENT) -> Index:
    """Sketches of (id, text) items, partitioned by width and by powers of two of their size.

    An item of fewer than ``width`` words is one shingle, its whole sequence;
    one without words is in no document.
    """
    index = Index([], [], [], [])
    sketches: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    least: dict[tuple[int, int], int] = {}
    for item, text in items:
        words = words_of((text or "").encode())
        if not words:
            continue
        w = min(width, len(words))
        own = shingles_of(words, w)
        raw = np.frombuffer(b" ".join(words), np.uint8)
        hashes = np.unique(hashed_shingles(raw, np.array([0, len(raw)]), w)[0])
        at = len(index.ids)
        index.ids.append(item)
        index.shingles.append(own)
        index.widths.append(w)
        part = (w, len(own).bit_length())
        least[part] = min(least.get(part, 1 << 60), least_shared(len(own), containment) + w - 1)
        for h in hashes[: len(own) - least_shared(len(own), containment) + 1].tolist():
            sketches[part][h].append(at)
    for part, found in sorted(sketches.items()):
        keys = sorted(found)
        index.partitions.append(Partition(part[0], least[part], np.array(keys, np.uint64), [found[k] for k in keys]))
    return index


def search(index: Index, data: np.ndarray, offsets: np.ndarray, containment: float = CONTAINMENT) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) for each pair that reaches the containment, exactly."""
    pairs: set[tuple[int, int]] = set()
    size = np.diff(offsets)
    for width in {p.width for p in index.partitions}:
        key, doc = hashed_shingles(data, offsets, width)
        for part in (p for p in index.partitions if p.width == width):
            # documents with fewer bytes than the words and spaces that are needed cannot hold an item
            may = size[doc] >= 2 * part.least_words - 1
            at = np.minimum(np.searchsorted(part.hashes, key), len(part.hashes) - 1)
            for k in np.flatnonzero((part.hashes[at] == key) & may):
                pairs.update((int(doc[k]), i) for i in part.items[at[k]])
    out, last, sets = [], None, {}
    for d, i in sorted(pairs):
        if d != last:
            last, sets = d, {}
            words = words_of(data[offsets[d] : offsets[d + 1]].tobytes())
        w = index.widths[i]
        if w not in sets:
            sets[w] = shingles_of(words, w)
        shared = len(index.shingles[i] & sets[w])
        if shared >= least_shared(len(index.shingles[i]), containment):
            out.append((d, i, shared))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = SHINGLE, containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for each document that holds enough of an item.

    Containment is the share of an item's distinct shingles that the document
    has. Items are a query set: they are sent to the documents in blocks of at
    most ``block_bytes`` of text, one pass each. Null and wordless texts match
    nothing; repeated rows on either side give repeated pairs; null ids are
    kept; empty tables give no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(text_col, "UTF-8").alias("body"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    item_kind = items.schema[0].dataType
    kinds = f"doc_id {rows.schema[0].dataType.simpleString()}, item_id {item_kind.simpleString()}, n_item long, n_shared long, containment double"
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(item_kind)
    spark = docs.sparkSession

    def passed(block: list[tuple]) -> DataFrame:
        index = spark.sparkContext.broadcast(build_index(block, width, containment))

        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in text_pieces(batch, "body"):
                    found = search(index.value, *raw_text(piece.column(1)), containment)
                    sizes = [len(index.value.shingles[i]) for _, i, _ in found]
                    shared = [n for _, _, n in found]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0).take(pa.array([d for d, _, _ in found], pa.int64())), pa.array([index.value.ids[i] for _, i, _ in found], arrow_kind), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array([a / b for a, b in zip(shared, sizes)], pa.float64())],
                        ["doc_id", "item_id", "n_item", "n_shared", "containment"],
                    )

        return rows.mapInArrow(run, kinds)

    out, block, held = None, [], 0
    for item in items.toLocalIterator():
        if block and held > block_bytes:
            out, block, held = (passed(block) if out is None else out.union(passed(block))), [], 0
        block.append(tuple(item))
        held += len(item[1] or "")
    return passed(block) if out is None else out.union(passed(block)) if block else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``; rows are told apart by id and text, so one that shares an id, or has none, is judged by its own text."""
    mine = unused(docs, "mine")
    rows = docs.withColumn(mine, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag")))
    bad = contaminated(rows, benchmark, mine, text_col, **how).select(F.col("doc_id").alias(mine)).distinct()
    return rows.join(bad, mine, "left_anti").select(*docs.columns)


def op6_benchmark_decontamination(spark, sf_dir):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark),
bs AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS width, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s
  FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
widths AS (SELECT DISTINCT width FROM bs),
ds AS (
  SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, CAST(len(w) - width + 2 AS BIGINT)), lambda i: array_to_string(w[i : i + width - 1], ' '))) AS s
  FROM d, widths WHERE len(w) >= width),
hits AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (width, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM hits JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n_item
"""
