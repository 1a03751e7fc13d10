"""SimHash near-duplicates, joined through tables of distances to pivots."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.batches import released, text_pieces
from lodestack.llm.components import connected_components, with_roots
from lodestack.llm.workspace import materialise, settled, unused

BITS = 64
#: Reference fingerprints; each linked pair differs by at most the radius in its distance to every one.
PIVOTS = 24
#: Fingerprints that one bucket may hold before it is dealt out anew by further bits.
BUCKET_LIMIT = 20_000


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):
        block = h[at : at + (1 << 15)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, width: int = 4) -> int:
    """The majority bits of the XXH64 (seed 42) of all word shingles of ``text``.

    A-Z count as lower case; words are runs without ASCII white space; a text of
    fewer than ``width`` words is one shingle; one without words gives 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    cut = (line[a : b - 1] for a, b in zip(starts, ends[width - 1 :]))
    n = len(words) - width + 1
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, cut, itertools.repeat(42)), np.uint64, n))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, tag, fp): the fingerprint of every whole text as a signed long, and a hash of the text; null texts count as empty."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch, "body"):
                fps = np.array([fingerprint(x or b"", width) for x in piece.column(2).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(fps.view(np.int64))], ["doc_id", "tag", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.encode(text_col, "UTF-8").alias("body"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, tag long, fp long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Fixed pseudo-random reference fingerprints."""
    return np.random.default_rng(20240).integers(0, 1 << 64, count, dtype=np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot, as uint8."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of every choice of ``blocks - radius`` blocks of the 64 bits.

    ``radius`` differing bits touch at most that many blocks, so a linked pair
    agrees on all bits of at least one mask.
    """
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(one, blocks - radius)]


def blocks_for(count: int, radius: int, per_bucket: int = 64) -> int:
    """The fewest blocks that leave at most ``per_bucket`` unrelated fingerprints in a bucket."""
    b = radius + 2
    while b < 2 * radius + 4 and count > per_bucket * 2 ** (BITS * (b - radius) / b):
        b += 1
    return b


def link(fps: np.ndarray, radius: int, refs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links of one bucket of distinct fingerprints.

    Fingerprints are ordered by their distance to the first pivot. From each
    one reached, only those within ``radius`` on every coordinate of the table
    are verified; those that are linked leave the unreached set, so a dense
    group costs few passes and gives one edge a member.
    """
    table = distance_table(fps, refs)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    left = np.arange(len(fps))
    out = []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            u = frontier.pop()
            row = table[u]
            lo, hi = np.searchsorted(table[left, 0], (row[0] - radius, row[0] + radius + 1))
            near = np.arange(lo, hi)
            for k in range(1, table.shape[1]):
                if len(near) < 16:
                    break
                near = near[np.abs(table[left[near], k] - row[k]) <= radius]
            near = near[np.bitwise_count(fps[left[near]] ^ fps[u]) <= radius]
            if len(near):
                got = left[near]
                out.append((np.full(len(got), fps[u]), fps[got]))
                frontier += got.tolist()
                left = np.delete(left, near)
    return out


def link_small(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links inside many small buckets at once, by the same table and check."""
    table = distance_table(fps, refs)
    first = np.repeat(np.arange(len(fps)), np.repeat(sizes, sizes) - 1 - (np.arange(len(fps)) - np.repeat(starts, sizes)))
    if not len(first):
        return fps[:0], fps[:0]
    begin = np.r_[True, first[1:] != first[:-1]]
    run = np.arange(len(first)) - np.maximum.accumulate(np.where(begin, np.arange(len(first)), 0))
    second = first + 1 + run
    for k in range(table.shape[1]):
        keep = np.abs(table[first, k] - table[second, k]) <= radius
        first, second = first[keep], second[keep]
        if len(first) < 1024:
            break
    keep = np.bitwise_count(fps[first] ^ fps[second]) <= radius
    return fps[first[keep]], fps[second[keep]]


def _link_partition(radius: int, small: int = 48):
    """mapInArrow function over rows (band, part, fp) sorted by (band, part)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()

        def emit(pairs):
            a, b = (np.concatenate(x) if len(x) else np.zeros(0, np.uint64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.uint64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])

        def solve(band, part, fp):
            cut = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (part[1:] != part[:-1])])
            sizes = np.diff(np.r_[cut, len(fp)])
            pairs = []
            few = (sizes > 1) & (sizes <= small)
            if few.any():
                rows = np.repeat(few, sizes)
                s = sizes[few]
                pairs.append(link_small(fp[rows], np.cumsum(s) - s, s, radius, refs))
            for at, n in zip(cut[sizes > small], sizes[sizes > small]):
                pairs += link(fp[at : at + n], radius, refs)
            return pairs

        kept = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new[2] = new[2].view(np.uint64)
            kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
            change = np.flatnonzero((kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1]))
            if len(change):  # the last bucket may go on in the next batch
                to = change[-1] + 1
                yield emit(solve(*(x[:to] for x in kept)))
                kept = [x[to:] for x in kept]
        if kept is not None and len(kept[0]):
            yield emit(solve(*kept))

    return run


def near_links(fps: DataFrame, count: int, radius: int = 4, limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (src, dst) whose components are those of all pairs within ``radius`` bits.

    ``fps`` holds ``count`` distinct fingerprints (column fp). A pair meets in a
    bucket of equal bits under a mask (pigeonhole, no pair is lost). A bucket of
    more than ``limit`` is dealt out by its free bits in the same way until none
    is that large, so no task gets an unbounded bucket and no all-pairs list is made.
    """
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    masks = block_masks(blocks_for(count, radius), radius)
    keys = [F.struct(F.lit(i).cast("long").alias("band"), F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for i, m in enumerate(masks)]
    rows = fps.select("fp", F.inline(F.array(*keys)))
    hot = materialise(rows.groupBy("band", "mask", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
    parts, key = [], ["band", "mask", "part"]
    while hot.take(1):
        parts.append(rows.join(hot, key, "left_anti"))
        rows = materialise(_refined(rows.join(hot, key, "left_semi"), radius))
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        hot = materialise(sizes.where((F.col("n") > limit) & (F.bit_count("mask") < BITS - radius)))
    parts.append(rows)
    out = None
    for p in parts:
        dealt = p.select(F.xxhash64("band", "mask").alias("band"), "part", "fp").repartition("band", "part").sortWithinPartitions("band", "part")
        edges = dealt.mapInArrow(_link_partition(radius), "src long, dst long")
        out = edges if out is None else out.union(edges)
    return out


def _refined(rows: DataFrame, radius: int) -> DataFrame:
    """Rows of crowded buckets, dealt out by radius + 1 slices of the bits outside their mask.

    Slice k takes every free bit whose rank among the free bits is k modulo radius + 1.
    """

    def slice_of(k: int):
        free = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("mask", i) == 0)
        return F.filter(free, lambda _, rank: rank % (radius + 1) == k)

    out = None
    for k in range(radius + 1):
        more = F.aggregate(slice_of(k), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))))
        part = rows.withColumn("mask", F.col("mask").bitwiseOR(more))
        part = part.select("fp", F.xxhash64(F.col("band"), F.lit(k)).alias("band"), "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
        out = part if out is None else out.union(part)
    return out


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, tag, fp, root, component_id) for every row of ``docs``; ``tag`` is a hash of the text, ``root`` a fingerprint that names the component.

    component_id is the smallest doc_id that links of at most ``radius`` bits
    reach, the row's own included. Null texts and texts without words have the
    fingerprint zero and link like any other; a null doc_id is never the
    smallest; repeated rows are returned as often as they come; an empty table
    gives an empty result. Other columns of ``docs`` are not looked at.
    """
    rows = materialise(with_fingerprints(docs, id_col, text_col, width))

    def named() -> DataFrame:
        nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
        roots = connected_components(near_links(nodes.select("fp"), nodes.count(), radius))
        return with_roots(nodes.withColumnRenamed("fp", "node"), roots).withColumnRenamed("node", "fp")

    comp = settled(docs.sparkSession, named)
    # two written tables: a join of theirs can split the rows of a fingerprint that very many texts have
    return rows.join(comp, "fp").select("doc_id", "tag", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", components=near_components) -> DataFrame:
    """One row of ``docs`` for each of its ``components``: the one whose id is the least.

    Of rows that share that id the one with the least text hash stays, and
    equal rows become one. Of a component without any id one row stays. An
    empty table gives no rows; other columns stay as they are.
    """
    of, tag = unused(docs, "of"), unused(docs, "tag")
    rows = settled(docs.sparkSession, lambda: components(docs, id_col, text_col))
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("tag").alias(tag), F.first("component_id").alias(of))
    kept = docs.join(first.select(of, tag), F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text_col) == F.col(tag)), "left_semi")
    repeated = rows.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    return kept if repeated.isEmpty() else kept.dropDuplicates([id_col, text_col])


def op10_simhash_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
