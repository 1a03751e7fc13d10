"""Near copies by the exact Jaccard similarity of their word shingles; SimHash fingerprints nominate, MinHash bands add what lies further apart, sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import rolling, simhash
from lodestack.llm.batches import raw_text, released, text_pieces
from lodestack.llm.components import connected_components, with_roots
from lodestack.llm.decontaminate import hashed_shingles
from lodestack.llm.workspace import materialise, settled

WIDTH = 5
#: Differing bits up to which fingerprints nominate a pair. Near copies of similarity 0.8 differ in some 10 bits, with 6 to
#: either side; a wider radius multiplies the choices of equal blocks, so bands nominate those pairs.
RADIUS = 6
#: A pair of similarity 0.8 agrees on no band with probability (1 - 0.8**4)**24 = 3e-6, one of more similarity less often.
BANDS, BAND_ROWS = 24, 4
#: Texts, and shingles, that a slice of nominated texts holds on average; larger groups are compared slice by slice.
SLICE_TEXTS, SLICE_SHINGLES = 1_000, 1_000_000
#: Bytes of text whose shingles are hashed at a time.
PIECE_BYTES = 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the shingles of each text.

    A-Z count as lower case; words are runs without ASCII white space; a text of
    fewer than ``width`` words is one shingle; one without words has none.
    """
    key, doc = hashed_shingles(data, offsets, width)
    cut = np.searchsorted(doc, np.arange(len(offsets)))
    out = []
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        if a < b:
            out.append(np.unique(key[a:b]))
        else:
            words = data[offsets[k] : offsets[k + 1]].tobytes().lower().split()
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64))
    return out


def _factors() -> np.ndarray:
    return np.random.default_rng(8051).integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def band_keys(own: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A hash for each band of the MinHash signature of a set."""
    x = (own >> np.uint64(32)).astype(np.uint32) ^ own.astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        least = np.minimum(least, (x[at : at + 1024, None] * factors).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = rolling.mixed(key * np.uint64(3) + rows[:, k] + np.uint64(1))
    return key


@released
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, tag, body) to (doc_id, tag, node, n, fp, bands); node is a hash of the text's set, fp its SimHash."""
    factors = _factors()
    for batch in batches:
        for piece in text_pieces(batch, "body", PIECE_BYTES):
            sets = shingle_sets(*raw_text(piece.column(2)))
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            bands = np.array([band_keys(s, factors) for s in sets], np.uint64).reshape(-1).view(np.int64)
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            fps = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
            columns = [piece.column(0), piece.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.ListArray.from_arrays(ends, pa.array(bands))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "node", "n", "fp", "bands"])


@released
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (node, tasks, body) to (node, tasks, own), the bytes of the set."""
    for batch in batches:
        for piece in text_pieces(batch, "body", PIECE_BYTES):
            sets = shingle_sets(*raw_text(piece.column(2)))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "tasks", "own"])


def link(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets`` with a Jaccard similarity of 4/5 or more, exactly.

    Shared members are counted through lists of the sets that hold each member;
    a set that was reached is not reached again, so a dense group costs few passes.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(of, kind="stable")
    holder = owner[order]
    first = np.searchsorted(of[order], np.arange(of.max() + 2 if len(of) else 1))
    ends = np.cumsum(sizes)
    free = np.ones(len(sets), bool)
    out = []
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed] = False
        frontier = [seed]
        while frontier and free.any():
            u = frontier.pop()
            own = of[ends[u] - sizes[u] : ends[u]]
            lo, n = first[own], first[own + 1] - first[own]
            at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            shared = np.bincount(holder[at], minlength=len(sets))
            near = np.flatnonzero(free & (shared > 0) & (9 * shared >= 4 * (sizes + sizes[u])))
            free[near] = False
            out += [(u, int(v)) for v in near]
            frontier += near.tolist()
    return out


@released
def _link_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows (root, i, j, node, own) sorted by all but the last: links inside each (root, i, j)."""

    def solve(nodes, sets):
        pairs = link(sets)
        return pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in pairs], pa.int64()) for k in (0, 1)], ["src", "dst"])

    task, nodes, sets = None, [], []
    for batch in batches:
        for *at, node, own in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
            if at != task:
                if len(nodes) > 1:
                    yield solve(nodes, sets)
                task, nodes, sets = at, [], []
            if not nodes or nodes[-1] != node:
                nodes.append(node)
                sets.append(np.frombuffer(own.as_buffer().to_pybytes(), np.uint64))
    if len(nodes) > 1:
        yield solve(nodes, sets)


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (src, dst) of ``nodes`` (node, fp) whose components hold all pairs within ``radius`` bits, by ``simhash.near_links``.

    Its pairs meet in buckets of equal bits, distances to pivots discard them,
    survivors are verified. Nodes of one fingerprint hang on the least of them.
    """
    fps = materialise(nodes.groupBy("fp").agg(F.min("node").alias("low")))
    links = simhash.near_links(fps.select("fp"), fps.count(), radius)
    for end in ("src", "dst"):
        links = links.join(fps.select(F.col("fp").alias(end), F.col("low").alias(f"{end}_low")), end)
    same = nodes.join(fps, "fp").where("node <> low").select(F.col("node").alias("src"), F.col("low").alias("dst"))
    return same.union(links.select(F.col("src_low").alias("src"), F.col("dst_low").alias("dst")))


def similar_links(docs: DataFrame, nodes: DataFrame, slice_texts: int = SLICE_TEXTS, slice_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """Edges (src, dst) of nodes whose components are those of all nominated pairs that are similar.

    Nodes of near fingerprints are joined, and nodes that agree on a band are
    joined to the least of them; the components of those edges hold every
    nominated pair. A component beyond the size of a slice is cut into slices,
    and each two slices meet in a task of their own, so none is unbounded and
    no pair is left out.
    """
    keys = nodes.select("node", F.explode("bands").alias("key"))
    low = materialise(keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low"))
    banded = keys.join(low, "key").select(F.col("node").alias("src"), F.col("low").alias("dst"))
    roots = connected_components(fingerprint_links(nodes.select("node", "fp")).union(banded))
    members = materialise(nodes.join(roots, "node").select("node", "n", "at", "root"))
    slices = F.ceil(F.greatest(F.count(F.lit(1)) / slice_texts, F.sum("n") / slice_shingles)).cast("int")
    members = members.join(members.groupBy("root").agg(slices.alias("slices")), "root")
    mine = F.pmod(F.xxhash64("node"), "slices").cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: F.struct(F.col("root"), F.least(mine, k).alias("i"), F.greatest(mine, k).alias("j")))
    # members grow with the corpus, so the plan is the same at every size
    found = docs.join(members.select("at", "node", tasks.alias("tasks")).hint("merge"), "at").select("node", "tasks", "body")
    sets = found.mapInArrow(_sets, "node long, tasks array<struct<root:long,i:int,j:int>>, own binary")
    dealt = sets.select(F.inline("tasks"), "node", "own").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    return dealt.mapInArrow(_link_tasks, "src long, dst long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """(doc_id, tag, root, component_id) for every row of ``docs``, as of ``simhash.near_components``.

    Texts are linked if the sets of their five-word shingles have a Jaccard
    similarity of 0.8 or more; SimHash fingerprints of the sets and MinHash
    bands nominate the pairs. Null texts and texts without words are alike; a
    null doc_id is never the smallest; repeated rows are returned as often as
    they come; an empty table gives an empty result.
    """
    tagged = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.encode(text_col, "UTF-8").alias("body"))
    kind = tagged.schema[0].dataType.simpleString()
    rows = materialise(tagged.mapInArrow(_sketches, f"doc_id {kind}, tag long, node long, n long, fp long, bands array<long>"))
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tag")).alias("at"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    spark = docs.sparkSession

    def named() -> DataFrame:
        links = similar_links(tagged.select(F.struct("doc_id", "tag").alias("at"), "body"), nodes, **sizes)
        return with_roots(nodes.select("node", "least"), connected_components(links))

    comp = settled(spark, named)
    # two written tables: a join of theirs can split the rows of a text that has very many copies
    return rows.select("doc_id", "tag", "node").join(comp, "node").select("doc_id", "tag", "root", "component_id")
