"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import rolling, suffixes
from lodestack.llm.batches import PIECE_BYTES, raw_text, released, text_pieces
from lodestack.llm.decontaminate import SPACE
from lodestack.llm.workspace import materialise, settled, unused

#: Bytes of a string that counts as repeated.
LENGTH = 400
#: Bytes of an anchor: equal strings of LENGTH bytes have an equal anchor at the same place.
ANCHOR = 128
#: Bytes that one suffix array takes, but for a single anchor's stretches.
SORT_BYTES = 600_000
#: The columns of a table of byte ranges.
RANGES = "key binary, cuts array<struct<lo:bigint,hi:bigint>>"
#: Rows of a batch that are made Python values at a time.
SORT_ROWS = 500
#: An anchor with more different stretches is dealt out by what stands beside it, as often as its number is twice as large.
HOT_PARTS = 1_000
#: Words of a passage that counts as repeated: over 50.
PASSAGE_WORDS = 51
#: Words of an anchor of a passage, as ANCHOR is the bytes of a string's.
ANCHOR_WORDS = 16
#: Bytes of text whose passages are found at a time.
PASSAGE_BYTES = 1 << 18
#: Low bits of an anchor's hash that give way to its place in what is searched at a time.
PLACE_BITS = np.uint64(22)
PASSAGE_PLACE = np.uint64((1 << 28) - 1)
PLACE = (np.uint64(1) << PLACE_BITS) - np.uint64(1)


def owned_starts(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts that share an anchor: (document, start, count, anchor hash, place of the anchor after the start).

    The anchor of a string is its stretch of ``anchor`` bytes with the least
    hash, the leftmost of equals, so equal strings have equal anchors, whatever
    stands around them: hashes are cut to the same bits everywhere. Each start
    of a string inside one document is in exactly one run. At most 2 **
    PLACE_BITS bytes.
    """
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none.astype(np.uint64), none
    sums = rolling.prefix_sums(data)
    at = np.arange(n - anchor + 1)
    grams = rolling.stretches(sums, at, at + anchor)
    low = (grams & ~PLACE) | at.astype(np.uint64)
    wide, span = length - anchor + 1, 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    chosen = (low & PLACE).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    valid = at[: len(chosen)] + length <= offsets[doc + 1]
    start = np.flatnonzero(valid)
    chosen, doc = chosen[start], doc[start]
    first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])]) if len(start) else none
    count = np.diff(np.r_[first, len(start)])
    return doc[first], start[first] - offsets[doc[first]], count, grams[chosen[first]], chosen[first] - start[first]


def windows(data: np.ndarray, offsets: np.ndarray, overlap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, data, offsets) of bounded parts of what ``text_pieces`` gave; parts of one long text overlap."""
    if len(data) <= PIECE_BYTES:
        yield 0, data, offsets
        return
    for at in range(0, len(data) - overlap, PIECE_BYTES):
        part = data[at : at + PIECE_BYTES + overlap]
        yield at, part, np.array([0, len(part)])


def _find_runs(length: int, anchor: int):
    """mapInArrow: (id, key, body) to one row for each run of starts of one anchor."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, at, data, offsets in ((p, *w) for p in text_pieces(batch, "body") for w in windows(*raw_text(p.column(2)), length - 1)):
                doc, start, count, anchors, after = owned_starts(data, offsets, length, anchor)
                view = memoryview(data)
                lo = offsets[doc] + start
                start = start + at
                parts = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(lo.tolist(), (lo + count - 1 + length).tolist())]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.view(np.int64)), pa.array(np.array(parts, np.uint64).view(np.int64)), piece.column(0).take(rows), piece.column(1).take(rows), pa.array(start), pa.array(count), pa.array(after)],
                    ["anchor", "part", "id", "key", "start", "count", "after"],
                )

    return run


def _bucketed(p: dict, text: bytes, length: int, anchor: int) -> Iterator[tuple]:
    """Rows (bucket, anchor, part, shift, copies, count, text) of one stretch.

    The bucket of a usual anchor is the anchor. Under a hot one, each string
    holds half of its other bytes left of the anchor or else right of it; those
    decide on its bucket, so equal strings still meet, and the stretch becomes
    two. Each further level deals out the rest of the bytes in the same way.
    """
    groups = [(0, p["count"], p["after"], p["after"] + anchor, b"")]
    for _ in range(p["levels"]):
        dealt = []
        for a, b, lo, hi, side in groups:  # starts from a to b, whose strings all hold the bytes from lo to hi
            half = (length - (hi - lo)) // 2
            if not half:
                dealt.append((a, b, lo, hi, side))
                continue
            cut = max(a, min(b, lo - half + 1))
            dealt += [g for g in ((a, cut, lo - half, hi, side + b"l"), (cut, b, lo, hi + half, side + b"r")) if g[0] < g[1]]
        groups = dealt
    for a, b, lo, hi, side in groups:
        bucket = int(np.uint64(xxhash.xxh3_64_intdigest(side + text[lo:hi])).view(np.int64)) if p["levels"] else p["anchor"]
        yield bucket, p["anchor"], p["part"], a, p["copies"], b - a, text[a : b - 1 + length]


def _cut_parts(length: int, anchor: int):
    """mapInArrow: (body, parts) to rows with the bytes of each part."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch, "body"):
                out: list[tuple] = []
                for body, parts in zip(piece.column(0), piece.column(1).to_pylist()):
                    text = body.as_buffer().to_pybytes()
                    for p in parts:
                        out += _bucketed(p, text[p["start"] : p["start"] + p["count"] - 1 + length], length, anchor)
                kinds = (*[pa.int64()] * 6, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], ["bucket", "anchor", "part", "shift", "copies", "count", "text"])

    return run


def _sort_parts(length: int, limit: int):
    """mapInArrow over rows sorted by (bucket, part, shift): the starts in each part that repeat, as ranges."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        hits = suffixes.repeated_starts([r[6] for r in rows], [r[5] for r in rows], [r[4] for r in rows], length)
        out: list[tuple] = []
        for (_, anchor, part, shift, *_), hit in zip(rows, hits):
            if hit.any():
                edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0])) + shift
                out += [(anchor, part, a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["anchor", "part", "lo", "hi"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, SORT_ROWS) for r in zip(*(c.to_pylist() for c in batch.slice(at, SORT_ROWS).columns))):
                if rows and row[:4] == rows[-1][:4]:  # a repeated row of the table brought it twice
                    continue
                if held > limit and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[6])
        if rows:
            yield solve(rows)

    return run


def _report(length: int):
    """mapInArrow: (id, body, cuts, passages) to the digest of what is left of each document, and the words of its passages."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SORT_ROWS) for b in batches for at in range(0, b.num_rows, SORT_ROWS)):
            out = []
            for body, cuts, passages in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = memoryview(body.as_buffer())
                spans = merged(cuts)
                kept = hashlib.sha256()
                at = 0
                for a, b in spans:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                words = sum(len(bytes(text[a:b]).split()) for a, b in merged(passages))
                out.append((len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), words))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    return run


def merged(cuts: list[dict] | None) -> list[tuple[int, int]]:
    """Byte ranges in order, with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((c["lo"], c["hi"]) for c in (() if cuts is None else cuts)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (key, cuts) to the same with ranges in order, those that touch or overlap made one."""
    for batch in batches:
        cuts = batch.column(1)
        size = pa.compute.list_value_length(cuts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = cuts.flatten()
        lo, hi = (pa.compute.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
        row = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((lo, row))
        row, lo, hi = row[order], lo[order], hi[order]
        if len(lo):
            span = int(hi.max()) + 2  # keeps each row's ranges beyond those of the row before
            far = np.maximum.accumulate(hi + row * span)
            first = np.flatnonzero(np.r_[True, (lo + row * span)[1:] > far[:-1]])
            lo, hi, row = lo[first], np.maximum.reduceat(hi, first), row[first]
        ends = pa.array(np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32))
        spans = pa.StructArray.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["lo", "hi"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, spans)], ["key", "cuts"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, body): the text as bytes and its digest; equal texts share a key."""
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(body)).alias("key"), body.alias("body"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, sort_bytes: int = SORT_BYTES, hot_parts: int = HOT_PARTS) -> DataFrame:
    """(key, cuts): for each text with any, the byte ranges covered by strings of ``length`` bytes that start at two or more places.

    Every string is assigned to its anchor; strings of anchors that occur once
    cannot repeat. Equal stretches of one anchor are counted before anything is
    shuffled with its bytes; one of each goes to a suffix array with the others
    of its anchor. Anchors with more than ``hot_parts`` different stretches are
    dealt out in more levels the more they have. Texts of one key have the same
    ranges and share a row. The result is a written table.
    """
    rows = keyed(docs, id_col, text_col)
    runs = rows.where(F.octet_length("body") >= length).mapInArrow(
        _find_runs(length, anchor), f"anchor long, part long, id {rows.schema[0].dataType.simpleString()}, key binary, start long, count long, after long"
    )
    spark = docs.sparkSession

    def shared() -> DataFrame:
        written = materialise(runs)
        # written before they are joined: joins of two plain tables can split a hot anchor's rows
        twice = materialise(written.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
        return written.join(twice, "anchor", "left_semi")

    kept = settled(spark, shared)

    def found() -> DataFrame:
        first = materialise(kept.groupBy("anchor", "part").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "id", "start", "count", "after")).alias("at")))
        levels = F.ceil(F.log2(F.col("n") / F.lit(hot_parts))).cast("int").alias("levels")
        hot = materialise(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_parts).select("anchor", levels))
        part = F.struct("anchor", "part", "copies", F.col("at.start").alias("start"), F.col("at.count").alias("count"), F.col("at.after").alias("after"), F.coalesce("levels", F.lit(0)).alias("levels"))
        mine = F.struct("key", "id").alias("of")
        wanted = first.join(hot, "anchor", "left").select(F.struct("at.key", "at.id").alias("of"), part.alias("part")).groupBy("of").agg(F.collect_list("part").alias("parts"))
        stretches = rows.where(F.octet_length("body") >= length).select(mine, "body").join(wanted, "of").select("body", "parts")
        parts = stretches.mapInArrow(_cut_parts(length, anchor), "bucket long, anchor long, part long, shift long, copies long, count long, text binary")
        hits = parts.repartition("bucket").sortWithinPartitions("bucket", "part", "shift").mapInArrow(_sort_parts(length, sort_bytes), "anchor long, part long, lo long, hi long")
        places = kept.select("anchor", "part", "key", "start").distinct().join(hits, ["anchor", "part"])
        cuts = places.select("key", F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") - 1 + length).alias("hi")).alias("cut"))
        return cuts.groupBy("key").agg(F.collect_list("cut").alias("cuts")).mapInArrow(_merge, RANGES)

    # a written table: its join with texts can split one that has very many copies
    return settled(spark, found)


def passages(data: np.ndarray, offsets: np.ndarray, words: int, anchor: int = ANCHOR_WORDS) -> tuple[np.ndarray, ...]:
    """Every stretch of ``words`` words of each text: (document, hash, anchor hash, place of the anchor, first byte, byte after the last).

    Words are runs without ASCII white space; what stands between them does not
    count. The anchor is the leftmost stretch of ``anchor`` words with the least
    hash, so equal passages have equal anchors at the same place in them.
    """
    n = len(data)
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    solid = ~SPACE[data]
    start = np.flatnonzero(solid & np.r_[True, ~solid[:-1] | head[1:-1]]) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(solid & (np.r_[~solid[1:], True] | head[1:])) + 1 if n else start
    doc = np.searchsorted(offsets, start, side="right") - 1
    m = len(start) - words + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none, none
    h = rolling.hashed(data, start, end)

    def joined(width: int) -> np.ndarray:
        key = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            key = rolling.mixed(key * np.uint64(3) + h[k : k + len(key)])
        return key

    low = joined(anchor)
    low = (low & ~PASSAGE_PLACE) | np.arange(len(low), dtype=np.uint64)
    wide, span = words - anchor + 1, 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    inside = np.flatnonzero(doc[:m] == doc[words - 1 :])
    low = low[inside]
    place = low & PASSAGE_PLACE
    return doc[inside], joined(words)[inside], (low & ~PASSAGE_PLACE).view(np.int64), place.astype(np.int64), start[inside], end[inside + words - 1]


def _find_anchors(words: int):
    """mapInArrow: (of, body) to (of, anchors), one anchor for each run of passages."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch, "body", PASSAGE_BYTES):
                data, offsets = raw_text(piece.column(1))
                doc, _, anchors, place, _, _ = passages(data, offsets, words)
                first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else doc
                ends = pa.array(np.searchsorted(doc[first], np.arange(len(offsets))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(ends, pa.array(anchors[first]))], ["of", "anchors"])

    return run


def _find_passages(words: int):
    """mapInArrow: (key, body, copies, anchors) to (key, whole, passages).

    ``passages`` are those of the anchors, with their byte ranges; ``whole`` is
    the range from the first word to the last of a text that has copies, as all its passages repeat.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch, "body", PASSAGE_BYTES):
                data, offsets = raw_text(piece.column(1))
                doc, key, anchors, _, lo, hi = passages(data, offsets, words)
                cut = np.searchsorted(doc, np.arange(len(offsets)))
                keep = [a + np.flatnonzero(np.isin(anchors[a:b], have.values.to_numpy())) if have.is_valid else np.zeros(0, np.int64) for a, b, have in zip(cut[:-1], cut[1:], piece.column(3))]
                ends = pa.array(np.cumsum([0, *map(len, keep)]).astype(np.int32))
                at = np.concatenate(keep).astype(np.int64)
                found = [key[at].view(np.int64), (lo[at] - offsets[doc[at]]).astype(np.int32), (hi[at] - offsets[doc[at]]).astype(np.int32)]
                rows = pa.StructArray.from_arrays([pa.array(c) for c in found], ["passage", "lo", "hi"])
                whole = [{"lo": int(lo[a] - o), "hi": int(hi[b - 1] - o)} if n > 1 and a < b else None for a, b, o, n in zip(cut[:-1], cut[1:], offsets, piece.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(whole, pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.ListArray.from_arrays(ends, rows)], ["key", "whole", "passages"])

    return run


def repeated_passages(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, cuts) as of ``repeated_ranges``: the byte ranges of runs of ``words`` words that start at two or more places.

    Equal texts count once; all passages of a text with copies repeat. Of the
    others only passages whose anchor occurs twice can; those of other anchors
    never leave the pass over their text. Passages are counted by 64-bit
    hashes, and counts combine map-side, so one common passage crowds no task.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col).where(F.octet_length("body") >= 2 * words - 1).select(F.xxhash64("key").alias("of"), "key", "body")

    def wanted() -> DataFrame:
        runs = rows.select("of", "body").mapInArrow(_find_anchors(words), "of long, anchors array<long>")
        runs = materialise(runs.groupBy("of").agg(F.any_value("anchors").alias("anchors"))).select("of", F.explode("anchors").alias("anchor"))
        twice = materialise(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
        return runs.join(twice, "anchor", "left_semi").groupBy("of").agg(F.collect_set("anchor").alias("anchors"))

    def found() -> DataFrame:
        mine = settled(spark, wanted)
        texts = rows.groupBy("of", "key").agg(F.any_value("body").alias("body"), F.count(F.lit(1)).alias("copies"))
        texts = texts.join(mine, "of", "left").where("copies > 1 OR anchors IS NOT NULL").select("key", "body", "copies", "anchors")
        kinds = "key binary, whole struct<lo:bigint,hi:bigint>, passages array<struct<passage:long,lo:int,hi:int>>"
        # numbers stand for the keys while single passages are shuffled, and are written so that they stay
        return texts.mapInArrow(_find_passages(words), kinds).withColumn("nr", F.monotonically_increasing_id())

    def cuts() -> DataFrame:
        held = settled(spark, found)
        single = held.select("nr", F.inline("passages"))
        again = materialise(single.groupBy("passage").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("passage"))
        cut = F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
        mine = held.where("whole IS NULL").select("nr", F.inline("passages")).join(again, "passage", "left_semi").groupBy("nr").agg(F.collect_list(cut).alias("cuts"))
        of_copies = held.where("whole IS NOT NULL").select("key", F.array("whole").alias("cuts"))
        return held.select("nr", "key").join(mine, "nr").select("key", "cuts").mapInArrow(_merge, RANGES).union(of_copies)

    return settled(spark, cuts)


def covered(docs: DataFrame, id_col: str, text_col: str, length: int, words: int | None, **sizes) -> DataFrame:
    """(key, cuts, passages): the ranges of ``repeated_ranges`` and, with ``words``, of ``repeated_passages``; a written table."""
    kind = "array<struct<lo:bigint,hi:bigint>>"
    cuts = repeated_ranges(docs, id_col, text_col, length, **sizes).select("key", "cuts", F.lit(None).cast(kind).alias("passages"))
    if not words:
        return cuts
    passages = repeated_passages(docs, words, id_col, text_col).select("key", F.lit(None).cast(kind).alias("cuts"), F.col("cuts").alias("passages"))
    both = lambda: cuts.union(passages).groupBy("key").agg(F.any_value("cuts", True).alias("cuts"), F.any_value("passages", True).alias("passages"))
    return settled(docs.sparkSession, both)


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int | None = None, **sizes) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words) for every row of ``docs``.

    With ``words``, n_passage_words counts the words in runs of so many words
    that start at two or more places, whatever their bytes; without, it is 0.
    Null texts are empty; texts of fewer than ``length`` bytes lose nothing;
    both copies of a repeated row lose what they share; a null id is kept; an
    empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    cuts = covered(docs, id_col, text_col, length, words, **sizes)
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()
    joined = rows.join(cuts, "key", "left").select("id", "body", "cuts", "passages")
    return joined.mapInArrow(_report(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int | None = None, **sizes) -> DataFrame:
    """The rows of ``docs`` with repeated strings cut out of the text.

    With ``words``, repeated runs of so many words are cut out as well, however
    few bytes they have. Cuts that would split a character are widened to whole characters. A null
    text stays null; all other columns stay as they are.
    """
    cuts = covered(docs, id_col, text_col, length, words, **sizes)
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    cuts = cuts.select("key", F.concat(F.coalesce("cuts", none), F.coalesce("passages", none)).alias("cuts"))

    @F.pandas_udf("string")
    def left_over(body, spans):
        def one(text, ranges):
            out, at = [], 0
            for a, b in merged(ranges):
                while 0 < a < len(text) and text[a] & 0xC0 == 0x80:
                    a -= 1
                while b < len(text) and text[b] & 0xC0 == 0x80:
                    b += 1
                out.append(text[at:a])
                at = max(at, b)
            return b"".join([*out, text[at:]]).decode()

        return pd.Series([None if t is None or r is None else one(t, r) for t, r in zip(body, spans)], dtype=object)

    key, spans = unused(docs, "key"), unused(docs, "cuts")
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    named = cuts.select(F.col("key").alias(key), F.col("cuts").alias(spans))
    joined = docs.withColumn(key, F.unhex(F.md5(body))).join(named, key, "left")
    text = F.when(F.col(spans).isNotNull(), left_over(F.encode(text_col, "UTF-8"), F.col(spans))).otherwise(F.col(text_col))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op4_suffix_array_dedup(spark, sf_dir):
    return removal_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=PASSAGE_WORDS)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h, coalesce(strlen(text), 0) AS n FROM documents),
c AS (SELECT doc_id, n, h, unnest(range(0, n - 399, 200)) AS b FROM d WHERE n >= 400),
c2 AS MATERIALIZED (SELECT doc_id, b, least(200, n - 399 - b) AS m, substr(h, CAST(2 * b + 1 AS BIGINT), 1198) AS hb FROM c),
w AS (SELECT doc_id, b, hb, unnest(range(0, m)) AS j FROM c2),
k AS (SELECT doc_id, b + j AS i, md5(substr(hb, CAST(2 * j + 1 AS BIGINT), 800)) AS m FROM w),
r AS (SELECT m FROM k GROUP BY m HAVING count(*) > 1),
s AS (SELECT doc_id, i FROM k SEMI JOIN r USING (m)),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM s),
x AS (SELECT doc_id, i, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
p AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM x GROUP BY doc_id, island),
q AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prev FROM p),
t AS (SELECT q.doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, max(hi) AS last,
             string_agg(substr(h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (lo - prev) AS BIGINT)), '' ORDER BY lo) AS front
      FROM q JOIN d USING (doc_id) GROUP BY 1),
pw AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
pg AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 50], ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 49)) AS i FROM pw WHERE len(w) > 50)),
pr AS (SELECT m FROM pg GROUP BY m HAVING count(*) > 1),
ps AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM pg SEMI JOIN pr USING (m)),
pn AS (SELECT doc_id, CAST(sum(least(51, coalesce(next - i, 51))) AS BIGINT) AS n_passage_words FROM ps GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256,
       coalesce(n_passage_words, 0) AS n_passage_words
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN pn ON pn.doc_id = d.doc_id
"""
