"""SentencePiece encoding and decoding by suffix-array matching of all pieces at once."""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.batches import ragged, raw_text, released, text_pieces
from lodestack.llm.suffixes import rank_pairs

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Bytes of text that are encoded at a time; a longer text is encoded in parts of it.
PIECE_BYTES = 1 << 20
#: Bytes of units and pieces that each of two generations of a worker's memory holds.
REMEMBERED_BYTES = 40 << 20
#: Bytes that an entry of that memory takes beside its unit and pieces.
ENTRY_BYTES = 160
#: Longest unit that is remembered.
REMEMBERED_UNIT = 48
#: Symbols that one suffix array takes, but for a single unit.
SORT_SYMBOLS = 1 << 19
#: Rows that are decoded at a time.
DECODED_ROWS = 500
UNKNOWN, NONE = -2, -1


class PieceBpe:
    """Encodes as a SentencePiece BPE model file with byte fallback does.

    Tokens are numbered by merge order: single characters first. ``split``
    holds the two tokens whose merge makes a token; ``pairs`` every pair that
    some merge joins. An encoding is valid if each two neighbours are what the
    merges leave of their joined text, and a text has one valid encoding.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, sp.unk_id(), np.int64)
        self.out = [b""] * n
        plain = []
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(text[i][1:-1], 16)] = i
                self.out[i] = bytes([int(text[i][1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.out[i] = text[i].replace(MARK, " ").encode()
                plain.append(i)
        self.out[sp.unk_id()] = " ⁇ ".encode()
        runs = [i for i in plain if len(text[i]) > 1 and set(text[i]) == {MARK}]
        self.runs = {len(text[i]): (sp.get_score(i), i) for i in runs}
        normal = [i for i in plain if i not in set(runs)]
        singles = [i for i in normal if len(text[i]) == 1]
        merged = sorted((i for i in normal if len(text[i]) > 1), key=lambda i: -sp.get_score(i))
        self.ids = np.array(singles + merged, np.int64)
        self.number = {text[i]: k for k, i in enumerate(self.ids)}
        self.text = [text[i] for i in self.ids]
        made: list[tuple[int, int, int]] = []
        for c, t in enumerate(self.text):
            for k in range(1, len(t)):
                a, b = self.number.get(t[:k]), self.number.get(t[k:])
                if a is not None and b is not None:
                    made.append((a, b, c))
        self.base = len(self.ids) + 1
        keys = np.array([a * self.base + b for a, b, _ in made], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], np.array([c for _, _, c in made], np.int64)[order]
        self.split = np.repeat(np.arange(len(self.ids))[:, None], 2, axis=1)
        reachable = np.ones(len(self.ids), bool)
        reachable[len(singles) :] = False
        self._learn_splits(made, len(singles), reachable)
        usable = np.flatnonzero(reachable)
        self.usable = usable[np.argsort([len(self.text[k]) for k in usable], kind="stable")]
        self.length = np.array([len(self.text[k]) for k in self.usable], np.int64)
        self.longest = int(self.length.max(initial=1))
        self.letters = np.zeros((len(self.usable), self.longest), np.int64)
        for row, k in enumerate(self.usable):
            self.letters[row, : len(self.text[k])] = [ord(ch) + 1 for ch in self.text[k]]
        self.split = self.split.astype(np.int32)
        self.usable, self.length, self.letters = (x.astype(np.int32) for x in (self.usable, self.length, self.letters))
        self.out_bytes = np.frombuffer(b"".join(self.out), np.uint8)
        self.out_size = np.array([len(x) for x in self.out], np.int32)
        self.out_start = (np.cumsum(self.out_size) - self.out_size).astype(np.int32)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _learn_splits(self, made: list[tuple[int, int, int]], singles: int, reachable: np.ndarray) -> None:
        """The split of every token, shortest first, as a split's parts are shorter than it."""
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for m in made:
            by_length.setdefault(len(self.text[m[2]]), []).append(m)
        for _, rows in sorted(by_length.items()):
            a, b, c = (np.array(x, np.int64) for x in zip(*rows))
            ok = reachable[a] & reachable[b]
            a, b, c = a[ok], b[ok], c[ok]
            ok = self.compatible(a, b, c)
            self.split[c[ok], 0], self.split[c[ok], 1] = a[ok], b[ok]
            reachable[c[ok]] = True

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or a number beyond all."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], np.int64(1 << 40))

    def compatible(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges leave each pair of tokens apart until ``limit`` is made of them.

        The later made of the two is undone step by step; the pair holds unless
        what then stands at the border would have been joined before.
        """
        a, b = left.copy(), right.copy()
        limit = np.full(len(a), 1 << 39, np.int64) if limit is None else limit.copy()
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, m = a[live], b[live], limit[live]
            early = self.joined(x, y) < m
            out[live[early]] = False
            live, x, y, m = live[~early], x[~early], y[~early], m[~early]
            undo = x > y  # the left one was made later
            nx, ny = np.where(undo, self.split[x, 1], x), np.where(undo, y, self.split[y, 0])
            nm = np.where(undo, x, y + 1)
            # a single character cannot be undone: then the other one is
            stuck = undo & (nx == x)
            ny, nm, nx = np.where(stuck, self.split[y, 0], ny), np.where(stuck, y + 1, nm), np.where(stuck, x, nx)
            done = stuck & (ny == y)
            flat = ~undo & (ny == y)
            nx, nm = np.where(flat, self.split[x, 1], nx), np.where(flat, x, nm)
            done |= flat & (nx == x)
            a[live], b[live], limit[live] = nx, ny, nm
            live = live[~done]
        return out

    def edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, token) of every occurrence of every piece in the symbols.

        The suffixes of the whole batch are ordered by as many symbols as the
        longest piece has; each piece narrows its range of them by one binary
        search a symbol.
        """
        n = len(points)
        present = np.zeros(int(points.max(initial=0)) + 1, np.int64)
        present[points] = 1
        name, span = (np.cumsum(present) - 1)[points], 1
        while span < self.longest:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - span)] = name[span:]
            name = rank_pairs(name, ahead)
            span *= 2
        order = np.argsort(name, kind="stable").astype(np.int32)
        del name
        padded = np.r_[points, np.zeros(self.longest, np.int32)]
        lo, hi = np.zeros(len(self.usable), np.int32), np.full(len(self.usable), n, np.int32)
        for k in range(self.longest):
            todo = np.flatnonzero((self.length > k) & (lo < hi))
            if not len(todo):
                break
            want = self.letters[todo, k]
            new = []
            for side in (0, 1):
                a, b = lo[todo], hi[todo]
                while True:
                    open_ = a < b
                    if not open_.any():
                        break
                    mid = (a + b) >> 1
                    seen = padded[order[np.minimum(mid, n - 1)] + k]
                    right = (seen < want) if side == 0 else (seen <= want)
                    a = np.where(open_ & right, mid + 1, a)
                    b = np.where(open_ & ~right, mid, b)
                new.append(a)
            lo[todo], hi[todo] = new
        count = hi - lo
        return order[ragged(lo, count)], np.repeat(self.length, count), np.repeat(self.usable, count)

    def encode_units(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit, as the bytes of an int32 array; long lists are taken in parts."""
        out: list[bytes] = []
        at = 0
        while at < len(units):
            to, held = at, 0
            while to < len(units) and (to == at or held + len(units[to]) < SORT_SYMBOLS):
                held += len(units[to]) + 1
                to += 1
            out += self._encode_part([u.decode().replace(" ", MARK) for u in units[at:to]])
            at = to
        return out

    def _encode_part(self, units: list[str]) -> list[bytes]:
        """Matches all pieces in the units, sorts the edges by their end, and relaxes them.

        A place is reached by the one edge that is compatible with the token that
        reaches the edge's start. Leading marks beyond one are runs of their own.
        """
        extra = {u: len(t) - len(t.lstrip(MARK)) - 1 for u, t in enumerate(units) if t[1:2] == MARK and t[0] == MARK}
        bare = [t[extra[u] :] if u in extra else t for u, t in enumerate(units)] if extra else units
        size = np.array([len(u) for u in bare], np.int32)
        begin = (np.cumsum(size + 1) - size - 1).astype(np.int32)
        points = np.frombuffer("\0".join([*bare, ""]).encode("utf-32-le"), np.uint32).astype(np.int32) + 1
        points[begin + size] = 0
        start, length, token = self.edges(points)
        reach = np.full(len(points) + 1, NONE, np.int32)
        back = np.zeros(len(points) + 1, np.int32)
        single = points == 0
        single[start[length == 1]] = True
        lost = np.flatnonzero(~single).astype(np.int32)
        if len(lost):
            start, length, token = np.r_[start, lost], np.r_[length, np.ones(len(lost), np.int32)], np.r_[token, np.full(len(lost), UNKNOWN, np.int32)]
        unit = np.repeat(np.arange(len(units), dtype=np.int32), size + 1)
        first = begin[unit]
        step = start + length - first[start]
        # small numbers sort by radix
        order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")
        start, length, token, step = start[order], length[order], token[order], step[order]
        bounds = np.flatnonzero(np.r_[True, step[1:] != step[:-1], True]) if len(step) else np.zeros(1, np.int64)
        head = start == first[start]
        del order, step, single
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            s, t = start[a:b], token[a:b]
            before = reach[s]
            ok = head[a:b] | (before == UNKNOWN) | (t == UNKNOWN)
            ask = np.flatnonzero(~ok & (before >= 0))
            if len(ask):
                pair, back_to = np.unique(before[ask] * np.int64(self.base) + t[ask], return_inverse=True)
                ok[ask] = self.compatible(pair // self.base, pair % self.base)[back_to]
            s = s[ok]
            e = s + length[a:b][ok]
            reach[e], back[e] = t[ok], s
        ends = np.zeros(len(points) + 1, bool)
        live = np.flatnonzero(size > 0)
        at = begin[live] + size[live]
        while len(at):
            ends[at] = True
            at = back[at]
            at = at[at > first[at]]
        spot = np.flatnonzero(ends)
        t = reach[spot]
        # the end of a unit is the place of its separator, which belongs to the unit
        to = np.cumsum(np.bincount(unit[spot], minlength=len(units)))
        raw = np.where(t >= 0, self.ids[t], UNKNOWN).astype(np.int32).tobytes()
        ends_at = (4 * to).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends_at], ends_at)]
        for u in np.unique(unit[spot[t == UNKNOWN]]).tolist():
            a, b = int(to[u - 1]) if u else 0, int(to[u])
            ids = [self.byte_ids[list(chr(int(points[p]) - 1).encode())] if i == UNKNOWN else [i] for i, p in zip(np.frombuffer(out[u], np.int32), back[spot[a:b]].tolist())]
            out[u] = np.concatenate(ids).astype(np.int32).tobytes()
        lone = int(self.ids[self.number[MARK]]) if MARK in self.number else NONE
        for u, k in extra.items():
            got = np.frombuffer(out[u], np.int32).tolist()
            run = k + 1 if got and got[0] == lone and bare[u][:1] == MARK else k
            out[u] = np.array([*self.mark_run(run), *(got[1:] if run > k else got)], np.int32).tobytes()
        return out

    @functools.lru_cache(4096)
    def mark_run(self, n: int) -> tuple[int, ...]:
        """Pieces of n marks in a row: the best pair first, and the leftmost of equals."""
        size, nxt, prev, alive = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def push(i):
            j = nxt[i] if 0 <= i < n else n
            if i >= 0 and j < n and (size[i] + size[j]) in self.runs:
                heapq.heappush(heap, (-self.runs[size[i] + size[j]][0], i, size[i], size[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if not alive[i] or j >= n or (size[i], size[j]) != (x, y):
                continue
            size[i], alive[j], nxt[i] = x + y, False, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            push(prev[i])
            push(i)
        lone = int(self.ids[self.number[MARK]])
        return tuple(self.runs[size[i]][1] if size[i] > 1 else lone for i in range(n) if alive[i])

    def _remembered(self, units: list[bytes]) -> list[bytes]:
        """The pieces of distinct units; those that came in the last two generations are not encoded again."""
        young, old = self.young, self.old
        got = [young.get(u) or old.get(u) for u in units]
        new = [k for k, x in enumerate(got) if x is None]
        for k, x in zip(new, self.encode_units([units[k] for k in new])):
            got[k] = x
        for u, x in zip(units, got):
            if len(u) <= REMEMBERED_UNIT and u not in young:
                young[u] = x
                self.held += len(u) + len(x) + ENTRY_BYTES
        if self.held > REMEMBERED_BYTES:
            self.old, self.young, self.held = young, {}, 0
        return got

    def _encode_bytes(self, data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts that begin at ``heads``, each with a mark before it, and how many each has."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(heads), np.int64)
        space = data == 0x20
        wide = np.zeros(n, bool)
        if n > 2:
            wide[:-2] = (data[:-2] == MARK_BYTES[0]) & (data[1:-1] == MARK_BYTES[1]) & (data[2:] == MARK_BYTES[2])
        after = np.r_[False, space[:-1]]
        after[3:] |= wide[:-3]
        first = (space | wide) & ~after
        first[heads] = True
        cut = np.flatnonzero(first)
        units = pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(np.r_[cut, n].astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        pieces = self._remembered(units.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(pieces), np.int32)
        size = np.array([len(x) >> 2 for x in pieces], np.int32)
        which = units.indices.to_numpy()
        count = size[which]
        ids = flat[ragged((np.cumsum(size) - size).astype(np.int32)[which], count)]
        return ids, np.add.reduceat(count.astype(np.int64), np.searchsorted(cut, heads))

    def encode_raw(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all whole texts end to end, given their UTF-8 bytes, and the offset of each text's.

        Empty texts have none. A text beyond PIECE_BYTES is encoded in parts
        that end before a space that follows another character, where units end.
        """
        size = np.diff(offsets)
        full = np.flatnonzero(size > 0)
        own = np.full(len(data) + len(full), 0x20, np.uint8)
        heads = offsets[full] + np.arange(len(full))
        inside = np.ones(len(own), bool)
        inside[heads] = False
        own[inside] = data
        del inside
        count = np.zeros(len(size), np.int64)
        if len(own) <= 2 * PIECE_BYTES or len(full) != 1:
            ids, count[full] = self._encode_bytes(own, heads)
        else:
            found = np.flatnonzero((own[1:] == 0x20) & (own[:-1] != 0x20) & (own[:-1] != MARK_BYTES[2])) + 1
            at, parts = 0, []
            while at < len(own):
                k = np.searchsorted(found, at + PIECE_BYTES)
                to = int(found[k]) if k < len(found) else len(own)
                parts.append(self._encode_bytes(own[at:to], np.zeros(1, np.int64))[0])
                at = to
            ids = np.concatenate(parts)
            count[full] = len(ids)
        return ids, np.r_[0, np.cumsum(count)]

    def decode_raw(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of the text of each row of ids, without the mark that encoding puts before it."""
        size = self.out_size[ids]
        ends = np.r_[0, np.cumsum(size, dtype=np.int64)][offsets].tolist()
        raw = self.out_bytes[ragged(self.out_start[ids], size)].tobytes()
        return [raw[a + (raw[a : a + 1] == b" " and b > a) : b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; nulls and empty texts have none."""
        ids, ends = self.encode_raw(*raw_text(pa.array(texts, pa.string())))
        return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids."""
        return valid_text(self.decode_raw(np.array(ids, np.int32), np.array([0, len(ids)]))[0])


def valid_text(raw: bytes) -> str:
    """The bytes as text, each broken sequence replaced."""
    return raw.decode("utf-8", "replace")


@functools.lru_cache(2)
def _loaded(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with piece_ids, the pieces of every whole text.

    ``model`` is the path of the model file on every executor. Null and empty
    texts have no pieces; characters outside the vocabulary are their bytes'
    pieces. A column piece_ids that ``docs`` has is replaced; all others stay.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(model)
        for batch in batches:
            for piece in text_pieces(batch, text_col, PIECE_BYTES):
                ids, ends = bpe.encode_raw(*raw_text(piece.column(piece.schema.get_field_index(text_col))))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids))], [*piece.schema.names, "piece_ids"])

    rows = docs.drop("piece_ids")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, piece_ids array<int>")


def decode(rows: DataFrame, model: str, ids_col: str = "piece_ids") -> DataFrame:
    """``rows`` with decoded, the text of the pieces; null for null."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(model)
        for batch in batches:
            for row in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(row, DECODED_ROWS)
                ids = part.column(part.schema.get_field_index(ids_col))
                size = np.nan_to_num(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64)
                texts = bpe.decode_raw(ids.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(size)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([valid_text(t) if known else None for t, known in zip(texts, ids.is_valid().to_pylist())], pa.string())], [*part.schema.names, "decoded"])

    kept = rows.drop("decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{kinds}, decoded string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, piece_ids, decoded_sha256, same) for every row of ``docs``.

    The pieces are decoded again; ``same`` tells whether that gives the text (a
    null one counts as empty), which fails only for texts that hold the mark
    character. Repeated rows are encoded each; an empty table gives no rows.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(model)
        for batch in batches:
            for piece in text_pieces(batch, "text", PIECE_BYTES):
                data, offsets = raw_text(piece.column(1))
                ids, ends = bpe.encode_raw(data, offsets)
                texts = [data[a:b].tobytes() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                back = [x if x == t else valid_text(x).encode() for x, t in zip(bpe.decode_raw(ids, ends), texts)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.diff(ends)), pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids)), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()), pa.array([b == t for b, t in zip(back, texts)], pa.bool_())],
                    ["doc_id", "n_pieces", "piece_ids", "decoded_sha256", "same"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_pieces long, piece_ids array<int>, decoded_sha256 string, same boolean")


def op2_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
