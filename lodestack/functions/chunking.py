"""Content-defined chunking of binary columns by a gear hash with two masks and forced cuts."""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions import blake3

CHUNKS = "array<struct<offset:bigint,size:bigint,content_hash:string>>"


@dataclass(frozen=True)
class ChunkingConfig:
    """Sizes in bytes of the least, usual and largest chunk."""

    min_size: int = 256 << 10
    avg_size: int = 1 << 20
    max_size: int = 4 << 20
    algo: str = "fastcdc"


def mask_bits(avg_size: float) -> int:
    """Bits of the loose mask: the power of two at or below the usual size, 8 to 24."""
    return min(24, max(8, round(avg_size).bit_length() - 1))


class Cutter:
    """Cuts of one byte string.

    The low bits of a gear hash depend on as many last bytes only, so the hash
    of every place is one sum of shifted tables. Near a chunk's start the hash
    has seen fewer bytes; there sums of fewer terms apply.
    """

    def __init__(self, data: bytes, config: ChunkingConfig, forced: Iterable[int] = ()):
        self.data, self.config, self.forced = data, config, sorted(set(forced))
        self.bits = mask_bits(config.avg_size)
        raw = np.frombuffer(data, np.uint8)
        gear = np.array(blake3.gear_table(), np.uint64)[raw]
        total = np.zeros(len(raw), np.uint64)
        self.early: list[np.ndarray] = []
        self.tight = np.uint64((1 << (self.bits + 1)) - 1)
        loose = np.uint64((1 << self.bits) - 1)
        for k in range(min(self.bits + 1, len(raw))):
            total[k:] += gear[: len(raw) - k] << np.uint64(k)
            if k == self.bits - 1:
                self.loose_hits = np.flatnonzero((total & loose) == 0)
        if len(raw) < self.bits:
            self.loose_hits = np.flatnonzero((total & loose) == 0)
        self.tight_hits = np.flatnonzero((total & self.tight) == 0)
        self.gear = gear

    def cut(self, start: int) -> int:
        """The size of the chunk that begins at ``start``."""
        c = self.config
        n = min(c.max_size, len(self.data) - start)
        if n <= c.min_size:
            return n
        mid = min(n, (c.min_size + c.max_size) // 2)
        at = bisect.bisect_left(self.forced, start + c.min_size)
        if at < len(self.forced) and self.forced[at] <= start + n:  # wins over an earlier hit
            return self.forced[at] - start
        first, warm = start + c.min_size, start + c.min_size + self.bits
        h = 0
        for i in range(first, min(warm, start + n)):  # the hash has not seen enough bytes yet
            h = ((h << 1) + int(self.gear[i])) & 0xFFFFFFFFFFFFFFFF
            mask = int(self.tight) if i < start + mid else int(self.tight) >> 1
            if not h & mask:
                return i + 1 - start
        for hits, lo, hi in ((self.tight_hits, warm, start + mid), (self.loose_hits, max(warm, start + mid), start + n)):
            at = int(np.searchsorted(hits, lo))
            if at < len(hits) and hits[at] < hi:
                return int(hits[at]) + 1 - start
        return n

    def sizes(self) -> list[int]:
        """Sizes of all chunks in order; none for no bytes."""
        out, at = [], 0
        while at < len(self.data):
            out.append(self.cut(at))
            at += out[-1]
        return out


def hex_digests(parts: list[bytes], algo: str) -> list[str]:
    return [hashlib.sha256(p).hexdigest() for p in parts] if algo == "sha2" else [d.hex() for d in blake3.digests(parts)]


def chunk_list(data: bytes, config: ChunkingConfig, forced: Iterable[int] = (), algo: str = "sha2", base: int = 0) -> list[dict]:
    """(offset, size, content_hash) of the chunks; offsets count from ``base``."""
    sizes = Cutter(data, config, forced).sizes()
    starts = [0, *itertools.accumulate(sizes)]
    hashes = hex_digests([data[at : at + size] for at, size in zip(starts, sizes)], algo)
    return [{"offset": base + at, "size": size, "content_hash": h} for at, size, h in zip(starts, sizes, hashes)]


def chunks(body: Column | str, config: ChunkingConfig, forced: Column | None = None, algo: str = "sha2") -> Column:
    """Chunks of a whole file: an empty one is one chunk of no bytes; null gives null."""

    def one(data, cuts):
        if data is None:
            return None
        return chunk_list(data, config, () if cuts is None else cuts, algo) or [{"offset": 0, "size": 0, "content_hash": hex_digests([b""], algo)[0]}]

    @F.pandas_udf(CHUNKS)
    def run(data: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([one(d, c) for d, c in zip(data, cuts)], dtype=object)

    return run(body, F.lit(None).cast("array<bigint>") if forced is None else forced)


def chunks_in_range(body: Column | str, start: Column, length: Column, config: ChunkingConfig, forced: Column | None = None, algo: str = "sha2") -> Column:
    """Chunks of a byte range, with offsets in the file: none where the range is empty or beyond the end."""

    @F.pandas_udf(CHUNKS)
    def run(data: pd.Series, begin: pd.Series, size: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for d, a, n, c in zip(data, begin, size, cuts):
            a = None if d is None or a is None else max(0, int(a))
            inside = [] if c is None or a is None else [int(x) - a for x in c if x > a]
            out.append(None if a is None else [] if n <= 0 or a >= len(d) else chunk_list(d[a : a + int(n)], config, inside, algo, a))
        return pd.Series(out, dtype=object)

    return run(body, start, length, F.lit(None).cast("array<bigint>") if forced is None else forced)
