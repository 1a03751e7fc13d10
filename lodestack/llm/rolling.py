"""Hashes of stretches of bytes in numpy: rolling ones modulo 2**64, and mixed ones of words and lines."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i up to n."""
    out = []
    for b in (BASE, INVERSE):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@functools.lru_cache(1)
def _values() -> np.ndarray:
    return np.random.default_rng(77).integers(1, 1 << 64, 256, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a hash over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n+1 prefix sums whose differences, scaled back, are the hashes of stretches."""
    up, _ = _powers(1 << max(16, int(len(data)).bit_length()))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values()[data] * up[: len(data)], out=out[1:])
    return out


def stretches(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal stretches have equal hashes."""
    _, down = _powers(1 << max(16, (len(sums) - 1).bit_length()))
    return mixed((sums[end] - sums[start]) * down[start])


#: Longest stretch that is hashed by its 8-byte parts in step with others.
STEPWISE = 128


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], for words and lines.

    Each 8 bytes are mixed into the hash, whose first value is the length, so
    unlike rolling hashes these have no known equal pairs of unequal stretches.
    """
    size = end - start
    h = mixed(size.astype(np.uint64) + np.uint64(BASE))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    who = np.flatnonzero((size > 0) & (size <= STEPWISE))
    at = start[who]
    left = size[who]
    while len(who):
        part = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)))
        h[who] = mixed(h[who] * np.uint64(3) + mixed(part + np.uint64(BASE)))
        more = left > 8
        who, at, left = who[more], at[more] + 8, left[more] - 8
    view = memoryview(np.ascontiguousarray(data))
    for k in np.flatnonzero(size > STEPWISE).tolist():
        h[k] = xxhash.xxh3_64_intdigest(view[int(start[k]) : int(end[k])], BASE & 0xFFFFFFFF)
    return h
