"""BLAKE3-256 of many byte strings at once, after the published specification, and the table derived from it."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

# Initial words and message order of the specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
START, END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
#: Bytes whose chunks are mixed side by side.
SIDE_BYTES = 4 << 20


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray | int, size: np.ndarray | int, flags: np.ndarray | int) -> np.ndarray:
    """New chaining values (8, n) of n blocks: ``chain`` is (8, n), ``words`` (16, n)."""
    a, b = chain[:4].copy(), chain[4:].copy()
    c = np.repeat(np.array(IV[:4], np.uint32)[:, None], words.shape[1], axis=1)
    d = np.empty_like(c)
    d[0], d[1], d[2], d[3] = counter & 0xFFFFFFFF, counter >> 32, size, flags
    for _ in range(7):
        for half in (0, 8):
            for k, (far, near) in enumerate(((16, 12), (8, 7))):
                a += b
                a += words[half + k : half + 8 : 2]
                d = _turned(d ^ a, far)
                c += d
                b = _turned(b ^ c, near)
            # the second half of a round works on diagonals; the rows go round by one, two and three places and back
            there = half == 0
            b, c, d = np.roll(b, -1 if there else 1, axis=0), np.roll(c, 2, axis=0), np.roll(d, 1 if there else -1, axis=0)
        words = words[list(ORDER)]
    return np.concatenate((a ^ c, b ^ d))


def _side_by_side(items: Sequence[bytes]) -> Iterator[list[tuple[memoryview, int, bool]]]:
    """Slices of whole chunks (bytes, number of the first chunk, whether it is all of an item), in lists of about SIDE_BYTES."""
    out, held = [], 0
    for item in items:
        view = memoryview(item)
        for at in range(0, max(1, len(view)), SIDE_BYTES):
            part = view[at : at + SIDE_BYTES]
            out.append((part, at // CHUNK, len(view) <= CHUNK))
            held += max(CHUNK, len(part))
            if held >= SIDE_BYTES:
                yield out
                out, held = [], 0
    if out:
        yield out


def _leaves(parts: list[tuple[memoryview, int, bool]]) -> np.ndarray:
    """Chaining values (8, n) of all chunks of the parts, in order."""
    counts = np.array([max(1, -(-len(p) // CHUNK)) for p, _, _ in parts])
    ends = np.cumsum(counts)
    data = np.zeros((ends[-1], CHUNK), np.uint8)
    sizes = np.full(ends[-1], CHUNK, np.int64)
    flat = data.reshape(-1)
    for (p, _, _), end, n in zip(parts, ends, counts):
        at = int(end - n) * CHUNK
        flat[at : at + len(p)] = np.frombuffer(p, np.uint8)
        sizes[end - 1] = len(p) - (n - 1) * CHUNK
    within = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
    counter = within + np.repeat(np.array([c for _, c, _ in parts]), counts)
    root = np.repeat(np.array([ROOT * whole for _, _, whole in parts]), counts)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    words = data.view("<u4")
    chain = np.repeat(np.array(IV, np.uint32)[:, None], ends[-1], axis=1)
    for k in range(int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        last = blocks[on] == k + 1
        flags = START * (k == 0) | np.where(last, END | root[on], 0)
        mixed = np.ascontiguousarray(words[on, 16 * k : 16 * k + 16].T).astype(np.uint32, copy=False)
        chain[:, on] = _compress(chain[:, on], mixed, counter[on], np.minimum(BLOCK, sizes[on] - k * BLOCK), flags)
    return chain


def digests(items: Iterable[bytes]) -> list[bytes]:
    """The 32-byte BLAKE3 hash of each item.

    Chunks of all items are mixed side by side, at most about SIDE_BYTES at a
    time, so beside the items only 32 bytes a chunk are held. Parents join
    neighbours level by level; an odd last node goes up as it is.
    """
    items = list(items)
    if not items:
        return []
    nodes = np.concatenate([_leaves(p) for p in _side_by_side(items)], axis=1)
    counts = np.array([max(1, -(-len(x) // CHUNK)) for x in items])
    while counts.max() > 1:
        starts, above = np.cumsum(counts) - counts, (counts + 1) // 2
        of = np.repeat(np.arange(len(items)), above)
        pair = 2 * (np.arange(len(of)) - np.repeat(np.cumsum(above) - above, above))
        left = starts[of] + pair
        two = np.flatnonzero(pair + 1 < counts[of])
        up = nodes[:, left]
        flags = PARENT | ROOT * (counts[of[two]] == 2)
        start = np.repeat(np.array(IV, np.uint32)[:, None], len(two), axis=1)
        up[:, two] = _compress(start, np.concatenate((nodes[:, left[two]], nodes[:, left[two] + 1])), 0, BLOCK, flags)
        nodes, counts = up, above
    whole = np.ascontiguousarray(nodes.T).astype("<u4").tobytes()
    return [whole[i : i + 32] for i in range(0, len(whole), 32)]


def digest(data: bytes) -> bytes:
    """The 32-byte BLAKE3 hash of ``data``."""
    return digests([data])[0]


@functools.lru_cache(1)
def gear_table() -> tuple[int, ...]:
    """For each byte, the first eight bytes of its BLAKE3 hash as a big-endian number."""
    return tuple(int.from_bytes(d[:8], "big") for d in digests(bytes([b]) for b in range(256)))
