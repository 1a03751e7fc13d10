"""Two-stage suffix sorting of byte strings in numpy, and what repeats in them."""

from __future__ import annotations

import numpy as np

SYMBOLS = 257
#: Types of a key: seven symbols of nine bits, each a byte (plus one) and its type.
KEY = 7


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The parts as one array of symbols, each followed by the least symbol 0, and where each starts."""
    size = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + len(parts), np.uint16)
    inside = np.ones(len(text), bool)
    inside[starts + size] = False
    text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    return text, starts


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one is."""
    n = len(text)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1]).astype(np.int8)
    rise[-1] = 1
    at = np.where(rise != 0, np.arange(n), n - 1)
    return rise[np.minimum.accumulate(at[::-1])[::-1]] > 0


def rank_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (a, b); both are ranks below their number."""
    m = len(a)
    bits = max(1, (m - 1).bit_length())
    if bits <= 20:  # pair and place fit one integer, and sorting values is faster than sorting places
        full = np.sort((a << (2 * bits)) | (b << bits) | np.arange(m))
        order, pair = full & ((1 << bits) - 1), full >> bits
    else:
        pair = a * np.int64(m) + b
        order = np.argsort(pair)
        pair = pair[order]
    out = np.empty(m, np.int64)
    new = np.zeros(m, np.int64)
    new[1:] = pair[1:] != pair[:-1]
    out[order] = np.cumsum(new)
    return out


def sort_smaller(text: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that are smaller than their successors, in order of their first ``depth`` symbols.

    A key holds seven symbols with their types, so equal keys have such suffixes
    at the same places; each round pairs the rank of a suffix with the rank of
    the last such suffix inside what is already compared. In a falling run of
    seven or more, every sixth suffix takes part. Ties stand in text order.
    """
    n = len(text)
    at = np.arange(n, dtype=np.int64)
    since = at - np.maximum.accumulate(np.where(small, at, -1))
    taken = small | ((since % (KEY - 1) == 0) & (since > 0))
    chosen = np.flatnonzero(taken)
    m = len(chosen)
    before = np.zeros(n + 1, np.int64)
    np.cumsum(taken, out=before[1:])
    typed = np.zeros(n + KEY, np.int64)
    typed[:n] = text.astype(np.int64) * 2 + small
    key = np.zeros(m, np.int64)
    for k in range(KEY):
        key = (key << 9) | typed[chosen + k]
    # the last one within the key; at the end of the text the jump stays there
    jump = before[np.minimum(chosen + KEY, n)] - 1
    order = np.argsort(key)
    name = np.empty(m, np.int64)
    name[order] = np.cumsum(np.r_[0, key[order[1:]] != key[order[:-1]]])
    while True:
        tied = np.bincount(name)[name] > 1
        if not tied.any() or int((chosen[jump] - chosen)[tied].min()) >= depth:
            break
        name = rank_pairs(name, name[jump])
        jump = jump[jump]
    ranked = chosen[np.argsort(name, kind="stable")]
    return ranked[small[ranked]]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of at least their first ``depth`` symbols; ties stand in text order.

    Stage one sorts the suffixes smaller than their successors. Stage two scans
    the buckets of first symbols from the least: each suffix found puts its
    predecessor, if that is larger than it, at the next free place of its bucket.
    """
    small = smaller_than_next(text)
    seeds = sort_smaller(text, small, depth)
    heads = text[seeds]
    bounds = np.searchsorted(heads, np.arange(SYMBOLS + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    out = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Sends the larger predecessors to their buckets; returns those of this one."""
        prev = found[found > 0] - 1
        prev = prev[~small[prev]]
        if not len(prev):
            return prev
        first = text[prev]
        order = np.argsort(first, kind="stable")
        first, prev = first[order], prev[order]
        cut = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        own = prev[:0]
        for a, b in zip(cut, np.r_[cut[1:], len(prev)]):
            if first[a] == c:
                own = prev[a:b]
            else:
                waiting[first[a]].append(prev[a:b])
        return own

    for c in range(SYMBOLS):
        wave = np.concatenate(waiting[c]) if waiting[c] else seeds[:0]
        waiting[c] = []
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        mine = seeds[bounds[c] : bounds[c + 1]]
        if len(mine):
            out.append(mine)
            induce(mine, c)
    return np.concatenate(out) if out else seeds


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """True for each pair of suffixes whose first ``depth`` symbols are equal.

    Pairs at one distance overlap, so each stretch of such a diagonal is
    compared once, and a pair holds if no unequal place lies in its range.
    """
    n = len(text)
    ok = (a + depth <= n) & (b + depth <= n)
    for k in (0, depth - 1, depth // 2, depth // 4, 3 * depth // 4):
        at = np.flatnonzero(ok)
        ok[at] = text[a[at] + k] == text[b[at] + k]
    at = np.flatnonzero(ok)
    if not len(at):
        return ok
    x, d = a[at], b[at] - a[at]
    order = np.lexsort((x, d))
    x, d, at = x[order], d[order], at[order]
    fresh = np.r_[True, (d[1:] != d[:-1]) | (x[1:] - x[:-1] > depth)]
    head = np.flatnonzero(fresh)
    tail = np.r_[head[1:], len(x)] - 1
    size = x[tail] + depth - x[head]
    base = np.cumsum(size) - size
    good = np.empty(len(x), bool)
    step = max(1, int(np.searchsorted(np.cumsum(size), 1 << 22)))
    for lo in range(0, len(head), step):
        hi = min(len(head), lo + step)
        s = size[lo:hi]
        place = np.arange(int(s.sum())) + np.repeat(x[head[lo:hi]] - (base[lo:hi] - base[lo]), s)
        other = place + np.repeat(d[head[lo:hi]], s)
        bad = np.zeros(len(place) + 1, np.int32)
        np.cumsum((text[place] != text[other]) | (text[place] == 0), out=bad[1:])
        rows = slice(head[lo], tail[hi - 1] + 1)
        stretch = np.cumsum(fresh[rows]) - 1
        local = x[rows] - x[head[lo:hi]][stretch] + (base[lo:hi] - base[lo])[stretch]
        good[rows] = bad[local + depth] == bad[local]
    ok[at] = good
    return ok


def repeated_starts(parts: list[bytes], runs: list[int], copies: list[int], depth: int) -> list[np.ndarray]:
    """For each part, which of its first ``runs[i]`` places start a repeated string of ``depth`` bytes.

    A string repeats if it starts at two such places, or once in a part that
    stands for two or more copies.
    """
    text, starts = joined(parts)
    run = np.array(runs, np.int64)
    wanted = np.zeros(len(text), bool)
    place = np.arange(int(run.sum())) + np.repeat(starts - (np.cumsum(run) - run), run)
    wanted[place] = True
    weight = np.repeat(np.array(copies, np.int64), run)
    at = np.zeros(len(text), np.int64)
    at[place] = weight
    found = suffix_array(text, depth)
    found = found[wanted[found]]
    same = np.zeros(len(found), bool)
    same[1:] = common_prefixes(text, found[:-1], found[1:], depth)
    group = np.cumsum(~same) - 1
    total = np.bincount(group, weights=at[found]) if len(found) else np.zeros(0)
    hit = np.zeros(len(text), bool)
    hit[found] = total[group] >= 2
    return np.split(hit[place], np.cumsum(run)[:-1])
