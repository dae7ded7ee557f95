"""Suffix arrays by induced sorting, and permuted common prefixes, on byte arrays (numpy).

Suffixes are classified as larger or smaller than their successor; the leftmost smaller ones (LMS) are sorted by the substring up to the
next one, named, and where names repeat the string of names is sorted recursively; then all suffixes are induced
from the sorted LMS ones in two passes over the 256 buckets. A bucket is handled in waves: all entries that it holds at once, then
those that they add to the same bucket.
"""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of t (uint8) in ascending order; a text that ends sorts before one that goes on."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    smaller = _types(t)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    if not len(lms):
        return _induce(t, smaller, lms)
    order = _induce(t, smaller, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = order[is_lms[order]]
    size = np.full(n, 0, np.int32)
    size[lms[:-1]] = lms[1:] - lms[:-1] + 1
    a, b = by_substring[:-1], by_substring[1:]
    same = (size[a] == size[b]) & (size[a] > 0)
    at = np.flatnonzero(same)
    same[at] = common_prefixes(t, a[at], b[at], int(size[lms].max())) >= size[a[at]]
    name = np.zeros(n, np.int32)
    name[by_substring] = np.concatenate([[0], np.cumsum(~same)])
    names = name[lms]
    if not same.any():
        return _induce(t, smaller, by_substring)
    return _induce(t, smaller, lms[np.array(_sort_names(names.tolist(), int(names.max()) + 1), np.int64)])


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; the last one is larger than the empty suffix."""
    n = len(t)
    up = np.zeros(n, bool)
    up[:-1] = t[:-1] < t[1:]
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    place = np.flatnonzero(differs)
    run = np.zeros(n, np.int64)
    run[1:] = np.cumsum(differs[:-1])
    return up[place[run]]


def _spread(queues: list[list], chars: np.ndarray, items: np.ndarray) -> None:
    """Append the items to the queues of their characters, in their order."""
    if not len(items):
        return
    order = np.argsort(chars, kind="stable")
    chars, items = chars[order], items[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for c, part in zip(chars[np.concatenate([[0], cuts])].tolist(), np.split(items, cuts), strict=True):
        queues[c].append(part)


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, sorted as far as the order of the LMS suffixes given sorts them."""
    n = len(t)
    empty = np.zeros(0, np.int32)
    join = lambda parts: parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else empty
    seeds: list[list] = [[] for _ in range(256)]
    _spread(seeds, t[lms], lms)
    larger: list[list] = [[] for _ in range(256)]
    if not smaller[n - 1]:
        larger[t[n - 1]].append(np.array([n - 1], np.int32))
    done_larger = [empty] * 256
    for c in range(256):
        waves, now = [], join(larger[c])
        while len(now):
            waves.append(now)
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            chars = t[before]
            here = chars == c
            _spread(larger, chars[~here], before[~here])
            now = before[here]
        done_larger[c] = join(waves)
        start = join(seeds[c])
        start = start[start > 0] - 1
        start = start[~smaller[start]]
        _spread(larger, t[start], start)
    least: list[list] = [[] for _ in range(256)]  # descending
    done = [empty] * 256
    for c in range(255, -1, -1):
        waves, now = [], join(least[c])
        while len(now):
            waves.append(now)
            before = now[now > 0] - 1
            before = before[smaller[before]]
            chars = t[before]
            here = chars == c
            _spread(least, chars[~here], before[~here])
            now = before[here]
        done[c] = join(waves)[::-1]
        down = done_larger[c][::-1]
        down = down[down > 0] - 1
        down = down[smaller[down]]
        _spread(least, t[down], down)
    return np.concatenate([x for c in range(256) for x in (done_larger[c], done[c])])


def _sort_names(s: list[int], k: int) -> list[int]:
    """The suffix array of a string of numbers under k, by the same method, entry by entry (buckets are many and small here)."""
    n = len(s)
    if n == 1:
        return [0]
    small = bytearray(n)
    for i in range(n - 2, -1, -1):
        a, b = s[i], s[i + 1]
        if a < b or (a == b and small[i + 1]):
            small[i] = 1
    count = [0] * (k + 1)
    for x in s:
        count[x + 1] += 1
    for c in range(k):
        count[c + 1] += count[c]
    heads, tails = count[:k], count[1:]

    def induce(lms: list[int]) -> list[int]:
        sa = [-1] * n
        at = tails[:]
        for i in reversed(lms):
            c = s[i]
            at[c] -= 1
            sa[at[c]] = i
        at = heads[:]
        c = s[n - 1]
        sa[at[c]] = n - 1
        at[c] += 1
        for p in range(n):
            i = sa[p]
            if i > 0 and not small[i - 1]:
                i -= 1
                c = s[i]
                sa[at[c]] = i
                at[c] += 1
        at = tails[:]
        for p in range(n - 1, -1, -1):
            i = sa[p]
            if i > 0 and small[i - 1]:
                i -= 1
                c = s[i]
                at[c] -= 1
                sa[at[c]] = i
        return sa

    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    if not lms:
        return induce(lms)
    end = dict(zip(lms, lms[1:], strict=False))
    name, names, last = -1, {}, None
    for i in induce(lms):
        if i > 0 and small[i] and not small[i - 1]:
            piece = s[i : end[i] + 1] if i in end else None
            if piece is None or piece != last:
                name += 1
            names[i], last = name, piece
    if name + 1 == len(lms):
        return induce(sorted(lms, key=names.__getitem__))
    return induce([lms[x] for x in _sort_names([names[i] for i in lms], name + 1)])


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and at b, right up to `most` (they may be given as more)."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 8, 8), (1, 1))
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    a, b = a.astype(np.int64), b.astype(np.int64)
    at = 0
    while len(live) and at < most:
        x = eight[np.minimum(a[live] + at, n)].view(np.uint64)[:, 0] ^ eight[np.minimum(b[live] + at, n)].view(np.uint64)[:, 0]
        part = x != 0
        low = x[part] & (~x[part] + np.uint64(1))
        out[live[part]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        out[live[~part]] = at + 8
        live = live[~part & (np.maximum(a[live], b[live]) + at + 8 < n)]
        at += 8
    return np.minimum(out, n - np.maximum(a, b))


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By position, the length that its suffix shares with the one before it in sa.

    Where the characters before both suffixes agree the length is one less than that of the position before; only the others are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    given = np.zeros(n, bool)
    both = (np.arange(n) > 0) & (before > 0)
    at = np.flatnonzero(both)
    given[at] = (t[at - 1] == t[before[at] - 1]) & (before[at - 1] == before[at] - 1)
    at = np.flatnonzero(~given & (before >= 0))
    value = np.zeros(n, np.int64)
    value[at] = common_prefixes(t, at, before[at], n)
    start = np.maximum.accumulate(np.where(given, 0, np.arange(n)))
    return value[start] - (np.arange(n) - start)
