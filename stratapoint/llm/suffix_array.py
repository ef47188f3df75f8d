"""Suffix arrays by induced sorting, for many strings at a time.

Induced sorting reads a suffix array from left to right and back, and each step needs the one before; in one string it
can't be vectorised. But many strings can take the same step together, so all functions here work on a batch of strings,
as rows of padded arrays, and a step is a few numpy calls however many rows there are.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """True for S suffixes (smaller than the next). The last symbol of a row is its unique smallest."""
    rows, width = t.shape
    if width == 1:
        return np.ones((rows, 1), bool)
    up = np.sign(t[:, 1:].astype(np.int64) - t[:, :-1])
    at = np.where(up != 0, np.arange(width - 1), width - 1)
    at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]  # the next place where neighbours differ
    s = np.zeros((rows, width), bool)
    s[:, :-1] = np.take_along_axis(np.concatenate((up, np.zeros((rows, 1), up.dtype)), 1), at, 1) > 0
    s[np.arange(rows), n - 1] = True
    s[np.arange(width) >= n[:, None]] = False
    return s


def _ends(t: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Where each symbol's bucket ends, by row: shape (rows, k + 1), the first column being 0."""
    rows, width = t.shape
    flat = (t + np.arange(rows)[:, None] * k)[np.arange(width) < n[:, None]]
    counts = np.bincount(flat, minlength=rows * k).reshape(rows, k)
    return np.concatenate((np.zeros((rows, 1), np.int64), np.cumsum(counts, 1)), 1)


def _seed(t: np.ndarray, ends: np.ndarray, order: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A suffix array that holds the suffixes of order (sorted by first symbol, many to a row) at their buckets' ends."""
    rows, width = t.shape
    sa = np.full((rows, width), -1, np.int32)
    if not order.shape[1]:
        return sa
    real = np.arange(order.shape[1]) < many[:, None]
    first = np.where(real, np.take_along_axis(t, np.where(real, order, 0), 1), -1)
    change = np.concatenate((first[:, 1:] != first[:, :-1], np.ones((rows, 1), bool)), 1)
    last = np.where(change, np.arange(order.shape[1]), order.shape[1])
    last = np.minimum.accumulate(last[:, ::-1], axis=1)[:, ::-1]  # the last of the same bucket
    r, e = np.nonzero(real)
    sa[r, ends[r, first[r, e] + 1] - 1 - (last[r, e] - e)] = order[r, e]
    return sa


def _induce(t: np.ndarray, s: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> None:
    """L suffixes from left to right, then S suffixes from right to left."""
    rows, width = t.shape
    k = ends.shape[1] - 1
    flat, types, out = t.ravel(), s.ravel(), sa.ravel()
    base, bucket = np.arange(rows) * width, np.arange(rows) * k
    for kind, heads in ((False, ends[:, :-1].copy().ravel()), (True, ends[:, 1:].copy().ravel())):
        for j in range(width - 1, -1, -1) if kind else range(width):
            p = sa[:, j]
            live = np.flatnonzero(p > 0)
            if not len(live):
                continue
            q = p[live] - 1
            at = base[live] + q
            own = types[at] == kind
            live, q, at = live[own], q[own], at[own]
            b = bucket[live] + flat[at]
            if kind:
                heads[b] -= 1
                out[base[live] + heads[b]] = q
            else:
                out[base[live] + heads[b]] = q
                heads[b] += 1


def _same(t: np.ndarray, r: np.ndarray, p: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n symbols from p and from q on are the same."""
    flat, same = t.ravel(), np.ones(len(r), bool)
    p, q, live, i = r * t.shape[1] + p, r * t.shape[1] + q, np.flatnonzero(n > 0), 0
    while len(live):
        ok = flat[p[live] + i] == flat[q[live] + i]
        same[live[~ok]] = False
        i += 1
        live = live[ok & (n[live] > i)]
    return same


def suffix_arrays(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """t: rows of symbols from 0 on, n of them valid, the last one the row's unique smallest. Row by row, the suffix array."""
    rows, width = t.shape
    t = t.astype(np.int64)
    if width == 1:
        return np.zeros((rows, 1), np.int32)
    k = int(t.max()) + 1
    inside = np.arange(width) < n[:, None]
    t = np.where(inside, t, 0)
    s = _types(t, n)
    lms = np.zeros_like(s)
    lms[:, 1:] = s[:, 1:] & ~s[:, :-1] & inside[:, 1:]
    many = lms.sum(1)
    most = int(many.max())
    ends = _ends(t, n, k)

    # Where the leftmost S suffixes are, in text order, and how long their substrings (to the next one, included) are.
    r, at = np.nonzero(lms)
    first = np.cumsum(many) - many
    place = np.full((rows, most), -1, np.int64)
    place[r, np.arange(len(r)) - first[r]] = at
    real = np.arange(most) < many[:, None]
    size = np.zeros((rows, width), np.int64)
    following = np.concatenate((place[:, 1:], np.full((rows, 1), -1)), 1)
    size[r, at] = np.where(following[real] > 0, following[real] - at + 1, 1)

    symbol = np.where(real, np.take_along_axis(t, np.where(real, place, 0), 1), k)
    order = np.take_along_axis(place, np.argsort(symbol, axis=1, kind="stable"), 1)
    sa = _seed(t, ends, order, many)
    _induce(t, s, ends, sa)

    # Names of the substrings in sorted order; equal ones share a name.
    sr, sj = np.nonzero(np.take_along_axis(lms, np.where(sa >= 0, sa, 0), 1) & (sa >= 0))
    pos = sa[sr, sj].astype(np.int64)
    new = np.r_[True, sr[1:] != sr[:-1]]
    differs = np.ones(len(pos), bool)
    inner = np.flatnonzero(~new)
    a, b, ra = pos[inner], pos[inner - 1], sr[inner]
    same_size = size[ra, a] == size[ra, b]
    differs[inner] = True
    check = inner[same_size]
    differs[check] = ~_same(t, sr[check], pos[check], pos[check - 1], size[sr[check], pos[check]])
    name = np.cumsum(differs & ~new)
    name -= name[np.flatnonzero(new)][np.cumsum(new) - 1]
    names = np.zeros((rows, width), np.int64)
    names[sr, pos] = name
    reduced = np.where(real, np.take_along_axis(names, np.where(real, place, 0), 1), 0)
    top = reduced.max(1) + 1
    rank = np.full((rows, most), -1, np.int64)
    done = (top == many) | (many == 0)
    if done.any():
        rr, ee = np.nonzero(real & done[:, None])
        rank[rr, reduced[rr, ee]] = ee
    if not done.all():
        again = np.flatnonzero(~done)
        widest = int(many[again].max())
        rank[again, :widest] = suffix_arrays(reduced[again, :widest], many[again])
    order = np.where(real, np.take_along_axis(place, np.where(real & (rank >= 0), rank, 0), 1), -1)
    sa = _seed(t, ends, order, many)
    _induce(t, s, ends, sa)
    sa[n == 1, 0] = 0  # the last symbol alone
    return sa


def permuted_prefixes(t: np.ndarray, n: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By text position, the common prefix with the suffix before it in sorted order (0 for the first suffix).

    Only where the symbols before the two suffixes differ is it counted; elsewhere it is one less than at the place before.
    """
    rows, width = t.shape
    inside = np.arange(width) < n[:, None]
    before = np.full((rows, width), -1, np.int64)
    r, j = np.nonzero(inside[:, 1:])
    before[r, sa[r, j + 1]] = sa[r, j]
    r, i = np.nonzero(inside & (before >= 0))
    q = before[r, i]
    count = (i == 0) | (q == 0) | (t[r, i - 1] != t[r, q - 1])
    r, i, q = r[count], i[count], q[count]
    flat, value = t.ravel(), np.zeros(len(r), np.int64)
    pa, pb, room, live = r * width + i, r * width + q, n[r] - np.maximum(i, q), np.arange(len(r))
    while len(live):
        ok = flat[pa[live] + value[live]] == flat[pb[live] + value[live]]
        live = live[ok]
        value[live] += 1
        live = live[value[live] < room[live]]
    counted = np.full((rows, width), -1, np.int64)
    counted[r, i] = i
    out = np.zeros((rows, width), np.int64)
    out[r, i] = value
    start = np.maximum.accumulate(counted, axis=1)
    out = np.where(start >= 0, np.take_along_axis(out, np.maximum(start, 0), 1) - (np.arange(width) - start), 0)
    return np.where(inside & (before >= 0), np.maximum(out, 0), 0)
