"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The order of the leftmost smaller suffixes is found by sorting their substrings
and recursing on their ranks, until few ranks repeat; the other suffixes follow from it in two scans.
A scan takes a whole run of buckets at a time, as long as what it finds falls
into later buckets.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last symbol of ``t``
    must be its only 0."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = 1
    # equal symbols take after the next pair that differs
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _place(sa: np.ndarray, free: np.ndarray, bucket: np.ndarray, suffix: np.ndarray, step: int) -> None:
    """Puts suffixes, in order, at the free ends of their buckets."""
    order = bucket.argsort(kind="stable")
    bucket = bucket[order]
    new = np.empty(len(bucket), bool)
    new[0] = True
    np.not_equal(bucket[1:], bucket[:-1], out=new[1:])
    first = new.nonzero()[0]
    counts = np.empty(len(first), np.int64)
    np.subtract(first[1:], first[:-1], out=counts[:-1])
    counts[-1] = len(bucket) - first[-1]
    bucket = bucket[first]
    at = free[bucket]
    free[bucket] = at + step * counts
    place = (at - step * first).repeat(counts)
    place += _STEPS[step][:len(place)] if len(place) <= len(_STEPS[step]) else step * np.arange(len(place))
    sa[place] = suffix[order]


_STEPS = {step: step * np.arange(1 << 12) for step in (1, -1)}


def _scan(sa, t, smaller, starts, ends, free, up: bool) -> None:
    """One induction: for every suffix in bucket order, its left neighbour of the
    wanted type goes to the free end of the neighbour's bucket."""
    sigma = len(starts)
    step = 1 if up else -1

    def left(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        items = items[items > 0] - 1
        items = items[smaller[items] != up]
        return t[items], items

    c = 0 if up else sigma - 1
    span = 1
    while 0 <= c < sigma:
        if up:
            last = min(sigma, c + span) - 1
            bucket, items = left(sa[starts[c]:ends[last]])
            near = int(bucket.min()) if len(bucket) else last + 1
        else:
            last = max(0, c - span + 1)
            bucket, items = left(sa[starts[last]:ends[c]][::-1])
            near = int(bucket.max()) if len(bucket) else last - 1
        if near != c:
            # nothing falls into the buckets before ``near``: these are complete
            if (near <= last) if up else (near >= last):
                bucket, items = left(sa[starts[c]:starts[near]] if up else sa[ends[near]:ends[c]][::-1])
                span = max(1, abs(near - c))
                c = near
            else:
                c = last + step
                span *= 2
            if len(bucket):
                _place(sa, free, bucket, items, step)
            continue
        # the bucket adds to itself: take what it has, then what that added
        done = starts[c] if up else ends[c] - 1
        while (done < free[c]) if up else (done > free[c]):
            now = int(free[c])
            part = sa[done:now] if up else sa[now + 1:done + 1][::-1]
            done = now
            bucket, items = left(part)
            if len(bucket):
                _place(sa, free, bucket, items, step)
        bucket, items = left(sa[free[c]:ends[c]] if up else sa[starts[c]:free[c] + 1][::-1])
        if len(bucket):
            _place(sa, free, bucket, items, step)
        c += step
        span = 1


def _induce(t, smaller, sigma, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in the order that follows from the leftmost smaller ones in
    ``seeds``, which are in order."""
    counts = np.bincount(t, minlength=sigma)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(len(t), -1, np.int32)
    _place(sa, ends - 1, t[seeds[::-1]], seeds[::-1], -1)
    _scan(sa, t, smaller, starts, ends, starts.copy(), True)
    sa[smaller[np.maximum(sa, 0)] & (sa >= 0)] = -1
    sa[0] = len(t) - 1
    free = ends - 1
    free[0] = -1
    _scan(sa, t, smaller, starts, ends, free, False)
    return sa


def _doubled(ranks: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a short string whose symbols hardly repeat,
    where recursion would end: ranks of pairs, each time twice as far apart."""
    n = len(ranks)
    rank, reach = ranks.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[:n - reach] += rank[reach:] + 1
        order = key.argsort(kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[0] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        reach *= 2


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """The suffixes of ``t`` (symbols below ``sigma``, its only 0 at the end) in
    lexical order."""
    n = len(t)
    if n < 3:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    smaller = _types(t)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = _induce(t, smaller, sigma, leftmost)
    number = np.full(n, -1, np.int32)
    number[leftmost] = np.arange(len(leftmost))
    in_order = number[sa]
    in_order = in_order[in_order >= 0]
    # rank the substrings between leftmost smaller positions: equal ones share a rank
    lengths = np.diff(np.append(leftmost, n))
    a, b = in_order[:-1], in_order[1:]
    differ = lengths[a] != lengths[b]
    same = np.flatnonzero(~differ)
    offset = 0
    while len(same):
        x, y = leftmost[a[same]] + offset, leftmost[b[same]] + offset
        unlike = (t[x] != t[y]) | (smaller[x] != smaller[y])
        differ[same[unlike]] = True
        same = same[~unlike & (offset < lengths[a[same]])]
        offset += 1
    ranks = np.empty(len(leftmost), np.int32)
    ranks[in_order] = np.append(0, np.cumsum(differ))
    top = int(ranks[in_order[-1]]) + 1
    if top < len(leftmost):
        in_order = suffix_array(ranks, top) if top < len(leftmost) // 4 else _doubled(ranks)
    return _induce(t, smaller, sigma, leftmost[in_order])


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, shared) by text position: the suffix before it in order (-1 for
    the first) and the length of their common prefix, up to ``most``.

    In text order a common prefix is at most one shorter than that of the position
    to the left. So the prefixes of every 64th position are measured first; the
    others start from what these leave, and go on by eight symbols at a time."""
    n = len(t)
    before = np.empty(n, np.int32)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    padded = np.append(t, np.zeros(most + 16, t.dtype)).astype(np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + most + 8, 8), (1, 1))
    eight = np.ascontiguousarray(eight).view(np.uint64).ravel()
    shared = np.zeros(n, np.int32)
    known = np.empty(0, np.int64)
    for stride in (64, 8, 1):
        todo = np.arange(0, n, stride)
        if len(known):
            left = (todo // (stride * 8)) * (stride * 8)
            start = np.maximum(0, shared[left] - (todo - left))
            fresh = todo != left
            todo, start = todo[fresh], start[fresh]
        else:
            start = np.zeros(len(todo), np.int32)
        some = before[todo] >= 0
        todo, length = todo[some], start[some].astype(np.int64)
        active = np.arange(len(todo))
        while len(active):
            x, y = todo[active] + length[active], before[todo[active]] + length[active]
            unlike = eight[x] ^ eight[y]
            whole = unlike == 0
            # equal low bytes of the first unlike word
            low = unlike & (~unlike + np.uint64(1))
            length[active] += np.where(whole, 8, np.searchsorted(_LOW, low, side="right") - 1)
            active = active[whole & (length[active] < most)]
        shared[todo] = np.minimum(length, most)
        known = todo
    return before, shared


#: The least value of the lowest set bit of a word whose first k bytes are 0.
_LOW = np.array([1 << (8 * k) for k in range(8)], np.uint64)
