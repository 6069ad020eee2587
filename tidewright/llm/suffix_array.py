"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

The induction runs bucket by bucket: all suffixes that stand in a bucket when it is reached induce their predecessors together, in order, and
those that land in the same bucket form the next generation of it. Names of the leftmost-smaller (LMS) substrings make a string at most half as
long, which is sorted the same way; an alphabet of more than SMALL_ALPHABET names is induced suffix by suffix.
"""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 1024


def _classify(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type). s ends with its unique smallest value."""
    n = len(s)
    sign = np.empty(n, np.int8)
    sign[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    sign[-1] = 1
    at = np.where(sign != 0, np.arange(n), n)
    return sign[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order (or, within buckets, in any order: then their LMS substrings come out sorted)."""
    n, k = len(s), len(size)
    head = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    tail = np.cumsum(size).astype(np.int64)
    sa = np.full(n, -1, np.int64)
    of = s[lms]
    seeds = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=k))))
    grouped = lms[np.argsort(of, kind="stable")]
    used = np.flatnonzero(size)

    def place(found: list[np.ndarray], ptr: np.ndarray, back: bool) -> None:
        p = found[0] if len(found) == 1 else np.concatenate(found)
        if not len(p):
            return
        c = s[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        count = np.diff(np.concatenate((first, [len(c)])))
        rank = np.arange(len(c)) - np.repeat(first, count)
        sa[ptr[c] - 1 - rank if back else ptr[c] + rank] = p
        ptr[c[first]] += -count if back else count

    ptr = head.copy()
    for b in used.tolist():
        out, done = [], head[b]
        while done < ptr[b]:
            cur = sa[done : ptr[b]]
            done = ptr[b]
            p = cur[cur > 0] - 1
            p = p[~small[p]]
            here = s[p] == b
            if here.any():
                same = p[here]
                sa[ptr[b] : ptr[b] + len(same)] = same
                ptr[b] += len(same)
                p = p[~here]
            out.append(p)
        p = grouped[seeds[b] : seeds[b + 1]]
        p = p[p > 0] - 1
        out.append(p[~small[p]])
        place(out, ptr, False)
    larger = ptr.copy()
    ptr = tail.copy()
    for b in used[::-1].tolist():
        out, done = [], tail[b]
        while done > ptr[b]:
            cur = sa[ptr[b] : done][::-1]
            done = ptr[b]
            p = cur[cur > 0] - 1
            p = p[small[p]]
            here = s[p] == b
            if here.any():
                same = p[here]
                ptr[b] -= len(same)
                sa[ptr[b] : ptr[b] + len(same)] = same[::-1]
                p = p[~here]
            out.append(p)
        cur = sa[head[b] : larger[b]][::-1]
        p = cur[cur > 0] - 1
        out.append(p[small[p]])
        place(out, ptr, True)
    sa[0] = n - 1
    return sa


def _induce_singly(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same as _induce, one suffix at a time: for alphabets so large that a bucket holds few suffixes."""
    ends = np.cumsum(size)
    text, is_small, tail, head = s.tolist(), small.tolist(), ends.tolist(), (ends - size).tolist()
    sa = [0] * len(text)  # 0 has no predecessor, so an unfilled place induces nothing
    for p in lms[::-1].tolist():
        c = text[p]
        tail[c] -= 1
        sa[tail[c]] = p
    for k in range(len(sa)):
        p = sa[k] - 1
        if p >= 0 and not is_small[p]:
            c = text[p]
            sa[head[c]] = p
            head[c] += 1
    tail = ends.tolist()
    for k in range(len(sa) - 1, -1, -1):
        p = sa[k] - 1
        if p >= 0 and is_small[p]:
            c = text[p]
            tail[c] -= 1
            sa[tail[c]] = p
    return np.array(sa)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of s, whose last value is 0 and smaller than all others."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    size = np.bincount(s)
    small = _classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce if len(size) <= SMALL_ALPHABET else _induce_singly
    if len(lms) < 2:
        return induce(s, small, lms, size)
    rough = induce(s, small, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = rough[is_lms[rough]]
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    end = np.concatenate((lms[1:], [n - 1]))
    length = end - lms + 1
    a, b = rough[:-1], rough[1:]
    la, lb = length[number[a]], length[number[b]]
    same = la == lb
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        equal = s[a[live] + k] == s[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[la[live] > k]
    name = np.concatenate(([0], np.cumsum(~same)))
    short = np.empty(len(lms), np.int64)
    short[number[rough]] = name
    if name[-1] == len(lms) - 1:
        order = np.argsort(short, kind="stable")
    else:
        order = suffix_array(short)
    return induce(s, small, lms[order], size)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """plcp[p]: the common prefix of suffix p and the suffix before it in sa.

    Where the values before both suffixes are equal it is one less than at p - 1; the other positions are compared directly, together.
    """
    n = len(s)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    at = np.arange(n)
    known = (phi > 0) & (at > 0)
    known[known] = s[at[known] - 1] == s[phi[known] - 1]
    own = np.flatnonzero(~known & (phi >= 0))
    lcp = np.zeros(n, np.int64)
    live, k = own, 0
    while len(live):
        live = live[np.maximum(live, phi[live]) + k < n]
        live = live[s[live + k] == s[phi[live] + k]]
        lcp[live] += 1
        k += 1
    first = np.maximum.accumulate(np.where(~known, at, 0))
    return np.where(known, lcp[first] - (at - first), lcp)
