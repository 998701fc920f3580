"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classed as smaller or larger than their successor.  The leftmost-smaller
substrings are sorted and named, the row of names is sorted by recursion, and the order
of the rest is induced bucket by bucket: all suffixes of a bucket that are in place
deal out their predecessors in one step.  Small alphabets take array steps; the rows of
names, whose alphabet is as large as they are, take the plain loop.
"""

from __future__ import annotations

import numpy as np

_FEW = 1024  # symbols up to which buckets are dealt with by array steps


def _smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last one is larger."""
    step = np.empty(len(s), dtype=np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = -1
    turn = np.flatnonzero(step)
    return step[turn[np.searchsorted(turn, np.arange(len(s)))]] > 0


def _deal(sa, s, preds, at, down):
    """Put suffixes, in this order, at the open ends of their buckets."""
    if not len(preds):
        return
    symbol = s[preds]
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    n = np.bincount(symbol, minlength=len(at))
    rank = np.arange(len(order)) - (np.cumsum(n) - n)[symbol]
    if down:
        sa[at[symbol] - 1 - rank] = preds[order]
        at -= n
    else:
        sa[at[symbol] + rank] = preds[order]
        at += n


def _induce_arrays(s, small, lms, head, tail):
    sa = np.full(len(s), -1, dtype=np.int64)
    of = s[lms]
    first = np.searchsorted(of, np.arange(len(head) + 1))
    at = head.copy()
    symbols = np.flatnonzero(tail > head)

    def before(front, want):
        p = front[front > 0] - 1
        return p[small[p] == want]

    _deal(sa, s, np.array([len(s) - 1]), at, False)
    for c in symbols:
        a = head[c]
        while a < at[c]:
            b = at[c]
            _deal(sa, s, before(sa[a:b], False), at, False)
            a = b
        _deal(sa, s, before(lms[first[c] : first[c + 1]], False), at, False)
    larger_end, at = at, tail.copy()
    for c in symbols[::-1]:
        a = tail[c]
        while a > at[c]:
            b = at[c]
            _deal(sa, s, before(sa[b:a][::-1], True), at, True)
            a = b
        _deal(sa, s, before(sa[head[c] : larger_end[c]][::-1], True), at, True)
    return sa


def _induce_loop(s, small, lms, head, tail):
    t, up = s.tolist(), small.tolist()
    sa = [-1] * len(t)
    at = tail.tolist()
    for j in lms[::-1].tolist():
        at[t[j]] -= 1
        sa[at[t[j]]] = j
    at = head.tolist()
    last = len(t) - 1
    sa[at[t[last]]] = last
    at[t[last]] += 1
    for i in range(len(t)):
        j = sa[i] - 1
        if j >= 0 and not up[j]:
            sa[at[t[j]]] = j
            at[t[j]] += 1
    at = tail.tolist()
    for i in range(last, -1, -1):
        j = sa[i] - 1
        if j >= 0 and up[j]:
            at[t[j]] -= 1
            sa[at[t[j]]] = j
    return np.array(sa, dtype=np.int64)


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes of integers below ``symbols``, in order; an end comes before any symbol."""
    s = np.asarray(s, dtype=np.int64)
    if len(s) < 2:
        return np.arange(len(s))
    small = _smaller(s)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    n = np.bincount(s, minlength=symbols)
    tail = np.cumsum(n)
    head = tail - n
    induce = _induce_arrays if symbols <= _FEW else _induce_loop
    if len(lms) > 1:
        sa = induce(s, small, lms[np.argsort(s[lms], kind="stable")], head, tail)
        order = sa[is_lms[sa]]
        names, count = _names(s, lms, order)
        if count < len(lms):
            lms = lms[suffix_array(names, count)]
        else:
            lms = order
    return induce(s, small, lms, head, tail)


def _names(s, lms, order):
    """Name of each leftmost-smaller substring, in the order of places, and how many there are."""
    end = np.full(len(s), len(s), dtype=np.int64)  # the last one reaches beyond the end and equals no other
    end[lms[:-1]] = lms[1:]
    a, b = order[:-1], order[1:]
    size = end[a] - a
    same = (size == end[b] - b) & (end[a] < len(s)) & (end[b] < len(s))
    live, t = np.flatnonzero(same), 0
    while len(live):
        equal = s[a[live] + t] == s[b[live] + t]
        same[live[~equal]] = False
        live = live[equal]
        live = live[size[live] > t]
        t += 1
    name = np.append(0, np.cumsum(~same))
    by_place = np.empty(len(s), dtype=np.int64)
    by_place[order] = name
    return by_place[lms], int(name[-1]) + 1


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix with the one before it in order.

    Only irreducible values are compared symbol by symbol; a value is reducible where
    the symbols to the left agree, and is one less than its left neighbour's.
    """
    n = len(s)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    reducible = (place > 0) & (phi > 0)
    r = np.flatnonzero(reducible)
    reducible[r] = s[r - 1] == s[phi[r] - 1]
    own = np.flatnonzero(~reducible)
    value = np.zeros(len(own), dtype=np.int64)
    live = np.flatnonzero(phi[own] >= 0)
    t = 0
    while len(live):
        x, y = own[live] + t, phi[own[live]] + t
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[s[x] == s[y]]
        t += 1
        value[live] = t
    nearest = np.cumsum(~reducible) - 1
    return value[nearest] - (place - own[nearest])
