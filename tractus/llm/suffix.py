"""Suffix arrays by induced sorting, and longest common prefixes in text order, on numpy arrays.

A suffix is S where it is smaller than the next one, else L; a leftmost S after an L begins a substring. Sorted
leftmost-smaller suffixes induce the order of all L suffixes in one scan from the left, and these the order of all S
suffixes in one scan from the right. The scans go bucket by bucket: all entries of a bucket that are known when it is
reached are taken together, in order, and their predecessors are dealt to their buckets by a stable radix sort; what
falls into the bucket itself is taken next. The substrings themselves are first sorted by the same induction and named;
where names repeat, the reduced text is sorted by refining the groups of equal names, each round with twice the length.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S. The end of the text is smaller than everything."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    step[-1] = -1
    decided = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    return step[following] > 0


def _dealt(sa, place, pred, symbols, k: int, down: bool):
    """Puts pred into the buckets of their symbols, in order, from place on (down: from place backwards)."""
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    count = np.bincount(s, minlength=k)
    rank = np.arange(len(s)) - (np.cumsum(count) - count)[s]
    if down:
        sa[place[s] - 1 - rank] = pred[order]
        place -= count
    else:
        sa[place[s] + rank] = pred[order]
        place += count


def _induced(t, small, sizes, lms) -> np.ndarray:
    """The suffix array from leftmost-smaller suffixes in their order (or in text order: then substrings are sorted)."""
    n, k = len(t), len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int32)
    head = starts.copy()
    sa[head[t[n - 1]]] = n - 1
    head[t[n - 1]] += 1
    own = t[lms]
    order = np.argsort(own, kind="stable")
    seeds, seeded = lms[order], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=k))])
    for c in np.flatnonzero(sizes):
        done = starts[c]
        while done < head[c]:
            batch = sa[done : head[c]]
            done = head[c]
            pred = batch[batch > 0] - 1
            pred = pred[~small[pred]]
            if len(pred):
                _dealt(sa, head, pred, t[pred], k, False)
        pred = seeds[seeded[c] : seeded[c + 1]]
        pred = pred[pred > 0] - 1
        if len(pred):
            _dealt(sa, head, pred, t[pred], k, False)
    tail = ends.copy()
    for c in np.flatnonzero(sizes)[::-1]:
        done = ends[c]
        while tail[c] < done:
            batch = sa[tail[c] : done][::-1]
            done = tail[c]
            pred = batch[batch > 0] - 1
            pred = pred[small[pred]]
            if len(pred):
                _dealt(sa, tail, pred, t[pred], k, True)
        batch = sa[starts[c] : head[c]][::-1]
        pred = batch[batch > 0] - 1
        pred = pred[small[pred]]
        if len(pred):
            _dealt(sa, tail, pred, t[pred], k, True)
    return sa


def _chunks(t: np.ndarray) -> np.ndarray:
    """Eight symbols from each place on, as one number."""
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    return np.ndarray((len(t) + 8,), np.dtype("<u8"), padded, 0, (1,))


def _common(chunks, n: int, a: np.ndarray, b: np.ndarray, most=None) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes a and b, up to most."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    limit = np.minimum(n - a, n - b) if most is None else most
    while len(live):
        at = out[live]
        x = chunks[np.minimum(a[live] + at, n)] ^ chunks[np.minimum(b[live] + at, n)]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.log2(np.where(x == 0, np.uint64(1), low).astype(np.float64)).astype(np.int64) >> 3)
        out[live] = np.minimum(at + same, limit[live])
        live = live[(same == 8) & (out[live] < limit[live])]
    return out


def _refined(names: np.ndarray) -> np.ndarray:
    """Suffix array of a text of names (0 and up, dense and in order)."""
    m = len(names)
    rank = (np.cumsum(np.bincount(names)) - np.bincount(names))[names].astype(np.int64)
    count = np.bincount(rank, minlength=m)
    live = np.flatnonzero(count[rank] > 1)
    length = 1
    while len(live):
        following = live + length
        second = np.where(following < m, rank[np.minimum(following, m - 1)] + 1, 0)
        order = np.argsort(rank[live] * (m + 1) + second, kind="stable")
        live, second = live[order], second[order]
        group = rank[live]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_part = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(live))
        begin = np.maximum.accumulate(np.where(new_group, at, 0))
        part = np.maximum.accumulate(np.where(new_part, at, 0))
        rank[live] = group + part - begin
        alone = new_part & np.concatenate([new_part[1:], [True]])
        live = live[~alone]
        length *= 2
    sa = np.empty(m, np.int64)
    sa[rank] = np.arange(m)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """t: uint8. The end sorts before all symbols."""
    n = len(t)
    if n < 2:
        return np.zeros(n, np.int32)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    sizes = np.bincount(t, minlength=256)
    if len(lms) < 2:
        return _induced(t, small, sizes, lms)
    sa = _induced(t, small, sizes, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # Length of each substring up to and with the next one's first symbol; the last one ends with the text.
    size = np.zeros(n, np.int64)
    size[lms] = np.append(np.diff(lms) + 1, n - lms[-1] + 1)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    alike = np.zeros(len(order), bool)
    same = np.flatnonzero(size[a] == size[b])
    alike[1 + same] = _common(_chunks(t), n, a[same], b[same], np.minimum(size[a[same]], n - np.maximum(a[same], b[same]) + 1)) >= size[a[same]]
    names = np.zeros(n, np.int64)
    names[order] = np.cumsum(~alike) - 1
    reduced = names[lms]
    lms = order if reduced.max() + 1 == len(lms) else lms[_refined(reduced)]
    return _induced(t, small, sizes, lms)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: its predecessor in the suffix array (-1 for the first), and the length of their common prefix.
    Only where the symbols before both differ is it counted out; elsewhere it is that of the place before, less one."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    known = (before < 1) | (at == 0)
    inner = np.flatnonzero(~known)
    known[inner] = t[inner - 1] != t[before[inner] - 1]
    places = np.flatnonzero(known & (before >= 0))
    lcp = np.zeros(n, np.int64)
    lcp[places] = _common(_chunks(t), n, places, before[places])
    last = np.maximum.accumulate(np.where(known, at, 0))
    return before, np.maximum(lcp[last] - (at - last), 0)
