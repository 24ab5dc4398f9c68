"""The fourth sequence of SISCAN: the nearest outlier of a triplet among the other rows of its alignment."""

from __future__ import annotations

import numpy as np

from ..trees import wpgma


def similarities(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Direct ones, of the sites that both rows have, and those of the WPGMA tree (1 - height / 2)."""
    n = len(rows)
    has = rows > 0
    direct = np.ones((n, n), np.float32)
    for i in range(n):
        both = has[i] & has
        valid = both.sum(axis=1)
        direct[i] = np.where(valid > 0, (both & (rows[i] == rows)).sum(axis=1) / np.maximum(valid, 1), 0)
    np.fill_diagonal(direct, 1)
    distance = np.where(direct > 0, np.float32(1) - direct, np.float32(0.999))
    tree = (1 - wpgma(distance)[1] / 2).astype(np.float32)
    np.fill_diagonal(tree, 1)
    return direct, tree


def nearest(triplet, rows: np.ndarray, direct: np.ndarray, tree: np.ndarray, origins=None) -> int | None:
    """The row that is closest in the tree to the triplet's outer member and farther from it than its inner ones; without
    one the row that is least like all three; last the row with the fewest sites missing that the three have. Rows of
    the triplet's own originals do not count."""
    a, b, c = triplet
    origins = np.arange(len(rows)) if origins is None else np.asarray(origins)
    others = np.flatnonzero(~np.isin(origins, origins[[a, b, c]]))
    if not len(others):
        return None
    if tree[a, b] > tree[a, c]:
        inside, outer = a, c
    elif tree[a, c] > tree[a, b]:
        inside, outer = a, b
    else:
        inside, outer = b, a
    have = (rows[[a, b, c]] > 0).all(axis=0)
    missing = (have & (rows[others] == 0)).sum(axis=1)
    mean = direct[others][:, [a, b, c]].sum(axis=1) / np.float32(3)
    good = others[missing == 0]
    near = good[tree[outer, good] < tree[outer, inside]]
    if len(near):
        best = min(near, key=lambda k: (-tree[outer, k], -direct[outer, k], k))
        if tree[outer, best] > 0:
            return int(best)
    if len(good) and (low := mean[missing == 0]).min() < 1:
        return int(good[low.argmin()])
    return int(others[min(range(len(others)), key=lambda k: (missing[k], mean[k], k))])
