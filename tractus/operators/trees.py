"""Trees of regions: neighbour joining, WPGMA, Newick text, midpoint rooting, rank matrices and split support.

A tree belongs to one alignment and region, so it is a grouped function; distances come in as rows of pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import ensure

EDGES = "dataset_id long, parent int, child int, length double"


def matrix(n: int, first, second, distance) -> np.ndarray:
    d = np.zeros((n, n))
    d[first, second] = d[second, first] = distance
    return d


def neighbour_joining(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges (parent, child, length) of 2 n - 1 nodes; leaves are 0 .. n - 1, the last node is the root, and the first of
    equally good pairs is joined. The last two nodes hang from the root at half of their distance."""
    n = len(d)
    d = d.astype(np.float32).astype(float)
    live, edges, new = list(range(n)), [], n
    full = np.zeros((2 * n, 2 * n))
    full[:n, :n] = d
    while len(live) > 2:
        sub = full[np.ix_(live, live)]
        total = sub.sum(axis=1)
        q = (len(live) - 2) * sub - total[:, None] - total[None, :]
        q[np.tril_indices(len(live))] = np.inf
        i, j = np.unravel_index(q.argmin(), q.shape)
        a, b = live[i], live[j]
        to_a = sub[i, j] / 2 + (total[i] - total[j]) / (2 * (len(live) - 2))
        edges += [(new, a, to_a), (new, b, sub[i, j] - to_a)]
        for c in live:
            full[new, c] = full[c, new] = (full[a, c] + full[b, c] - full[a, b]) / 2
        live = [c for c in live if c not in (a, b)] + [new]
        new += 1
    if len(live) == 2:
        half = full[live[0], live[1]] / 2
        edges += [(new, live[0], half), (new, live[1], half)]
    return [(p, c, float(min(1.0, max(0.0, length)))) for p, c, length in edges]


def wpgma(d: np.ndarray) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """Merges (first, second, height) in order, and cophenetic distances; ties: smallest pair."""
    n = len(d)
    size = {i: [i] for i in range(n)}
    full = np.full((2 * n, 2 * n), np.inf)
    full[:n, :n] = d
    merges, coph = [], np.zeros((n, n))
    for new in range(n, 2 * n - 1):
        ids = sorted(size)
        _, a, b = min((full[i, j], i, j) for x, i in enumerate(ids) for j in ids[x + 1 :])
        h = full[a, b]
        for x in size[a]:
            for y in size[b]:
                coph[x, y] = coph[y, x] = h
        for c in ids:
            full[new, c] = full[c, new] = (full[a, c] + full[b, c]) / 2
        size[new] = size.pop(a) + size.pop(b)
        merges.append((a, b, float(h)))
    return merges, coph


def children(edges) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list[tuple[int, float]]] = {}
    for p, c, length in edges:
        out.setdefault(p, []).append((c, length))
    return out


def newick(edges, names: list[str]) -> str:
    kids, root = children(edges), max(p for p, _, _ in edges)

    def text(node: int) -> str:
        if node not in kids:
            return names[node]
        return "(" + ",".join(f"{text(c)}:{length:.5f}" for c, length in kids[node]) + ")"

    return text(root) + ";"


def paths(edges, n: int) -> np.ndarray:
    """Distances between leaves along the tree."""
    kids, out = children(edges), np.zeros((n, n))

    def below(node: int) -> dict[int, float]:
        if node not in kids:
            return {node: 0.0}
        parts = [{x: d + length for x, d in below(c).items()} for c, length in kids[node]]
        for i, p in enumerate(parts):
            for q in parts[i + 1 :]:
                for x, dx in p.items():
                    for y, dy in q.items():
                        out[x, y] = out[y, x] = dx + dy
        return {k: v for p in parts for k, v in p.items()}

    below(max(p for p, _, _ in edges))
    return out


def midpoint_rooted(edges, n: int) -> list[tuple[int, int, float]]:
    """The same tree, rooted halfway between the two leaves that are farthest apart."""
    d = paths(edges, n)
    a, b = np.unravel_index(d.argmax(), d.shape)
    near: dict[int, list[tuple[int, float]]] = {}
    old = max(p for p, _, _ in edges)
    joined = [(c, length) for p, c, length in edges if p == old]
    plain = [e for e in edges if e[0] != old]
    if len(joined) == 2:
        plain.append((joined[0][0], joined[1][0], joined[0][1] + joined[1][1]))
    for p, c, length in plain:
        near.setdefault(p, []).append((c, length))
        near.setdefault(c, []).append((p, length))
    trail, seen = [(int(a), None, 0.0)], {int(a)}
    came = {int(a): None}
    while trail:
        node, _, _ = trail.pop()
        for m, length in near[node]:
            if m not in seen:
                seen.add(m)
                came[m] = (node, length)
                trail.append((m, node, length))
    node, left = int(b), float(d[a, b]) / 2
    while came[node] is not None and came[node][1] < left:
        left -= came[node][1]
        node = came[node][0]
    up, length = came[node] if came[node] is not None else (near[node][0][0], near[node][0][1])
    out, stack = [(old, node, left), (old, up, max(0.0, length - left))], [(node, up), (up, node)]
    while stack:
        x, origin = stack.pop()
        for m, size in near[x]:
            if m != origin:
                out.append((x, m, size))
                stack.append((m, x))
    return out


def ranks(edges, n: int) -> np.ndarray:
    """Levels between leaves: how many nodes above two leaves their common one lies, the deeper side counting."""
    kids, out = children(edges), np.zeros((n, n), int)

    def below(node: int) -> dict[int, int]:
        if node not in kids:
            return {node: 0}
        parts = [{x: k + 1 for x, k in below(c).items()} for c, _ in kids[node]]
        for i, p in enumerate(parts):
            for q in parts[i + 1 :]:
                for x, kx in p.items():
                    for y, ky in q.items():
                        out[x, y] = out[y, x] = max(kx, ky)
        return {k: v for p in parts for k, v in p.items()}

    below(max(p for p, c, _ in edges if p not in {x for _, x, _ in edges}))
    return out


def splits(edges, n: int) -> set[frozenset]:
    """Inner splits, each as the side without leaf 0."""
    kids, out = children(edges), set()

    def below(node: int) -> frozenset:
        if node not in kids:
            return frozenset([node])
        leaves = frozenset().union(*(below(c) for c, _ in kids[node]))
        side = leaves if 0 not in leaves else frozenset(range(n)) - leaves
        if 1 < len(side) < n - 1:
            out.add(side)
        return leaves

    below(max(p for p, _, _ in edges))
    return out


def support(edges, replicates: list, n: int) -> dict[frozenset, float]:
    """(n + 1) / (replicates + 1) of each inner split."""
    seen = [splits(r, n) for r in replicates]
    return {s: (sum(s in r for r in seen) + 1) / (len(replicates) + 1) for s in splits(edges, n)}


def trees(distances: DataFrame) -> DataFrame:
    """Edges of one neighbour-joining tree for each data set of (dataset_id, s1, s2, distance)."""
    ensure(distances.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        d = table.select(["dataset_id", "s1", "s2", "distance"]).to_pydict()
        ids = sorted({*d["s1"], *d["s2"]})
        at = {s: i for i, s in enumerate(ids)}
        edges = neighbour_joining(matrix(len(ids), [at[s] for s in d["s1"]], [at[s] for s in d["s2"]], d["distance"]))
        name = lambda k: ids[k] if k < len(ids) else 1000 + k - len(ids)
        return pa.table({"dataset_id": pa.array([d["dataset_id"][0]] * len(edges), pa.int64()), "parent": pa.array([name(p) for p, _, _ in edges], pa.int32()), "child": pa.array([name(c) for _, c, _ in edges], pa.int32()), "length": pa.array([x for _, _, x in edges], pa.float64())})

    return distances.groupBy("dataset_id").applyInArrow(run, EDGES)
