"""Bootstrap trees and their splits against sets of leaves."""

from itertools import combinations

import numpy as np
import pytest

from tests.test_kernels import lineage, mutated
from tractus.operators import splits, trees
from tractus.operators.kernels.common import bootstrap_weights
from tractus.plans import catalog


def table(spark, held):
    return spark.createDataFrame([(d, i, [int(x) for x in r]) for d, rows in held.items() for i, r in rows.items()], "dataset_id long, seq_id int, states array<tinyint>")


def family(n, seed, length=240):
    rows = {i * 3: lineage(length, seed + i) for i in range(n)}
    for i in range(1, n, 2):
        rows[i * 3] = mutated(rows[(i - 1) * 3], 0.08, seed + 100 + i)
    rows[0][20:60] = 0
    return rows


def edges_of(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.dataset_id, r.replicate), []).append((r.parent, r.child))
    return out


def plain_splits(edges, ids):
    """Leaves on the side without the first one, for each inner edge."""
    kids = {}
    for p, c in edges:
        kids.setdefault(p, []).append(c)
    below = lambda x: {x} if x >= 0 else set().union(*map(below, kids[x]))
    out = set()
    for p in kids:
        side = below(p)
        side = side if ids[0] not in side else set(ids) - side
        if 1 < len(side) < len(ids) - 1:
            out.add(frozenset(side))
    return out


def decoded(split, ids):
    words = np.frombuffer(bytes(split), ">u8")
    return frozenset(x for i, x in enumerate(ids) if int(words[i // splits.WORD]) >> i % splits.WORD & 1)


def test_weights_of_trees():
    # Five sites, the sample and two replicates, seed 3.
    assert bootstrap_weights(5, 2, 3).tolist() == [[1, 2, 0], [1, 1, 2], [1, 1, 2], [1, 1, 1], [1, 0, 0]]


def test_distances_of_replicates(spark):
    held = {1: family(4, 5)}
    w = bootstrap_weights(240, 6, 3)
    for r in splits.replicate_distances(table(spark, held), 240, 6).collect():
        x, y = held[1][r.s1], held[1][r.s2]
        both, weight = (x > 0) & (y > 0), w[:, r.replicate]
        same = 1 - (weight * both * (x != y)).sum() / (weight * both).sum()
        want = 10.0 if same <= 0.25 else max(0.0, -0.75 * np.log((4 * same - 1) / 3))
        assert abs(r.distance - want) < 1e-9


@pytest.mark.parametrize("replicates", [0, 12])
def test_support_against_sets(spark, replicates):
    held = {1: family(6, 1), 2: family(9, 50), 3: family(3, 80), 4: family(70, 300, 60)}
    for d, length in ((60, 60), (240, 240)):
        some = {k: v for k, v in held.items() if len(v[0]) == length}
        edges = splits.joined_trees(splits.replicate_distances(table(spark, some), length, replicates)).persist()
        of = edges_of(edges)
        got, want = {}, {}
        for r in splits.split_support(splits.bipartitions(edges), replicates).collect():
            ids = sorted(some[r.dataset_id])
            assert bin(int.from_bytes(bytes(r.split), "big")).count("1") == r.leaves
            got[r.dataset_id, decoded(r.split, ids)] = (r.seen, r.percent, r.collapsed)
        for k, rows in some.items():
            ids = sorted(rows)
            each = [plain_splits(of[k, x], ids) for x in range(replicates + 1)]
            for s in each[0]:
                seen = sum(s in x for x in each[1:])
                percent = round((seen + 1) / (replicates + 1) * 100)
                want[k, s] = (seen, percent, percent < 50)
        assert got == want and want
        assert replicates == 0 or any(c for *_, c in want.values())
        near = {(r.dataset_id, r.s1, r.s2): r.splits for r in splits.collapsed_distances(edges, splits.split_support(splits.bipartitions(edges), replicates)).collect()}
        for k, rows in some.items():
            kept = [s for (d_, s), v in want.items() if d_ == k and not v[2]]
            for x, y in combinations(sorted(rows), 2):
                assert near[k, x, y] == sum((x in s) != (y in s) for s in kept)
        edges.unpersist()


def test_trees_are_those_of_the_alignment(spark):
    """The tree of replicate 0 is the neighbour-joining tree of the unweighted distances."""
    held = {1: family(8, 9)}
    edges = edges_of(splits.joined_trees(splits.replicate_distances(table(spark, held), 240, 2)))
    rows = splits.replicate_distances(table(spark, held), 240, 0).collect()
    ids = sorted(held[1])
    d = trees.matrix(8, [ids.index(r.s1) for r in rows], [ids.index(r.s2) for r in rows], [r.distance for r in rows])
    plain = trees.splits(trees.neighbour_joining(d), 8)
    assert plain_splits(edges[1, 0], ids) == {frozenset(ids[i] for i in s) for s in plain}


def test_registered_query(spark):
    rows = catalog.queries()["split_support"](spark, "/root/testdata/sf0.001").collect()
    assert rows and {r.collapsed for r in rows} == {True, False} and all(0 < r.percent <= 100 for r in rows)
    assert len({(r.dataset_id, r.members) for r in rows}) == len(rows)
