"""Role metrics and the vote against lists, on a planted recombinant."""

import math
from itertools import combinations

import numpy as np

from tests.test_kernels import lineage, mutated
from tests.test_late import tables
from tractus.operators import late, roles, trees


def planted():
    root = [lineage(300, s) for s in (1, 2)]
    major, minor = mutated(root[0], 0.1, 3), mutated(root[1], 0.1, 4)
    mosaic = np.where((np.arange(300) >= 100) & (np.arange(300) < 200), minor, major)
    near = [mutated(x, 0.1, 10 + i) for i, x in enumerate((root[0], root[0], root[1], root[1]))]
    return [mutated(mosaic, 0.02, 30), major, minor, *near, mutated(mosaic, 0.04, 31)]


def plain(rows, begin, end, reps, members):
    n, pos = len(rows), np.arange(1, len(rows[0]) + 1)
    inner = (pos >= begin) & (pos <= end)

    def jc(x, y, held):
        both = held & (x > 0) & (y > 0)
        if not both.any():
            return 10.0
        same = 1 - (both & (x != y)).sum() / both.sum()
        return 0.0 if same == 1 else 10.0 if same <= 0.25 else -0.75 * math.log((4 * same - 1) / 3)

    direct = {r: np.array([[jc(x, y, h) if x is not y else 0.0 for y in rows] for x in rows]) for r, h in (("in", inner), ("out", ~inner))}
    tree = {}
    for r, d in direct.items():
        held = trees.splits(trees.neighbour_joining(d), n)
        tree[r] = np.array([[sum((i in s) != (j in s) for s in held) for j in range(n)] for i in range(n)], float)

    def corr(x, y):
        return float(np.corrcoef(x, y)[0, 1]) if np.ptp(x) > 1e-6 and np.ptp(y) > 1e-6 else 0.0

    out = {}
    for role, row in enumerate(reps):
        others = [i for i in range(n) if i != row]
        for kind, (a, b, c) in ((direct, (0, 3, 5)), (tree, (1, 4, 6))):
            x, y = kind["in"][row][others], kind["out"][row][others]
            out[role, a], out[role, c] = 1 - corr(x, y), float(np.abs(x - y).mean())
            rest = [(j, [i for i in range(n) if i not in (j, row)]) for j in reps if j != row]
            out[role, b] = float(np.mean([corr(kind["in"][j][o], kind["out"][j][o]) for j, o in rest]))
        out[role, 2] = out[role, 1]
        x, y = direct["in"][row], direct["out"][row]
        turned = [(x[i] - x[j]) * (y[i] - y[j]) < 0 for i, j in combinations(others, 2)]
        out[role, 7] = float(np.mean(turned))
        out[role, 8] = float(members.get(role, 0))
    return out


def test_metrics_and_vote_against_lists(spark):
    rows = planted()
    seqs, events = tables(spark, {1: (rows, 101, 200)})
    members = {}
    for r in late.distance_correlation_set(seqs, events).filter("member").collect():
        members[r.role] = members.get(r.role, 0) + 1
    want = plain(rows, 101, 200, (0, 1, 2), members)
    scores = roles.role_metrics(seqs, events)
    got = {(r.role, r.metric): r.score for r in scores.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert abs(got[k] - v) < 2e-6, (k, got[k], v)
    points = dict.fromkeys(range(3), 0.0)
    for m, weight in enumerate((8, 18, 20, 10, 8, 2, 10, 8, 0)):
        for role in range(3):
            above = sum(got[role, m] > got[o, m] for o in range(3))
            points[role] += weight * {2: 1.0, 1: 0.5, 0: 0.0}[above]
    ranked = sorted(points.values(), reverse=True)
    r = roles.recommendation(scores).first()
    assert r.role == 0 == max(points, key=points.get) and r.points == ranked[0]
    assert abs(r.confidence - (ranked[0] - ranked[1]) / sum(ranked)) < 1e-12


def test_no_events(spark):
    seqs, events = tables(spark, {1: (planted(), 101, 200)})
    assert roles.recommendation(roles.role_metrics(seqs, events.limit(0))).collect() == []


def test_events_are_read_once(spark, tmp_path):
    """The metrics' plan is small and reads the events' own table no more; what they come from may be a whole scan."""
    seqs, events = tables(spark, {1: (planted(), 101, 200)})
    events.write.parquet(str(tmp_path / "events"))
    scores = roles.role_metrics(seqs, spark.read.parquet(str(tmp_path / "events")))
    assert len(scores._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert not [f for f in scores.inputFiles() if str(tmp_path) in f]
    assert {(r.role, r.metric) for r in scores.collect()} == {(role, m) for role in range(3) for m in range(9)}
