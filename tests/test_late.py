"""Late evidence against plain lists: walks around the origin, rows with gaps, and relations that are planted."""

from itertools import permutations

import numpy as np
import pytest

from tests.test_kernels import lineage, mutated
from tractus.operators import late


def planted(n=400, begin=121, end=260):
    """Recombinant, its parents, a later copy of the recombinant, rows near either parent, an unrelated row, one of few sites."""
    major, minor = lineage(n, 1, 2), lineage(n, 2, 2)
    held = (np.arange(n) >= begin - 1) & (np.arange(n) < end) if begin <= end else (np.arange(n) >= begin - 1) | (np.arange(n) < end)
    mosaic = np.where(held, minor, major)
    rows = [mosaic, major, minor, mutated(mosaic, 0.03, 5), mutated(major, 0.03, 6), mutated(minor, 0.03, 7), lineage(n, 9, 2)]
    few = np.where(np.arange(n) % 50 == 3, mosaic, 0)
    gapped = rows[3].copy()
    gapped[100:200] = 0
    return [*rows, few, gapped]


def tables(spark, held):
    seqs = spark.createDataFrame([(d, i, r.tolist()) for d, (rows, *_) in held.items() for i, r in enumerate(rows)], "dataset_id long, seq_id int, states array<tinyint>")
    events = spark.createDataFrame([(d * 10, d, 0, 1, 2, 0, b, e) for d, (_, b, e) in held.items()], "event_id long, dataset_id long, a int, b int, c int, recombinant int, begin int, end int")
    return seqs, events


def regions(rows, begin, end):
    """Positions (from 1) of the six regions: lists of variable sites, walked outwards from the breakpoints."""
    x = np.stack(rows[:3])
    pos = [p + 1 for p in range(x.shape[1]) if (x[:, p] > 0).all() and len(set(x[:, p])) > 1]
    n, w = len(pos), min(late.WALK, len(pos) // 2)
    inside = [p for p in pos if (begin <= p <= end if begin < end else p >= begin or p <= end)]
    b, e = sum(p < begin for p in pos), sum(p <= end for p in pos)
    walk = lambda first, way: [pos[(first + way * i) % n] for i in range(w)]
    return [walk(b - 1, -1), walk(b, 1), walk(e - 1, -1), walk(e, 1), [p for p in pos if p not in inside], inside]


def vector(row, reps, where):
    own = [[p for p in r if row[p - 1] > 0] for r in where]
    return [len(r) for r in own], [[sum(row[p - 1] != x[p - 1] for p in r) / len(r) if r else None for x in reps] for r in own]


def corr(x, y):
    if any(v is None for v in (*x, *y)):
        return None
    if np.ptp(x) < 1e-6 or np.ptp(y) < 1e-6:
        return 0.0
    return round(float(np.corrcoef(x, y)[0, 1]), 6)


@pytest.mark.parametrize("tract", [(121, 260), (350, 60), (1, 200)])
def test_against_lists(spark, tract):
    held = {1: (planted(400, *tract), *tract), 2: (planted(90, 30, 60), 30, 60)}
    seqs, events = tables(spark, held)
    got = {(r.event_id, r.seq_id, r.role): r for r in late.distance_correlation_set(seqs, events).collect()}
    for d, (rows, b, e) in held.items():
        where = regions(rows, b, e)
        own = [vector(rows[k], rows[:3], where)[1] for k in range(3)]
        for i in range(3, len(rows)):
            valid, apart = vector(rows[i], rows[:3], where)
            for role in range(3):
                r = got.pop((d * 10, i, role))
                for c, (g, h) in enumerate(late.COMPARED):
                    x = [*apart[g], *apart[h]]
                    y = lambda o, g=g, h=h: [own[role][z][k] for z in (g, h) for k in o]  # noqa: B023, E731
                    assert (r[f"r{c}"] is None) == (None in x) and (r[f"r{c}"] is None or abs(r[f"r{c}"] - corr(x, y((0, 1, 2)))) < 1e-5)
                    if r[f"r{c}"] is not None:
                        assert abs(r[f"m{c}"] - max(corr(x, y(o)) for o in permutations(range(3)))) < 1e-5
                        assert r[f"k{c}"] == 0 or r[f"m{c}"] > r[f"r{c}"]
                assert r.overlap == (valid[0] + valid[1] > 10 or valid[2] + valid[3] > 10)
                near = [None not in apart[g] and apart[g][role] <= min(apart[g]) for g in (4, 5)]
                assert r.affinity == all(near)
    assert not got


def test_planted_members(spark):
    seqs, events = tables(spark, {1: (planted(), 121, 260)})
    out = late.distance_correlation_set(seqs, events).collect()
    member = {(r.seq_id, r.role) for r in out if r.member}
    assert {(3, 0), (4, 1), (5, 2)} <= member
    assert not any(i == 7 for i, _ in member)
    assert not any(r.member and not r.direct for r in out)


def test_no_events_and_no_other_rows(spark):
    seqs, events = tables(spark, {1: (planted()[:3], 121, 260)})
    assert late.distance_correlation_set(seqs, events).collect() == []
    assert late.distance_correlation_set(seqs, events.limit(0)).collect() == []


def test_blocks_of_rows_and_rows_without_sites(spark, monkeypatch):
    """Rows in blocks of two relate as in one block; a row without a state has no correlations, as one without a list."""
    rows = [*planted(90, 30, 60), np.zeros(90, int), None]
    held = [(1, i, None if r is None else r.tolist()) for i, r in enumerate(rows)]
    seqs = spark.createDataFrame(held, "dataset_id long, seq_id int, states array<tinyint>")
    events = tables(spark, {1: (planted(90, 30, 60), 30, 60)})[1]
    whole = {tuple(r) for r in late.distance_correlation_set(seqs, events).collect()}
    monkeypatch.setattr(late, "BLOCK", 2)
    found = late.distance_correlation_set(seqs, events)
    assert {tuple(r) for r in found.collect()} == whole
    assert {r[1] for r in whole} == set(range(3, 9)) and len(whole) == 18
    # Correlations are no tree of column expressions, and no row is made for a site.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "sites" not in plan


def test_values_are_rounded_as_sql_rounds():
    x = [np.array([v]) for v in (0.1, 0.5, 0.2, 0.4, 0.3, 0.9)]
    want = float(np.corrcoef(np.concatenate(x), [0.2, 0.4, 0.1, 0.5, 0.35, 0.7])[0, 1])
    r = late._pearson(x, [np.array([v]) for v in (0.2, 0.4, 0.1, 0.5, 0.35, 0.7)])[0]
    assert r == float(f"{want:.9f}")
    assert late._pearson(x, [np.array([0.5])] * 6)[0] == 0 and np.isnan(late._pearson(x, [np.array([np.nan])] * 6)[0])
