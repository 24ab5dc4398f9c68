"""The table of descents against all orders of the steps, and its reuse."""

from itertools import combinations
from math import comb

from tractus.operators import exact


def test_small_keys_against_all_orders(spark):
    keys = [(u, d, f) for u in range(5) for d in range(5) for f in range(5)]
    got = {tuple(r)[:3]: r.p for r in exact.descent_table(spark.createDataFrame([*keys, *keys], "plus int, minus int, drop int")).collect()}
    assert len(got) == len(keys)
    for u, d, f in keys:
        hits = 0
        for ups in combinations(range(u + d), u):
            height = top = most = 0
            for i in range(u + d):
                height += 1 if i in ups else -1
                top = max(top, height)
                most = max(most, top - height)
            hits += most >= f
        want = hits / comb(u + d, u) if u and d and f else 1.0
        assert abs(got[u, d, f] - want) < 1e-12, (u, d, f)


def test_joined_back_once_for_each_walk(spark):
    rows = [(1, i, 3 + i % 2, 10, 4) for i in range(40)]
    out = exact.with_probability(spark.createDataFrame(rows, "dataset_id long, a int, plus int, n_sites long, descent int")).collect()
    assert len(out) == 40 and len({(r.plus, r.p) for r in out}) == 2 and all(r.exact and r.minus == 10 - r.plus for r in out)
