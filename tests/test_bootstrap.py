"""Pair profiles as a table against the kernel, their reuse, and the kernel's own cache."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_kernels import lineage, mutated
from tractus.operators import bootstrap, scan
from tractus.operators.kernels import windows
from tractus.operators.kernels.common import Options, bootstrap_weights, crt_random


def alignment(n=5, length=200):
    base = lineage(length, 3)
    rows = [mutated(base, 0.1 + 0.12 * i, i) for i in range(n)]
    rows[1][50:140] = 0
    rows[2] = np.where(np.arange(length) % 7 == 0, 0, rows[0])
    return rows


def table(spark, held):
    return spark.createDataFrame([(d, i, r.tolist()) for d, rows in held.items() for i, r in enumerate(rows)], "dataset_id long, seq_id int, states array<tinyint>")


def test_weights():
    w = bootstrap_weights(5, 3, 3)
    draws = crt_random(3, 17)[2:].reshape(5, 3)
    assert w.shape == (5, 4) and (w.sum(axis=0) == 5).all()
    assert [int((np.minimum(4, draws[:, r] / 32767 * 4).astype(int) == s).sum()) for r in range(3) for s in range(5)] == w[:, 1:].T.ravel().tolist()


@pytest.mark.parametrize(("window", "step", "replicates"), [(40, 10, 20), (300, 7, 5)])
def test_profiles_and_votes_are_those_of_the_kernel(spark, window, step, replicates):
    o = Options(boot_window=window, boot_step=step, boot_replicates=replicates)
    held = {4: alignment(), 9: alignment(3)}
    df = table(spark, held)
    got = {(r.dataset_id, r.s1, r.s2): np.array(r.profile) for r in bootstrap.pair_profiles(df, 200, window, step, replicates).collect()}
    for d, rows in held.items():
        for i, j in combinations(range(len(rows)), 2):
            assert np.allclose(got[d, i, j], windows.pair_profile(rows[i], rows[j], o), atol=1e-5)
    assert len(got) == 10 + 3
    voted = {(r.dataset_id, r.a, r.b, r.c, r.win): (r.v12, r.v13, r.v23) for r in bootstrap.bootstrap_votes(df, 200, window, step, replicates).collect()}
    for d, rows in held.items():
        for t in combinations(range(len(rows)), 3):
            votes, usable = windows.support(windows.pair_profiles(np.stack([rows[i] for i in t]), o)[0])
            assert [voted[d, *t, w] for w in range(votes.shape[1])] == [tuple(v) for v in votes.T.tolist()]


def test_a_pair_is_measured_once(spark):
    """Two triplets with a pair in common have five profiles; the block's cache has one hit."""
    df = table(spark, {1: alignment(4)})
    profiles = bootstrap.pair_profiles(df, 200, 40, 10, 10)
    triples = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 1, 3)], "dataset_id long, a int, b int, c int")
    used = bootstrap.with_profiles(triples, profiles)
    assert used.count() == 2
    pairs = triples.select("dataset_id", F.explode(F.array(*[F.struct(F.col(x).alias("s1"), F.col(y).alias("s2")) for x, y in ("ab", "ac", "bc")])).alias("p")).select("dataset_id", "p.*")
    assert pairs.count() == 6 and profiles.join(pairs.distinct(), ["dataset_id", "s1", "s2"]).count() == 5
    held, rows, o = {}, alignment(4), Options(boot_window=40, boot_step=10, boot_replicates=10)
    for t in ((0, 1, 2), (0, 1, 3)):
        whole = scan.detect(np.stack([rows[i] for i in t]), o, ("BootScan",))
        assert [vars(c) for c in scan.detect(np.stack([rows[i] for i in t]), o, ("BootScan",), None, held, t)] == [vars(c) for c in whole]
    assert len(held) == 5


def test_regions(spark):
    rows = [(1, 0, 1, 2, w, 10, v, 0, 10 - v) for w, v in enumerate([9, 9, 2, 8, 7, 6, 9])]
    voted = spark.createDataFrame(rows, "dataset_id long, a int, b int, c int, win int, usable long, v12 long, v13 long, v23 long")
    got = {(r.pair, r.first, r["last"], r.windows, r.mean_votes) for r in bootstrap.support_regions(voted, 10).collect()}
    assert got == {(0, 0, 1, 2, 9.0), (0, 3, 4, 2, 7.5), (0, 6, 6, 1, 9.0), (2, 2, 2, 1, 8.0)}


def test_regions_end_where_a_window_is_not_there(spark):
    rows = [(1, 0, 1, 2, w, 10, 9, 0, 1) for w in (0, 1, 3)]
    voted = spark.createDataFrame(rows, "dataset_id long, a int, b int, c int, win int, usable long, v12 long, v13 long, v23 long")
    found = bootstrap.support_regions(voted, 10)
    assert {(r.pair, r.first, r["last"], r.windows) for r in found.collect()} == {(0, 0, 1, 2), (0, 3, 3, 1)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_votes_in_tiles_are_those_of_each_triplet(spark, monkeypatch):
    """Two blocks and a bit more, windows a few at a time; profiles are not joined to triplets."""
    monkeypatch.setattr(bootstrap, "HELD", 40_000)
    rows = [mutated(lineage(60, 3), 0.02 + 0.01 * i, i) for i in range(2 * bootstrap.BLOCK + 3)]
    rows[17][10:40] = 0
    o = Options(boot_window=20, boot_step=10, boot_replicates=5)
    voted = bootstrap.bootstrap_votes(table(spark, {2: rows, 3: rows[:2], 5: rows[4:7]}), 60, 20, 10, 5)
    assert "Join" not in voted._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.dataset_id, r.a, r.b, r.c, r.win): (r.usable, r.v12, r.v13, r.v23) for r in voted.collect()}
    n, held = len(rows), {}
    assert len(got) == (n * (n - 1) * (n - 2) // 6 + 1) * 8
    for i, j in combinations(range(n), 2):
        held[i, j] = windows.pair_profile(rows[i], rows[j], o)
    for t in combinations(range(n), 3):
        d = np.stack([held[p] for p in combinations(t, 2)])
        usable, votes = (d < 2).all(axis=0).sum(axis=1), windows.support(d)[0]
        assert [got[2, *t, w] for w in range(8)] == list(zip(usable.tolist(), *votes.tolist(), strict=True))


def test_window_scores_are_those_of_each_window():
    p = np.random.default_rng(1).integers(0, 16, 120)
    prefix = windows.vertical_prefix(64, 3)
    rows = p[np.arange(0, 80, 8)[:, None] + np.arange(40)]
    got = windows.window_scores(rows, 30, prefix)
    for row, z in zip(rows, got, strict=True):
        draws = prefix[(np.arange(30)[:, None] * 40 + np.arange(40)) % 64]
        null = np.array([[np.isin(windows.permuted(row, d), s).sum() for d in draws] for s in windows.SUPPORT])
        seen = np.array([np.isin(row, s).sum() for s in windows.SUPPORT])
        want = [(a - n.mean()) / n.std() if a > 0 and n.std() > 0 else 0.0 for a, n in zip(seen, null, strict=True)]
        assert np.allclose(z, want)
