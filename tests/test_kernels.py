"""Detectors: fixed constants, brute force twins, and planted mosaics that have to be found again."""

import itertools
import math

import numpy as np
import pytest

from tests.plain_cycle import overlap
from tractus.operators import rounds, scan
from tractus.operators.kernels import common, geneconv, maxchi, threeseq, windows
from tractus.operators.kernels.common import Options, Variable


def lineage(n, seed, states=4):
    return np.random.default_rng(seed).integers(1, states + 1, n).astype(np.int8)


def mutated(row, share, seed):
    r = np.random.default_rng(seed)
    hit = r.random(len(row)) < share
    return np.where(hit, (row - 1 + r.integers(1, 4, len(row))) % 4 + 1, row).astype(np.int8)


def mosaic(length=900, begin=300, end=600, seed=1):
    """Recombinant, major and minor parent; the tract comes from the minor parent."""
    major = lineage(length, seed)
    minor = mutated(major, 0.35, seed + 1)
    child = major.copy()
    child[begin - 1 : end] = minor[begin - 1 : end]
    return np.stack([mutated(child, 0.01, seed + 2), major, minor])


def test_random_streams():
    assert common.vertical_prefix(20, 3).tolist() == [3, 4, 4, 3, 9, 7, 9, 10, 5, 2, 11, 1, 7, 8, 1, 9, 6, 4, 8, 9]
    assert common.bootstrap_weights(5, 2, 3).tolist() == [[1, 2, 0], [1, 1, 2], [1, 1, 2], [1, 1, 1], [1, 0, 0]]


def test_normal_tail_is_near_the_true_one():
    for z in (0.5, 1.96, 3.0, 4.5):
        assert abs(common.normal_tail(z) - math.erfc(z / math.sqrt(2))) < 1e-5
    assert common.chi_p(0) == 1.0 and 0 < common.chi_p(60) < 1e-9


@pytest.mark.parametrize("plus,minus,drop", [(3, 3, 2), (4, 2, 2), (2, 5, 4), (5, 4, 3)])
def test_exact_excursion_probability(plus, minus, drop):
    hits = total = 0
    for ups in itertools.combinations(range(plus + minus), plus):
        h = top = worst = 0
        for i in range(plus + minus):
            h += 1 if i in ups else -1
            top = max(top, h)
            worst = max(worst, top - h)
        hits += worst >= drop
        total += 1
    assert abs(threeseq.exact_p(plus, minus, drop) - hits / total) < 1e-5


def test_binomial_tail():
    want = sum(math.comb(20, k) * 0.3**k * 0.7 ** (20 - k) for k in range(9, 21))
    assert abs(common.binomial_tail(20, 9, 0.3) - want) < 1e-12


def test_chi_profile_by_brute_force():
    flags = np.random.default_rng(3).integers(0, 2, 60)
    h = 8
    got = maxchi.profile(flags, h, 0, True)
    for i in range(60):
        left, right = sum(flags[(i - 1 - k) % 60] for k in range(h)), sum(flags[(i + k) % 60] for k in range(h))
        want = float(common.chi_square(h, left, right)) if abs(left - right) > 0 else 0.0
        assert abs(got[i] - want) < 1e-12


def test_karlin_altschul_root():
    lam, k = geneconv.lambda_k(30, 100, 4)
    z = math.exp(lam)
    assert abs(0.7 * z + 0.3 * z**-4 - 1) < 1e-9 and k > 0


@pytest.mark.parametrize("method", ["RDP", "GENECONV", "BootScan", "MaxChi", "CHIMAERA", "SISCAN", "3SEQ"])
def test_planted_tract_is_found(method):
    states = mosaic()
    o = Options(tests=1, boot_window=100, sis_window=100, sis_step=10, maxchi_window=70, chimaera_window=60)
    if method == "SISCAN":
        outlier = (states[1] % 4 + 1).astype(np.int8)
        found = windows.siscan(states, o, None, outlier)
    else:
        found = scan.METHODS[method](states, o)
    assert found, method
    best = min(found, key=lambda c: c.corrected_p)
    assert overlap(best.begin, best.end, 300, 600, 900) > 0.5
    assert best.corrected_p < 0.05
    if method in ("3SEQ", "MaxChi", "RDP"):
        assert best.recombinant == 0


@pytest.mark.parametrize("method", ["RDP", "GENECONV", "MaxChi", "CHIMAERA", "3SEQ"])
def test_nothing_is_found_without_recombination(method):
    base = lineage(900, 11)
    states = np.stack([mutated(base, 0.1, s) for s in (12, 13, 14)])
    assert scan.METHODS[method](states, Options(cutoff=0.001)) == []


def test_empty_and_short_profiles():
    for states in (np.zeros((3, 50), np.int8), np.ones((3, 50), np.int8), np.array([[1], [2], [3]], np.int8)):
        for m in scan.METHODS.values():
            assert m(states, Options()) == []
        assert len(Variable(states)) <= 1


def test_scan_does_not_depend_on_partitions(spark):
    rows = [(0, i, [int(x) for x in r]) for i, r in enumerate([*mosaic(300, 100, 200), lineage(300, 9)])]
    df = spark.createDataFrame(rows, "dataset_id long, seq_id int, states array<tinyint>")
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, scan.scan(df, Options(tests=4)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1] and got[0]
    events = rounds.cyclic_scan(df, Options()).collect()
    assert events and events[0].round == 1


@pytest.mark.parametrize("method", ["RDP", "GENECONV", "BootScan", "MaxChi", "CHIMAERA", "SISCAN", "3SEQ"])
def test_recheck_and_plot(method):
    from tractus.operators.kernels import review

    states, o = mosaic(), Options(boot_window=100, sis_window=100, sis_step=10)
    p = review.recheck(method, states, 300, 600, o)
    assert 0 <= p <= 1 and (method == "SISCAN" or p < 1e-3)
    assert review.recheck(method, np.ones((3, 50), np.int8), 5, 20, o) == 1.0
    pos, values = review.plot(method, states, o)
    assert values.shape == (3, len(pos)) and len(pos) > 10 and np.isfinite(values).all()


def test_pearson_of_six_points():
    from tractus.operators.kernels import consensus

    assert consensus.pearson6(range(6), range(6)) == (1.0, 0.0)
    assert consensus.pearson6([1] * 6, range(6)) == (0.0, 1.0)
    # t = 2.776 is the two-sided 5 % point of four degrees of freedom; r follows from it.
    r = 2.776445 / math.sqrt(4 + 2.776445**2)
    x = np.array([1, -1, 0, 0, 1, -1.0])
    y = np.array([1, 1, -2, 0, 0, 0.0]) / math.sqrt(6) * math.sqrt(x @ x)
    got, p = consensus.pearson6(x, r * x + math.sqrt(1 - r * r) * y)
    assert abs(got - r) < 1e-9 and abs(p - 0.05) < 1e-4
    own = np.array([[1.0, 2, 3], [3, 2, 1.5]])
    assert consensus.relabelled(own[:, [2, 0, 1]], own)[0] > 0.999


def test_erased_data_ban_windows_and_split_tracts():
    from tractus.operators.kernels import consensus

    states = mosaic()
    assert consensus.gaps(np.array([1, *[0] * 9, 1, *[0] * 10])).sum() == 10
    assert consensus.pieces(8, 3, np.isin(np.arange(10), (8, 9))) == [(8, 8), (1, 3)]
    whole = threeseq.discover(states, Options())[0]
    assert consensus.split(whole, states, Options()) is whole
    holed = states.copy()
    holed[0, 399:430] = 0
    c = min(threeseq.discover(holed, Options()), key=lambda c: c.corrected_p)
    part = consensus.split(c, holed, Options())
    assert part is not None and part.detail["split"] and (part.end < 400 or part.begin > 430)
    v = Variable(holed)
    cut = maxchi.cuts(holed, v.pos)
    assert cut.sum() == 1
    at = int(np.flatnonzero(cut)[0])
    chi = maxchi.profile(v.match[0], 10, 0, True, cut)
    assert (np.delete(chi[at - 9 : at + 10], 9) == 0).all()
    inner, outer = consensus.support_shares(states, 300, 600)
    assert inner > 0.9 and outer > 0.9
