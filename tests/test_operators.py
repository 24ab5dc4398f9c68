"""Operators on small relations with known answers."""

import pytest

from tractus.functions import stats
from tractus.operators import events as E
from tractus.operators import profiles as P
from tractus.operators import relations as R
from tractus.sources import alignments as A


def seqs(spark, *rows):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(rows)], "dataset_id long, seq_id int, seq string")
    return df.select("dataset_id", "seq_id", A.encode_sequence(df.seq).alias("states"))


def test_encoding(spark):
    assert [r.states for r in seqs(spark, "acGu-N", "TTTTTT").collect()] == [[1, 2, 3, 4, 0, 0], [4] * 6]


def test_summary_of_ten_rows(spark):
    s = seqs(spark, *["ACGTACGTAC"] * 10)
    r = R.dataset_summary(s, 5).first()
    assert (r.active_count, r.n_triplets, r.correction) == (10, 120, 120)


def test_site_classes(spark):
    r = R.site_classes(A.cells(seqs(spark, "AACA", "AAC-", "ACGC", "ACGG"))).first()
    assert (r.variable_sites, r.informative_sites) == (3, 2)


def test_reference_groups(spark):
    names = ["REF-A:1", "x", "ref_b", "y|REF", "REFA", "REF"]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(names)], "dataset_id long, seq_id int, name string")
    assert {r.seq_id: r.ref_group for r in R.reference_groups(df).collect()} == {0: 1, 2: 2, 3: 3, 4: 1, 5: 4}


@pytest.mark.parametrize("b1,e1,b2,e2,want", [(1, 10, 6, 15, 0.5), (60, 5, 1, 5, 2 * 5 / 15), (1, 5, 6, 9, 0.0), (60, 5, 62, 3, 2 * 6 / 16)])
def test_overlap(spark, b1, e1, b2, e2, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(stats.overlap(*map(F.lit, (b1, e1, b2, e2, 64)))).first()[0] == pytest.approx(want)


def test_circular_windows_by_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(1)
    states = r.integers(1, 4, (3, 80))
    df = spark.createDataFrame([(0, i, s.tolist()) for i, s in enumerate(states)], "dataset_id long, seq_id int, states array<tinyint>")
    v = R.variable_sites(R.triplet_sites(df))
    x, y, z = states
    keep = np.flatnonzero(~((x == y) & (x == z)))
    match = (x == y)[keep].astype(int)
    n = len(keep)
    got = {(p.idx, p.pair): (p.l, p.r) for p in P.chi_profile(v, 6).collect()}
    for i in range(n):
        want = sum(match[(i - 1 - k) % n] for k in range(6)), sum(match[(i + k) % n] for k in range(6))
        assert got[i, 0] == want
    assert len(got) == 3 * n


def test_missing_runs_at_the_limit(spark):
    s = seqs(spark, "A" + "-" * 9 + "A", "A" + "-" * 10, "-" * 11)
    assert {r.seq_id: (r.first, r.last, r.sites) for r in P.missing_runs(A.cells(s)).collect()} == {1: (2, 11, 10), 2: (1, 11, 11)}


def test_merged_tracts_wrap_and_touch(spark):
    df = spark.createDataFrame([(0, 1, 60, 3), (0, 1, 4, 6), (0, 1, 8, 9), (0, 2, 5, 5)], "dataset_id long, recombinant int, begin int, end int")
    got = {(r.recombinant, r.lo, r.hi) for r in E.merged_tracts(df, "recombinant", 64).collect()}
    assert got == {(1, 1, 6), (1, 8, 9), (1, 60, 64), (2, 5, 5)}


def test_fragments_and_masks(spark):
    s = seqs(spark, "ACGTACGT", "AAAAAAAA")
    t = spark.createDataFrame([(0, 0, 7, 3, 5), (0, 0, 8, 7, 1), (0, 1, 9, 1, 1)], "dataset_id long, seq_id int, event_id long, begin int, end int")
    masked = {r.seq_id: r.t for r in E.masked_states(s, t).select("seq_id", E.as_text(E.F.col("states")).alias("t")).collect()}
    # begin = end is the whole sequence
    assert masked == {0: "-C---C--", 1: "--------"}
    frag = {r.event_id: r.t for r in E.fragments(s, t, 3).select("event_id", E.as_text(E.F.col("states")).alias("t")).collect()}
    assert frag == {7: "--GTA---", 8: "A-----GT", 9: "AAAAAAAA"}


def test_role_votes(spark):
    rows = [(1, r, m, s) for m, scores in enumerate([(3, 1, 1), (2, 2, 0), (0, 0, 5)]) for r, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "event_id long, role int, metric int, score int")
    r = E.role_votes(df).first()
    # 8 to role 0; 18 halved between 0 and 1; 20 to role 2
    assert (r.role, r.points) == (2, 20.0) and r.confidence == pytest.approx((20 - 17) / 46)


def test_siegmund_against_the_published_formula(spark):
    """Columns and kernel against the formula with the normal distribution of the standard library, and against the exact
    chance, of which it is an approximation."""
    import math

    from pyspark.sql import functions as F

    from tractus.operators.kernels import threeseq

    def plain(up, down, drop):
        n, x, b = up + down, down - up, drop - 0.5
        cdf = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
        arg = 2 * (2 * b - x) / n
        nu = (2 / arg) * (cdf(arg / 2) - 0.5) / ((arg / 2) * cdf(arg / 2) + math.exp(-arg * arg / 8) / math.sqrt(2 * math.pi))
        return 1 - math.exp(-nu * nu * (2 * (2 * b - x) * (b - x) / n + 1) * math.exp(-2 * b * (b - x) / n))

    cases = [(60, 80, 40), (100, 90, 35), (30, 30, 12), (200, 200, 45), (40, 60, 20), (5, 40, 36)]
    df = spark.createDataFrame(cases, "p int, m int, d int")
    for r in df.select("*", stats.siegmund(F.col("p"), F.col("m"), F.col("d")).alias("v")).collect():
        want = 1.0 if r.d <= r.m - r.p else plain(r.p, r.m, r.d)
        assert r.v == pytest.approx(want, rel=1e-3, abs=1e-9) and threeseq.siegmund(r.p, r.m, r.d) == pytest.approx(want, rel=1e-3, abs=1e-9)
        if r.d - (r.m - r.p) > 10 and r.p + r.m < 300:
            assert want == pytest.approx(threeseq.exact_p(r.p, r.m, r.d), rel=0.35, abs=0.01)
    assert spark.range(1).select(stats.siegmund(F.lit(0), F.lit(0), F.lit(1))).first()[0] == 0.0


def test_excursion_goes_round():
    """The two laps against a walk of explicit steps."""
    import numpy as np

    from tractus.operators.kernels import threeseq
    from tractus.operators.kernels.common import Options

    for seed in range(300):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(4, 30))
        pos, steps = np.sort(rng.choice(np.arange(1, 101), n, replace=False)), rng.choice([-1, 1], n)
        height, top, peak, size, end = 0, 0, 0, 0, 0
        for i, s in enumerate(steps):
            height += s
            if height > top:
                top, peak = height, i
            if top - height > size:
                size, end = top - height, i
        plain, total, walk = size, height, np.cumsum(steps)
        top = walk[peak]
        for i in range((peak if pos[peak] < pos[end] else end) + 1):
            now = total + walk[i]
            if now > top:
                top, peak = now, i
            if top - now > size:
                size, end = top - now, i
        want = (plain, size, int(pos[(peak + 1) % n]), int(pos[end]))
        assert threeseq.excursion(pos, steps, Options(), 100) == want
        assert threeseq.excursion(pos, steps, Options(circular=False), 100)[:2] == want[:2]
