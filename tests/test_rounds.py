"""The cyclic scan as rounds of tables against lists; what runs again and what does not."""

from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.plain_cycle import Cycle
from tests.test_kernels import lineage, mosaic, mutated
from tractus.operators import rounds, scan
from tractus.operators.kernels.common import Options
from tractus.plans import catalog


def table(spark, alignments):
    rows = [(d, i * 2 + 1, [int(x) for x in r]) for d, rows in alignments.items() for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "dataset_id long, seq_id int, states array<tinyint>")


def events(df):
    out = {}
    for r in df.orderBy("dataset_id", "round").collect():
        out.setdefault(r.dataset_id, []).append((r["round"], r.method, *((r[x] - 1) // 2 for x in ("recombinant", "major", "minor")), r.begin, r.end, round(r.corrected_p, 12), r.supports, r.methods, r.scheduled, r.executed))
    return out


def two_events():
    a, c = lineage(900, 21), lineage(900, 23)
    b, d = mutated(a, 0.4, 25), mutated(c, 0.4, 26)
    one, two = a.copy(), c.copy()
    one[299:500], two[599:800] = b[299:500], d[599:800]
    return [one, two, a, b, c, d]


def gapped():
    """Runs of missing sites across tracts, a row of few sites, two equal rows."""
    rows = [r.copy() for r in two_events()]
    rows[0][380:420] = 0
    rows[3][100:640] = 0
    return [*rows, np.where(np.arange(900) < 25, rows[2], 0), rows[2].copy()]


@pytest.mark.parametrize("methods", [("RDP", "3SEQ"), ("MaxChi", "SISCAN", "3SEQ")])
def test_rounds_against_lists(spark, methods):
    o = Options(rdp_window=30, sis_window=100, sis_step=25, sis_permutations=20)
    held = {4: two_events(), 9: gapped(), 5: [*mosaic(), lineage(900, 31)], 6: [lineage(900, s) for s in (41, 42, 43)], 7: [lineage(900, s) for s in (51, 52)]}
    got = events(rounds.cyclic_scan(table(spark, held), o, methods))
    want = {d: e for d, rows in held.items() if len(rows) > 2 and (e := Cycle(rows, o, methods).run())}
    assert got == want
    assert {e[2] for e in got[4]} >= {0, 1} and all(e[-1] <= e[-2] for d in got.values() for e in d)
    assert all(e[-1] < e[-2] for d in got.values() for e in d if e[0] > 1) and any(e[0] > 1 for d in got.values() for e in d)


def test_clean_triplets_never_run_again(spark):
    """The blocks of a later round: every triplet has a dirty row, each once, and none has two rows of one original."""
    o = Options(rdp_window=30)
    first = rounds.numbered(table(spark, {1: two_events(), 2: gapped()})).drop("seq_id")
    tracts = spark.createDataFrame([(1, 0, 300, 500, 1), (2, 2, 10, 20, 1)], "dataset_id long, row int, begin int, end int, number int")
    after, dirty = rounds.erased(first, tracts, o)
    assert sorted(map(tuple, dirty.collect())) == [(1, 0), (1, rounds.FIRST + 1), (2, 2)]
    live = after.filter(rounds.usable(F.col("states"), o))
    held = {}
    for r in live.orderBy("dataset_id", "row").collect():
        held.setdefault(r.dataset_id, []).append((r.row, r.origin))

    def expand(work):
        for r in work.collect():
            ids, origins = (np.array(x) for x in zip(*held[r.dataset_id], strict=True))
            yield from ((r.dataset_id, tuple(ids[t].tolist())) for t in scan.triplets_of_block(r.low, r.high, r.beside, r.listed, ids, origins))

    work, all_ = list(expand(scan.triplets_with(live, dirty))), list(expand(scan.all_triplets(live)))
    some = spark.createDataFrame([(d, *t) for d, t in all_[::3]], "dataset_id long, a int, b int, c int")
    assert sorted(expand(scan.listed_triplets(some))) == sorted(all_[::3])
    own = {(r.dataset_id, r.row): r.origin for r in after.collect()}
    changed = {tuple(r) for r in dirty.collect()}
    assert len(set(work)) == len(work) and len(set(all_)) == len(all_)
    assert set(work) == {(d, t) for d, t in all_ if any((d, i) in changed for i in t)}
    assert all(len({own[d, i] for i in t}) == 3 for d, t in all_)
    n = {r.dataset_id: r.executed for r in rounds.executed_sizes(live, dirty).collect()}
    m = {r.dataset_id: r.scheduled for r in rounds.schedule_sizes(live).collect()}
    assert n == {d: sum(x == d for x, _ in work) for d in (1, 2)} and m == {d: sum(x == d for x, _ in all_) for d in (1, 2)}


def test_blocks_of_many_rows(spark):
    """More triplets than a block has; every one is in one block. Ranks are those of the columns."""
    rows = [(3, i, i, [1]) for i in range(30)]
    df = spark.createDataFrame(rows, "dataset_id long, row int, origin int, states array<tinyint>")
    work, ids = scan.all_triplets(df).collect(), np.arange(30)
    assert max(r.high - r.low for r in work) == scan.BLOCK and len(work) == -(-4060 // scan.BLOCK)
    got = [tuple(t) for r in sorted(work, key=lambda r: r.low) for t in scan.triplets_of_block(*r[1:], ids, ids).tolist()]
    assert got == sorted(combinations(range(30), 3), key=lambda t: t[::-1])
    for n in (3, 1000, 199_999):
        assert scan.unranked(np.array([comb(n, 3) - 1, comb(n, 3)]), 3).tolist() == [[n - 3, n - 2, n - 1], [0, 1, n]]


def test_fragments(spark):
    """A tract of few sites, or equal to a row, leaves no fragment; a whole sequence is begin = end."""
    o = Options(rdp_window=5)
    base = list(range(1, 5)) * 10
    piece = [0] * 10 + base[10:30] + [0] * 10
    rows = [(d, i, r) for d in (1, 2, 3) for i, r in enumerate([base, piece if d == 2 else base[::-1], base[1:] + [1]])]
    first = rounds.numbered(spark.createDataFrame(rows, "dataset_id long, seq_id int, states array<tinyint>")).drop("seq_id")
    tracts = spark.createDataFrame([(1, 0, 38, 2, 7), (2, 0, 11, 30, 7), (3, 0, 5, 5, 7)], "dataset_id long, row int, begin int, end int, number int")
    after, dirty = rounds.erased(first, tracts, o)
    got = {(r.dataset_id, r.row): r for r in after.collect()}
    assert got[1, 0].states == [0, 0, *base[2:37], 0, 0, 0] and (1, rounds.FIRST + 7) in got
    assert got[1, rounds.FIRST + 7].states == [*base[:2], *[0] * 35, *base[37:]] and got[1, rounds.FIRST + 7].origin == 0
    assert (2, rounds.FIRST + 7) not in got and got[3, 0].states == [0] * 40 and got[3, rounds.FIRST + 7].states == base
    assert dirty.count() == 5


def test_rediscovery_keeps_decided_events(spark):
    rows, o, methods = [*mosaic(), lineage(900, 31)], Options(), ("RDP", "3SEQ")
    df = table(spark, {1: rows})
    found = rounds.cyclic_scan(df, o, methods).orderBy("round").collect()
    first = {x: found[0][x] for x in ("recombinant", "begin", "end")}
    decide = lambda state, **new: spark.createDataFrame([(1, 1, *(first | new).values(), state)], "dataset_id long, round int, recombinant int, begin int, end int, state string")
    again = rounds.rediscovered(df, decide("accepted"), o, methods).orderBy("round").collect()
    assert [(e["round"], e.begin, e.end) for e in again] == [(e["round"], e.begin, e.end) for e in found[1:]]
    edited = rounds.rediscovered(df, decide("accepted", begin=1, end=10), o, methods).collect()
    assert any(250 < e.begin < 350 and 550 < e.end < 650 for e in edited) and min(e["round"] for e in edited) == 2
    assert rounds.rediscovered(df, decide("rejected"), o, methods).count() >= 1
    assert rounds.cyclic_scan(df.limit(0), o, methods).collect() == []


def test_registered_query_against_lists(spark):
    sf = "/root/testdata/sf0.001"
    o = catalog._options()
    held = {}
    for r in catalog._planted(spark, sf).orderBy("dataset_id", "seq_id").collect():
        held.setdefault(r.dataset_id, []).append(r.states)
    got = {}
    for r in catalog.queries()["cyclic_scan"](spark, sf).orderBy("dataset_id", "round").collect():
        got.setdefault(r.dataset_id, []).append((r["round"], r.method, r.recombinant, r.major, r.minor, r.begin, r.end, round(r.corrected_p, 12), r.supports, r.methods, r.scheduled, r.executed))
    assert got == {d: e for d, rows in held.items() if (e := Cycle(rows, o, ("RDP", "3SEQ")).run())}
