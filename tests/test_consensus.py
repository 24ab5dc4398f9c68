"""Late consensus against plain lists on random evidence with ties, and on planted relations."""

import random

import pytest

from tests.test_late import planted, tables
from tractus.operators import consensus as C
from tractus.tables import settled

ROWS = "event_id long, role int, seq_id int, inside double, outside double, tree_inside double, tree_outside double, top double, best double, vetoed boolean, affinity boolean, foreign boolean, member boolean, direct boolean"


def made(seed, events=12, n=14):
    """Evidence, anchors and all distances of events with few different values, so that limits tie."""
    rng = random.Random(seed)
    rows, anchors, distances = [], [], []
    for e in range(events):
        for s in range(3, n):
            six = [(rng.randint(0, 6) / 4, rng.randint(0, 6) / 4) for _ in range(3)]
            for r in range(3):
                best = rng.choice([0.0, 0.84, 0.9, 0.96, 0.97, 0.995, 1.0])
                rows.append((e, r, s, *six[r], float(rng.randint(0, 5)), float(rng.randint(0, 5)), max(best, rng.choice([0.5, 0.992])), best, rng.random() < 0.1, rng.random() < 0.5, rng.random() < 0.5, best > 0 and rng.random() < 0.8, best > 0.83))
        turned = rng.random() < 0.6
        anchors += [(e, r, float(rng.randint(1, 5)), float(rng.randint(1, 5)), turned) for r in range(3)]
        distances += [(e, g, a, b, rng.randint(0, 9) / 4) for g in (0, 1) for a in range(n) for b in range(a + 1, n)]
    return rows, anchors, distances


def frames(spark, rows, anchors, distances):
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(anchors, "event_id long, role int, tree_inside double, tree_outside double, turned boolean"), spark.createDataFrame(distances, "event_id long, region int, s1 int, s2 int, distance double")


def without(items, gone):
    """One by one: the last item takes the place of each that goes."""
    items, p = list(items), 0
    while p < len(items):
        if items[p] in gone:
            items[p] = items[-1]
            items.pop()
        else:
            p += 1
    return items


def nearest(ev):
    """ev: {(role, seq): row}; lists by role."""
    lists = {r: sorted(s for (q, s), v in ev.items() if q == r and v["member"]) for r in range(3)}
    rounds = 0
    while True:
        rounds += 1
        listed = {s for x in lists.values() for s in x}
        new = {}
        for r in range(3):
            out = [v for (q, s), v in ev.items() if q == r and s not in listed]
            gone = set()
            for s in lists[r]:
                v = ev[r, s]
                within = sum(not out or v[x] <= min(o[x] for o in out) for x in ("inside", "outside"))
                if v["vetoed"] or v["best"] <= {2: 0.83, 1: 0.95, 0: 0.99}[within]:
                    gone.add(s)
            new[r] = without(lists[r], gone)
        if new == lists:
            return lists, rounds
        lists = new


def wide(lists, ev, anchor):
    lists = {r: list(x) for r, x in lists.items()}
    listed = {s for x in lists.values() for s in x}
    left = {s for (_, s), v in ev.items() if v["member"]} - listed
    known = {s for (_, s), v in ev.items() if v["direct"]} - left
    add = {}
    for r in range(3):
        out = [v for (q, s), v in ev.items() if q == r and s not in listed | known]
        add[r] = sorted(s for (q, s), v in ev.items() if q == r and s not in listed | left and v["direct"] and not v["vetoed"] and all(not out or v[x] < min(o[x] for o in out) for x in ("inside", "outside")))
    for r in range(3):
        lists[r] += add[r]
    listed = {s for x in lists.values() for s in x}
    for r in range(3):
        lists[r] += sorted(s for (q, s), v in ev.items() if q == r and s not in listed | left and not v["vetoed"] and v["tree_inside"] < anchor[r][0] and v["tree_outside"] < anchor[r][1])
    return lists


def pruned(lists, ev, anchor, chosen):
    gone = {s for s in lists[chosen] if anchor[chosen][2] and ev[chosen, s]["foreign"] and ev[chosen, s]["top"] < 0.99}
    return lists | {chosen: without(lists[chosen], gone)}


def score(r, s, v, anchor, first, final):
    points = v["member"] + (s in first[r]) + v["affinity"] + (v["tree_inside"] < anchor[r][0] and v["tree_outside"] < anchor[r][1])
    return round(points * (1 + (s in final[r])) * v["best"], 9)


def passes(ev, sc, far, saved, n):
    """far: {(region, a, b): distance} both ways. Representatives are rows 0, 1 and 2."""
    have, seqs = {}, range(3, n)
    six = {s: tuple((ev[r, s]["inside"], ev[r, s]["outside"]) for r in range(3)) for s in seqs}
    for s in seqs:
        top = max(sc[r, s] for r in range(3))
        best = [r for r in range(3) if sc[r, s] == top]
        if len(best) == 1 and top >= 2:
            have[best[0], s] = "primary"
    one = dict(have)
    placed = {s for _, s in one}
    for s in set(seqs) - placed:
        for r in range(3):
            near = [min((far[g, s, o], o) for o in range(n) if o != s)[1] for g in (0, 1)]
            beside = sc[r, s] > 0 and all((r, o) in one or o == r for o in near)
            if beside or any(q == r and six[o] == six[s] for q, o in one) or six[s][r] == (0, 0):
                have[r, s] = "equivalent"
    two = dict(have)
    placed = {s for _, s in two}
    for s in set(seqs) - placed:
        for r in range(3):
            reach = [six[o][r] for q, o in two if q == r]
            if reach and all(six[s][r][g] < min(six[s][q][g] for q in range(3) if q != r) and six[s][r][g] <= max(x[g] for x in reach) for g in (0, 1)):
                have[r, s] = "straggler"
    if any(saved[r] and not any(q == r for q, _ in have) for r in range(3)):
        return {(r, s): "restored" for r in range(3) for s in saved[r]}
    return have


def as_lists(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.event_id, r.role), {})[r.place] = r.seq_id
    assert all(sorted(x) == list(range(len(x))) for x in out.values())
    return {k: [x[i] for i in range(len(x))] for k, x in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_lists(spark, seed):
    n, (rows, anchors, distances) = 14, made(seed)
    ev, an, di = frames(spark, rows, anchors, distances)
    events = spark.createDataFrame([(e, [0, 1, 2]) for e in range(12)], "event_id long, reps array<int>")
    chosen = spark.createDataFrame([(e, e % 3) for e in range(12)], "event_id long, role int")
    first, final = C.final_lists(ev, an, chosen)
    scored = C.scores(ev, an, first, final)
    got_first, got_final, got_scores = as_lists(first), as_lists(final), {(r.event_id, r.role, r.seq_id): r.score for r in scored.collect()}
    back = {(r.event_id, r.role, r.seq_id): r["pass"] for r in C.rebuilt(scored, di, events, final).collect()}
    names = [x.split()[0] for x in ROWS.split(", ")]
    kinds, most, moved = set(), 0, False
    for e in range(12):
        mine = {(r[1], r[2]): dict(zip(names, r, strict=True)) for r in rows if r[0] == e}
        anchor = {a[1]: a[2:] for a in anchors if a[0] == e}
        far = {(g, *p): d for x, g, a, b, d in distances if x == e for p in ((a, b), (b, a))}
        lists, rounds = nearest(mine)
        most = max(most, rounds)
        moved |= any(x != sorted(x) for x in lists.values())
        last = pruned(wide(lists, mine, anchor), mine, anchor, e % 3)
        sc = {(r, s): score(r, s, v, anchor, lists, last) for (r, s), v in mine.items()}
        want = passes(mine, sc, far, last, n)
        for r in range(3):
            assert got_first.get((e, r), []) == lists[r]
            assert got_final.get((e, r), []) == last[r]
        assert all(got_scores[e, *k] == pytest.approx(x) for k, x in sc.items())
        assert {k[1:]: p for k, p in back.items() if k[0] == e} == want
        kinds |= set(want.values())
    assert most > 2 and moved and kinds >= {"primary", "equivalent"}


def test_an_emptied_role_gives_the_saved_lists(spark):
    rows, anchors, distances = made(3, 1, 6)
    rows = [(*r[:3], 1.0 + r[1], 1.0 + r[1], *r[5:]) for r in rows]
    ev, _, di = frames(spark, rows, anchors, distances)
    scored = spark.createDataFrame([(*r, 5.0 if r[1] == 0 else 0.0) for r in rows], ROWS + ", score double")
    events = spark.createDataFrame([(0, [0, 1, 2])], "event_id long, reps array<int>")
    saved = spark.createDataFrame([(0, 0, 0, 3), (0, 1, 0, 4)], "event_id long, role int, place int, seq_id int")
    out = {(r.role, r.seq_id, r["pass"]) for r in C.rebuilt(scored, di, events, saved).collect()}
    assert out == {(0, 3, "restored"), (1, 4, "restored")}
    out = {(r.role, r.seq_id, r["pass"]) for r in C.rebuilt(scored, di, events, saved.filter("role = 0")).collect()}
    assert out == {(0, s, "primary") for s in (3, 4, 5)}


@pytest.mark.parametrize("seed", range(3))
def test_gaps_take_the_last_rows(spark, seed):
    rng = random.Random(seed)
    lists = {(e, r): rng.sample(range(100), rng.randint(0, 12)) for e in range(6) for r in range(3)}
    gone = {k: {s for s in x if rng.random() < (0.0, 0.5, 1.0, 0.3, 0.7, 0.9)[k[0]]} for k, x in lists.items()}
    rows = [(*k, p, s, s in gone[k]) for k, x in lists.items() for p, s in enumerate(x)]
    got = as_lists(C.compacted(spark.createDataFrame(rows, "event_id long, role int, place int, seq_id int, gone boolean")))
    assert got == {k: y for k, x in lists.items() if (y := without(x, gone[k]))}


def test_rounds_end(spark):
    from pyspark.sql import functions as F

    start = spark.createDataFrame([(k, k) for k in range(40)], "g long, v long")
    count = lambda df: df.select("g", F.greatest(F.col("v") - 1, F.lit(0)).alias("v"), (F.col("v") > 0).alias("changed"))
    assert {tuple(r) for r in settled(start, count, "t", 41).collect()} == {(k, 0) for k in range(40)}
    with pytest.raises(RuntimeError):
        settled(start, count, "t", 5)
    assert settled(start.limit(0), count, "t", 1).collect() == []


def test_planted_rows(spark):
    seqs, events = tables(spark, {1: (planted(), 121, 260), 2: (planted(400, 350, 60), 350, 60)})
    out = {(r.event_id, r.role, r.seq_id): r for r in C.late_consensus(seqs, events).collect()}
    for e in (10, 20):
        assert {(e, 0, 3), (e, 1, 4), (e, 2, 5)} <= set(out)
        assert not any(k[0] == e and k[2] == 6 for k in out)
    assert all(r["pass"] != "primary" or r.score >= C.LEAST_SCORE for r in out.values())
    assert C.late_consensus(seqs, events.limit(0)).collect() == []
    assert C.late_lists(seqs.filter("seq_id < 3"), events).collect() == []
