"""Nearest intervals on the circle and sites with data, against lists."""

import random

from tractus.operators import matching as M

N = 40


def span(low, high):
    return [(low - 1 + k) % N + 1 for k in range((high - low) % N + 1)]


def test_against_lists(spark):
    rng = random.Random(4)
    seqs = {(d, i): [0 if rng.random() < 0.4 else 1 for _ in range(N)] for d in range(8) for i in range(3)}
    events = [(e, e % 8, 0, 1, 2, rng.randint(1, N), rng.randint(1, N)) for e in range(60)]
    intervals = [(e, rng.randint(1, N), rng.randint(1, N)) for e in range(59) for _ in range(rng.randint(1, 4))]
    ev = spark.createDataFrame(events, "event_id long, dataset_id long, a int, b int, c int, begin int, end int")
    iv = spark.createDataFrame([*intervals, *intervals[:5], (3, None, 4)], "event_id long, low int, high int")
    sq = spark.createDataFrame([(*k, v) for k, v in seqs.items()], "dataset_id long, seq_id int, states array<int>")
    got = {(r.event_id, r.side): r for r in M.repositioned(M.matched(ev, iv, N), ev, sq, N).collect()}
    assert len(got) == 2 * 59
    for e, d, *_, begin, end in events[:59]:
        for side, site in (("begin", begin), ("end", end)):
            mine = [(min(min(abs(p - site), N - abs(p - site)) for p in span(low, high)), low, high) for x, low, high in intervals if x == e]
            r, (distance, low, high) = got[e, side], min(mine)
            assert (r.site, r.distance, r.low, r.high) == (site, distance, low, high)
            has = [all(seqs[d, i][p - 1] for i in range(3)) for p in span(low, high)]
            half = (len(has) - 1) // 2
            steps = [(abs(k - half), k) for k, x in enumerate(has) if x]
            assert r.gap == (not has[half]) and r.moved_to == (span(low, high)[min(steps)[1]] if steps else None)


def test_nothing_to_match(spark):
    ev = spark.createDataFrame([(1, 1, 0, 1, 2, None, 4)], "event_id long, dataset_id long, a int, b int, c int, begin int, end int")
    iv = spark.createDataFrame([(1, 38, 2)], "event_id long, low int, high int")
    assert [(r.side, r.distance) for r in M.matched(ev, iv, N).collect()] == [("end", 2)]
    assert M.matched(ev, iv.limit(0), N).collect() == M.matched(ev.limit(0), iv, N).collect() == []
