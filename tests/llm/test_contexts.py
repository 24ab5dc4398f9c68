"""Seating, and word contexts of the language model."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractus.llm import lm, seating

D = 0.7


def law(c, x):
    """Of the tables of c customers: weights of all paths, added up by their openings."""
    now = {1: 1.0}
    for m in range(1, c):
        new = Counter()
        for t, w in now.items():
            new[t] += w * (m - D * t)
            new[t + 1] += w * x
        now = new
    p = np.array([now[t] for t in range(1, c + 1)])
    return p * x / (p * x).sum()


@pytest.mark.parametrize(("c", "x"), [(2, 0.5), (5, 0.3), (8, 3.0), (30, 0.05)])
def test_tables_follow_their_law(c, x):
    n = 20_000
    seed = seating.mixed(np.arange(n).astype(np.uint64))
    rate, sweep = np.zeros(n, np.float32), np.zeros(n, np.int16)
    for k in range(1, 7):
        _, t, rate, sweep = seating.moved(np.full(n, c), rate, sweep, np.full(n, x), seed, k, D)
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - law(c, x)).max() < 0.015


def test_large_dishes_follow_the_same_path(monkeypatch):
    r = np.random.default_rng(1)
    c, x, seed = r.integers(0, 3000, 200), r.random(200) * 50, seating.mixed(np.arange(200).astype(np.uint64))
    one = seating.seat(c, x, x + 1, seed, D)
    monkeypatch.setattr(seating, "ABREAST", 3)
    monkeypatch.setattr(seating, "BLOCK", 17)
    two = seating.seat(c, x, x + 1, seed, D)
    assert (one[0] == two[0]).all() and np.allclose(one[1], two[1])
    assert (one[0][c > 0] >= 1).all() and (one[0] <= c).all()


def test_gamma_moments():
    for shape in (0.3, 1.0, 7.5):
        g = seating.gamma(np.full(50_000, shape), seating.mixed(np.arange(50_000).astype(np.uint64)))
        assert abs(g.mean() - shape) < 0.05 * shape and abs(g.var() - shape) < 0.1 * shape
    assert seating.gamma(np.zeros(3), np.arange(3).astype(np.uint64)).tolist() == [0, 0, 0]


TEXTS = ["red house", "red house", "red house", "blue car", "blue car", "house of red", "", "Red HOUSE\tof blue"] * 3


def _state(table):
    return next(b for k, _, b in lm._read(lm._of(table, lm.STATE).toArrow()))


def test_scores_are_those_of_the_seating(spark):
    rows = [(i, t, True) for i, t in enumerate(TEXTS)] + [(100, "red house", False), (101, "house red", False), (102, None, False), (103, "red zebra", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    texts = lm.coded(docs, train="train", keep=["doc_id"])
    model = lm.fit(texts)
    score = {r.doc_id: r.score for r in lm.score(texts, model).collect()}
    assert score[100] > score[101] + 0.5
    assert score[0] == score[100]
    # Other texts, coded like these, have the same scores.
    again = lm.score(lm.coded(docs, keep=["doc_id", "train"], like=model), model).collect()
    assert {r.doc_id: r.score for r in again} == score
    # By hand: counts from the texts, tables and word probabilities from the model's states.
    part = lm._Part.read(_state(model.words))
    own, ui, wi, c, *rest = lm.unpacked(_state(model.pairs))
    own = lm.summed(own)
    train = [[lm.END_TOKEN, *lm.tokens(t), lm.END_TOKEN] for _, t, learn in rows if learn]
    count = Counter(p for ws in train for p in zip(ws, ws[1:]))
    total = Counter(u for ws in train for u in ws[:-1])
    name = {int(lm.hashes([w])[0]): w for _, t, _ in rows for w in [*lm.tokens(t), lm.END_TOKEN]}
    place = {name[int(h)]: i for i, h in enumerate(part.h)}
    where = {(name[int(own[a])], name[int(own[b])]): i for i, (a, b) in enumerate(zip(ui, wi))}
    assert {p: int(c[i]) for p, i in where.items()} == {p: k for p, k in count.items() if k > 1}
    tables = [*rest[-(lm.SAMPLES - 1) :], rest[2]]

    def probability(u, w, k):
        a, t = part.samples[k]
        s, z = model.outside[k]
        p = (a[place[w]] + s * math.exp(part.log_base[place[w]])) / z
        n = count[u, w]
        return (n - model.inner * (tables[k][where[u, w]] if n > 1 else n) + (lm.STRENGTH + model.inner * t[place[u]]) * p) / (lm.STRENGTH + total[u])

    for i, t, _ in rows:
        ws = [lm.END_TOKEN, *lm.tokens(t), lm.END_TOKEN]
        want = sum(math.log10(sum(probability(u, w, k) for k in range(lm.SAMPLES)) / lm.SAMPLES) for u, w in zip(ws, ws[1:]))
        assert abs(score[i] - want) < 1e-5
    # Tables of a context are those of its pairs, and what it leaves is there for words without training.
    for k in range(lm.SAMPLES):
        for u in total:
            mine = sum(int(tables[k][where[p]]) if n > 1 else 1 for p, n in count.items() if p[0] == u)
            assert part.samples[k][1][place[u]] == mine
            assert 0.3 < sum(probability(u, w, k) for w in {w for ws in train for w in ws}) < 1


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: tuple(r) for r in lm.op4(df).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, dealt in ((4, df), (7, df.repartition(7)), (211, df.orderBy(F.rand(3)))):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = {r.doc_id: tuple(r) for r in lm.op4(dealt).collect()}
            assert all(np.allclose(got[i][4:], want[i][4:], rtol=1e-9, atol=0) and got[i][:4] == want[i][:4] for i in want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_several_shards_parts_and_buckets(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: tuple(r) for r in lm.op4(df).collect()}
    for name, size in (("SHARD_BYTES", 30_000), ("PART_BYTES", 70_000), ("BUCKET_BYTES", 50_000), ("PIECE", 1000), ("BLOB", 2000)):
        monkeypatch.setattr(lm, name, size)
    got = {r.doc_id: tuple(r) for r in lm.op4(df).collect()}
    assert all(np.allclose(got[i][4:], want[i][4:], rtol=1e-9, atol=0) and got[i][:4] == want[i][:4] for i in want)
