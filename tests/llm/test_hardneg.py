"""Mined negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractus.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    held = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        held[i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(x)) for x in e)] = None
    dims = max((len(k[2]) for k in held), default=0)
    ids, labels = [k[0] for k in held], [k[1] for k in held]
    m = np.array([list(k[2]) + [0] * (dims - len(k[2])) for k in held], dtype=object).reshape(len(ids), dims)
    out = []
    for a in range(len(ids)):
        if ids[a] % 100:
            continue
        scored = sorted((-int(s), ids[b], labels[b]) for b, s in enumerate(m @ m[a]) if ids[b] != ids[a])
        for p in [x for x in scored if x[2] == labels[a]][:5]:
            found = [x for x in scored if x[2] != labels[a] and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]][:5]
            out += [(ids[a], p[1], r, x[1], -p[0], -x[0]) for r, x in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in hardneg.op11(df).collect())


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert len(want) > 50 and got(df) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_copies_and_small_blocks(spark, monkeypatch, seed):
    """Near clusters of mixed labels, one vector with a third of all rows, many equal scores; blocks of few rows, so that
    several rounds and many annuli are met."""
    for name, value in (("BLOCK", 37), ("CHUNK", 3), ("PIVOTS", 7)):
        monkeypatch.setattr(hardneg, name, value)
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(9, 6)) * 3
    rows = [(i, [float(x) for x in np.round(centres[i % 9] + draw.normal(size=6) * 0.2, 2)], int(draw.integers(0, 4))) for i in range(1500)]
    rows += [(i, [float(x) for x in centres[0]], i % 5) for i in range(1500, 2300)]
    df = spark.createDataFrame([(i, np.float32(e).tolist(), label) for i, e, label in rows], SCHEMA)
    want = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert len(want) > 100 and got(df) == want


def test_odd_rows(spark):
    draw = random.Random(5)
    near = lambda: [draw.uniform(0.4, 0.6) for _ in range(4)]
    rows = [(i, near(), i % 3) for i in range(0, 120)]
    rows += [rows[0], rows[0], rows[1], rows[1]]
    rows += [(None, near(), 1), (200, None, 1), (300, [0.5, None, 0.5, 0.5], 1), (400, [0.5, float("nan"), 0.5, 0.5], 1), (500, [0.5, float("inf"), 0.5, 0.5], 1), (600, near(), None), (700, [], 1), (800, [0.5, 0.5], 2), (900, near() + [0.1], 0), (7, near(), 1), (-100, near(), 2), (1000, [-x for x in near()], 1), (1100, near(), 77)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    clash = df.withColumns({c: F.lit("own") for c in ("key", "v", "anchor", "pivot", "distance", "score", "rank", "chunk")})
    assert want and got(clash) == want
    assert got(df.limit(0)) == [] and got(df.filter("vec_id = 100")) == [] and got(df.filter("vec_id = 101")) == []
    far = spark.createDataFrame([(100, [1e30, 1.0], 1), (1, [1e30, 1.0], 1)], SCHEMA)
    with pytest.raises(ValueError, match="component"):
        hardneg.op11(far)
