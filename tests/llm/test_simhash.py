"""SimHash classes against all pairs of fingerprints, at the real sizes and with small tiles and every number of parts."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tractus.llm import common, simhash
from tractus.llm.graph import components


def plain(text):
    lower = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius=2):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ordered = sorted(up)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {f: find(f) for f in up}


def brute(rows):
    fps = [plain(t) for _, t in rows]
    of, least = classes(fps), {}
    for (k, _), f in zip(rows, fps, strict=True):
        if k is not None:
            least[of[f]] = min(k, least.get(of[f], k))
    return sorted(((k, f"{f:016x}", least.get(of[f])) for (k, _), f in zip(rows, fps, strict=True)), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((tuple(r) for r in simhash.op12(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len({x[2] for x in got}) < len(got)


def test_odd_rows(spark):
    rows = [(5, "A b\tC d"), (5, "A b\tC d"), (None, "a B c\x0bD"), (3, None), (2, ""), (9, " \n\x0c "), (None, "only null keys here now"), (4, "é É"), (6, "one"), (7, "Y " * 200_000), (1, "x\x1fy z\x85w"), (8, "日本語 テキスト \U0001f600 x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.withColumns({c: F.lit("own") for c in ("key", "fp", "k", "m", "component", "component_id", "fingerprint", "_salt")})
    assert sorted(map(tuple, simhash.op12(clash).collect()), key=str) == brute(rows)
    assert simhash.op12(docs.limit(0)).collect() == []


@pytest.mark.parametrize("parts", [4, 8, 16])
@pytest.mark.parametrize("tile", [5, 4096])
def test_tiles(spark, parts, tile):
    """Random fingerprints, chains of near ones, all one bit away from zero and from all ones, and a crowd of one count."""
    draw = random.Random(parts)
    fps = {draw.getrandbits(64) for _ in range(150)} | {1 << b for b in range(64)} | {(1 << 64) - 1 - (1 << b) for b in range(64)} | {0, (1 << 64) - 1}
    for _ in range(40):
        f = draw.getrandbits(64)
        for _ in range(5):
            fps.add(f)
            for _ in range(draw.choice((1, 2, 3))):
                f ^= 1 << draw.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = common.written(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), "test")
    found = simhash.links(table, 2, tile, parts)
    got = {r.node % (1 << 64): r.component % (1 << 64) for r in components(found, "u", "v").collect()}
    want = classes(fps)
    group = lambda of: sorted(sorted(f for f in fps if of.get(f, f) == c) for c in {of.get(f, f) for f in fps})
    assert group(got) == group(want)
    pairs = [tuple(r) for r in simhash.tile_pairs(simhash.tiles(table, parts, 2, tile), parts, 2).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})


def test_wider_radius(spark):
    draw = random.Random(3)
    fps = {draw.getrandbits(64) & ((1 << 20) - 1) for _ in range(120)}
    table = common.written(spark.createDataFrame([(f,) for f in fps], "fp long"), "test")
    got = {r.node: r.component for r in components(simhash.links(table, 4, 7, 8), "u", "v").collect()}
    want = classes(fps, 4)
    assert {f: got.get(f, f) for f in fps} == want


def test_salted_join(spark):
    """One key with nearly all rows, and many rare ones, against the plain join."""
    rows = spark.range(5000).select(F.when(F.col("id") % 50 > 0, 7).otherwise(F.col("id")).alias("a"), "id")
    counts = rows.groupBy("a").agg(F.count("*").alias("m")).withColumn("v", F.col("a") * 2)
    got = common.salted_join(rows, counts, ["a"], 100)
    assert sorted(map(tuple, got.select("a", "id", "v").collect())) == sorted((r.a, r.id, r.a * 2) for r in rows.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
