"""Combinations from their ranks, and the triplets made from them, against lists."""

from itertools import combinations
from math import comb

from pyspark.sql import functions as F

from tractus.functions import ranks
from tractus.operators import relations as R


def colex(n, k):
    return sorted(combinations(range(n), k), key=lambda t: t[::-1])


def test_all_small_ranks(spark):
    one = spark.range(1).select("id")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    assert [tuple(r)[1:] for r in ranks.with_triplets(one, upto(comb(60, 3)), "a", "b", "c").collect()] == colex(60, 3)
    assert [tuple(r)[1:] for r in ranks.with_pairs(one, upto(comb(200, 2)), "a", "b").collect()] == colex(200, 2)


def test_ranks_around_every_edge_of_large_numbers(spark):
    ends = [comb(c, 3) + d for c in (3, 999, 12_345, 100_000, 199_999) for d in (-1, 0, 1)] + [comb(100_000, 3) + comb(b, 2) + d for b in (2, 99_999) for d in (-1, 0)]
    df = spark.createDataFrame([(e,) for e in ends], "r long")
    for r in ranks.with_triplets(df, F.array("r"), "a", "b", "c").select("r", F.array("a", "b", "c").alias("t")).collect():
        a, b, c = r.t
        assert 0 <= a < b < c and comb(c, 3) + comb(b, 2) + a == r.r


def test_triplets_without_a_self_join(spark):
    rows = [(d, i * 3, f"x{i}") for d, n in ((1, 7), (2, 2), (3, 3), (4, 1), (9, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "dataset_id long, seq_id int, name string")
    out = R.triplets(df)
    want = [(d, *[v for i in t for v in (i * 3, f"x{i}")]) for d, n in ((1, 7), (3, 3), (9, 50)) for t in combinations(range(n), 3)]
    assert sorted(map(tuple, out.select("dataset_id", "a", "name_a", "b", "name_b", "c", "name_c").collect())) == sorted(want)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert R.triplets(df.limit(0)).count() == 0


def test_one_large_data_set_is_spread(spark):
    """300 rows of one data set: 4,455,100 triplets, on all cores."""
    df = spark.range(300).select(F.lit(5).cast("long").alias("dataset_id"), F.col("id").cast("int").alias("seq_id"))
    parts = R.triplets(df).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in parts) == comb(300, 3)
    assert len(parts) == 8 and max(r.n for r in parts) < comb(300, 3) / 4


def test_query_reference_triplets(spark):
    rows = [(d, i, (i * 5 + d) % 4) for d, n in ((1, 9), (2, 30), (3, 2)) for i in range(n)] + [(4, i, 0) for i in range(5)] + [(5, i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "dataset_id long, seq_id int, ref_group int")
    want = [(d, q, x, y) for d, q, g in rows if g == 0 for e, x, gx in rows if e == d and gx for f, y, gy in rows if f == d and gy and x < y and gx != gy]
    out = R.query_reference_triplets(df)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
