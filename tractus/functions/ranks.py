"""Combinations by their rank, as column arithmetic: pairs a < b and triplets a < b < c of 0, 1, 2, ...

Ranks ascend by the last member, then the one before it, so they do not depend on how many members there are: the pairs
of n members are the ranks below n (n - 1) / 2, the triplets those below n (n - 1) (n - 2) / 6. Work over all triplets of a
group is dealt as ranges of ranks; no join carries it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole(x: Column, y: int) -> Column:
    return F.floor(x / y).cast("long")


def pairs_of(n: Column) -> Column:
    """n over 2."""
    n = n.cast("long")
    return _whole(n * (n - 1), 2)


def triplets_of(n: Column) -> Column:
    """n over 3; exact while n (n - 1) / 2 times n is below 2 ** 53, that is up to 200,000 members."""
    n = n.cast("long")
    return _whole(pairs_of(n) * (n - 2), 3)


def _largest(rank: Column, root: Column, count: Callable[[Column], Column]) -> Column:
    """The largest number whose count is not above the rank; its root is off by one or two."""
    near = root.cast("long")
    return F.coalesce(*[F.when(count(near + d) <= rank, near + d) for d in (3, 2, 1, 0)])


def _last_of_pair(r: Column) -> Column:
    return _largest(r, F.greatest(F.floor(F.sqrt(2.0 * r.cast("double"))) - 1, F.lit(0)), pairs_of)


def _last_of_triplet(r: Column) -> Column:
    return _largest(r, F.floor(F.cbrt(6.0 * r.cast("double"))), triplets_of)


def _less(count: Callable[[Column], Column], rank: Column, member: Column) -> Column:
    return rank - count(member)


def _staged(rows: DataFrame, rank: str, k: int) -> tuple[DataFrame, list[str]]:
    """rows with an array for each member, beside the array of ranks. Each array is a column of its own, so that no
    expression holds another several times, and nothing above the generator can be pushed into them."""
    stage, left, out = rows, rank, []
    for size, last, count in ((3, _last_of_triplet, triplets_of), (2, _last_of_pair, pairs_of))[3 - k :]:
        stage = stage.withColumn(f"_m{size}", F.transform(left, last))
        stage = stage.withColumn(f"_left{size}", F.zip_with(left, f"_m{size}", partial(_less, count)))
        left, out = f"_left{size}", [f"_m{size}", *out]
    return stage, [left, *out]


def with_pairs(rows: DataFrame, ranks: Column, a: str, b: str) -> DataFrame:
    """A row for each of the ranks (an array): a and b of its pair, besides the columns of rows."""
    stage, parts = _staged(rows.withColumn("_ranks", ranks), "_ranks", 2)
    return stage.select(*rows.columns, F.inline(F.arrays_zip(*[F.col(p).alias(n) for p, n in zip(parts, (a, b), strict=True)])))


def with_triplets(rows: DataFrame, ranks: Column, a: str, b: str, c: str) -> DataFrame:
    """A row for each of the ranks (an array): a, b and c of its triplet, besides the columns of rows."""
    stage, parts = _staged(rows.withColumn("_ranks", ranks), "_ranks", 3)
    return stage.select(*rows.columns, F.inline(F.arrays_zip(*[F.col(p).alias(n) for p, n in zip(parts, (a, b, c), strict=True)])))


def blocks(count: Column, size: int) -> Column:
    """Numbers of the ranges of so many ranks, to be exploded; none where nothing is counted."""
    return F.when(count > 0, F.sequence(F.lit(0).cast("long"), _whole(count - 1, size)))


def block_ranks(block: Column, count: Column, size: int) -> Column:
    """The ranks of a range."""
    return F.sequence(block * size, F.least(block * size + size, count) - 1)
