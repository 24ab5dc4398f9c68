"""BootScan's bootstrap over alignments: distances of a pair in each window and replicate, and a triplet's votes.

A pair is in n - 2 triplets. Rows are cut into blocks, and triplets are dealt as tiles of three blocks: a tile measures its
pairs once, all windows and replicates of them by one product with the weights, and compares them for up to BLOCK ** 3
triplets; so no profile is shuffled. Replicates weight a window's sites; the weights are the same for every window and pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..ship import ensure
from .kernels.common import bootstrap_weights
from .profiles import window_geometry
from .relations import TRIPLET, pairs
from .scan import unranked

#: Distances from here on do not count; a pair without a distance has SATURATED.
USABLE, SATURATED = 2.0, 10.0
#: Rows of a block, tiles of a task's piece of an alignment, and numbers that a task holds of a tile at once.
BLOCK, TILES, HELD = 16, 64, 1 << 21


@lru_cache(8)
def replicate_weights(window: int, replicates: int, seed: int = 3) -> np.ndarray:
    """Weights of a window's sites (rows) in each replicate; the first one is the sample itself, and the last that is drawn
    is thrown away."""
    return bootstrap_weights(window, replicates, seed)[:, :-1].astype(np.float32)


def window_places(length: int, window: int, step: int) -> np.ndarray:
    """Sites (from 0) of each window: centred, wrapped, counted from 0."""
    window, step, last = window_geometry(length, window, step)
    return (np.arange(last + 1)[:, None] * step - window // 2 + np.arange(window)) % length


def identities(x: np.ndarray, y: np.ndarray, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Shares of equal sites of pairs of rows, by pair, window and replicate; 0 without common sites."""
    both = (x > 0) & (y > 0)
    # Sums of small whole numbers are exact in single precision; equal shares are equal in double precision.
    valid, same = ((f[:, places].astype(np.float32) @ weights).astype(np.float64) for f in (both, both & (x == y)))
    return np.divide(same, valid, out=np.zeros_like(same), where=valid > 0)


def _states(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, length)


def _whole(length: int) -> Column:
    """A row's states, as many as the alignment has; what is not there is missing."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.get("states", i), F.lit(0)).cast("tinyint"))


def pair_profiles(sequences: DataFrame, length: int, window: int, step: int, replicates: int, seed: int = 3) -> DataFrame:
    """dataset_id, s1, s2, profile: for each window (centred, wrapped, counted from 0) the distances of its replicates."""
    ensure(sequences.sparkSession)
    each = pairs(sequences.select("dataset_id", "seq_id", _whole(length).alias("states")))

    def run(batches):
        places, weights = window_places(length, window, step), replicate_weights(min(window, length // 2), replicates, seed)
        few = max(1, HELD // (places.shape[0] * weights.shape[1]))
        for b in (b.slice(i, few) for b in batches for i in range(0, b.num_rows, few)):
            same = identities(_states(b.column("x"), length), _states(b.column("y"), length), places, weights)
            close = same > 0.25
            d = np.where(close, -0.75 * np.log((4 * np.where(close, same, 1.0) - 1) / 3), SATURATED)
            d[same == 1] = 0.0
            of = lambda values, n: pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, n, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("dataset_id", "s1", "s2")), of(of(pa.array(d.ravel()), d.shape[2]), d.shape[1])], names=["dataset_id", "s1", "s2", "profile"])

    kinds = dict(each.dtypes)
    return each.mapInArrow(run, f"dataset_id {kinds['dataset_id']}, s1 {kinds['s1']}, s2 {kinds['s2']}, profile array<array<double>>")


def with_profiles(triples: DataFrame, profiles: DataFrame) -> DataFrame:
    """triples (dataset_id, a, b, c) with p12, p13, p23."""
    out = triples
    for name, x, y in (("p12", "a", "b"), ("p13", "a", "c"), ("p23", "b", "c")):
        out = out.join(profiles.select("dataset_id", F.col("s1").alias(x), F.col("s2").alias(y), F.col("profile").alias(name)), ["dataset_id", x, y])
    return out


def tile(blocks: tuple[int, int, int], n: int) -> np.ndarray:
    """Ascending triplets of the n rows, one of each block."""
    rows = [np.arange(k * BLOCK, min(n, k * BLOCK + BLOCK)) for k in blocks]
    t = np.stack(np.meshgrid(*rows, indexing="ij"), axis=-1).reshape(-1, 3)
    return t[(t[:, 0] < t[:, 1]) & (t[:, 1] < t[:, 2])]


def tile_votes(states: np.ndarray, t: np.ndarray, places: np.ndarray, weights: np.ndarray):
    """Of triplets t of rows, for ranges of windows: the first window, and usable and the three pairs' votes by triplet and
    window. Distances fall where identities rise, so identities are compared."""
    n, least = len(states), float((3 * np.exp(USABLE / -0.75) + 1) / 4)
    both, at = np.unique(t[:, (0, 0, 1)] * n + t[:, (1, 2, 2)], return_inverse=True)
    first, second = states[both // n], states[both % n]
    at = at.reshape(t.shape)
    # Different shares of so few sites are different in single precision too.
    kind = np.float32 if len(weights) <= 2048 else np.float64
    once = np.ones(weights.shape[1], np.float32)
    counted = lambda held: (held.astype(np.float32) @ once).astype(np.int64)
    few = max(1, HELD // (max(len(t), len(both)) * weights.shape[1]))
    for low in range(0, len(places), few):
        same = identities(first, second, places[low : low + few], weights)
        same = np.where(same > least, same, np.nan).astype(kind)
        # Not usable is not a number: no comparison with it holds.
        x, y, z = (same[at[:, k]] for k in range(3))
        yield low, [counted(v) for v in (~np.isnan(x + y + z), (x > y) & (x > z), (y > x) & (y > z), (z > x) & (z > y))]


def bootstrap_votes(sequences: DataFrame, length: int, window: int, step: int, replicates: int, seed: int = 3) -> DataFrame:
    """dataset_id, a, b, c, win, usable, v12, v13, v23: of each triplet and window the replicates in which all three distances
    are usable, and those in which a pair is strictly the closest."""
    ensure(sequences.sparkSession)
    members = F.array_sort(F.collect_list(F.struct("seq_id", _whole(length).alias("states"))))
    whole = sequences.groupBy("dataset_id").agg(members.alias("members"))
    # Tiles are combinations of three blocks with repetition: those of two blocks more without.
    count = F.when(F.size("members") > 2, ranks.triplets_of(F.ceil(F.size("members") / BLOCK) + 2))
    pieces = whole.withColumn("_n", count).withColumn("_piece", F.explode(ranks.blocks(F.col("_n"), TILES)))
    parts = 4 * int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = F.col("_piece") * TILES
    work = pieces.repartition(parts, "dataset_id", "_piece").select("dataset_id", "members", low.alias("low"), F.least(low + TILES, F.col("_n")).alias("high"))
    kinds = dict(sequences.dtypes)
    names = [*TRIPLET, "win", "usable", "v12", "v13", "v23"]

    def run(batches):
        places, weights = window_places(length, window, step), replicate_weights(min(window, length // 2), replicates, seed)
        for b in batches:
            ids, members = b.column("dataset_id"), b.column("members")
            for r in range(b.num_rows):
                held = members[r].values
                rows, states = held.field(0).to_numpy(), _states(held.field(1), length)
                for blocks in unranked(np.arange(b.column("low")[r].as_py(), b.column("high")[r].as_py()), 3) - np.arange(3):
                    if not len(t := tile(tuple(blocks.tolist()), len(rows))):
                        continue
                    for first, counts in tile_votes(states, t, places, weights):
                        wins = counts[0].shape[1]
                        who = [np.repeat(rows[t[:, k]], wins) for k in range(3)]
                        win = np.tile(np.arange(first, first + wins, dtype=np.int32), len(t))
                        cols = [pa.array(x) for x in (*who, win, *(c.astype(np.int64).ravel() for c in counts))]
                        yield pa.RecordBatch.from_arrays([pa.repeat(ids[r], len(win)), *cols], names=names)

    of = ", ".join(f"{x} {kinds['seq_id']}" for x in "abc")
    return work.mapInArrow(run, f"dataset_id {kinds['dataset_id']}, {of}, win int, usable long, v12 long, v13 long, v23 long")


def support_regions(voted: DataFrame, replicates: int, support: float = 0.7) -> DataFrame:
    """dataset_id, a, b, c, pair, first, last, windows, mean_votes: maximal linear runs of windows in which a pair has the
    wanted support. Only such windows are shuffled."""
    each = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(v).alias("votes")) for i, v in enumerate(("v12", "v13", "v23"))])
    full = voted.select(*TRIPLET, "win", F.inline(F.filter(each, lambda p: p["votes"] >= support * replicates)))
    # Windows that follow each other are as far from their places as each other.
    run = F.col("win") - F.row_number().over(Window.partitionBy(*TRIPLET, "pair").orderBy("win"))
    both = full.withColumn("_run", run).groupBy(*TRIPLET, "pair", "_run")
    return both.agg(F.min("win").alias("first"), F.max("win").alias("last"), F.count("*").alias("windows"), F.avg("votes").alias("mean_votes")).drop("_run")
