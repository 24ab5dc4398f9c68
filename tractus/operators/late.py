"""Late evidence on an event: which other rows share its history.

A row that descends from a recombinant is related to the event's three representatives as the recombinant is, and in the
same way on either side of each breakpoint. So every row has a vector of six distances, to the three representatives in
two regions, and is compared with each representative's own vector, over all relabellings of the three. Regions are walks
of a fixed number of variable sites from the breakpoints, around the origin where they must, and the tract and its rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ensure

#: Variable sites of a walk, at most half of all; sites that a row must have more of around a breakpoint; the correlation
#: that counts as support.
WALK, LEAST_SITES, SUPPORT = 60, 10, 0.83
REGIONS = ("begin_left", "begin_right", "end_left", "end_right", "outside", "inside")
#: Two regions of each comparison: around the first breakpoint, around the second, rest and tract.
COMPARED = ((0, 1), (2, 3), (4, 5))
#: Relabellings of the representatives by class: none, three swaps, both cycles as one.
CLASSES = (((0, 1, 2),), ((1, 0, 2),), ((2, 1, 0),), ((0, 2, 1),), ((1, 2, 0), (2, 0, 1)))
DIGITS = 9
#: Rows of an alignment that meet an event at once, and events of which a task compares the rows at once.
BLOCK, EVENTS = 64, 256


def representatives(events: DataFrame) -> DataFrame:
    """event_id, dataset_id, begin, end, reps: the recombinant and the two parents, in the order of the triplet."""
    parents = F.filter(F.array("a", "b", "c"), lambda x: x != F.col("recombinant"))
    return events.select("event_id", "dataset_id", "begin", "end", F.concat(F.array("recombinant"), parents).alias("reps"))


def _apart(reps: np.ndarray, rows: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its sites in each region, and the share of these at which it differs from each representative (row, region,
    representative; NaN without sites). Only sites count where all representatives have a state and not all the same."""
    at = np.flatnonzero((reps > 0).all(axis=0) & (reps != reps[0]).any(axis=0))
    n, pos, j = len(at), at + 1, np.arange(len(at))
    b, e = np.searchsorted(pos, begin), np.searchsorted(pos, end, "right")
    inner = (pos >= begin) & (pos <= end) if begin < end else (pos >= begin) | (pos <= end)
    near = lambda d: d % max(1, n) < min(WALK, n // 2)
    held = np.stack([near(b - 1 - j), near(j - b), near(e - 1 - j), near(j - e), ~inner, inner], axis=1).astype(float)
    own = rows[:, at]
    valid = (own > 0).astype(float) @ held
    differ = np.stack([((own > 0) & (own != x)).astype(float) @ held for x in reps[:, at]], axis=2)
    return valid, np.divide(differ, valid[:, :, None], out=np.full_like(differ, np.nan), where=valid[:, :, None] > 0)


def _pearson(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Correlation of two short lists, to DIGITS digits; 0 where one does not vary, NaN where a value is."""
    n, total = len(x), lambda v: sum(v[1:], v[0])
    xx, yy, xy = (n * total([p * q for p, q in zip(a, b, strict=True)]) - total(a) * total(b) for a, b in ((x, x), (y, y), (x, y)))
    varies = (xx > 1e-12) & (yy > 1e-12)
    # Adding 0 takes the sign of a zero away.
    r = np.round(xy / np.sqrt(np.where(varies, xx * yy, 1.0)), DIGITS) + 0.0
    return np.where(varies | np.isnan(xx + yy), r, 0.0)


def _compared(apart: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """r, k and m of each comparison in turn, by row and role. apart: row, region, representative; own: row, role, region,
    representative (the vectors of the representatives themselves)."""
    out = []
    for i, j in COMPARED:
        x = [apart[:, None, g, k] for g in (i, j) for k in range(3)]
        y = lambda order, i=i, j=j: [own[:, :, g, k] for g in (i, j) for k in order]
        each = np.stack([np.max([_pearson(x, y(p)) for p in kinds], axis=0) for kinds in CLASSES])
        out += [each[0], each.argmax(axis=0), each.max(axis=0)]
    return out


def correlations(events: DataFrame, sequences: DataFrame) -> DataFrame:
    """event_id, seq_id, role (0 the recombinant, 1 and 2 the parents), r0, r1, r2 (unrelabelled correlations with the role's
    representative), k0, k1, k2 (class of the best relabelling; of equal ones the first), m0, m1, m2 (its correlation),
    overlap and affinity as in correlation_set, and vetoed (another representative is closer on both sides of both
    breakpoints). Representatives themselves are left out, and rows that have none of their variable sites. events:
    representatives(). Rows meet an event in blocks, with the states of its representatives."""
    ensure(sequences.sparkSession)
    whole = sequences.filter("states IS NOT NULL").groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("seq_id", "states"))).alias("members"))
    of = lambda k: F.get(F.filter("members", lambda m: m["seq_id"] == F.col("reps")[k]), F.lit(0))["states"].alias(f"_s{k}")
    three = events.join(whole, "dataset_id").select("dataset_id", "event_id", "begin", "end", "reps", *map(of, range(3))).dropna(subset=["_s0", "_s1", "_s2"])
    first = F.sequence(F.lit(0), F.floor((F.size("members") - 1) / BLOCK).cast("int"))
    blocks = whole.select("dataset_id", F.explode(F.transform(first, lambda i: F.slice("members", i * BLOCK + 1, F.lit(BLOCK)))).alias("members"))
    met = three.join(blocks, "dataset_id").select("event_id", "begin", "end", "reps", F.array("_s0", "_s1", "_s2").alias("own"), "members")
    kinds = dict(events.dtypes) | dict(sequences.dtypes)
    names = ["event_id", "seq_id", "role", *[f"{x}{c}" for c in range(3) for x in "rkm"], "overlap", "affinity", "vetoed"]

    def run(batches):
        for b in (b.slice(i, EVENTS) for b in batches for i in range(0, b.num_rows, EVENTS)):
            begin, end = (b.column(c).to_pylist() for c in ("begin", "end"))
            reps, own = (b.column(c).flatten() for c in ("reps", "own"))
            reps, own = reps.to_numpy().reshape(b.num_rows, 3), [own[3 * r : 3 * r + 3].flatten().to_numpy().reshape(3, -1) for r in range(b.num_rows)]
            found = [], [], []
            ids, of = [], np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("members")).to_numpy())
            for r in range(b.num_rows):
                members = b.column("members")[r].values
                rows = members.field(1).flatten().to_numpy().reshape(len(members), -1)
                ids.append(members.field(0))
                valid, apart = _apart(own[r], np.concatenate([rows, own[r]]), begin[r], end[r])
                for held, x in zip(found, (valid[:-3], apart[:-3], np.broadcast_to(apart[-3:], (len(rows), 3, 6, 3))), strict=True):
                    held.append(x)
            ids = pa.concat_arrays(ids)
            valid, apart, mine = map(np.concatenate, found)
            # The last two regions are all variable sites.
            kept = np.flatnonzero((valid[:, 4] + valid[:, 5] > 0) & (ids.to_numpy()[:, None] != reps[of]).all(axis=1))
            valid, apart, mine, n = valid[kept], apart[kept], mine[kept], len(kept)
            each = lambda x: np.broadcast_to(x[:, None], (n, 3)).ravel()
            columns = [b.column("event_id").take(pa.array(each(of[kept]))), ids.take(pa.array(each(kept))), pa.array(np.tile(np.arange(3, dtype=np.int32), n))]
            for i, x in enumerate(values := _compared(apart, mine)):
                null = np.isnan(values[i - i % 3]).ravel()
                columns.append(pa.array(x.ravel().astype(np.int32) if i % 3 == 1 else x.ravel(), mask=null))
            least = apart.min(axis=2, keepdims=True)
            near, far = (apart <= least).swapaxes(1, 2), (apart > least).swapaxes(1, 2)
            overlap = (valid[:, 0] + valid[:, 1] > LEAST_SITES) | (valid[:, 2] + valid[:, 3] > LEAST_SITES)
            columns += [pa.array(x) for x in (each(overlap), near[:, :, 4:].all(axis=2).ravel(), far[:, :, :4].all(axis=2).ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    scores = ", ".join(f"r{c} double, k{c} int, m{c} double" for c in range(3))
    return met.mapInArrow(run, f"event_id {kinds['event_id']}, seq_id {kinds['seq_id']}, role int, {scores}, overlap boolean, affinity boolean, vetoed boolean")


def correlation_set(found: DataFrame) -> DataFrame:
    """found with direct, inverse, strong and member.

    direct: a comparison without warning (no relabelling does better) correlates above SUPPORT. strong: both comparisons
    around breakpoints do. inverse: one does only with two representatives swapped. A row is a member of a role's set if
    it has sites around a breakpoint (overlap), a direct correlation, and is nowhere closer to another representative
    than to the role's (affinity) or strongly correlated; rows with inverse support alone are no members."""
    direct = [F.coalesce((F.col(f"k{c}") == 0) & (F.col(f"r{c}") > SUPPORT), F.lit(False)) for c in range(3)]
    turned = [F.coalesce(F.col(f"k{c}").between(1, 3) & (F.col(f"m{c}") > SUPPORT), F.lit(False)) for c in range(3)]
    out = found.withColumns({"direct": direct[0] | direct[1] | direct[2], "strong": direct[0] & direct[1], "inverse": turned[0] | turned[1] | turned[2]})
    return out.withColumn("member", F.col("overlap") & F.col("direct") & (F.col("affinity") | F.col("strong")))


def distance_correlation_set(sequences: DataFrame, events: DataFrame) -> DataFrame:
    return correlation_set(correlations(representatives(events), sequences)).drop("vetoed")
