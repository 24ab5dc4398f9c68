"""Which of an event's three representatives is the recombinant: metrics of what changes across its breakpoints, and a vote.

A recombinant's relations to other rows differ inside and outside the tract; its parents' do not. Distances of all rows
in both regions, direct ones and those of the regions' trees, are one relation; each metric is an aggregate of it, and
all are stacked as (event_id, role, metric, score), higher for a likelier recombinant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import in_tract, jukes_cantor
from ..tables import written
from .events import ROLE_WEIGHTS
from .late import correlation_set, correlations, representatives
from .relations import pairs
from .splits import WORD, bipartitions, joined_trees

#: Metrics by number: profiles of direct, tree and collapsed-tree distances; the same with a role left out, direct and
#: by trees; displacements, direct and by trees; changes of order; members of the role's set.
METRICS = ("profile", "tree_profile", "collapsed_profile", "left_out", "tree_left_out", "displacement", "tree_displacement", "order", "members")
INSIDE, OUTSIDE = 0, 1
DIGITS = 6


def region_distances(sequences: DataFrame, events: DataFrame) -> DataFrame:
    """event_id, region (INSIDE or OUTSIDE), s1, s2, distance: all pairs of the event's alignment. events: representatives()."""
    both = pairs(sequences.select("dataset_id", "seq_id", "states")).join(events.select("event_id", "dataset_id", "begin", "end"), "dataset_id")
    sites = F.zip_with("x", "y", lambda x, y: F.when((x > 0) & (y > 0), (x != y).cast("int")))
    where = lambda i: in_tract(i + 1, F.col("begin"), F.col("end"))
    held = {INSIDE: F.filter("_d", lambda d, i: where(i) & d.isNotNull()), OUTSIDE: F.filter("_d", lambda d, i: ~where(i) & d.isNotNull())}
    distance = lambda v: jukes_cantor(F.size(v), F.aggregate(v, F.lit(0), lambda a, d: a + d))
    each = F.array(*[F.struct(F.lit(r).alias("region"), distance(v).alias("distance")) for r, v in held.items()])
    return both.withColumn("_d", sites).select("event_id", "s1", "s2", F.inline(each)).select("event_id", "region", "s1", "s2", "distance")


def tree_distances(distances: DataFrame) -> DataFrame:
    """As region_distances, but of the neighbour-joining tree of each event and region: the inner splits between two rows."""
    edges = written(joined_trees(distances.select(F.col("event_id").alias("dataset_id"), F.col("region").alias("replicate"), "s1", "s2", "distance")), "trees")
    ids = edges.filter("child >= 0").groupBy("dataset_id", "replicate").agg(F.array_sort(F.collect_set("child")).alias("ids"))
    kept = bipartitions(edges).groupBy("dataset_id", "replicate").agg(F.collect_list("words").alias("kept"))
    two = ids.join(kept, ["dataset_id", "replicate"], "left").select("*", F.explode(F.sequence(F.lit(0), F.size("ids") - 1)).alias("i"))
    two = two.withColumn("j", F.explode(F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda j: j > F.col("i"))))
    bit = lambda w, p: F.element_at(w, (F.floor(p / WORD) + 1).cast("int")).bitwiseAND(F.pow(F.lit(2.0), F.pmod(p, F.lit(WORD))).cast("long")) != 0
    between = F.size(F.filter(F.coalesce("kept", F.array().cast("array<array<bigint>>")), lambda w: bit(w, F.col("i")) != bit(w, F.col("j"))))
    at = lambda i: F.element_at("ids", F.col(i) + 1)
    return two.select(F.col("dataset_id").alias("event_id"), F.col("replicate").alias("region"), at("i").alias("s1"), at("j").alias("s2"), between.cast("double").alias("distance"))


def profiles(distances: DataFrame, events: DataFrame) -> DataFrame:
    """event_id, role, row (the representative's), other, inside, outside: each representative's distances to all others."""
    both = distances.unionByName(distances.select("event_id", "region", F.col("s2").alias("s1"), F.col("s1").alias("s2"), "distance"))
    who = events.select("event_id", F.posexplode("reps").alias("role", "s1"))
    at = lambda r, n: F.max(F.when(F.col("region") == r, F.col("distance"))).alias(n)
    return both.join(who, ["event_id", "s1"]).groupBy("event_id", "role", F.col("s1").alias("row"), F.col("s2").alias("other")).agg(at(INSIDE, "inside"), at(OUTSIDE, "outside"))


def _correlation() -> Column:
    """Of inside and outside over a group; 0 where one does not vary."""
    x, y = F.col("inside"), F.col("outside")
    n, sx, sy = F.count("*"), F.sum("inside"), F.sum("outside")
    xx, yy, xy = n * F.sum(x * x) - sx * sx, n * F.sum(y * y) - sy * sy, n * F.sum(x * y) - sx * sy
    return F.when((xx > 1e-9) & (yy > 1e-9), xy / F.sqrt(xx * yy)).otherwise(0.0)


def _scores(rows: DataFrame, metric: int, score: Column) -> DataFrame:
    return rows.select("event_id", "role", F.lit(metric).alias("metric"), F.round(score, DIGITS).alias("score"))


def metrics(profile: DataFrame, numbers: tuple[int, int, int]) -> DataFrame:
    """Profile, left-out and displacement metrics of one kind of distances, under these numbers."""
    own = profile.groupBy("event_id", "role").agg((1 - _correlation()).alias("change"), F.avg(F.abs(F.col("inside") - F.col("outside"))).alias("moved"))
    # Without a role, how alike the regions are for the other two.
    without = profile.select("event_id", F.col("role").alias("of"), "other", "inside", "outside").join(profile.select("event_id", "role", "row").distinct(), "event_id").filter("role <> of AND other <> row")
    rest = without.groupBy("event_id", "role", "of").agg(_correlation().alias("r")).groupBy("event_id", "role").agg(F.avg("r").alias("left"))
    return _scores(own, numbers[0], F.col("change")).unionByName(_scores(rest, numbers[1], F.col("left"))).unionByName(_scores(own, numbers[2], F.col("moved")))


def order_changes(profile: DataFrame) -> DataFrame:
    """Metric 7: the share of pairs of other rows of which the closer one inside is the farther one outside."""
    held = profile.groupBy("event_id", "role").agg(F.collect_list(F.struct("inside", "outside")).alias("p"))
    # Each turned pair is met twice, as are all pairs.
    turned = lambda a: F.size(F.filter("p", lambda b: (a["inside"] - b["inside"]) * (a["outside"] - b["outside"]) < 0))
    n, all_ = F.size("p"), F.aggregate(F.transform("p", turned), F.lit(0), lambda s, x: s + x)
    return _scores(held, 7, F.when(n > 1, all_ / (n * (n - 1))).otherwise(0.0))


def direct_metrics(sequences: DataFrame, events: DataFrame) -> DataFrame:
    """The metrics of direct distances: 0, 3, 5 and 7."""
    reps = representatives(events)
    profile = written(profiles(region_distances(sequences, reps), reps), "profiles")
    return metrics(profile, (0, 3, 5)).unionByName(order_changes(profile))


def role_metrics(sequences: DataFrame, events: DataFrame) -> DataFrame:
    """event_id, role (0 the recombinant as found, 1 and 2 the parents), metric, score: all of METRICS. The collapsed tree is
    the tree itself, as there are no replicates."""
    # All metrics read the events, and each the profiles again, so these are written once; profiles are what the events'
    # alignments have pairs.
    reps = written(representatives(events), "representatives")
    distances = written(region_distances(sequences, reps), "distances")
    direct, tree = written(profiles(distances, reps), "profiles"), written(profiles(tree_distances(distances), reps), "profiles")
    out = metrics(direct, (0, 3, 5)).unionByName(order_changes(direct))
    by_tree = metrics(tree, (1, 4, 6))
    out = out.unionByName(by_tree).unionByName(by_tree.filter("metric = 1").withColumn("metric", F.lit(2)))
    sets = correlation_set(correlations(reps, sequences)).filter("member").groupBy("event_id", "role").agg(F.count("*").cast("double").alias("n"))
    size = reps.select("event_id", F.explode(F.array(*map(F.lit, range(3)))).alias("role")).join(sets, ["event_id", "role"], "left")
    return out.unionByName(_scores(size, 8, F.coalesce("n", F.lit(0.0))))


def recommendation(scores: DataFrame) -> DataFrame:
    """event_id, role, points, confidence: each metric gives its weight to a role that is above both others, half of it to one
    that is above one; the role with the most points (of equal ones the first), and its margin over the next, as a share
    of all points."""
    w = F.element_at(F.array(*map(F.lit, ROLE_WEIGHTS)), F.col("metric") + 1)
    three = scores.groupBy("event_id", "metric").agg(F.collect_list(F.struct("role", "score")).alias("s"))
    each = three.select("event_id", "metric", "s", F.inline("s"))
    above = F.size(F.filter("s", lambda x: x["score"] < F.col("score")))
    points = each.withColumn("given", w * F.when(above == 2, 1.0).when(above == 1, 0.5).otherwise(0.0)).groupBy("event_id", "role").agg(F.sum("given").alias("points"))
    ranked = points.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("points", (-F.col("role")).alias("r"))), asc=False).alias("p"), F.sum("points").alias("all"))
    margin = F.col("p")[0]["points"] - F.col("p")[1]["points"]
    return ranked.select("event_id", (-F.col("p")[0]["r"]).alias("role"), F.col("p")[0]["points"].alias("points"), F.when(F.col("all") > 0, margin / F.col("all")).otherwise(0.0).alias("confidence"))
