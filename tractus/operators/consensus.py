"""Late consensus on an event: which rows share its history, as a list for each of its three representatives.

Lists are relations (event_id, role, place, seq_id). The rows of the distance-correlation set are trimmed by what lies
nearest to a representative without being listed, until no event changes; then lists are widened, pruned for the chosen
role, scored, and rebuilt in three passes, each of which reads the memberships that the one before left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import settled, written
from .late import SUPPORT, correlation_set, correlations, representatives
from .roles import profiles, region_distances, tree_distances

#: Correlation that a listed row needs if it is no farther from the representative than the nearest unlisted row in both
#: regions, in one, in none; that which saves a row of the chosen role from pruning; the score that makes a primary member.
TICKETS, SAVED, LEAST_SCORE = (SUPPORT, 0.95, 0.99), 0.99, 2.0
LIST = ("event_id", "role", "place", "seq_id")
DIGITS = 9


def compacted(rows: DataFrame) -> DataFrame:
    """Lists without the rows marked as gone: in turn each gap takes the last row that is left.

    After all such moves rows that stay below the new length keep their places, and gaps below it take the kept rows
    above it, the first gap the last of them. So both are numbered and joined, whatever the number of removals.
    """
    whole = Window.partitionBy("event_id", "role")
    so_far = whole.orderBy("place")
    count = lambda test, w: F.count_if(test).over(w)
    rows = rows.withColumn("_n", count(~F.col("gone"), whole))
    gap, tail = F.col("gone") & (F.col("place") < F.col("_n")), ~F.col("gone") & (F.col("place") >= F.col("_n"))
    rows = rows.withColumn("_k", F.when(gap, count(gap, so_far)).when(tail, count(tail, whole) - count(tail, so_far) + 1))
    gaps = rows.filter(gap).select("event_id", "role", "_k", F.col("place").alias("_to"))
    return rows.filter(~F.col("gone")).join(gaps, ["event_id", "role", "_k"], "left").withColumn("place", F.coalesce("_to", "place")).drop("_n", "_k", "_to", "gone")


def appended(lists: DataFrame, rows: DataFrame) -> DataFrame:
    """Lists with rows (event_id, role, seq_id) that their list lacks at its end, in order of seq_id."""
    new = rows.join(lists, ["event_id", "role", "seq_id"], "left_anti")
    size = lists.groupBy("event_id", "role").agg(F.count("*").alias("_n"))
    place = F.coalesce("_n", F.lit(0)) + F.row_number().over(Window.partitionBy("event_id", "role").orderBy("seq_id")) - 1
    return lists.select(*LIST).unionByName(new.join(size, ["event_id", "role"], "left").select("event_id", "role", place.alias("place"), "seq_id"))


def evidence(sequences: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is known of each row, of each role, and all distances between rows, written.

    Rows (event_id, role, seq_id, all but the representatives): inside, outside, tree_inside and tree_outside (distances to
    the role's representative), top (the largest of the three correlations), best (the largest in a comparison without warning
    that supports no other role, 0 if none), direct (best is above SUPPORT), vetoed (another representative is closer on
    both sides of both breakpoints), affinity, foreign (another one is closer in the trees of both regions) and member (of
    the distance-correlation set). Roles: tree_inside and tree_outside, the nearest other representative in the trees, and
    turned: whether the closest pair of representatives differs between the regions.
    """
    reps = representatives(events)
    found = written(correlation_set(correlations(reps, sequences)), "correlations")
    row = Window.partitionBy("event_id", "seq_id")
    clean = [F.col(f"_d{c}") & (F.count_if(F.col(f"_d{c}")).over(row) == 1) for c in range(3)]
    found = found.withColumns({f"_d{c}": F.coalesce((F.col(f"k{c}") == 0) & (F.col(f"r{c}") > SUPPORT), F.lit(False)) for c in range(3)}).withColumns({f"_c{c}": clean[c] for c in range(3)})
    best = F.greatest(*[F.when(F.col(f"_c{c}"), F.col(f"r{c}")).otherwise(0.0) for c in range(3)])
    found = found.select("event_id", "role", "seq_id", F.coalesce(F.greatest("r0", "r1", "r2"), F.lit(0.0)).alias("top"), best.alias("best"), "vetoed", "affinity", "member")
    distances = written(region_distances(sequences, reps), "distances")
    trees = profiles(tree_distances(distances), reps).withColumnsRenamed({"inside": "tree_inside", "outside": "tree_outside"})
    both = written(profiles(distances, reps).join(trees, ["event_id", "role", "row", "other"]).join(reps.select("event_id", "reps"), "event_id"), "profiles")
    is_rep = F.array_contains("reps", F.col("other"))
    rows = both.filter(~is_rep).withColumnRenamed("other", "seq_id").drop("row", "reps").join(found, ["event_id", "role", "seq_id"], "left").fillna(0.0, ["top", "best"]).fillna(False, ["vetoed", "affinity", "member"])
    farther = lambda x: F.col(x) > F.min(x).over(row)
    rows = rows.withColumns({"direct": F.col("best") > SUPPORT, "foreign": farther("tree_inside") & farther("tree_outside")})
    pair = lambda x: F.min_by(F.array_sort(F.array("row", "other")), F.struct(x, F.least("row", "other"), F.greatest("row", "other")))
    closest = both.filter(is_rep).groupBy("event_id").agg((pair("inside") != pair("outside")).alias("turned"))
    anchors = both.filter(is_rep).groupBy("event_id", "role").agg(F.min("tree_inside").alias("tree_inside"), F.min("tree_outside").alias("tree_outside")).join(closest, "event_id")
    return written(rows, "evidence"), written(anchors, "anchors"), distances


def _limits(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_id", "role").agg(F.min("inside").alias("_i"), F.min("outside").alias("_o"))


def nearest_lists(rows: DataFrame) -> DataFrame:
    """Members without those that the nearest unlisted rows drive out, as lists.

    In a round each list's limits are the distances of the nearest row that no list of the event has, in either region. A
    listed row stays if its best correlation is above the ticket for the regions in which it is within the limits (TICKETS),
    and it is not vetoed. Rows that leave all lists are unlisted in the next round. Each round shortens a list of every event
    that it does not settle, so there are at most as many rounds as an event has members. rows: evidence().
    """
    listed = rows.filter("member")
    most = listed.groupBy("event_id").count().agg(F.max("count")).first()[0] or 0
    start = appended(rows.limit(0).select("event_id", "role", F.lit(0).alias("place"), "seq_id"), listed.select("event_id", "role", "seq_id"))

    def trimmed(lists: DataFrame) -> DataFrame:
        mine = rows.join(lists.select("event_id").distinct(), "event_id", "left_semi")
        limits = _limits(mine.join(lists, ["event_id", "seq_id"], "left_anti"))
        at = lists.join(mine, ["event_id", "role", "seq_id"]).join(limits, ["event_id", "role"], "left")
        within = [F.coalesce(F.col(x) <= F.col(y), F.lit(True)).cast("int") for x, y in (("inside", "_i"), ("outside", "_o"))]
        need = F.element_at(F.array(*map(F.lit, TICKETS)), 3 - within[0] - within[1])
        gone = at.select(*LIST, (F.col("vetoed") | (F.col("best") <= need)).alias("gone"))
        return compacted(gone.withColumn("changed", F.max("gone").over(Window.partitionBy("event_id")))).select(*LIST, "changed")

    return settled(start, trimmed, "lists", most + 1)


def widened(lists: DataFrame, rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Lists with, at their ends, first unlisted rows of direct support that are closer in both regions than every other row,
    then those that are closer in both trees than either other representative. Vetoed rows stay out. So do members that
    have left all lists; they and the unlisted rows without direct support are the other rows."""
    out = lists
    row = ["event_id", "seq_id"]
    left = rows.filter("member").select(*row).distinct().join(lists, row, "left_anti")
    free = lambda: rows.filter("NOT vetoed").join(out, row, "left_anti").join(left, row, "left_anti")
    known = rows.filter("direct").select(*row).distinct().join(left, row, "left_anti")
    limits = _limits(rows.join(out, row, "left_anti").join(known, row, "left_anti"))
    near = free().filter("direct").join(limits, ["event_id", "role"], "left").filter("coalesce(inside < _i, true) AND coalesce(outside < _o, true)")
    out = written(appended(out, near.select("event_id", "role", "seq_id")), "lists")
    return appended(out, _closer_in_trees(free(), anchors).select("event_id", "role", "seq_id"))


def _closer_in_trees(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    bounds = anchors.select("event_id", "role", F.col("tree_inside").alias("_i"), F.col("tree_outside").alias("_o"))
    return rows.join(bounds, ["event_id", "role"]).filter("tree_inside < _i AND tree_outside < _o").drop("_i", "_o")


def pruned(lists: DataFrame, rows: DataFrame, anchors: DataFrame, chosen: DataFrame) -> DataFrame:
    """Lists without the rows of an event's chosen role (event_id, role) that are foreign and nowhere correlated at SAVED or
    more, if the closest pair of representatives differs between the regions."""
    at = lists.join(rows.select("event_id", "role", "seq_id", "foreign", "top"), ["event_id", "role", "seq_id"])
    at = at.join(anchors.select("event_id", "role", "turned"), ["event_id", "role"]).join(chosen.select("event_id", "role", F.lit(True).alias("_c")), ["event_id", "role"], "left")
    gone = F.col("turned") & F.col("_c").isNotNull() & F.col("foreign") & (F.col("top") < SAVED)
    return compacted(at.select(*LIST, F.coalesce(gone, F.lit(False)).alias("gone")))


def scores(rows: DataFrame, anchors: DataFrame, settled_lists: DataFrame, final_lists: DataFrame) -> DataFrame:
    """rows with score: one for the set, the nearest lists, affinity and closeness in the trees each, twice that in the final
    lists, times the best correlation."""
    key = ["event_id", "role", "seq_id"]
    mark = lambda df, name: df.select(*key, F.lit(1).alias(name))
    out = rows.join(mark(settled_lists, "_s"), key, "left").join(mark(final_lists, "_f"), key, "left").join(mark(_closer_in_trees(rows, anchors), "_t"), key, "left").fillna(0, ["_s", "_f", "_t"])
    points = F.col("member").cast("int") + F.col("_s") + F.col("affinity").cast("int") + F.col("_t")
    return out.withColumn("score", F.round(points * (1 + F.col("_f")) * F.col("best"), DIGITS)).drop("_s", "_f", "_t")


def rebuilt(scored: DataFrame, distances: DataFrame, events: DataFrame, saved: DataFrame) -> DataFrame:
    """event_id, role, seq_id, pass: memberships in three passes over fixed snapshots, representatives left out.

    primary: the role whose score is above both others' and at least LEAST_SCORE. equivalent: a row without a role that has
    the six distances of one with a role or of a representative, or has a score for a role and whose nearest row in both
    regions (of equal ones the smallest seq_id) has that role. straggler: a row still without one that is closer to a
    representative than to both others in both regions, and no farther than that role's farthest member. If a role that the
    saved lists fill has no row then, the event keeps its saved lists (restored). events: representatives().
    """
    row = Window.partitionBy("event_id", "seq_id")
    # A second role of the same score leaves the row without one.
    top = scored.withColumns({"_m": F.max("score").over(row), "_n": F.count("*").over(Window.partitionBy("event_id", "seq_id", "score"))})
    primary = written(top.filter((F.col("score") == F.col("_m")) & (F.col("_n") == 1) & (F.col("score") >= LEAST_SCORE)).select("event_id", "role", "seq_id", F.lit("primary").alias("pass")), "passes")
    anchors = events.select("event_id", F.posexplode("reps").alias("role", "seq_id"))
    six = scored.groupBy("event_id", "seq_id").agg(F.sort_array(F.collect_list(F.struct("role", F.round("inside", DIGITS).alias("i"), F.round("outside", DIGITS).alias("o")))).alias("six"))
    left = lambda *done: six.join(_together(done), ["event_id", "seq_id"], "left_anti")

    same = left(primary).join(primary.join(six, ["event_id", "seq_id"]).select("event_id", "six", "role").distinct(), ["event_id", "six"]).select("event_id", "role", "seq_id")
    at_rep = scored.filter((F.round("inside", DIGITS) == 0) & (F.round("outside", DIGITS) == 0)).join(left(primary).select("event_id", "seq_id"), ["event_id", "seq_id"], "left_semi").select("event_id", "role", "seq_id")
    nearest = distances.unionByName(distances.select("event_id", "region", F.col("s2").alias("s1"), F.col("s1").alias("s2"), "distance"))
    nearest = nearest.groupBy("event_id", "region", F.col("s1").alias("seq_id")).agg(F.min(F.struct("distance", "s2"))["s2"].alias("other"))
    snapshot = primary.select("event_id", "role", F.col("seq_id").alias("other")).unionByName(anchors.withColumnRenamed("seq_id", "other"))
    beside = nearest.join(snapshot, ["event_id", "other"]).groupBy("event_id", "role", "seq_id").agg(F.countDistinct("region").alias("_n")).filter("_n = 2").drop("_n")
    beside = beside.join(left(primary).select("event_id", "seq_id"), ["event_id", "seq_id"], "left_semi").join(scored.filter("score > 0").select("event_id", "role", "seq_id"), ["event_id", "role", "seq_id"], "left_semi")
    equivalent = written(same.unionByName(at_rep).unionByName(beside.select("event_id", "role", "seq_id")).distinct().withColumn("pass", F.lit("equivalent")), "passes")

    reach = scored.join(_together((primary, equivalent)), ["event_id", "role", "seq_id"], "left_semi").groupBy("event_id", "role").agg(F.max("inside").alias("_i"), F.max("outside").alias("_o"))
    alone = lambda x: (F.col(x) == F.min(x).over(row)) & (F.count("*").over(Window.partitionBy("event_id", "seq_id", x)) == 1)
    close = scored.withColumn("_a", alone("inside") & alone("outside")).filter("_a").join(reach, ["event_id", "role"]).filter("inside <= _i AND outside <= _o")
    straggler = close.join(left(primary, equivalent), ["event_id", "seq_id"], "left_semi").select("event_id", "role", "seq_id", F.lit("straggler").alias("pass"))

    new = written(primary.unionByName(equivalent).unionByName(straggler), "passes")
    empty = saved.select("event_id", "role").distinct().join(new, ["event_id", "role"], "left_anti").select("event_id").distinct()
    kept = saved.join(empty, "event_id", "left_semi").select("event_id", "role", "seq_id", F.lit("restored").alias("pass"))
    return new.join(empty, "event_id", "left_anti").unionByName(kept)


def _together(tables) -> DataFrame:
    out = tables[0].select("event_id", "role", "seq_id")
    for t in tables[1:]:
        out = out.unionByName(t.select("event_id", "role", "seq_id"))
    return out


def final_lists(rows: DataFrame, anchors: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nearest lists, and those widened and pruned."""
    first = written(nearest_lists(rows), "lists")
    wide = written(widened(first, rows, anchors), "lists")
    return first, written(pruned(wide, rows, anchors, chosen), "lists")


def first_role(events: DataFrame) -> DataFrame:
    """The recombinant as found, as each event's chosen role."""
    return events.select("event_id", F.lit(0).alias("role"))


def late_lists(sequences: DataFrame, events: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """event_id, role, place, seq_id: the final lists."""
    rows, anchors, _ = evidence(sequences, events)
    return final_lists(rows, anchors, first_role(events) if chosen is None else chosen)[1]


def late_consensus(sequences: DataFrame, events: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """event_id, role, seq_id, pass, score: the rebuilt memberships."""
    rows, anchors, distances = evidence(sequences, events)
    first, final = final_lists(rows, anchors, first_role(events) if chosen is None else chosen)
    scored = written(scores(rows, anchors, first, final), "scores")
    out = rebuilt(scored, distances, representatives(events), final)
    return out.join(scored.select("event_id", "role", "seq_id", "score"), ["event_id", "role", "seq_id"])
