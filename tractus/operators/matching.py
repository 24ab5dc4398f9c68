"""Breakpoints against intervals in which a triplet's relation changes: the nearest one on the circle, and a site with data.

Intervals come from neighbouring information-rich sites with different closest pairs, or from a model (breakpoint ranges);
they may pass the origin. An event has two breakpoints, so the match is a join by event and one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(rich: DataFrame, events: DataFrame) -> DataFrame:
    """event_id, low, high, from, to: neighbouring information-rich sites of each event's triplet with different agreeing pairs,
    the last and the first site included (low > high). rich: relations.information_rich()."""
    triplet = ["dataset_id", "a", "b", "c"]
    at = events.select("event_id", *triplet).join(rich.select(*triplet, "pos", "cat"), triplet)
    order = Window.partitionBy("event_id").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda x: F.coalesce(F.lead(x).over(order), F.first(x).over(whole))
    both = at.select("event_id", F.col("pos").alias("low"), following("pos").alias("high"), F.col("cat").alias("from"), following("cat").alias("to"))
    return both.filter(F.col("from") != F.col("to"))


def ahead(start: Column, to: Column, length: int) -> Column:
    """Steps from one site forwards to another on the circle."""
    return F.pmod(to - start, F.lit(length))


def matched(events: DataFrame, intervals: DataFrame, length: int) -> DataFrame:
    """event_id, side (begin or end), site, low, high, distance: each breakpoint with its nearest interval, 0 sites away if it lies
    within; of equally near ones that with the smallest low end, then high end. Events without intervals have no row; rows
    with a null breakpoint or end take no part."""
    sides = F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("site")) for x in ("begin", "end")])
    points = events.select("event_id", F.inline(sides)).filter("site IS NOT NULL")
    both = points.join(intervals.select("event_id", "low", "high").dropna(), "event_id")
    inside = ahead(F.col("low"), F.col("site"), length) <= ahead(F.col("low"), F.col("high"), length)
    distance = F.when(inside, 0).otherwise(F.least(ahead(F.col("site"), F.col("low"), length), ahead(F.col("high"), F.col("site"), length))).cast("int")
    best = F.min(F.struct(distance.alias("distance"), "low", "high")).alias("b")
    return both.groupBy("event_id", "side", "site").agg(best).select("event_id", "side", "site", "b.low", "b.high", "b.distance")


def repositioned(found: DataFrame, events: DataFrame, sequences: DataFrame, length: int) -> DataFrame:
    """found with moved_to and gap. moved_to is the site within the interval that is nearest to its middle and at which all
    three rows have data (of two the one before the middle); null if no site has. gap: the middle itself lacks data."""
    rows = events.select("event_id", "dataset_id", "a", "b", "c")
    for x in ("a", "b", "c"):
        rows = rows.join(sequences.select("dataset_id", F.col("seq_id").alias(x), F.col("states").alias(f"_{x}")), ["dataset_id", x])
    has = F.transform(F.arrays_zip("_a", "_b", "_c"), lambda s: (s["_a"] > 0) & (s["_b"] > 0) & (s["_c"] > 0))
    at = found.join(rows.select("event_id", has.alias("_has")), "event_id").withColumn("_n", ahead(F.col("low"), F.col("high"), length))
    half = F.floor(F.col("_n") / 2).cast("int")
    place = lambda k: (F.pmod(F.col("low") - 1 + k, F.lit(length)) + 1).cast("int")
    steps = F.filter(F.sequence(F.lit(0), F.col("_n").cast("int")), lambda k: F.element_at("_has", place(k)))
    nearest = F.array_min(F.transform(steps, lambda k: F.struct(F.abs(k - half).alias("d"), k.alias("k"))))
    return at.withColumns({"moved_to": place(nearest["k"]), "gap": ~F.element_at("_has", place(half))}).drop("_has", "_n")
