"""Signals and events as relations: deduplication, support, voting, erasure, review and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import in_tract, overlap, segments, tract_span

#: Methods in the order that breaks ties between them.
METHOD_ORDER = ("RDP", "GENECONV", "BootScan", "MaxChi", "CHIMAERA", "SISCAN", "3SEQ")
#: Weights of the listed role metrics.
ROLE_WEIGHTS = (8, 18, 20, 10, 8, 2, 10, 8, 0)


def method_rank(method: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, METHOD_ORDER)), method)


def _strength() -> list[Column]:
    return [F.col("corrected_p"), F.col("local_p"), method_rank(F.col("method")), F.col("signal_id")]


def strongest(signals: DataFrame, keys: list[str]) -> DataFrame:
    """One signal of each key: least corrected, then local p, then order of methods, then id; aggregated, not sorted."""
    best = F.min(F.struct("corrected_p", "local_p", method_rank(F.col("method")).alias("rank"), "signal_id", "method", "begin", "end")).alias("b")
    return signals.groupBy(*keys).agg(best).select(*keys, "b.signal_id", "b.method", "b.begin", "b.end", "b.corrected_p")


def deduplicated(signals: DataFrame) -> DataFrame:
    """Signals of one canonical triplet, recombinant and bounds: the strongest stays."""
    w = Window.partitionBy("dataset_id", "a", "b", "c", "recombinant", "begin", "end").orderBy(*_strength())
    return signals.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def tract_overlaps(tracts: DataFrame, length: int, more_than: float) -> DataFrame:
    """Pairs of tracts of one data set (i before j) with a symmetric overlap above the limit. Tracts are cut into ranges
    that do not wrap and dealt to bins of 16 sites, so only tracts with a bin in common are compared."""
    n = F.lit(length)
    cut = tracts.withColumn("bin", F.explode(F.array_distinct(F.flatten(F.transform(segments(F.col("begin"), F.col("end"), n), lambda s: F.sequence(F.floor((s["lo"] - 1) / 16), F.floor((s["hi"] - 1) / 16)))))))
    i = cut.select("dataset_id", "bin", F.col("id").alias("i"), F.col("begin").alias("b1"), F.col("end").alias("e1"))
    j = cut.select("dataset_id", "bin", F.col("id").alias("j"), F.col("begin").alias("b2"), F.col("end").alias("e2"))
    near = i.join(j, ["dataset_id", "bin"]).filter("i < j").drop("bin").distinct()
    return near.withColumn("overlap", overlap(F.col("b1"), F.col("e1"), F.col("b2"), F.col("e2"), n)).filter(F.col("overlap") > more_than).select("dataset_id", "i", "j", "overlap")


def supports(signals: DataFrame, events: DataFrame, length: int, more_than: float = 0.3) -> DataFrame:
    """Signals that share two originals or more with an event and overlap it by more than the limit."""
    pair_keys = F.array(F.concat_ws("-", "a", "b"), F.concat_ws("-", "a", "c"), F.concat_ws("-", "b", "c"))
    s = signals.select("dataset_id", "signal_id", F.col("begin").alias("b1"), F.col("end").alias("e1"), F.explode(pair_keys).alias("pair"))
    e = events.select("dataset_id", "event_id", F.col("begin").alias("b2"), F.col("end").alias("e2"), F.explode(pair_keys).alias("pair"))
    both = s.join(e, ["dataset_id", "pair"]).drop("pair").dropDuplicates(["dataset_id", "signal_id", "event_id"])
    share = overlap(F.col("b1"), F.col("e1"), F.col("b2"), F.col("e2"), F.lit(length))
    return both.filter(share > more_than).select("dataset_id", "event_id", "signal_id")


def not_committed(signals: DataFrame, events: DataFrame, length: int, more_than: float = 0.8) -> DataFrame:
    """Signals but those of a committed event's triplet that overlap it by more than the limit."""
    e = events.select("dataset_id", "a", "b", "c", F.col("begin").alias("b2"), F.col("end").alias("e2"))
    share = overlap(F.col("begin"), F.col("end"), F.col("b2"), F.col("e2"), F.lit(length)) > more_than
    s = signals.alias("s")
    on = [F.col(f"s.{k}") == F.col(f"e.{k}") for k in ("dataset_id", "a", "b", "c")]
    return s.join(e.alias("e"), [*on, share], "left_anti")


def enabled_triplets(triplets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triplets all of whose three pairs are enabled."""
    out = triplets
    for p, q in (("a", "b"), ("a", "c"), ("b", "c")):
        out = out.join(pairs.select("dataset_id", F.col("s1").alias(p), F.col("s2").alias(q)), ["dataset_id", p, q], "left_semi")
    return out.select("dataset_id", "a", "b", "c")


def at_least(sets: list[DataFrame], keys: list[str], votes: int) -> DataFrame:
    """Members of at least so many of the sets."""
    tagged = [s.select(*keys).distinct().withColumn("_s", F.lit(i)) for i, s in enumerate(sets)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy(*keys).agg(F.count("*").alias("votes")).filter(F.col("votes") >= votes)


def closure(sets: DataFrame) -> DataFrame:
    """dataset_id, role (0, 1, 2), member: adds a member to a role while it is in both others. Adding x to a role never
    brings x into two others that it was not in, so one round is the fixed point."""
    sets = sets.distinct()
    two = sets.groupBy("dataset_id", "member").agg(F.collect_set("role").alias("roles")).filter(F.size("roles") >= 2)
    return two.select("dataset_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("role"), "member").unionByName(sets).distinct()


def merged_tracts(tracts: DataFrame, key: str, length: int) -> DataFrame:
    """Union of the tracts of each key as ranges that neither overlap nor touch."""
    cut = tracts.select("dataset_id", key, F.explode(segments(F.col("begin"), F.col("end"), F.lit(length))).alias("s")).select("dataset_id", key, "s.lo", "s.hi")
    w = Window.partitionBy("dataset_id", key).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = cut.withColumn("_new", (before.isNull() | (F.col("lo") > before + 1)).cast("int")).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("dataset_id", key, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def inside_outside(sites: DataFrame, tracts: DataFrame) -> DataFrame:
    """Match rates of each pair inside and outside a triplet's tract, over variable sites."""
    inside = in_tract(F.col("pos"), F.col("begin"), F.col("end"))
    rows = sites.join(tracts, ["dataset_id", "a", "b", "c"]).withColumn("_in", inside)
    aggs = []
    for m in ("m12", "m13", "m23"):
        aggs += [F.avg(F.when(F.col("_in"), F.col(m))).alias(f"{m}_in"), F.avg(F.when(~F.col("_in"), F.col(m))).alias(f"{m}_out")]
    return rows.groupBy("signal_id").agg(*aggs)


def role_votes(scores: DataFrame) -> DataFrame:
    """event_id, role, metric, score: each metric gives its weight to the role with the highest score, and half of it to
    each where roles tie; confidence is the margin of the two highest totals over the sum."""
    weights = F.array(*map(F.lit, ROLE_WEIGHTS))
    top = scores.groupBy("event_id", "metric").agg(F.max("score").alias("top"))
    won = scores.join(top, ["event_id", "metric"]).filter("score = top")
    n = won.groupBy("event_id", "metric").agg(F.count("*").alias("n"))
    credit = F.element_at(weights, F.col("metric") + 1) * F.when(F.col("n") == 1, 1.0).otherwise(0.5)
    points = won.join(n, ["event_id", "metric"]).groupBy("event_id", "role").agg(F.sum(credit).alias("points"))
    ranked = points.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("points", (-F.col("role")).alias("r"))), asc=False).alias("p"), F.sum("points").alias("total"))
    second = F.coalesce(F.get("p", F.lit(1))["points"], F.lit(0.0))
    first = F.get("p", F.lit(0))
    return ranked.select("event_id", (-first["r"]).alias("role"), first["points"].alias("points"), F.when(F.col("total") > 0, (first["points"] - second) / F.col("total")).otherwise(0.0).alias("confidence"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision on each event of an append-only log."""
    return decisions.groupBy("event_id").agg(F.max_by("state", F.struct("at", "decision_id")).alias("state"))


def next_undecided(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """The first event of each data set, in order of detection, that is neither accepted nor rejected."""
    open_ = events.join(latest_decisions(decisions), "event_id", "left").filter("state IS NULL OR state NOT IN ('accepted', 'rejected')")
    return open_.groupBy("dataset_id").agg(F.min("event_id").alias("event_id"))


def thinned(profile: DataFrame, keys: list[str], value: str, points: int, forced: Column) -> DataFrame:
    """At most about ``points`` rows of each profile: every k-th one, the forced ones, and those of the extremes."""
    w = Window.partitionBy(*keys)
    rows = profile.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("pos")) - 1, "_lo": F.min(value).over(w), "_hi": F.max(value).over(w)})
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / points))
    keep = (F.col("_i") % stride == 0) | forced | (F.col(value) == F.col("_lo")) | (F.col(value) == F.col("_hi"))
    return rows.filter(keep).drop("_n", "_i", "_lo", "_hi")


def closest_rows(identities: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """An event's anchors and the rows closest to any of them, ``limit`` in all."""
    both = identities.select("dataset_id", F.col("s1").alias("anchor"), F.col("s2").alias("row"), "identity").unionByName(identities.select("dataset_id", F.col("s2").alias("anchor"), F.col("s1").alias("row"), "identity"))
    near = both.join(anchors, ["dataset_id", "anchor"]).groupBy("dataset_id", "event_id", "row").agg(F.max("identity").alias("identity"))
    own = anchors.select("dataset_id", "event_id", F.col("anchor").alias("row"), F.lit(2.0).alias("identity"))
    all_ = near.unionByName(own).groupBy("dataset_id", "event_id", "row").agg(F.max("identity").alias("identity"))
    w = Window.partitionBy("dataset_id", "event_id").orderBy(F.desc("identity"), "row")
    return all_.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("dataset_id", "event_id", "row", "rank")


# ---- erasure and exports ----------------------------------------------------


def masked_states(sequences: DataFrame, tracts: DataFrame) -> DataFrame:
    """Sequences with their tracts set to missing; the states stay arrays, and rows without tracts pass through."""
    held = tracts.groupBy("dataset_id", "seq_id").agg(F.collect_set(F.struct("begin", "end")).alias("_t"))
    rows = sequences.join(held, ["dataset_id", "seq_id"], "left")
    hit = lambda i: F.exists("_t", lambda t: in_tract(i + 1, t["begin"], t["end"]))
    return rows.withColumn("states", F.when(F.col("_t").isNull(), F.col("states")).otherwise(F.transform("states", lambda s, i: F.when(hit(i), F.lit(0).cast("tinyint")).otherwise(s)))).drop("_t")


def fragments(sequences: DataFrame, tracts: DataFrame, least: int) -> DataFrame:
    """A new row for each tract with at least ``least`` usable sites, all else missing; equal rows once."""
    rows = sequences.join(tracts.select("dataset_id", "seq_id", "event_id", "begin", "end"), ["dataset_id", "seq_id"])
    kept = F.transform("states", lambda s, i: F.when(in_tract(i + 1, F.col("begin"), F.col("end")), s).otherwise(F.lit(0).cast("tinyint")))
    out = rows.select("dataset_id", F.col("seq_id").alias("origin"), "event_id", kept.alias("states"))
    return out.filter(F.size(F.filter("states", lambda s: s > 0)) >= least).groupBy("dataset_id", "origin", "states").agg(F.min("event_id").alias("event_id"))


def as_text(states: Column) -> Column:
    return F.array_join(F.transform(states, lambda s: F.element_at(F.array(*map(F.lit, "-ACGT")), s.cast("int") + 1)), "")


def fasta(rows: DataFrame, name: Column) -> DataFrame:
    """One record a row, header and sequence."""
    return rows.withColumn("record", F.concat(F.lit(">"), name, F.lit("\n"), as_text(F.col("states"))))


def without_sequences(sequences: DataFrame, recombinants: DataFrame) -> DataFrame:
    return sequences.join(recombinants.select("dataset_id", "seq_id"), ["dataset_id", "seq_id"], "left_anti")


def without_columns(sequences: DataFrame, tracts: DataFrame) -> DataFrame:
    """Sequences without the columns that any tract of their data set covers."""
    held = tracts.groupBy("dataset_id").agg(F.collect_set(F.struct("begin", "end")).alias("_t"))
    rows = sequences.join(held, "dataset_id", "left")
    out = F.filter("states", lambda s, i: ~F.exists("_t", lambda t: in_tract(i + 1, t["begin"], t["end"])))
    return rows.withColumn("states", F.when(F.col("_t").isNull(), F.col("states")).otherwise(out)).drop("_t")


def prior_erasures(events: DataFrame, length: int, window: int) -> DataFrame:
    """Events whose first breakpoint lies within ``window`` sites of an earlier event's tract in the same recombinant."""
    e = events.select("dataset_id", "recombinant", "event_id", F.explode(segments(F.col("begin"), F.col("end"), F.lit(length))).alias("s")).select("dataset_id", "recombinant", F.col("event_id").alias("earlier"), "s.lo", "s.hi")
    now = events.select("dataset_id", "recombinant", "event_id", F.col("begin").alias("bp"))
    near = now.join(e, ["dataset_id", "recombinant"]).filter((F.col("earlier") < F.col("event_id")) & (F.col("bp") + window >= F.col("lo")) & (F.col("bp") - window <= F.col("hi")))
    return near.groupBy("dataset_id", "event_id").agg(F.count_distinct("earlier").alias("n_earlier"))


def span(length: int) -> Column:
    return tract_span(F.col("begin"), F.col("end"), F.lit(length))


# ---- evidence and views -----------------------------------------------------


def chi_only(supports: DataFrame, signals: DataFrame) -> DataFrame:
    """Events that no method but MaxChi and CHIMAERA supports."""
    rows = supports.join(signals.select("dataset_id", "signal_id", "method"), ["dataset_id", "signal_id"])
    return rows.groupBy("event_id").agg((F.count_if(~F.col("method").isin("MaxChi", "CHIMAERA")) == 0).alias("chi_only"))


def role_hypotheses(events: DataFrame) -> DataFrame:
    """Each member of an event's triplet in turn as the recombinant, the other two as parents in order."""
    h = lambda i, r, p, q: F.struct(F.lit(i).alias("hypothesis"), F.col(r).alias("recombinant"), F.col(p).alias("parent1"), F.col(q).alias("parent2"))
    return events.select("event_id", F.inline(F.array(h(0, "a", "b", "c"), h(1, "b", "a", "c"), h(2, "c", "a", "b"))))


def masked_followup(states: DataFrame, events: DataFrame) -> DataFrame:
    """Masked rows against the parents of each event of their data set."""
    kept = F.filter(F.array("a", "b", "c"), lambda x: x != F.col("recombinant"))
    e = events.select("dataset_id", "event_id", "recombinant", kept.alias("p"))
    rows = states.filter("row_state = 'masked'").select("dataset_id", "seq_id").join(e, "dataset_id")
    return rows.filter("seq_id <> recombinant AND NOT array_contains(p, seq_id)").select("event_id", "seq_id", F.col("p")[0].alias("parent1"), F.col("p")[1].alias("parent2"))


def _regions(length: int, flank: int) -> Column:
    """Regions of a site: inside or outside the tract, and within the flanks of either breakpoint (circular)."""
    n, inner = F.lit(length), in_tract(F.col("pos"), F.col("begin"), F.col("end"))
    near = lambda d, name: F.when(F.pmod(d, n) < flank, name)
    names = F.array(
        F.when(inner, "in").otherwise("out"),
        near(F.col("begin") - 1 - F.col("pos"), "begin_left"),
        near(F.col("pos") - F.col("begin"), "begin_right"),
        near(F.col("end") - F.col("pos"), "end_left"),
        near(F.col("pos") - F.col("end") - 1, "end_right"),
    )
    return F.filter(names, lambda x: x.isNotNull())


def regional_counts(sequences: DataFrame, events: DataFrame, pairs: DataFrame, length: int, flank: int = 20) -> DataFrame:
    """event_id, s1, s2, region, valid, differences. pairs: event_id, s1, s2, the pairs to be measured for each event."""
    e = events.select("event_id", "dataset_id", "begin", "end").join(pairs, "event_id")
    side = lambda n, s: sequences.select("dataset_id", F.col("seq_id").alias(n), F.col("states").alias(s))
    rows = e.join(side("s1", "x"), ["dataset_id", "s1"]).join(side("s2", "y"), ["dataset_id", "s2"])
    sites = rows.select("event_id", "s1", "s2", "begin", "end", F.posexplode(F.arrays_zip("x", "y")).alias("i", "p")).withColumn("pos", F.col("i") + 1)
    sites = sites.filter("p.x > 0 AND p.y > 0").select("event_id", "s1", "s2", F.explode(_regions(length, flank)).alias("region"), (F.col("p.x") != F.col("p.y")).alias("differs"))
    return sites.groupBy("event_id", "s1", "s2", "region").agg(F.count("*").alias("valid"), F.count_if("differs").alias("differences"))


def triplet_pairs(events: DataFrame) -> DataFrame:
    p = lambda x, y: F.struct(F.col(x).alias("s1"), F.col(y).alias("s2"))
    return events.select("event_id", F.inline(F.array(p("a", "b"), p("a", "c"), p("b", "c"))))


def phylogenetic_set(sequences: DataFrame, events: DataFrame, length: int) -> DataFrame:
    """Rows that are closer to an event's recombinant than to both parents, inside the tract and outside."""
    others = sequences.select("dataset_id", F.col("seq_id").alias("s1"))
    member = events.select("dataset_id", "event_id", "recombinant", F.array("a", "b", "c").alias("t"))
    pairs = member.join(others, "dataset_id").filter("NOT array_contains(t, s1)").select("event_id", "s1", F.explode("t").alias("s2"))
    d = regional_counts(sequences, events, pairs, length).filter("region IN ('in', 'out')").withColumn("d", F.col("differences") / F.col("valid"))
    own = F.col("s2") == F.col("recombinant")
    d = d.join(member.select("event_id", "recombinant"), "event_id").groupBy("event_id", "s1", "region").agg(F.max(F.when(own, F.col("d"))).alias("own"), F.min(F.when(~own, F.col("d"))).alias("parent"), F.count("*").alias("k"))
    return d.filter("k = 3 AND own < parent").groupBy("event_id", F.col("s1").alias("seq_id")).agg(F.count("*").alias("regions")).filter("regions = 2").drop("regions")


def breakpoint_view(sequences: DataFrame, events: DataFrame, length: int, flank: int, rows: int) -> DataFrame:
    """Sites around both breakpoints of each event: its triplet first, then other rows in order, ``rows`` in all."""
    e = events.select("dataset_id", "event_id", F.array("a", "b", "c").alias("t"), F.explode(F.array(F.struct(F.lit("begin").alias("side"), F.col("begin").alias("at")), F.struct(F.lit("end").alias("side"), F.col("end").alias("at")))).alias("bp"))
    all_ = e.join(sequences.select("dataset_id", "seq_id", "states"), "dataset_id")
    w = Window.partitionBy("event_id", "bp.side").orderBy(~F.array_contains("t", F.col("seq_id")), "seq_id")
    shown = all_.withColumn("row", F.row_number().over(w)).filter(F.col("row") <= rows)
    offsets = shown.select("event_id", "bp.side", "seq_id", "row", "states", "bp.at", F.explode(F.sequence(F.lit(-flank), F.lit(flank))).alias("offset"))
    pos = (F.pmod(F.col("at") + F.col("offset") - 1, F.lit(length)) + 1).cast("int")
    return offsets.withColumn("pos", pos).select("event_id", "side", "seq_id", "row", "offset", "pos", F.element_at("states", F.col("pos")).cast("int").alias("st"))


def latest_values(edits: DataFrame, fields: list[str]) -> DataFrame:
    """Of an append-only log of edits the last value of each field that was given one."""
    return edits.groupBy("event_id").agg(*[F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.struct("at", "edit_id"))).alias(f) for f in fields])


def csv_lines(events: DataFrame, fields: list[str]) -> DataFrame:
    """One line of comma-separated values for each event; text with a comma, quote or line end is quoted."""
    cell = lambda c: F.when(F.col(c).cast("string").rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return events.select("event_id", F.concat_ws(",", *[cell(c) for c in fields]).alias("line"))


def tract_records(sequences: DataFrame, events: DataFrame) -> DataFrame:
    """The recombinant's own tract of each event as a sequence, in order of events; a wrapped tract goes on from the
    last site to the first."""
    rows = events.select("dataset_id", "event_id", F.col("recombinant").alias("seq_id"), "begin", "end").join(sequences.select("dataset_id", "seq_id", "states"), ["dataset_id", "seq_id"])
    part = lambda a, n: F.slice("states", a, n)
    size = F.size("states")
    tract = F.when(F.col("begin") <= F.col("end"), part(F.col("begin"), F.col("end") - F.col("begin") + 1)).otherwise(F.concat(part(F.col("begin"), size - F.col("begin") + 1), part(F.lit(1), F.col("end"))))
    return rows.select("event_id", "seq_id", as_text(tract).alias("sequence"))
