"""The cyclic scan as rounds of tables, all alignments abreast.

Each round the strongest signal of an alignment becomes an event: its tract is erased from the recombinant and lives on as
a fragment row of its own. Evaluation is semi-naive: a row is dirty if the last event changed or made it, only triplets
with a dirty row run, and the signals of all others are kept. Alignments without a signal leave the loop. Rows, kept
signals and events are written tables; what comes to the driver is whether anything is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import in_tract, overlap
from ..ship import ensure
from ..tables import discard, written
from .events import METHOD_ORDER, method_rank
from .kernels.common import Options
from .scan import PRIMARY, SIGNAL, all_triplets, detected, listed_triplets, packed, triplets_with

ROUNDS, FRAGMENTS, OVERLAP, LONGEST = 64, 256, 0.3, 100_000
EVENT_SCHEMA = "dataset_id long, round int, method string, recombinant int, major int, minor int, begin int, end int, corrected_p double, supports long, methods string, scheduled long, executed long"
#: Number of the first fragment row of an alignment; originals are counted from 0.
FIRST = 1 << 20
_ROWS = ["dataset_id", "row", "origin", "born", "states"]
_KEY = [x.split()[0] for x in SIGNAL.split(", ")]


def numbered(sequences: DataFrame) -> DataFrame:
    """dataset_id, row, origin, born, states, seq_id: rows of an alignment counted from 0 by seq_id; all originals."""
    row = (F.row_number().over(Window.partitionBy("dataset_id").orderBy("seq_id")) - 1).cast("int")
    return sequences.select("dataset_id", row.alias("row"), row.alias("origin"), F.lit(0).alias("born"), "states", "seq_id")


def usable(states: Column, o: Options) -> Column:
    valid, length = F.size(F.filter(states, lambda s: s > 0)), F.size(states)
    return valid >= F.greatest(F.lit(max(5, o.rdp_window)), F.ceil(length / 100))


def schedule_sizes(live: DataFrame) -> DataFrame:
    """dataset_id, scheduled: triplets of three different originals, from the number of rows of each original alone."""
    c = live.groupBy("dataset_id", "origin").agg(F.count("*").alias("c"))
    p1, p2, p3 = F.sum("c"), F.sum(F.col("c") * F.col("c")), F.sum(F.col("c") * F.col("c") * F.col("c"))
    return c.groupBy("dataset_id").agg(F.floor((p1 * p1 * p1 - 3 * p1 * p2 + 2 * p3) / 6).cast("long").alias("scheduled"))


def executed_sizes(live: DataFrame, dirty: DataFrame) -> DataFrame:
    """dataset_id, executed: triplets with a dirty row, likewise."""
    c = live.groupBy("dataset_id", "origin").agg(F.count("*").alias("c"))
    own = live.join(dirty.select("dataset_id", "row"), ["dataset_id", "row"]).groupBy("dataset_id", F.col("origin").alias("own")).agg(F.count("*").alias("d"))
    rest = c.join(own, "dataset_id").filter("origin <> own").groupBy("dataset_id", "own", "d").agg(F.sum("c").alias("p1"), F.sum(F.col("c") * F.col("c")).alias("p2"))
    return rest.groupBy("dataset_id").agg(F.sum(F.col("d") * F.floor((F.col("p1") * F.col("p1") - F.col("p2")) / 2)).cast("long").alias("executed"))


def strongest(signals: DataFrame) -> DataFrame:
    """One signal of each alignment by one aggregate: least corrected, then local p, order of methods, triplet and bounds,
    among those whose tract still has a site to erase."""
    order = ["corrected_p", "local_p", "rank", "a", "b", "c", "begin", "end", "recombinant", "major", "minor", "method", "oa", "ob", "oc"]
    held = signals.filter("erasable").withColumn("rank", method_rank(F.col("method")))
    return held.groupBy("dataset_id").agg(F.min(F.struct(*order)).alias("s")).select("dataset_id", "s.*").drop("rank")


def support(signals: DataFrame, chosen: DataFrame, lengths: DataFrame) -> DataFrame:
    """chosen with supports and methods: signals of two of its originals at least whose tracts overlap its own."""
    c = chosen.select("dataset_id", F.array("oa", "ob", "oc").alias("_own"), F.col("begin").alias("_b"), F.col("end").alias("_e")).join(lengths, "dataset_id")
    n = F.col("length")
    whole = lambda b, e: (F.when(F.col(b) == F.col(e), 1).otherwise(F.col(b)), F.when(F.col(b) == F.col(e), n).otherwise(F.col(e)))
    share = overlap(*whole("begin", "end"), *whole("_b", "_e"), n)
    two = sum((F.array_contains("_own", F.col(x)).cast("int") for x in ("oa", "ob", "oc")), F.lit(0)) >= 2
    backing = signals.join(c, "dataset_id").filter(two & (share > OVERLAP)).groupBy("dataset_id").agg(F.count("*").alias("supports"), F.collect_set("method").alias("_m"))
    names = F.array_join(F.filter(F.array(*map(F.lit, METHOD_ORDER)), lambda m: F.array_contains("_m", m)), ",")
    return chosen.join(backing.select("dataset_id", "supports", names.alias("methods")), "dataset_id")


def erased(rows: DataFrame, tracts: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """rows after the tracts (dataset_id, row, begin, end, number: one an alignment) were set to missing, and the changed and
    new rows. A tract lives on as a row if it has sites enough and equals no row of its alignment."""
    t = tracts.select("dataset_id", F.col("row").alias("_r"), F.col("begin").alias("_b"), F.col("end").alias("_e"), "number")
    met = rows.join(t, "dataset_id", "left")
    held = lambda i: (F.col("_b") == F.col("_e")) | in_tract(i + 1, F.col("_b"), F.col("_e"))
    none = F.lit(0).cast("tinyint")
    own = F.coalesce(F.col("row") == F.col("_r"), F.lit(False))
    out = F.when(own, F.transform("states", lambda s, i: F.when(held(i), none).otherwise(s))).otherwise(F.col("states"))
    after = met.select("dataset_id", "row", "origin", "born", out.alias("states"))
    kept = F.transform("states", lambda s, i: F.when(held(i), s).otherwise(none))
    pieces = met.filter(own).select("dataset_id", "origin", F.col("number").alias("born"), kept.alias("states")).filter(usable(F.col("states"), o) & (F.size("states") < LONGEST))
    # Fragments are numbered after all originals, by the event that made them.
    counts = rows.groupBy("dataset_id").agg(F.count_distinct("origin").alias("_n"), F.count("*").alias("_all"))
    fresh = pieces.join(counts, "dataset_id").filter(F.col("_all") - F.col("_n") < FRAGMENTS)
    fresh = fresh.join(after.select("dataset_id", "states"), ["dataset_id", "states"], "left_anti")
    fresh = fresh.select("dataset_id", (F.lit(FIRST) + F.col("born")).cast("int").alias("row"), "origin", "born", "states")
    dirty = t.select("dataset_id", F.col("_r").alias("row")).unionByName(fresh.select("dataset_id", "row"))
    return after.unionByName(fresh), dirty


def cyclic_scan(sequences: DataFrame, o: Options, methods=PRIMARY, decided: DataFrame | None = None) -> DataFrame:
    """Events of each alignment in the order in which they were found, at most ROUNDS.

    decided: reviewed events (dataset_id, round from 1, recombinant, begin, end, state; recombinant is a seq_id), which are
    taken over as they were decided: all but the rejected ones are erased again, in their order, and only later events are
    looked for, and returned. scheduled: triplets of an event's round; executed: those that were run for it, as one of
    their rows had changed. A clean triplet is never run again, but for the first round after an erasure, when 3SEQ looks
    once more at those with signals, to split their tracts. A fragment without any signal in the round after it was made
    is dropped. The correction is the first round's, for all rounds."""
    spark = sequences.sparkSession
    ensure(spark)
    first = written(numbered(sequences), "originals")
    names = first.select("dataset_id", F.col("row").alias("_row"), "seq_id")
    sizes = first.groupBy("dataset_id").agg(F.count("*").alias("n"), F.max(F.size("states")).alias("length")).filter("n >= 3")
    tests = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * (F.col("n") - 1) * (F.col("n") - 2) / 6)).cast("long")
    sizes = written(sizes.withColumn("_tests", tests if o.correction else F.lit(1).cast("long")), "sizes")
    rows, done = first.select(*_ROWS), None
    if decided is not None:
        who = decided.join(names.withColumnRenamed("seq_id", "recombinant"), ["dataset_id", "recombinant"]).withColumnRenamed("_row", "row")
        who = written(who.select("dataset_id", "row", "begin", "end", F.col("round").alias("number"), (F.coalesce("state", F.lit("")) == "rejected").alias("rejected")), "decided")
        done = who.groupBy("dataset_id").agg(F.max("number").cast("int").alias("_done"))
        for number in range(1, (who.agg(F.max("number")).first()[0] or 0) + 1):
            old, rows = rows, written(erased(rows, who.filter((F.col("number") == number) & ~F.col("rejected")), o)[0], "rows")
            discard(old)
    sizes = sizes.join(done, "dataset_id", "left").fillna(0, ["_done"]) if done is not None else sizes.withColumn("_done", F.lit(0))
    kept = dirty = None
    events: list[DataFrame] = []
    for number in range(1, ROUNDS + 1):
        live = rows.filter(usable(F.col("states"), o)).join(sizes.select("dataset_id"), "dataset_id", "left_semi")
        whole = packed(live.select("dataset_id", "row", "origin", "states"), "SISCAN" in methods)
        whole = whole.join(sizes.select("dataset_id", "_tests", (F.col("_done") + number > 1).alias("_split")), "dataset_id")
        run = lambda work, which, w=whole: detected(work, w, o, which, F.col("_tests"), F.col("_split"))
        if kept is None:
            fresh = run(all_triplets(live), methods)
        else:
            fresh = run(triplets_with(live, dirty), methods)
            if number == 2 and decided is None and "3SEQ" in methods:
                again = listed_triplets(kept.select("dataset_id", "a", "b", "c").distinct())
                fresh = fresh.unionByName(run(again, ("3SEQ",)))
                kept = kept.filter("method <> '3SEQ'")
            fresh = fresh.unionByName(kept.select(*_KEY))
        signals = written(fresh, "signals")
        # Fragments of the last event that are in no signal go.
        touched = signals.select("dataset_id", F.explode(F.array("a", "b", "c")).alias("row")).distinct()
        dead = rows.filter((F.col("row") >= FIRST) & (F.col("born") == number - 1)).select("dataset_id", "row").join(touched, ["dataset_id", "row"], "left_anti")
        held = rows.join(dead, ["dataset_id", "row"], "left_anti") if dirty is not None else rows
        chosen = written(strongest(signals), "chosen")
        if chosen.isEmpty():
            discard(signals, chosen)
            break
        scheduled = schedule_sizes(live)
        executed = scheduled.withColumnRenamed("scheduled", "executed") if dirty is None else executed_sizes(live, dirty)
        found = support(signals, chosen, sizes.select("dataset_id", "length")).join(scheduled, "dataset_id").join(executed, "dataset_id", "left").fillna(0, ["executed"])
        found = found.join(sizes.select("dataset_id", "_done"), "dataset_id").withColumn("round", (F.col("_done") + number).cast("int"))
        origin = lambda r: F.when(F.col(r) == F.col("a"), F.col("oa")).when(F.col(r) == F.col("b"), F.col("ob")).otherwise(F.col("oc")).alias(r)
        events.append(written(found.select("dataset_id", "round", "method", *map(origin, ("recombinant", "major", "minor")), "begin", "end", "corrected_p", "supports", "methods", "scheduled", "executed"), "events"))
        active = chosen.select("dataset_id")
        after, changed = erased(held.join(active, "dataset_id", "left_semi"), chosen.select("dataset_id", F.col("recombinant").alias("row"), "begin", "end", F.lit(number).alias("number")), o)
        older = (rows, kept, dirty)
        rows, dirty = written(after, "rows"), written(changed, "dirty")
        stale = [dirty.select("dataset_id", F.col("row").alias(x)) for x in "abc"]
        kept = signals.join(active, "dataset_id", "left_semi")
        for x, s in zip("abc", stale, strict=True):
            kept = kept.join(s, ["dataset_id", x], "left_anti")
        kept = written(kept.select(*_KEY), "kept")
        discard(*older, signals, chosen)
    if not events:
        return spark.createDataFrame([], EVENT_SCHEMA)
    out = reduce(DataFrame.unionByName, events)
    for role in ("recombinant", "major", "minor"):
        out = out.join(names.select("dataset_id", F.col("_row").alias(role), F.col("seq_id").alias("_id")), ["dataset_id", role]).drop(role).withColumnRenamed("_id", role)
    return out.select(*[F.col(n).cast(k) for n, k in (x.split() for x in EVENT_SCHEMA.split(", "))])


def rediscovered(sequences: DataFrame, decided: DataFrame, o: Options, methods=PRIMARY) -> DataFrame:
    """Events after the reviewed ones: those are kept in order, everything later is looked for anew."""
    return cyclic_scan(sequences, o, methods, decided)
