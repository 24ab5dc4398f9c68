"""Profiles along the sites of triplets: rolling counts, window differences, walks, runs and tallies.

Circular frames are unrolled: rows near the ends are repeated beyond them, windows run over the padded rows, and the
repeats are dropped again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi_square, jukes_cantor
from .relations import TRIPLET

#: Pairs of a triplet, and for each target the pairs with its first and its second parent.
PAIRS = ("m12", "m13", "m23")
TARGET_PAIRS = {0: ("m12", "m13"), 1: ("m12", "m23"), 2: ("m13", "m23")}


def indexed(sites: DataFrame, keys=TRIPLET) -> DataFrame:
    """idx from 0 along the retained sites of each key, and their number n."""
    w = Window.partitionBy(*keys)
    return sites.withColumns({"idx": (F.row_number().over(w.orderBy("pos")) - 1).cast("int"), "n": F.count("*").over(w).cast("int")})


def padded(sites: DataFrame, by: int) -> DataFrame:
    """Rows of indexed sites with the copies that a circular window of ``by`` rows to either side needs."""
    copies = F.when(F.col("n") > by, F.concat(F.array(F.lit(0)), F.when(F.col("idx") < by, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.when(F.col("idx") >= F.col("n") - by, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))))
    return sites.withColumn("lap", F.explode(F.coalesce(copies, F.array(F.lit(0))))).withColumn("at", F.col("idx") + F.col("lap") * F.col("n"))


def rolling_counts(rich: DataFrame, window: int) -> DataFrame:
    """Counts of each pair's sites in circular windows of 2 * floor(window / 2) + 1 information-rich sites; triplets
    with fewer sites than that have no window."""
    h = window // 2
    rows = padded(indexed(rich).filter(F.col("n") >= 2 * h + 1), h)
    w = Window.partitionBy(*TRIPLET).orderBy("at").rowsBetween(-h, h)
    counted = rows.select(*TRIPLET, "pos", "idx", "lap", *[F.sum((F.col("cat") == k).cast("int")).over(w).alias(f"c{k}") for k in (0, 1, 2)])
    return counted.filter("lap = 0").drop("lap")


def chi_profile(variable: DataFrame, h: int) -> DataFrame:
    """Chi-square of the matches in the h sites before a boundary and the h sites from it on, circular, for each pair."""
    rows = padded(indexed(variable).filter(F.col("n") >= 2 * h), h)
    w = Window.partitionBy(*TRIPLET).orderBy("at")
    sums = rows.select(
        *TRIPLET,
        "pos",
        "idx",
        "lap",
        *[F.sum(m).over(w.rowsBetween(-h, -1)).alias(f"l_{m}") for m in PAIRS],
        *[F.sum(m).over(w.rowsBetween(0, h - 1)).alias(f"r_{m}") for m in PAIRS],
    ).filter("lap = 0")
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.col(f"l_{m}").alias("l"), F.col(f"r_{m}").alias("r")) for i, m in enumerate(PAIRS)])).alias("p")
    flat = sums.select(*TRIPLET, "pos", "idx", pair).select(*TRIPLET, "pos", "idx", "p.pair", "p.l", "p.r")
    return flat.withColumn("chi", chi_square(F.lit(h), F.col("l"), F.col("r")))


def strongest_boundary(profile: DataFrame, critical: int) -> DataFrame:
    """The largest chi-square with |left - right| > critical; ties go to the first boundary, then the first pair."""
    gated = profile.filter(F.abs(F.col("l") - F.col("r")) > critical)
    best = gated.groupBy(*TRIPLET).agg(F.count("*").alias("n_gated"), F.min(F.struct((-F.col("chi")).alias("k"), "idx", "pair", "pos")).alias("best"))
    return best.select(*TRIPLET, "n_gated", "best.pair", "best.pos", (-F.col("best.k")).alias("chi"))


def targets(variable: DataFrame) -> DataFrame:
    """Each target's sites where it matches exactly one parent: step 1 for the first, -1 for the second."""
    row = lambda t, p: F.struct(F.lit(t).alias("target"), (F.col(p[0]) - F.col(p[1])).alias("step"))
    out = variable.select(*TRIPLET, "pos", F.explode(F.array(*[row(t, p) for t, p in TARGET_PAIRS.items()])).alias("t"))
    return out.select(*TRIPLET, "pos", "t.target", "t.step").filter("step <> 0")


def walk(steps: DataFrame) -> DataFrame:
    w = Window.partitionBy(*TRIPLET, "target").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("height", F.sum("step").over(w))


def excursions(walks: DataFrame, least: int = 4) -> DataFrame:
    """Largest descent of each walk from its maximum so far (0 at the start), before any wrapping: its size, where the
    maximum was first reached and where the descent first has its size. Walks under ``least`` sites are left out."""
    w = Window.partitionBy(*TRIPLET, "target").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = walks.withColumn("top", F.greatest(F.max("height").over(w), F.lit(0)))
    rows = rows.withColumn("top_pos", F.max(F.when((F.col("height") == F.col("top")) & (F.col("step") == 1) & (F.col("top") > 0), F.struct("top", (-F.col("pos")).alias("p")))).over(w))
    best = rows.groupBy(*TRIPLET, "target").agg(
        F.count("*").alias("n_sites"),
        F.count_if(F.col("step") == 1).alias("plus"),
        F.max("height").alias("max_height"),
        F.min("height").alias("min_height"),
        F.max(F.struct((F.col("top") - F.col("height")).alias("d"), (-F.col("pos")).alias("p"), F.when(F.col("top_pos.top") == F.col("top"), -F.col("top_pos.p")).otherwise(0).alias("b"))).alias("m"),
    )
    return best.filter(F.col("n_sites") >= least).select(*TRIPLET, "target", "n_sites", "plus", "max_height", "min_height", F.col("m.d").alias("descent"), F.col("m.b").alias("begin_after"), (-F.col("m.p")).alias("end_pos"))


def chimaera_targets(variable: DataFrame) -> DataFrame:
    """Sites of each target's profile, numbered anew, with the match to its first parent."""
    w = Window.partitionBy(*TRIPLET, "target").orderBy("pos")
    return targets(variable).withColumns({"idx": F.row_number().over(w), "match": (F.col("step") == 1).cast("int")})


def geneconv_categories(variable: DataFrame) -> DataFrame:
    """0, 1, 2: the pair that matches; 3: all differ."""
    return variable.withColumn("cat", F.when(F.col("m12") == 1, 0).when(F.col("m13") == 1, 1).when(F.col("m23") == 1, 2).otherwise(3))


def runs(rows: DataFrame, value: str, keys=TRIPLET) -> DataFrame:
    """Maximal runs of one value along pos: value, first, last and number of sites (gaps and islands, linear)."""
    w = Window.partitionBy(*keys).orderBy("pos")
    new = (F.lag(value).over(w).isNull() | (F.lag(value).over(w) != F.col(value))).cast("int")
    numbered = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run", value).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("sites"))


def window_geometry(length: int, window: int, step: int) -> tuple[int, int, int]:
    """Window and step after capping at L / 2, L / 4 and half the window; windows are numbered 0 .. L // step + 1."""
    window = min(window, length // 2)
    step = max(1, min(step, length // 4, window // 2))
    return window, step, length // step + 1


def window_sites(length: int, window: int, step: int) -> Column:
    """win, pos: the sites of each centred window, wrapped into 1 .. length; an array."""
    window, step, last = window_geometry(length, window, step)
    at = lambda win, k: F.struct(win.alias("win"), (F.pmod(win * step - window // 2 + k - 1, F.lit(length)) + 1).cast("int").alias("pos"))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(last)), lambda win: F.transform(F.sequence(F.lit(1), F.lit(window)), lambda k: at(win, k))))


def bootscan_windows(sequences: DataFrame, length: int, window: int, step: int) -> DataFrame:
    """dataset_id, win, pos: the windows of each alignment of that length."""
    held = sequences.filter(F.size("states") == length).select("dataset_id").distinct()
    return held.select("dataset_id", F.inline(window_sites(length, window, step)))


def pair_distances(cells: DataFrame, length: int, window: int, step: int) -> DataFrame:
    """Jukes-Cantor distance of each pair in each window (replicate 0: all weights 1). Pairs, not triplets, are measured."""
    a = cells.select("dataset_id", F.col("seq_id").alias("s1"), "pos", F.col("st").alias("x"))
    b = cells.select("dataset_id", F.col("seq_id").alias("s2"), "pos", F.col("st").alias("y"))
    place = F.filter(window_sites(length, window, step), lambda s: s["pos"] == F.col("pos"))
    both = a.join(b, ["dataset_id", "pos"]).filter("s1 < s2 AND x > 0 AND y > 0").withColumn("win", F.explode(F.transform(place, lambda s: s["win"])))
    return both.groupBy("dataset_id", "win", "s1", "s2").agg(jukes_cantor(F.count("*"), F.count_if(F.col("x") != F.col("y"))).alias("d"))


def closest_pair_votes(distances: DataFrame) -> DataFrame:
    """For each triplet the windows in which a pair is strictly the closest, all three distances being under 2."""
    d = lambda n, a, b: distances.select("dataset_id", "win", F.col("s1").alias(a), F.col("s2").alias(b), F.col("d").alias(n))
    t = d("d12", "a", "b").join(d("d13", "a", "c"), ["dataset_id", "win", "a"]).filter("b < c").join(d("d23", "b", "c"), ["dataset_id", "win", "b", "c"])
    t = t.filter("d12 < 2 AND d13 < 2 AND d23 < 2")
    least = lambda x, y, z: (F.col(x) < F.col(y)) & (F.col(x) < F.col(z))
    return t.groupBy(*TRIPLET).agg(F.count("*").alias("usable"), F.count_if(least("d12", "d13", "d23")).alias("v12"), F.count_if(least("d13", "d12", "d23")).alias("v13"), F.count_if(least("d23", "d12", "d13")).alias("v23"))


def triplet_relation(sites: DataFrame) -> DataFrame:
    """0 missing, 1 all differ, 2, 3, 4 the pair 12, 13, 23 agrees, 5 all the same."""
    same = lambda p, q: F.col(p) == F.col(q)
    rel = F.when((F.col("x") == 0) | (F.col("y") == 0) | (F.col("z") == 0), 0).when(same("x", "y"), F.when(same("x", "z"), 5).otherwise(2)).when(same("x", "z"), 3).when(same("y", "z"), 4).otherwise(1)
    return sites.withColumn("relation", rel)


def siscan_tallies(relations: DataFrame, length: int, window: int, step: int) -> DataFrame:
    """Sites of each relation in windows that never wrap, (L - w - 1) / step + 1 of them."""
    n = (length - window - 1) // step + 1
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - window) / step)).cast("int")
    last = F.least(F.lit(n - 1), F.floor((F.col("pos") - 1) / step)).cast("int")
    hit = relations.withColumns({"lo": first, "hi": last}).filter("lo <= hi").withColumn("win", F.explode(F.sequence("lo", "hi")))
    return hit.groupBy(*TRIPLET, "win").agg(*[F.count_if(F.col("relation") == k).alias(f"r{k}") for k in range(6)])


def pair_switches(tallies: DataFrame) -> DataFrame:
    """The pair that agrees at the most sites of a window (ties: the first), and runs of windows in which it stays."""
    pair = F.when((F.col("r2") >= F.col("r3")) & (F.col("r2") >= F.col("r4")), 0).when(F.col("r3") >= F.col("r4"), 1).otherwise(2)
    return runs(tallies.select(*TRIPLET, F.col("win").alias("pos"), pair.alias("pair")), "pair")


def phylpro(cells: DataFrame, h: int) -> DataFrame:
    """For each row and boundary the correlation between its differences to all rows in the h polymorphic sites before
    and in the h sites after; circular; 1 where a side does not vary. Lowest value of each row and its boundary."""
    poly = cells.groupBy("dataset_id", "pos").agg(F.count_distinct(F.when(F.col("st") > 0, F.col("st"))).alias("k")).filter("k >= 2").drop("k")
    kept = indexed(poly, ["dataset_id"]).filter(F.col("n") >= 2 * h)
    a = cells.select("dataset_id", "pos", F.col("seq_id").alias("t"), F.col("st").alias("x"))
    b = cells.select("dataset_id", "pos", F.col("seq_id").alias("o"), F.col("st").alias("y"))
    flags = kept.join(a, ["dataset_id", "pos"]).join(b, ["dataset_id", "pos"]).filter("t <> o")
    flags = flags.withColumn("miss", ((F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") != F.col("y"))).cast("int"))
    w = Window.partitionBy("dataset_id", "t", "o").orderBy("at")
    sums = padded(flags, h).select("dataset_id", "t", "o", "pos", "idx", "lap", F.sum("miss").over(w.rowsBetween(-h, -1)).alias("l"), F.sum("miss").over(w.rowsBetween(0, h - 1)).alias("r")).filter("lap = 0")
    s = sums.groupBy("dataset_id", "t", "idx", "pos").agg(F.count("*").alias("n"), F.sum("l").alias("sx"), F.sum("r").alias("sy"), F.sum(F.col("l") * F.col("r")).alias("sxy"), F.sum(F.col("l") * F.col("l")).alias("sxx"), F.sum(F.col("r") * F.col("r")).alias("syy"))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    r = F.when((vx <= 0) | (vy <= 0), 1.0).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(vx.cast("double")) * F.sqrt(vy.cast("double"))))
    return s.select("dataset_id", F.col("t").alias("seq_id"), "idx", "pos", r.alias("correlation"))


def missing_runs(cells: DataFrame, least: int = 10) -> DataFrame:
    """Runs of at least ``least`` missing sites."""
    flags = cells.withColumn("gap", (F.col("st") == 0).cast("int"))
    return runs(flags, "gap", ["dataset_id", "seq_id"]).filter((F.col("gap") == 1) & (F.col("sites") >= least))
