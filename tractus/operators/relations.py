"""Counts, identities, row curation, plans and enumeration of triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks

#: Ranks of one task's range of combinations.
RANKS = 20_000
#: Frozen cap of the correction: floor(255 ** 4 / 2).
CORRECTION_CAP = 255**4 // 2
TRIPLET = ["dataset_id", "a", "b", "c"]


def sequence_counts(sequences: DataFrame) -> DataFrame:
    """Valid and missing sites of each sequence, without unrolling the states."""
    valid = F.size(F.filter("states", lambda s: s > 0)).cast("long")
    return sequences.select("dataset_id", "seq_id", valid.alias("valid_sites"), (F.size("states") - valid).cast("long").alias("missing_sites"))


def site_classes(cells: DataFrame) -> DataFrame:
    """Variable sites (two states or more) and informative ones (two states, each in two rows or more)."""
    n = [F.count_if(F.col("st") == s).alias(f"n{s}") for s in (1, 2, 3, 4)]
    sites = cells.groupBy("dataset_id", "pos").agg(*n)
    seen = lambda least: sum((F.col(f"n{s}") >= least).cast("int") for s in (1, 2, 3, 4))
    return sites.groupBy("dataset_id").agg(F.count_if(seen(1) >= 2).alias("variable_sites"), F.count_if(seen(2) >= 2).alias("informative_sites"))


def pairs(sequences: DataFrame) -> DataFrame:
    """Rows s1 < s2 of one data set with the states of both, made from the pairs' ranks. No dense matrix, no self-join."""
    whole = sequences.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("seq_id", "states"))).alias("_m"))
    ranked = ranks.with_pairs(_dealt(whole, ranks.pairs_of(F.size("_m"))), F.col("_ranks"), "_i", "_j")
    a, b = (F.element_at("_m", (F.col(i) + 1).cast("int")) for i in ("_i", "_j"))
    return ranked.select("dataset_id", a["seq_id"].alias("s1"), b["seq_id"].alias("s2"), a["states"].alias("x"), b["states"].alias("y"))


def pair_identity(sequences: DataFrame) -> DataFrame:
    """Sites that both have, those that are the same, and their share (0 without common sites)."""
    both = F.zip_with("x", "y", lambda x, y: F.when((x > 0) & (y > 0), (x == y).cast("int")))
    known = F.filter(both, lambda v: v.isNotNull())
    out = pairs(sequences).select("dataset_id", "s1", "s2", known.alias("k"))
    valid, same = F.size("k").cast("long"), F.aggregate("k", F.lit(0), lambda acc, v: acc + v).cast("long")
    out = out.select("dataset_id", "s1", "s2", valid.alias("valid"), same.alias("same"))
    return out.withColumn("identity", F.when(F.col("valid") > 0, F.col("same") / F.col("valid")).otherwise(0.0))


def identity_summary(identities: DataFrame, warn_below: float = 0.6) -> DataFrame:
    return identities.groupBy("dataset_id").agg(
        F.min("identity").alias("min_identity"),
        F.avg("identity").alias("mean_identity"),
        F.count_if(F.col("valid") == 0).alias("pairs_without_sites"),
        (F.min("identity") < warn_below).alias("low_identity"),
    )


def eligible(counts: DataFrame, window: int) -> DataFrame:
    """Rows with sites enough for a scan: 5 or the window, whichever is more."""
    return counts.filter(F.col("valid_sites") >= max(5, window))


def dataset_summary(sequences: DataFrame, window: int) -> DataFrame:
    """Active rows, their triplets, the least distance 2 ln(4 n) / L that is recommended, and the frozen correction."""
    n = F.col("active_count")
    length = sequences.groupBy("dataset_id").agg(F.max(F.size("states")).alias("length"), F.count("*").alias("n_rows"))
    active = eligible(sequence_counts(sequences), window).groupBy("dataset_id").agg(F.count("*").alias("active_count"))
    triplets = F.floor(n * (n - 1) * (n - 2) / 6).cast("long")
    return length.join(active, "dataset_id").select(
        "dataset_id",
        "n_rows",
        "active_count",
        triplets.alias("n_triplets"),
        (F.lit(2.0) * F.ln(4.0 * n) / F.col("length")).alias("min_distance"),
        F.least(triplets, F.lit(CORRECTION_CAP)).alias("correction"),
    )


def normalised_names(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Blank names become Sequence_n by place; names that occur more than once are kept and marked."""
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy("dataset_id").orderBy(order)))
    named = numbered.withColumn("seq_name", F.when(blank, F.concat(F.lit("Sequence_"), "_n")).otherwise(F.trim(name)))
    many = named.groupBy("dataset_id", "seq_name").agg((F.count("*") > 1).alias("duplicated"))
    return named.drop("_n").join(many, ["dataset_id", "seq_name"])


def name_search(names: DataFrame, needle: str, order: str, limit: int = 500) -> DataFrame:
    """Names that contain the needle, whatever the case; the first rows only, as many as a list shows."""
    return names.filter(F.lower("name").contains(needle.strip().lower())).orderBy(order).limit(limit)


def row_state(counts: DataFrame, masked_below: int, disabled_below: int) -> DataFrame:
    """enabled, masked or disabled; exactly one for each row."""
    return counts.withColumn("row_state", F.when(F.col("valid_sites") < disabled_below, "disabled").when(F.col("valid_sites") < masked_below, "masked").otherwise("enabled"))


def reference_groups(names: DataFrame) -> DataFrame:
    """Groups from names such as REF-A: rows of one label are one group, a REF without a label is a group of its own;
    groups count from 1 in the order in which they appear. Other rows have none (queries)."""
    hit = F.col("name").rlike(r"(?i)(?:^|[\s|])REF")
    label = F.lower(F.trim(F.regexp_extract("name", r"(?i)(?:^|[\s|])REF(?:[-_:]?)([^<\s|:]*)", 1)))
    keyed = names.filter(hit).withColumn("key", F.when(label != "", F.concat(F.lit("label:"), label)).otherwise(F.concat(F.lit("sequence:"), F.col("seq_id").cast("string"))))
    first = keyed.groupBy("dataset_id", "key").agg(F.min("seq_id").alias("first"))
    ranked = first.withColumn("ref_group", F.row_number().over(Window.partitionBy("dataset_id").orderBy("first")))
    return keyed.join(ranked, ["dataset_id", "key"]).select("dataset_id", "seq_id", "ref_group")


def compacted_groups(rows: DataFrame, group: str) -> DataFrame:
    """Group numbers 1, 2, ... in the order of first appearance; 0 is no group."""
    first = rows.filter(F.col(group) != 0).groupBy("dataset_id", group).agg(F.min("seq_id").alias("first"))
    ranked = first.withColumn("compact_group", F.row_number().over(Window.partitionBy("dataset_id").orderBy("first")))
    return rows.join(ranked.drop("first"), ["dataset_id", group])


def _dealt(groups: DataFrame, count: Column) -> DataFrame:
    """groups with _ranks, a range of the ranks below count; ranges are spread over all tasks."""
    each = groups.withColumn("_count", count).withColumn("_block", F.explode(ranks.blocks(F.col("_count"), RANKS)))
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as ranks are many where rows are few
    return each.repartition(parts, "dataset_id", "_block").withColumn("_ranks", ranks.block_ranks(F.col("_block"), F.col("_count"), RANKS))


def triplets(rows: DataFrame) -> DataFrame:
    """a < b < c of each data set's rows; other columns come along as *_a, *_b, *_c. Triplets are made from their ranks, so
    those of one large data set are spread over all tasks. A data set's seq_ids are all different."""
    extra = [c for c in rows.columns if c not in ("dataset_id", "seq_id")]
    whole = rows.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("seq_id", *extra))).alias("_m"))
    ranked = ranks.with_triplets(_dealt(whole, ranks.triplets_of(F.size("_m"))), F.col("_ranks"), "_i", "_j", "_k")
    member = [F.element_at("_m", (F.col(i) + 1).cast("int")) for i in ("_i", "_j", "_k")]
    return ranked.select("dataset_id", *[c for m, n in zip(member, "abc", strict=True) for c in (m["seq_id"].alias(n), *[m[x].alias(f"{x}_{n}") for x in extra])])


def distinct_origins(candidates: DataFrame) -> DataFrame:
    """Triplets whose three rows come from three originals (fragments share their origin)."""
    return candidates.filter("origin_a <> origin_b AND origin_a <> origin_c AND origin_b <> origin_c")


def query_reference_triplets(rows: DataFrame) -> DataFrame:
    """One query (group 0) and two references of different groups, r1 before r2; the pairs beside each query come from their ranks."""
    held = lambda kept, what: F.array_sort(F.collect_list(F.when(kept, what)))
    whole = rows.groupBy("dataset_id").agg(held(F.col("ref_group") > 0, F.struct("seq_id", "ref_group")).alias("_r"), held(F.col("ref_group") == 0, F.col("seq_id")).alias("_q"))
    each = whole.withColumn("_q", F.explode("_q"))
    ranked = ranks.with_pairs(_dealt(each, ranks.pairs_of(F.size("_r"))), F.col("_ranks"), "_i", "_j")
    first, second = (F.element_at("_r", (F.col(i) + 1).cast("int")) for i in ("_i", "_j"))
    out = ranked.select("dataset_id", F.col("_q").alias("q"), first.alias("x"), second.alias("y"))
    return out.filter("x.ref_group <> y.ref_group AND x.seq_id < y.seq_id").select("dataset_id", "q", F.col("x.seq_id").alias("r1"), F.col("y.seq_id").alias("r2"))


def query_reference_plan(rows: DataFrame) -> DataFrame:
    """Queries, references, groups, triplets and the capped correction of each data set, from group sizes alone."""
    sizes = rows.groupBy("dataset_id", "ref_group").agg(F.count("*").alias("n"))
    refs = F.col("ref_group") > 0
    out = sizes.groupBy("dataset_id").agg(
        F.coalesce(F.sum(F.when(~refs, F.col("n"))), F.lit(0)).alias("queries"),
        F.coalesce(F.sum(F.when(refs, F.col("n"))), F.lit(0)).alias("refs"),
        F.count_if(refs).alias("ref_groups"),
        F.coalesce(F.sum(F.when(refs, F.col("n") * F.col("n"))), F.lit(0)).alias("squares"),
    )
    pairs_ = F.floor((F.col("refs") * F.col("refs") - F.col("squares")) / 2).cast("long")
    tests = F.floor(F.col("queries") * F.col("ref_groups") * (F.col("ref_groups") - 1) / 2).cast("long")
    return out.select("dataset_id", "queries", "refs", "ref_groups", (F.col("queries") * pairs_).alias("n_triplets"), F.least(tests, F.lit(CORRECTION_CAP)).alias("correction"))


def triplet_sites(sequences: DataFrame) -> DataFrame:
    """dataset_id, a, b, c, pos, x, y, z: all sites of all triplets. The three rows' arrays are zipped, so sites are
    made where the triplet is, without a join on sites."""
    t = triplets(sequences.select("dataset_id", "seq_id", "states"))
    zipped = F.arrays_zip(F.col("states_a").alias("x"), F.col("states_b").alias("y"), F.col("states_c").alias("z"))
    rows = t.select(*TRIPLET, F.posexplode(zipped).alias("i", "s"))
    return rows.select(*TRIPLET, (F.col("i") + 1).cast("int").alias("pos"), "s.x", "s.y", "s.z")


def variable_sites(sites: DataFrame) -> DataFrame:
    """Sites that all three have and where they are not all the same; m12, m13, m23: which pairs match."""
    kept = sites.filter("x > 0 AND y > 0 AND z > 0 AND NOT (x = y AND x = z)")
    return kept.withColumns({"m12": (F.col("x") == F.col("y")).cast("int"), "m13": (F.col("x") == F.col("z")).cast("int"), "m23": (F.col("y") == F.col("z")).cast("int")})


def information_rich(sites: DataFrame) -> DataFrame:
    """Variable sites where exactly one pair agrees; cat 0, 1, 2 for the pairs 12, 13, 23."""
    v = variable_sites(sites).filter("m12 + m13 + m23 = 1")
    return v.withColumn("cat", F.when(F.col("m12") == 1, 0).when(F.col("m13") == 1, 1).otherwise(2))
