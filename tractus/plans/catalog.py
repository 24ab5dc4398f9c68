"""Registered reference queries. Each runs over whole tables; ``oracle`` has the SQL that most are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import bootstrap, breakpoints, consensus, exact, late, masking, matching, roles, rounds, scan, splits, trees
from ..operators import events as E
from ..operators import profiles as P
from ..operators import relations as R
from ..operators.kernels.common import Options
from ..ship import ensure
from ..sources import alignments as A
from ..sources import imports, project, readers
from . import oracle

T = R.TRIPLET
LENGTH = 64


def _table(s: SparkSession, sf: str, name: str) -> DataFrame:
    return s.read.parquet(f"{sf}/{name}.parquet")


def _seqs(s, sf):
    return A.from_vectors(s, sf)


def _cells(s, sf):
    return A.cells(_seqs(s, sf).drop("vec_id", "label"))


def _sites(s, sf):
    return R.triplet_sites(_seqs(s, sf))


def _variable(s, sf):
    return R.variable_sites(_sites(s, sf))


def _rich(s, sf):
    return R.information_rich(_sites(s, sf))


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def flagship(s, sf):
    """Of each data set the ten triplets whose information-rich sites differ most between pairs, and the top pair."""
    n = _rich(s, sf).groupBy(*T).agg(F.count("*").alias("rich_sites"), *[F.count_if(F.col("cat") == k).alias(f"n{k}") for k in range(3)])
    top = F.when((F.col("n0") >= F.col("n1")) & (F.col("n0") >= F.col("n2")), "12").when(F.col("n1") >= F.col("n2"), "13").otherwise("23")
    rows = n.withColumns({"top": top, "contrast": (F.greatest("n0", "n1", "n2") - F.least("n0", "n1", "n2")) / F.col("rich_sites")})
    w = Window.partitionBy("dataset_id").orderBy(F.desc("contrast"), F.desc("rich_sites"), "a", "b", "c")
    return _round(rows.withColumn("k", F.row_number().over(w)).filter("k <= 10").select(*T, "rich_sites", "top", "contrast"), "contrast")


def signals(s, sf):
    """Large 3SEQ descents as signals; the method column cycles through all methods, so that ties between them occur."""
    x = P.excursions(P.walk(P.targets(_variable(s, sf)))).filter("descent >= 6")
    methods = F.array(*map(F.lit, E.METHOD_ORDER))
    p = F.pow(F.lit(2.0), -F.col("descent"))
    return x.select(
        (((F.col("dataset_id") * 10 + F.col("a")) * 10 + F.col("b")) * 100 + F.col("c") * 10 + F.col("target")).alias("signal_id"),
        *T,
        F.when(F.col("target") == 0, F.col("a")).when(F.col("target") == 1, F.col("b")).otherwise(F.col("c")).alias("recombinant"),
        F.element_at(methods, ((F.col("dataset_id") + F.col("a") + F.col("b") + F.col("c") + F.col("target")) % 7 + 1).cast("int")).alias("method"),
        (F.col("begin_after") + 1).alias("begin"),
        F.col("end_pos").alias("end"),
        p.alias("local_p"),
        F.least(F.lit(1.0), p * 120).alias("corrected_p"),
    )


def _events(s, sf):
    """The strongest signal of each recombinant, as an event."""
    w = Window.partitionBy("dataset_id", "recombinant").orderBy("corrected_p", "local_p", E.method_rank(F.col("method")), "signal_id")
    return signals(s, sf).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k").withColumn("event_id", F.col("signal_id"))


def _tracts(s, sf):
    return _events(s, sf).select("dataset_id", F.col("recombinant").alias("seq_id"), "event_id", "begin", "end")


def _decisions(s, sf):
    state = F.when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "error", "rejected").otherwise("viewed")
    return _table(s, sf, "events").select((F.col("event_id") * 7 % 500).alias("event_id"), F.col("event_id").alias("decision_id"), F.col("ts").alias("at"), state.alias("state"))


def _names(s, sf):
    v = F.col("vec_id").cast("string")
    name = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("REF-"), F.col("label").cast("string"), F.lit(":"), v)).when(F.col("vec_id") % 7 == 0, "x|REF").otherwise(F.concat(F.lit("seq "), v))
    return _seqs(s, sf).select("dataset_id", "seq_id", name.alias("name"))


def _groups(s, sf):
    n = _names(s, sf)
    return n.select("dataset_id", "seq_id").join(R.reference_groups(n), ["dataset_id", "seq_id"], "left").fillna(0, ["ref_group"])


def _identity(s, sf):
    return R.pair_identity(_seqs(s, sf))


def _relations(s, sf):
    return P.triplet_relation(_sites(s, sf))


def _tallies(s, sf):
    return P.siscan_tallies(_relations(s, sf), LENGTH, 16, 5)


def encode_residues(s, sf):
    t = F.coalesce(F.col("text"), F.lit(""))
    n = lambda letters: (F.length(t) - F.length(F.translate(t, letters, ""))).cast("long")
    d = _table(s, sf, "documents")
    return d.select("doc_id", n("Aa").alias("n_a"), n("Cc").alias("n_c"), n("Gg").alias("n_g"), n("TtUu").alias("n_t"), F.length(F.translate(t, "AaCcGgTtUu", "")).cast("long").alias("n_missing"))


def sequence_fragments(s, sf):
    f = A.sequence_fragment(F.coalesce(F.col("text"), F.lit("")))
    return _table(s, sf, "documents").select("doc_id", F.length(f).cast("long").alias("n"), F.md5(f).alias("digest"))


def partition_markers(s, sf):
    first = _table(s, sf, "documents").groupBy("source").agg(F.min_by("text", "doc_id").alias("text"))
    chars = F.filter(F.transform(F.split("text", ""), lambda c, i: F.when(c == "!", (i + 1).cast("int"))), lambda p: p.isNotNull())
    return first.select("source", F.explode(chars).alias("pos"))


def normalised_names(s, sf):
    name = F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("source"))
    rows = _table(s, sf, "documents").select(F.col("lang").alias("dataset_id"), "doc_id", name.alias("name"))
    return R.normalised_names(rows, "doc_id", "name").select("dataset_id", "doc_id", "seq_name", "duplicated")


def missing_runs(s, sf):
    """Runs without a nucleotide in whole texts; the pattern finds them without unrolling the text."""
    runs = F.regexp_extract_all(F.col("text"), F.lit("([^AaCcGgTtUu]+|[AaCcGgTtUu]+)"), F.lit(1))
    d = _table(s, sf, "documents").filter("text IS NOT NULL").select("doc_id", runs.alias("r"))
    sizes = d.select("doc_id", F.posexplode(F.transform("r", lambda x: F.struct(F.length(x).alias("n"), x.rlike("^[^AaCcGgTtUu]").alias("gap")))).alias("i", "x"))
    w = Window.partitionBy("doc_id").orderBy("i")
    last = F.sum("x.n").over(w)
    rows = sizes.select("doc_id", (last - F.col("x.n") + 1).cast("int").alias("first"), last.cast("int").alias("last"), F.col("x.n").cast("long").alias("sites"), "x.gap")
    return rows.filter("gap AND sites >= 10").drop("gap")


def scalar_functions(s, sf):
    q, r = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    p = r / 100.0
    return _table(s, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(stats.normal_tail(q / 6.0), 9).alias("tail"),
        F.round(stats.chi_square(F.lit(50), q, r), 6).alias("chi"),
        F.round(stats.bonferroni(p, F.lit(120)), 9).alias("bonferroni"),
        F.round(stats.sidak(p, F.lit(120)), 9).alias("sidak"),
        F.round(stats.half_even(q / 4.0), 1).alias("half_even"),
    )


def maxchi_strongest(s, sf):
    best = P.strongest_boundary(P.chi_profile(_variable(s, sf), 6), 2)
    return best.withColumns({"p": F.round(stats.normal_tail(-F.sqrt("chi")), 9), "chi": F.round("chi", 6)})


def maxchi_profile(s, sf):
    rows = P.chi_profile(_variable(s, sf), 6).groupBy(*T, "pair")
    return rows.agg(F.count("*").alias("boundaries"), F.max(F.abs(F.col("l") - F.col("r"))).alias("top_difference"), F.round(F.max("chi"), 6).alias("top_chi"), F.round(F.avg("chi"), 6).alias("mean_chi"))


def rdp_rolling(s, sf):
    c = P.rolling_counts(_rich(s, sf), 10)
    return c.groupBy(*T).agg(F.count("*").alias("windows"), F.max("c0").alias("top12"), F.max("c1").alias("top13"), F.max("c2").alias("top23"), F.min("c0").alias("low12"))


def geneconv_runs(s, sf):
    runs = P.runs(P.geneconv_categories(_variable(s, sf)), "cat")
    return runs.groupBy(*T, "cat").agg(F.count("*").alias("n_runs"), F.max("sites").alias("longest"), F.min("first").alias("first"), F.max("last").alias("last"))


def geneconv_counts(s, sf):
    v = _variable(s, sf)
    return v.groupBy(*T).agg(F.count("*").alias("variable_sites"), F.count_if(F.col("m12") == 0).alias("d12"), F.count_if(F.col("m13") == 0).alias("d13"), F.count_if(F.col("m23") == 0).alias("d23"), F.count_if(F.col("m12") + F.col("m13") + F.col("m23") == 0).alias("all_differ"))


def threeseq_walk(s, sf):
    w = P.walk(P.targets(_variable(s, sf))).groupBy(*T, "target")
    return w.agg(F.count("*").alias("sites"), F.max("height").alias("top"), F.min("height").alias("low"), F.max_by("height", "pos").alias("final"))


def three_set_vote(s, sf):
    i = _identity(s, sf).filter("identity > 0.3")
    full = R.sequence_counts(_seqs(s, sf)).filter("valid_sites > 60")
    sets = [i.select("dataset_id", F.col("s1").alias("seq_id")), i.select("dataset_id", F.col("s2").alias("seq_id")), full]
    return E.at_least(sets, ["dataset_id", "seq_id"], 2)


def detectable_closure(s, sf):
    x = signals(s, sf)
    rows = x.select("dataset_id", F.posexplode(F.array("a", "b", "c")).alias("role", "member"))
    return E.closure(rows)


def role_vote(s, sf):
    score = (F.col("event_id") * 31 + F.col("metric") * 17 + F.col("role") * (F.col("metric") + 5) * 13) % 11
    rows = _events(s, sf).select("event_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("role")).withColumn("metric", F.explode(F.sequence(F.lit(0), F.lit(8))))
    return _round(E.role_votes(rows.withColumn("score", score)), "confidence")


def plot_thinning(s, sf):
    w = P.walk(P.targets(_variable(s, sf)))
    return E.thinned(w, [*T, "target"], "height", 10, F.col("pos").isin(1, LENGTH)).select(*T, "target", "pos", "height")


def tree_panel(s, sf):
    anchors = _events(s, sf).select("dataset_id", "event_id", F.explode(F.array("a", "b", "c")).alias("anchor"))
    return E.closest_rows(_identity(s, sf), anchors, 6)


def pair_gate(s, sf):
    ok = _identity(s, sf).filter("identity >= 0.22")
    return E.enabled_triplets(R.triplets(_seqs(s, sf).select("dataset_id", "seq_id")), ok)


def _text(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, E.as_text(F.col("states")).alias("sequence"))


def enabled_fasta(s, sf):
    states = R.row_state(R.sequence_counts(_seqs(s, sf)), 61, 60).filter("row_state = 'enabled'")
    return _text(_seqs(s, sf).join(states, ["dataset_id", "seq_id"]), "dataset_id", "seq_id")


def fragments(s, sf):
    return _text(E.fragments(_seqs(s, sf), _tracts(s, sf), 5), "dataset_id", "origin", "event_id")


def _options() -> Options:
    """Windows for alignments of 64 sites."""
    return Options(tests=1, cutoff=0.01, rdp_window=10, maxchi_window=20, chimaera_window=16, boot_window=16, boot_step=4, boot_replicates=50, sis_window=16, sis_step=4, sis_permutations=50)


def _planted(s, sf):
    """Row 2 of each data set becomes a mosaic: row 1 from site 17 to 40, row 0 elsewhere."""
    seqs = _seqs(s, sf).select("dataset_id", "seq_id", "states")
    parent = lambda i, n: seqs.filter(F.col("seq_id") == i).select("dataset_id", F.col("states").alias(n))
    rows = seqs.join(parent(0, "p0"), "dataset_id").join(parent(1, "p1"), "dataset_id")
    mixed = F.zip_with("p0", "p1", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    mixed = F.transform(mixed, lambda p, i: F.when((i >= 16) & (i < 40), p["y"]).otherwise(p["x"]))
    return rows.withColumn("states", F.when(F.col("seq_id") == 2, mixed).otherwise(F.col("states"))).drop("p0", "p1")


def _scan(method):
    return lambda s, sf: scan.scan(_planted(s, sf), _options(), (method,))


def auto_mask(s, sf):
    return masking.auto_mask(_seqs(s, sf))


def event_trees(s, sf):
    return trees.trees(_identity(s, sf).select("dataset_id", "s1", "s2", stats.jukes_cantor(F.col("valid"), F.col("valid") - F.col("same")).alias("distance")))


def split_support(s, sf):
    """Support of each split of each alignment's tree among 20 replicates; members: the split's leaves as hexadecimal bits."""
    edges = splits.joined_trees(splits.replicate_distances(_planted(s, sf), LENGTH, 20))
    return splits.split_support(splits.bipartitions(edges), 20).select("dataset_id", F.hex("split").alias("members"), "leaves", "seen", "percent", "collapsed")


def breakpoint_ranges(s, sf):
    """The model of each event's triplet."""
    ensure(s)
    seqs = _seqs(s, sf)
    e = _events(s, sf).select("event_id", *T)
    for n in ("a", "b", "c"):
        e = e.join(seqs.select("dataset_id", F.col("seq_id").alias(n), F.col("states").alias(f"s_{n}")), ["dataset_id", n])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            d = b.to_pydict()
            rows = [(i, r["position"], r["range_0.995"][0], r["range_0.995"][1]) for i, *x in zip(d["event_id"], d["s_a"], d["s_b"], d["s_c"]) for r in breakpoints.ranges(np.array(x, np.int8))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2, 3)]], names=["event_id", "position", "low", "high"])

    return e.select("event_id", "s_a", "s_b", "s_c").mapInArrow(run, "event_id long, position int, low int, high int")


def _measured(kernel, ddl):
    """kernel(states, fourth sequence or None, row) -> rows for the triplet of each event of the planted alignments."""

    def query(s, sf):
        ensure(s)
        seqs = _planted(s, sf)
        e = rounds.cyclic_scan(seqs, _options(), ("RDP", "3SEQ"))

        def run(events, rows):
            import numpy as np
            import pyarrow as pa

            from ..operators.kernels import outlier

            kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
            fields = [x.split() for x in ddl.split(", ")]
            out = []
            if events.num_rows:
                rows = rows.sort_by("seq_id").to_pydict()
                at, states = {x: i for i, x in enumerate(rows["seq_id"])}, np.array(rows["states"], np.int8)
                direct, tree = (np.array(rows[x], np.float32) for x in ("direct", "tree"))
                for d in events.to_pylist():
                    t = [at[d[x]] for x in ("recombinant", "major", "minor")]
                    k = outlier.nearest(sorted(t), states, direct, tree)
                    out += kernel(states[t], None if k is None else states[k], d)
            return pa.table([pa.array([r[i] for r in out], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])

        return e.groupBy("dataset_id").cogroup(scan.with_similarities(seqs).groupBy("dataset_id")).applyInArrow(run, ddl)

    return query


def _recheck(states, fourth, d):
    from ..operators.kernels import review

    p = lambda m: 1.0 if m == "SISCAN" and fourth is None else review.recheck(m, states, d["begin"], d["end"], _options(), fourth)
    return [(d["dataset_id"], d["round"], m, p(m)) for m in E.METHOD_ORDER]


def _plot(states, fourth, d):
    from ..operators.kernels import review

    for m in E.METHOD_ORDER:
        if m != "SISCAN" or fourth is not None:
            pos, values = review.plot(m, states, _options(), fourth)
            yield from ((d["dataset_id"], d["round"], m, int(p), *map(float, v)) for p, v in zip(pos, values.T))


def _supports(s, sf):
    return E.supports(signals(s, sf), _events(s, sf), LENGTH)


def regional_distances(s, sf):
    e = _events(s, sf)
    r = E.regional_counts(_seqs(s, sf), e, E.triplet_pairs(e), LENGTH)
    return _round(r.withColumn("distance", stats.jukes_cantor(F.col("valid"), F.col("differences"))), "distance")


def masked_followup(s, sf):
    return E.masked_followup(R.row_state(R.sequence_counts(_seqs(s, sf)), 61, 60), _events(s, sf))


def _found(s, sf):
    """Events of the cyclic scan on the planted alignments."""
    e = rounds.cyclic_scan(_planted(s, sf), _options(), ("RDP", "3SEQ"))
    return e.select("dataset_id", (F.col("dataset_id") * 100 + F.col("round")).alias("event_id"), F.col("recombinant").alias("a"), F.col("major").alias("b"), F.col("minor").alias("c"), "recombinant", "begin", "end")


def late_lists(s, sf):
    """Trimmed, widened and pruned lists of the events of the cyclic scan on the planted alignments."""
    return consensus.late_lists(_planted(s, sf), _found(s, sf))


def late_consensus(s, sf):
    """Rows of each role of these events after the three passes."""
    return _round(consensus.late_consensus(_planted(s, sf), _found(s, sf)), "score")


def breakpoint_match(s, sf):
    """The breakpoints of all events with the nearest change of the closest pair, and where that puts them."""
    e, seqs = _events(s, sf), _seqs(s, sf)
    found = matching.matched(e, matching.transitions(_rich(s, sf), e), LENGTH)
    return matching.repositioned(found, e, seqs, LENGTH)


def masked_scan(s, sf):
    """The masked rows of the planted alignments beside the parents of the events that the cyclic scan finds there."""
    seqs = _planted(s, sf)
    e = _found(s, sf)
    masked = E.masked_followup(R.row_state(R.sequence_counts(seqs), 61, 0), e).join(e.select("event_id", "dataset_id", "begin", "end"), "event_id")
    return scan.followed_up(seqs, masked, _options(), ("RDP", "MaxChi", "3SEQ"))


def review_edits(s, sf):
    v = F.col("value").cast("int") % LENGTH + 1
    log = _table(s, sf, "events").select((F.col("event_id") * 7 % 500).alias("event_id"), F.col("event_id").alias("edit_id"), F.col("ts").alias("at"), F.when(F.col("event_id") % 3 == 0, v).alias("begin"), F.when(F.col("event_id") % 2 == 0, v).alias("end"))
    return E.latest_values(log, ["begin", "end"])


def siegmund(s, sf):
    n, q = F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int")
    p = stats.siegmund(q + 10, n + 20, n + 12)
    return _table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 9).alias("p"))


def readers_roundtrip(s, sf):
    """Each data set as FASTA text, parsed again."""
    row = F.struct("seq_id", F.concat(F.lit(">s"), F.col("seq_id").cast("string"), F.lit("\n"), E.as_text(F.col("states"))).alias("r"))
    texts = _seqs(s, sf).groupBy("dataset_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).select("dataset_id", F.array_join(F.col("rows.r"), "\n").alias("text"))
    out = readers.parse_texts(texts, "dataset_id", "text")
    return out.select(F.col("path").cast("long").alias("dataset_id"), "seq_id", "name", F.col("seq").alias("sequence"))


def project_roundtrip(s, sf):
    """Rows of each data set as a JSON document without row states and back."""
    rows = _seqs(s, sf).select("dataset_id", "seq_id", F.concat(F.lit("s"), F.col("seq_id").cast("string")).alias("name"), E.as_text(F.col("states")).alias("seq"), F.lit(None).cast("string").alias("row_state"), F.lit(None).cast("int").alias("ref_group"))
    return project.parsed(project.documents(rows)).select("dataset_id", "seq_id", "name", F.col("seq").alias("sequence"), "row_state")


def project_import(s, sf):
    """Each data set as a document of some version, a few of them of unknown versions or methods, and what its import gives."""
    row = F.struct("seq_id", F.col("seq_id").cast("string").alias("name"), E.as_text(F.col("states")).alias("sequence"))
    d = _seqs(s, sf).groupBy("dataset_id").agg(F.array_sort(F.collect_list(row)).alias("sequences"))
    method = F.when(F.col("dataset_id") % 11 == 5, "none").otherwise("rdp")
    analysis = F.struct(F.array(F.struct(method.alias("method"))).alias("signals"), F.array((F.col("dataset_id") % 10).cast("int")).alias("maskedSequenceIndices"), F.when(F.col("dataset_id") % 2 == 0, True).alias("bootscanPrimaryEnabled"), F.when(F.col("dataset_id") % 3 == 0, False).alias("threeSeqEnabled"))
    schema = F.concat(F.lit("project/v1alpha"), (F.col("dataset_id") % 21 + 1).cast("string")).alias("schema")
    out = imports.imported(d.select("dataset_id", F.to_json(F.struct(schema, F.struct("sequences").alias("dataset"), analysis.alias("analysis"))).alias("text")), "dataset_id", "text")
    rows = out.sequences.groupBy("dataset_id").agg(F.count("*").alias("n_rows"), F.sum("seq_id").alias("seq_ids"), F.count_if(F.col("row_state") == "masked").alias("n_masked"))
    read = out.projects.join(rows, "dataset_id").select("dataset_id", F.lit(None).cast("string").alias("reason"), F.array_join("methods", ",").alias("methods"), "n_rows", "seq_ids", "n_masked")
    return read.unionByName(out.rejects, allowMissingColumns=True)


def queries():
    keep = ("dataset_id", "seq_id")
    out = {
        "flagship": flagship,
        "encode_residues": encode_residues,
        "sequence_fragments": sequence_fragments,
        "partition_markers": partition_markers,
        "encode_cells": lambda s, sf: _cells(s, sf).select(*keep, "pos", F.col("st").cast("int").alias("st")),
        "sequence_counts": lambda s, sf: R.sequence_counts(_seqs(s, sf)),
        "site_classes": lambda s, sf: R.site_classes(_cells(s, sf)),
        "pair_identity": lambda s, sf: _round(_identity(s, sf), "identity"),
        "identity_summary": lambda s, sf: _round(R.identity_summary(_identity(s, sf)), "min_identity", "mean_identity"),
        "eligible_rows": lambda s, sf: R.eligible(R.sequence_counts(_seqs(s, sf)), 60),
        "dataset_summary": lambda s, sf: _round(R.dataset_summary(_seqs(s, sf), 60), "min_distance"),
        "row_curation": lambda s, sf: R.row_state(R.sequence_counts(_seqs(s, sf)), 61, 60).select(*keep, "row_state"),
        "name_search": lambda s, sf: R.name_search(_table(s, sf, "documents").select("doc_id", F.concat_ws("_", "source", "lang").alias("name")), " SRC1 ", "doc_id"),
        "normalised_names": normalised_names,
        "reference_groups": lambda s, sf: R.reference_groups(_names(s, sf)),
        "group_compaction": lambda s, sf: R.compacted_groups(_seqs(s, sf).select(*keep, "label"), "label").select(*keep, "label", "compact_group"),
        "triplets_exploratory": lambda s, sf: R.triplets(_seqs(s, sf).select(*keep)),
        "triplets_distinct_origins": lambda s, sf: R.distinct_origins(R.triplets(_seqs(s, sf).select(*keep, F.floor(F.col("seq_id") / 2).alias("origin")))).select(*T),
        "triplets_query_reference": lambda s, sf: R.query_reference_triplets(_groups(s, sf)),
        "correction_plan": lambda s, sf: R.query_reference_plan(_groups(s, sf)),
        "triplet_sites": lambda s, sf: _variable(s, sf).select(*T, "pos", "m12", "m13", "m23"),
        "rdp_categories": lambda s, sf: _rich(s, sf).groupBy(*T).agg(F.count("*").alias("rich_sites"), *[F.count_if(F.col("cat") == k).alias(n) for k, n in enumerate(("n12", "n13", "n23"))]),
        "rdp_rolling": rdp_rolling,
        "maxchi_profile": maxchi_profile,
        "maxchi_strongest": maxchi_strongest,
        "chimaera_targets": lambda s, sf: P.chimaera_targets(_variable(s, sf)).groupBy(*T, "target").agg(F.count("*").alias("sites"), F.count_if(F.col("match") == 1).alias("first_parent")),
        "geneconv_runs": geneconv_runs,
        "geneconv_counts": geneconv_counts,
        "threeseq_walk": threeseq_walk,
        "threeseq_excursion": lambda s, sf: P.excursions(P.walk(P.targets(_variable(s, sf)))),
        "threeseq_p": lambda s, sf: _round(exact.with_probability(P.excursions(P.walk(P.targets(_variable(s, sf))))).select(*T, "target", "plus", "minus", F.col("descent").cast("long").alias("descent"), "p", "exact"), "p", digits=9),
        "bootscan_windows": lambda s, sf: P.bootscan_windows(_seqs(s, sf), LENGTH, 32, 16),
        "bootscan_votes": lambda s, sf: P.closest_pair_votes(P.pair_distances(_cells(s, sf), LENGTH, 16, 8)),
        "bootstrap_votes": lambda s, sf: bootstrap.bootstrap_votes(_seqs(s, sf), LENGTH, 16, 4, 100),
        "bootstrap_regions": lambda s, sf: _round(bootstrap.support_regions(bootstrap.bootstrap_votes(_seqs(s, sf), LENGTH, 16, 4, 100), 100), "mean_votes"),
        "siscan_patterns": lambda s, sf: _relations(s, sf).groupBy(*T).agg(*[F.count_if(F.col("relation") == k).alias(f"r{k}") for k in range(6)]),
        "siscan_tallies": _tallies,
        "siscan_switches": lambda s, sf: P.pair_switches(_tallies(s, sf)),
        "phylpro_profile": lambda s, sf: _round(P.phylpro(_cells(s, sf), 10), "correlation"),
        "missing_runs": missing_runs,
        "jc_matrix": lambda s, sf: _round(_identity(s, sf).select("dataset_id", "s1", "s2", stats.jukes_cantor(F.col("valid"), F.col("valid") - F.col("same")).alias("distance")), "distance"),
        "signals": lambda s, sf: _round(signals(s, sf), "local_p", "corrected_p", digits=9),
        "strongest_signal": lambda s, sf: _round(E.strongest(signals(s, sf), ["dataset_id"]), "corrected_p", digits=9),
        "signal_dedupe": lambda s, sf: E.deduplicated(signals(s, sf)).select("signal_id", "method"),
        "tract_overlap": lambda s, sf: _round(E.tract_overlaps(_tracts(s, sf).withColumn("id", F.col("event_id")), LENGTH, 0.3), "overlap"),
        "support_pairs": lambda s, sf: E.supports(signals(s, sf), _events(s, sf), LENGTH),
        "uncommitted_signals": lambda s, sf: E.not_committed(signals(s, sf), _events(s, sf), LENGTH).select("signal_id"),
        "pair_gate": pair_gate,
        "three_set_vote": three_set_vote,
        "detectable_closure": detectable_closure,
        "erased_union": lambda s, sf: E.merged_tracts(signals(s, sf), "recombinant", LENGTH),
        "inside_outside_rates": lambda s, sf: _round(E.inside_outside(_variable(s, sf), _events(s, sf).select("signal_id", *T, "begin", "end")), *[f"{m}_{w}" for m in P.PAIRS for w in ("in", "out")]),
        "role_vote": role_vote,
        "role_metrics": lambda s, sf: roles.direct_metrics(_seqs(s, sf), _events(s, sf)),
        "role_recommendation": lambda s, sf: _round(roles.recommendation(roles.role_metrics(_planted(s, sf), _found(s, sf))), "confidence"),
        "review_latest": lambda s, sf: E.latest_decisions(_decisions(s, sf)),
        "next_undecided": lambda s, sf: E.next_undecided(_events(s, sf), _decisions(s, sf)),
        "plot_thinning": plot_thinning,
        "tree_panel": tree_panel,
        "prior_erasures": lambda s, sf: E.prior_erasures(_events(s, sf).withColumn("recombinant", F.lit(0)), LENGTH, 5),
        "masked_fasta": lambda s, sf: _text(E.masked_states(_seqs(s, sf), _tracts(s, sf)), *keep),
        "columns_removed_fasta": lambda s, sf: _text(E.without_columns(_seqs(s, sf), _tracts(s, sf)), *keep),
        "sequences_removed_fasta": lambda s, sf: _text(E.without_sequences(_seqs(s, sf), _tracts(s, sf)), *keep),
        "enabled_fasta": enabled_fasta,
        "fragments": fragments,
        "scalar_functions": scalar_functions,
        "chi_only_events": lambda s, sf: E.chi_only(_supports(s, sf), signals(s, sf)),
        "role_hypotheses": lambda s, sf: E.role_hypotheses(_events(s, sf)),
        "masked_followup": masked_followup,
        "masked_scan": masked_scan,
        "regional_distances": regional_distances,
        "phylogenetic_set": lambda s, sf: E.phylogenetic_set(_seqs(s, sf), _events(s, sf), LENGTH),
        "distance_correlation_set": lambda s, sf: late.distance_correlation_set(_seqs(s, sf), _events(s, sf)),
        "late_lists": late_lists,
        "late_consensus": late_consensus,
        "breakpoint_match": breakpoint_match,
        "breakpoint_view": lambda s, sf: E.breakpoint_view(_seqs(s, sf), _events(s, sf), LENGTH, 10, 5),
        "review_edits": review_edits,
        "event_csv": lambda s, sf: E.csv_lines(_events(s, sf), ["event_id", "method", "recombinant", "begin", "end"]),
        "tract_fasta": lambda s, sf: E.tract_records(_seqs(s, sf), _events(s, sf)),
        "siegmund": siegmund,
        "event_recheck": _measured(_recheck, "dataset_id long, round int, method string, p double"),
        "event_plots": _measured(_plot, "dataset_id long, round int, method string, pos int, v1 double, v2 double, v3 double"),
        "readers_roundtrip": readers_roundtrip,
        "project_roundtrip": project_roundtrip,
        "project_import": project_import,
        "auto_mask": auto_mask,
        "event_trees": event_trees,
        "split_support": split_support,
        "breakpoint_ranges": breakpoint_ranges,
        "cyclic_scan": lambda s, sf: rounds.cyclic_scan(_planted(s, sf), _options(), ("RDP", "3SEQ")),
    }
    out |= {f"scan_{m.lower().replace('3seq', 'threeseq')}": _scan(m) for m in E.METHOD_ORDER}
    return out


def oracle_sql():
    return oracle.sql()
