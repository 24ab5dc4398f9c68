"""Scans: the detectors over triplets of many alignments, in one round.

An alignment is packed into one row of members; its triplets are ranges of ranks, so blocks of triplets are made by
column arithmetic and dealt to all tasks with the alignment beside them. A task runs the chosen detectors on its block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.stats import overlap
from ..ship import ensure
from .events import METHOD_ORDER
from .kernels import consensus, geneconv, maxchi, outlier, threeseq, windows
from .kernels.common import Candidate, Options, Variable, inside

METHODS = {"RDP": windows.rdp, "GENECONV": geneconv.discover, "BootScan": windows.bootscan, "MaxChi": maxchi.discover, "CHIMAERA": maxchi.chimaera, "SISCAN": windows.siscan, "3SEQ": threeseq.discover}
PRIMARY = ("RDP", "GENECONV", "MaxChi", "CHIMAERA", "3SEQ")
#: A signal. a, b, c and the roles are rows of the alignment; oa, ob, oc the originals of a, b, c; erasable: the tract has
#: a site in the recombinant that is not missing.
SIGNAL = "dataset_id long, a int, b int, c int, oa int, ob int, oc int, method string, recombinant int, major int, minor int, begin int, end int, local_p double, corrected_p double, sites int, erasable boolean"
SCHEMA = "dataset_id long, a int, b int, c int, method string, recombinant int, major int, minor int, begin int, end int, local_p double, corrected_p double, sites int"
#: Triplets of a task's block.
BLOCK = 256


def detect(states: np.ndarray, o: Options, methods=PRIMARY, fourth: np.ndarray | None = None, held: dict | None = None, rows=(0, 1, 2)) -> list[Candidate]:
    """All detectors share one pass over the triplet's variable sites; results come in the order of the methods. SISCAN
    finds nothing without a fourth sequence. held: BootScan's profiles of pairs of rows that were measured before."""
    v = Variable(states)

    def run(m):
        if m == "SISCAN":
            return windows.siscan(states, o, v, fourth) if fourth is not None else []
        return windows.bootscan(states, o, v, held, rows) if m == "BootScan" else METHODS[m](states, o, v)

    return [c for m in METHOD_ORDER if m in methods for c in run(m)]


def with_similarities(sequences: DataFrame) -> DataFrame:
    """dataset_id, seq_id, states, and each row's direct and tree similarities to all rows, by seq_id; once an alignment."""
    whole = packed(sequences.select("dataset_id", F.col("seq_id").alias("row"), F.col("seq_id").alias("origin"), "states"), True)
    each = whole.select("dataset_id", F.posexplode("members").alias("i", "m"), "direct", "tree")
    own = lambda c: F.slice(c, F.col("i") * F.sqrt(F.size(c)).cast("int") + 1, F.sqrt(F.size(c)).cast("int"))
    return each.select("dataset_id", F.col("m.row").alias("seq_id"), "m.states", own(F.col("direct")).alias("direct"), own(F.col("tree")).alias("tree"))


def _members(m: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, originals and states of an alignment's members."""
    rows, origins, states = (m.field(i) for i in range(3))
    return rows.to_numpy(), origins.to_numpy(), states.flatten().to_numpy().reshape(len(rows), -1)


def packed(rows: DataFrame, similarities: bool) -> DataFrame:
    """dataset_id, members (row, origin, states; by row), and if wanted the similarities of all pairs, as one list each.
    rows: dataset_id, row, origin, states. An alignment's rows all have one length."""
    whole = rows.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("row", "origin", "states"))).alias("members"))
    if not similarities:
        return whole
    kind = whole.schema["members"].dataType.simpleString()

    def run(batches):
        for b in batches:
            both = [outlier.similarities(_members(m.values)[2]) for m in b.column("members")]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([x[i].ravel() for x in both], pa.list_(pa.float32())) for i in (0, 1)]], names=["dataset_id", "members", "direct", "tree"])

    return whole.mapInArrow(run, f"dataset_id long, members {kind}, direct array<float>, tree array<float>")


#: A block of triplets: ranks from low to high of all of an alignment, or of pairs beside one row, or a list of them.
_WORK = ["dataset_id", "low", "high", "beside", "listed"]
_LIST = "array<array<int>>"


def _ranges(groups: DataFrame, count: Column, beside: Column) -> DataFrame:
    each = groups.withColumn("_n", count).withColumn("_block", F.explode(ranks.blocks(F.col("_n"), BLOCK)))
    low = F.col("_block") * BLOCK
    return each.select("dataset_id", low.alias("low"), F.least(low + BLOCK, F.col("_n")).alias("high"), beside.cast("int").alias("beside"), F.lit(None).cast(_LIST).alias("listed"))


def all_triplets(rows: DataFrame) -> DataFrame:
    """Blocks of all triplets of each alignment's rows, from their number alone."""
    n = rows.groupBy("dataset_id").agg(F.count("*").alias("n"))
    return _ranges(n, ranks.triplets_of(F.col("n")), F.lit(None))


def triplets_with(rows: DataFrame, dirty: DataFrame) -> DataFrame:
    """Blocks of the triplets that have a dirty row (dataset_id, row): all pairs of rows, beside each. Dirty rows of one
    alignment share an original, so no triplet has two of them."""
    n = rows.groupBy("dataset_id").agg(F.count("*").alias("n"))
    held = dirty.select("dataset_id", "row").join(rows.select("dataset_id", "row"), ["dataset_id", "row"]).join(n, "dataset_id")
    return _ranges(held, ranks.pairs_of(F.col("n")), F.col("row"))


def listed_triplets(triplets: DataFrame) -> DataFrame:
    """Blocks of given triplets (dataset_id, a, b, c), about BLOCK of them in each."""
    n = triplets.groupBy("dataset_id").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    dealt = triplets.join(n, "dataset_id").withColumn("_block", F.pmod(F.xxhash64("a", "b", "c"), F.col("n")))
    lists = dealt.groupBy("dataset_id", "_block").agg(F.collect_list(F.array("a", "b", "c")).alias("listed"))
    return lists.select("dataset_id", *[F.lit(None).cast(k).alias(c) for c, k in (("low", "long"), ("high", "long"), ("beside", "int"))], "listed")


def triplets_of_block(low, high, beside, listed, ids: np.ndarray, origins: np.ndarray) -> np.ndarray:
    """Places of a block's triplets among an alignment's rows: ascending, of three different originals."""
    if listed is not None:
        t = np.searchsorted(ids, np.array(listed, np.int64).reshape(-1, 3))
    elif beside is None:
        t = unranked(np.arange(low, high), 3)
    else:
        pairs = unranked(np.arange(low, high), 2)
        t = np.sort(np.column_stack([pairs, np.full(len(pairs), np.searchsorted(ids, beside))]), axis=1)
    x, y, z = origins[t].T
    return t[(x != y) & (x != z) & (y != z)]


def unranked(rank: np.ndarray, k: int) -> np.ndarray:
    """The combinations of k with these ranks, as functions.ranks has them."""
    out = []
    for size in range(k, 0, -1):
        count = lambda n, size=size: np.prod([n - i for i in range(size)], axis=0) // (1, 1, 2, 6)[size]
        n = np.floor((rank * (1, 1, 2, 6)[size]) ** (1 / size)).astype(np.int64) + size
        while (over := count(n) > rank).any():
            n -= over
        out.append(n)
        rank = rank - count(n)
    return np.column_stack(out[::-1])


def detected(work: DataFrame, whole: DataFrame, o: Options, methods, tests: Column | None = None, split: Column | None = None) -> DataFrame:
    """Signals of the triplets in blocks of work. tests: the correction of a data set, by default that of o; split: whether
    its 3SEQ tracts are split at erased data."""
    like = "SISCAN" in methods
    settled = whole.withColumns({"_tests": F.lit(o.tests) if tests is None else tests, "_split": F.lit(False) if split is None else split})
    parts = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Blocks of one large alignment are spread over all tasks, more of them than cores, as triplets differ in cost.
    rows = work.join(settled, "dataset_id").repartition(4 * parts, "dataset_id", "low", "beside", F.col("listed")[0])
    rows = rows.select(*_WORK, "members", "_tests", "_split", *(["direct", "tree"] if like else []))
    names, kinds = zip(*[x.split() for x in SIGNAL.split(", ")], strict=True)
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[k] for k in kinds]

    def run(batches):
        from dataclasses import replace

        for b in batches:
            for r in range(b.num_rows):
                dataset, out = b.column("dataset_id")[r].as_py(), []
                own = replace(o, tests=b.column("_tests")[r].as_py())
                cut = b.column("_split")[r].as_py()
                ids, origins, states = _members(b.column("members")[r].values)
                if like:
                    direct, tree = (b.column(c)[r].values.to_numpy().reshape(len(ids), -1) for c in ("direct", "tree"))
                block, held = [b.column(c)[r].as_py() for c in _WORK[1:]], {}
                for t in triplets_of_block(*block, ids, origins):
                    at, of, fourth = ids[t].tolist(), origins[t].tolist(), None
                    if like and (k := outlier.nearest(t, states, direct, tree, origins)) is not None:
                        fourth = states[k]
                    for s in detect(states[t], own, methods, fourth, held, tuple(at)):
                        if cut and s.method == "3SEQ" and (s := consensus.split(s, states[t], own)) is None:
                            continue
                        tract = inside(states.shape[1], s.begin, s.end)
                        out.append((dataset, *at, *of, s.method, at[s.recombinant], at[s.major], at[s.minor], s.begin, s.end, s.local_p, s.corrected_p, s.sites, bool((states[t[s.recombinant]][tract] > 0).any())))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=list(names))

    return rows.mapInArrow(run, SIGNAL)


def scan(sequences: DataFrame, o: Options, methods=PRIMARY) -> DataFrame:
    """Signals of all triplets in one round."""
    ensure(sequences.sparkSession)
    rows = sequences.select("dataset_id", F.col("seq_id").alias("row"), F.col("seq_id").alias("origin"), "states")
    return detected(all_triplets(rows), packed(rows, "SISCAN" in methods), o, methods).select(*[x.split()[0] for x in SCHEMA.split(", ")])


def followed_up(sequences: DataFrame, candidates: DataFrame, o: Options, methods=PRIMARY) -> DataFrame:
    """event_id, seq_id, method, major, minor, begin, end, local_p, corrected_p, overlap: signals in which a masked row is a
    recombinant of an event's parents. Masked rows take no part in a scan, so this is a scan of its own, of one triplet
    for each of them and event. candidates: event_id, dataset_id, seq_id, parent1, parent2, begin, end (the event's
    tract); triplets of several events run once. overlap: of the signal's tract with the event's."""
    ensure(sequences.sparkSession)
    three = F.array_sort(F.array("seq_id", "parent1", "parent2"))
    wanted = candidates.withColumn("_t", three).select("*", *[F.col("_t")[i].alias(x) for i, x in enumerate("abc")]).drop("_t").filter("a < b AND b < c")
    rows = sequences.select("dataset_id", F.col("seq_id").alias("row"), F.col("seq_id").alias("origin"), "states")
    found = detected(listed_triplets(wanted.select("dataset_id", "a", "b", "c").distinct()), packed(rows, "SISCAN" in methods), o, methods)
    length = sequences.groupBy("dataset_id").agg(F.max(F.size("states")).alias("_n"))
    both = wanted.withColumnsRenamed({"begin": "_b", "end": "_e"}).join(found, ["dataset_id", "a", "b", "c"]).filter("recombinant = seq_id").join(length, "dataset_id")
    share = overlap(F.col("begin"), F.col("end"), F.col("_b"), F.col("_e"), F.col("_n"))
    return both.select("event_id", "seq_id", "method", "major", "minor", "begin", "end", "local_p", "corrected_p", share.alias("overlap"))
