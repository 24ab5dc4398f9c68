"""Bootstrap trees as an edge table, and their splits as bit sets that are counted across replicates.

Distances of all replicates come from one pass over the pairs. A tree's nodes are folded in the order in which they were
made: a node's leaves are the union of those of its children, as words of bits. A split is the side without the first
leaf, so equal splits of any two trees are equal bytes, and their support is one aggregate over the replicates.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import jukes_cantor
from ..ship import ensure
from .kernels.common import bootstrap_weights
from .relations import pairs
from .trees import matrix, neighbour_joining

#: Leaves of a word; below 63, so that words stay positive.
WORD = 62
#: Splits with a smaller support, in whole percent, are collapsed.
CUTOFF = 50
EDGES = "dataset_id long, replicate int, parent int, child int, length double"
_TREE = ["dataset_id", "replicate"]


def replicate_distances(sequences: DataFrame, length: int, replicates: int, seed: int = 3) -> DataFrame:
    """dataset_id, replicate, s1, s2, distance. Replicate 0 has each site once, the others weight all sites."""
    w = F.from_json(F.lit(json.dumps(bootstrap_weights(length, replicates, seed).T.tolist())), "array<array<int>>")
    sites = F.zip_with("x", "y", lambda x, y: F.when((x > 0) & (y > 0), (x != y).cast("int")))
    each = pairs(sequences.select("dataset_id", "seq_id", "states")).select("dataset_id", "s1", "s2", sites.alias("_d"), F.posexplode(w).alias("replicate", "_w"))
    # Valid sites and differences in one number: both are below 2 ** 24.
    both = F.aggregate(F.zip_with("_d", "_w", lambda d, n: F.coalesce(n * (d + (1 << 24)).cast("long"), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, n: a + n)
    v = F.col("_v")
    distance = F.when(v >= 1 << 24, jukes_cantor(F.shiftright(v, 24), v.bitwiseAND((1 << 24) - 1))).otherwise(10.0)
    return each.withColumn("_v", both).select("dataset_id", "replicate", "s1", "s2", distance.alias("distance"))


def joined_trees(distances: DataFrame) -> DataFrame:
    """Edges of one neighbour-joining tree for each data set and replicate. Leaves are seq_ids; inner nodes count from -1
    downwards in the order in which they are made, so a node comes after its children. The last one is the root."""
    ensure(distances.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        first, second = table.column("s1").to_numpy(), table.column("s2").to_numpy()
        ids = np.unique(np.concatenate([first, second]))
        edges = neighbour_joining(matrix(len(ids), np.searchsorted(ids, first), np.searchsorted(ids, second), table.column("distance").to_numpy()))
        name = lambda k: int(ids[k]) if k < len(ids) else len(ids) - 1 - k
        n = len(edges)
        return pa.table({"dataset_id": pa.array([table.column("dataset_id")[0].as_py()] * n, pa.int64()), "replicate": pa.array([table.column("replicate")[0].as_py()] * n, pa.int32()), "parent": pa.array([name(p) for p, _, _ in edges], pa.int32()), "child": pa.array([name(c) for _, c, _ in edges], pa.int32()), "length": pa.array([x for *_, x in edges], pa.float64())})

    return distances.groupBy(*_TREE).applyInArrow(run, EDGES)


def _or(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a.bitwiseOR(b))


def clades(edges: DataFrame) -> DataFrame:
    """dataset_id, replicate, node (counted from 1 in the order of making), leaves (a bit set as words), n (all leaves).
    A data set's leaves are numbered by seq_id."""
    nodes = edges.groupBy(*_TREE, "parent").agg(F.collect_list("child").alias("children"))
    made = F.array_sort(F.collect_list(F.struct((-F.col("parent")).alias("k"), "children")))
    trees = nodes.groupBy(*_TREE).agg(made.alias("_made"))
    held = F.array_sort(F.filter(F.flatten(F.transform("_made", lambda m: m["children"])), lambda c: c >= 0))
    trees = trees.withColumn("_leaves", held).withColumn("_words", F.sequence(F.lit(0), F.floor((F.size("_leaves") - 1) / WORD).cast("int")))
    place = lambda c: (F.array_position("_leaves", c) - 1).cast("int")
    one = lambda c: F.transform("_words", lambda w: F.when(F.floor(place(c) / WORD) == w, F.pow(F.lit(2.0), F.pmod(place(c), F.lit(WORD))).cast("long")).otherwise(F.lit(0).cast("long")))
    none = F.transform("_words", lambda w: F.lit(0).cast("long"))
    below = lambda sets, c: F.when(c >= 0, one(c)).otherwise(F.element_at(sets, -c))
    union = lambda sets, m: F.aggregate(m["children"], none, lambda x, c: _or(x, below(sets, c)))
    folded = F.aggregate("_made", F.array().cast("array<array<bigint>>"), lambda sets, m: F.concat(sets, F.array(union(sets, m))))
    each = trees.select(*_TREE, "_words", F.size("_leaves").alias("n"), folded.alias("_sets"))
    return each.select(*_TREE, "n", F.posexplode("_sets").alias("node", "leaves")).withColumn("node", F.col("node") + 1)


def as_bytes(words: Column) -> Column:
    return F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def bipartitions(edges: DataFrame) -> DataFrame:
    """dataset_id, replicate, split (BINARY), leaves, words (its bits, WORD in each): inner splits of each tree, each once."""
    c = clades(edges)
    # All leaves of word i: WORD bits, fewer in the last one.
    left = lambda i: F.least(F.lit(WORD), F.col("n") - i * WORD)
    turned = F.transform("leaves", lambda w, i: w.bitwiseXOR(F.pow(F.lit(2.0), left(i)).cast("long") - 1))
    side = F.when(F.element_at("leaves", 1).bitwiseAND(1) == 1, turned).otherwise(F.col("leaves"))
    sized = c.withColumn("_side", side).withColumn("leaves", F.aggregate("_side", F.lit(0), lambda a, w: a + F.bit_count(w)))
    inner = sized.filter((F.col("leaves") > 1) & (F.col("leaves") < F.col("n") - 1))
    return inner.select(*_TREE, as_bytes(F.col("_side")).alias("split"), "leaves", F.col("_side").alias("words")).distinct()


def split_support(splits: DataFrame, replicates: int) -> DataFrame:
    """dataset_id, split, leaves, seen, percent, collapsed: of each split of the tree of replicate 0 the replicates that have
    it, with that tree as one more, in whole percent (halves to even); collapsed below CUTOFF. Without replicates all have
    100 percent."""
    seen = splits.groupBy("dataset_id", "split").agg(F.count_if(F.col("replicate") > 0).alias("seen"), F.max(F.col("replicate") == 0).alias("_own"), F.max("leaves").alias("leaves"))
    percent = F.lit(100).cast("long") if replicates == 0 else F.bround((F.col("seen") + 1) / (replicates + 1) * 100, 0).cast("long")
    out = seen.filter("_own").select("dataset_id", "split", "leaves", "seen", percent.alias("percent"))
    return out.withColumn("collapsed", F.col("percent") < CUTOFF)


def collapsed_distances(edges: DataFrame, support: DataFrame) -> DataFrame:
    """dataset_id, s1, s2, splits: for each two leaves of the tree of replicate 0 the number of its splits between them that
    are not collapsed; rank distances of the collapsed tree."""
    base = edges.filter("replicate = 0")
    ids = base.filter("child >= 0").groupBy("dataset_id").agg(F.array_sort(F.collect_set("child")).alias("ids"))
    kept = support.filter("NOT collapsed").groupBy("dataset_id").agg(F.collect_list("split").alias("kept"))
    two = ids.join(kept, "dataset_id", "left").select("dataset_id", "ids", F.coalesce("kept", F.array().cast("array<binary>")).alias("kept"))
    # A leaf's place in the bytes: word and bit, the first of a word being its last bit.
    digit = lambda s, p: F.conv(F.substring(F.hex(s), (F.floor(p / WORD) * 16 + 16 - F.floor(F.pmod(p, F.lit(WORD)) / 4)).cast("int"), F.lit(1)), 16, 10).cast("int")
    bit = lambda s, p: F.floor(digit(s, p) / F.pow(F.lit(2), F.pmod(F.pmod(p, F.lit(WORD)), F.lit(4)))) % 2
    places = F.sequence(F.lit(0), F.size("ids") - 1)
    each = two.select("dataset_id", "ids", "kept", F.explode(places).alias("i")).withColumn("j", F.explode(F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda j: j > F.col("i"))))
    between = F.size(F.filter("kept", lambda s: bit(s, F.col("i")) != bit(s, F.col("j"))))
    at = lambda i: F.element_at("ids", F.col(i) + 1)
    return each.select("dataset_id", at("i").alias("s1"), at("j").alias("s2"), between.cast("long").alias("splits"))
