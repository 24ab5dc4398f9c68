"""Merkle dataset manifest: a proof for each row, by blocks reduced in parallel and a small top tree that is broadcast.

1. Leaves. Hashes of the rows' fields, by SQL functions; only hashes travel from there on.
2. Places. Leaves are sorted by (group, order) into ranges. A range that begins within a group has one offset, so the
   driver adds up one number for each range, however many groups there are.
3. Blocks. FAN ** depth consecutive leaves of a group become one node in one task. Where more than `top` nodes remain, they
   are dealt with like leaves; trees with one node left are the leaves of the tree over the groups.
4. Top. The driver builds the tree over at most `top` nodes and broadcasts each node's path to the root. Executors finish
   the proofs: a leaf's siblings within its block, then the path of its block.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, partitions, written

FAN = 16


class Shape(NamedTuple):
    """depth: levels of a block. top: nodes that the driver's tree may start from; the paths of 4096 have at most six levels of
    fifteen digests, 24 MB of hex in all. range_rows: leaves of a sorted range. None of them changes a result."""

    depth: int = 3
    top: int = 4096
    range_rows: int = 500_000

    @property
    def block(self) -> int:
        return FAN**self.depth


_PATH = "array<struct<left: string, right: string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(x: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def node(children: str) -> str:
    """The digest of a run of nodes, given as one text of their hex digests."""
    return sha256(children.encode()).hexdigest()


def levels(nodes: list[str], most: int | None = None) -> list[list[str]]:
    """All levels over nodes, from these to a single one, or to the most-th level above them."""
    out = [nodes]
    while len(out[-1]) > 1 and (most is None or len(out) <= most):
        below = out[-1]
        out.append([node("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def siblings(tree: list[list[str]], place: int) -> list[tuple[str, str]]:
    """For each level below the last the siblings of the node over place: those before it and those after it."""
    out = []
    for level in tree[:-1]:
        first = place - place % FAN
        out.append(("".join(level[first:place]), "".join(level[place + 1 : first + FAN])))
        place //= FAN
    return out


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = node(left + digest + right)
    return digest


def _block_tree(digests: list[str], block: int, depth: int) -> list[list[str]]:
    """The levels within a block. A group's only block ends at its root; of several, each goes up depth levels, which for
    the first of them, being full, is the same."""
    tree = levels(digests, depth)
    while block and len(tree) <= depth:  # the last block of several is carried up with runs of one
        tree.append([node(tree[-1][0])])
    return tree


def ranked(rows: DataFrame, group: str, order: list[str], shape: Shape) -> tuple[DataFrame, list[DataFrame]]:
    """rows with _place, their place in their group from 0; ties of the order are dealt anyhow. Nulls come first. Also the
    tables that can be deleted afterwards. No group meets in one task."""
    fixed = written(rows.withColumn("_tie", F.monotonically_increasing_id()), "merkle-leaves")
    parts = max(partitions(rows.sparkSession), -(-fixed.count() // shape.range_rows))
    keys = [group, *order, "_tie"]
    own = rows.columns
    fields = [f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in own]

    def run(batches):
        from pyspark import TaskContext

        part, run_, at, last, begun = TaskContext.get().partitionId(), 0, 0, None, False
        for b in batches:
            groups, runs, places = b.column(group).to_pylist(), [], []
            for g in groups:
                if begun and g != last:
                    run_, at = run_ + 1, 0
                begun, last = True, g
                runs.append(run_)
                places.append(at)
                at += 1
            held = b.select(own)
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(runs, pa.int64()), pa.array(places, pa.int64())], names=[*own, "_part", "_run", "_at"])

    ordered = fixed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    places = written(ordered.mapInArrow(run, ", ".join([*fields, "_part int", "_run long", "_at long"])), "merkle-places")
    # One row a range: its first group with that one's rows, its last group with that one's rows.
    ends = places.groupBy("_part", "_run").agg(F.count("*").alias("n"), F.first(group).alias("g")).groupBy("_part")
    ends = ends.agg(F.min_by(F.struct("g", "n"), "_run").alias("first"), F.max_by(F.struct("g", "n"), "_run").alias("last"), F.max("_run").alias("runs"))
    offsets, carried, held = [], 0, None
    for i, r in enumerate(sorted(ends.collect(), key=lambda r: r["_part"])):
        before = carried if i and r["first"].g == held else 0
        offsets.append((r["_part"], before))
        carried, held = r["last"].n + (0 if r["runs"] else before), r["last"].g
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part int, _before long"))
    place = F.col("_at") + F.when(F.col("_run") == 0, F.col("_before")).otherwise(0)
    return places.join(known, "_part").select(*rows.columns, place.alias("_place")), [fixed, places]


def _blocks(nodes: DataFrame, shape: Shape, *extra: str) -> DataFrame:
    """tree, block, rows: the nodes of a block in the order of their places, a bounded number of them."""
    block = F.floor(F.col("_place") / shape.block).cast("long").alias("block")
    return nodes.groupBy("tree", block).agg(F.sort_array(F.collect_list(F.struct("_place", "digest", *extra))).alias("rows"))


def _parents(blocks: DataFrame, shape: Shape) -> DataFrame:
    """tree, _place, digest: a node for each block."""

    def run(batches):
        for b in batches:
            tops = [_block_tree(d, i, shape.depth)[-1][0] for d, i in zip(b.column("d").to_pylist(), b.column("block").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("block"), pa.array(tops, pa.string())], names=["tree", "_place", "digest"])

    kind = blocks.schema["tree"].dataType.simpleString()
    return blocks.select("tree", "block", F.col("rows.digest").alias("d")).mapInArrow(run, f"tree {kind}, _place long, digest string")


def _top(nodes: DataFrame, kind: str) -> tuple[DataFrame, str, list[DataFrame]]:
    """The driver's tree over few nodes; trees come one after the other."""
    trees: dict = {}
    for r in sorted(nodes.collect(), key=lambda r: (r.tree is not None, (r.tree.encode() if isinstance(r.tree, str) else r.tree) if r.tree is not None else 0, r["_place"])):
        trees.setdefault(r.tree, []).append(r.digest)
    built = {t: levels(d) for t, d in trees.items()}
    whole = levels([b[-1][0] for b in built.values()])
    rows = [(t, i, siblings(b, i) + siblings(whole, k), b[-1][0]) for k, (t, b) in enumerate(built.items()) for i in range(len(b[0]))]
    return nodes.sparkSession.createDataFrame(rows, f"tree {kind}, block long, path {_PATH}, subroot string"), whole[-1][0], []


def _paths(nodes: DataFrame, kind: str, shape: Shape) -> tuple[DataFrame, str, list[DataFrame]]:
    """tree, block, path, subroot of each of the nodes (a node's place is the block that it stands for), the root, and the
    tables that can be deleted afterwards."""
    n, furthest = nodes.agg(F.count("*"), F.max("_place")).first()
    if n <= shape.top:
        return _top(nodes, kind)
    if furthest == 0:  # every tree is one node: they are the leaves of the tree over all
        placed, made = ranked(nodes.select(F.lit(0).alias("all"), "tree", "digest"), "all", ["tree"], shape)
        one = written(placed.select(F.col("all").alias("tree"), F.col("tree").alias("_tree"), "digest", "_place"), "merkle-groups")
        up, root, more = _paths(one.select("tree", "_place", "digest"), "int", shape)
        same = one.join(up.select(F.col("block").alias("_place"), "path"), "_place")
        return same.select(F.col("_tree").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot")), root, [*made, one, *more]
    blocks = written(_blocks(nodes, shape), "merkle-blocks")
    parents = written(_parents(blocks, shape), "merkle-nodes")
    up, root, made = _paths(parents, kind, shape)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                tree = _block_tree(r["d"], r["block"], shape.depth)
                above = [(x["left"], x["right"]) for x in r["path"]]
                paths = [[{"left": x, "right": y} for x, y in siblings(tree, i) + above] for i in range(len(r["d"]))]
                n = len(paths)
                path_type = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * n, b.schema.field("tree").type), pa.array([r["block"] * shape.block + i for i in range(n)], pa.int64()), pa.array(paths, path_type), pa.array([r["subroot"]] * n, pa.string())], names=["tree", "block", "path", "subroot"])

    both = _with_paths(blocks.select("tree", "block", F.col("rows.digest").alias("d")), up, parents.count() <= shape.top)
    return both.mapInArrow(run, f"tree {kind}, block long, path {_PATH}, subroot string"), root, [*made, blocks, parents]


def _with_paths(blocks: DataFrame, up: DataFrame, few: bool) -> DataFrame:
    """blocks with their paths; these are broadcast where they come from the driver."""
    up = up.select(F.col("tree").alias("_t"), F.col("block").alias("_b"), "path", "subroot")
    return blocks.join(F.broadcast(up) if few else up, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b"))).drop("_t", "_b")


def manifest(rows: DataFrame, key: str, group: str, digest: Column, again: Column | None = None, shape: Shape = Shape()) -> DataFrame:
    """key, leaf, subroot, root, proof (the digest of all siblings), folded (the root by way of the proof) and verified.

    digest: a row's leaf; again: the leaf of the row as it is now, from which the proof is folded (by default the same).
    Groups' leaves ascend by key, then leaf; null keys come first, a null group is a group of its own and the first. Every
    row has its own leaf, repeated rows too: theirs are equal, but their proofs are those of their places. An empty table
    gives an empty one. Other columns of rows, whatever their names, play no part."""
    spark = rows.sparkSession
    bounded_batches(spark)
    leaves = rows.select(F.col(group).alias("tree"), F.col(key).alias("key"), digest.alias("digest"), (digest if again is None else again).alias("now"))
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
    placed, made = ranked(leaves, "tree", ["key", "digest"], shape)
    blocks = written(_blocks(placed, shape, "key", "now"), "merkle-rows")
    discard(*made)
    nodes = written(_parents(blocks, shape), "merkle-nodes")
    n = nodes.count()
    schema = f"key {kinds['key']}, leaf string, subroot string, root string, proof string, folded string, verified boolean"
    if not n:
        return spark.createDataFrame([], schema)
    up, root, more = _paths(nodes, kinds["tree"], shape)

    def run(batches):
        for b in batches:
            for path, subroot, block, keys, digests, now in zip(*(b.column(c).to_pylist() for c in ("path", "subroot", "block", "key", "digest", "now")), strict=True):
                tree, above = _block_tree(digests, block, shape.depth), [(x["left"], x["right"]) for x in path]
                rest, proofs, ends = "".join(x + y for x, y in above), [], []
                for i, d in enumerate(now):
                    own = siblings(tree, i)
                    proofs.append(sha256(("".join(x + y for x, y in own) + rest).encode()).hexdigest())
                    ends.append(folded(folded(d, own), above))
                k = len(keys)
                columns = [pa.array(keys, b.schema.field("key").type.value_type), *(pa.array(x, pa.string()) for x in (digests, [subroot] * k, [root] * k, proofs, ends)), pa.array([e == root for e in ends], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "leaf", "subroot", "root", "proof", "folded", "verified"])

    found = _with_paths(blocks.select("tree", "block", *[F.col(f"rows.{c}").alias(c) for c in ("key", "digest", "now")]), up, n <= shape.top).mapInArrow(run, schema)
    found._written_to = [t._written_to for t in (blocks, nodes, *more)]
    return found


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Of every fifth document by crc32 of its id the text
    is lower-cased before its proof is folded; a null id has no crc32 and is left as it is."""
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    fields["n_chars"] = fields["n_chars"].cast("long")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    again = leaf(*(fields | {"text": F.translate("text", _UPPER, _LOWER)}).values())
    whole = leaf(*fields.values())
    out = manifest(docs, "doc_id", "source", whole, F.when(tampered, again).otherwise(whole), shape)
    named = out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")
    named._written_to = getattr(out, "_written_to", None)
    return named
