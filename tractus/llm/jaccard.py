"""N-gram Jaccard join: a prefix-tree join of globally ordered shingle sets.

1. Sets. All documents' distinct shingles, as 64-bit hashes. A first pass adds up a sketch of a fixed size: how many
   documents have a shingle of each hash slot. The global order is (magnitude of the slot's count, hash): rare shingles
   first. Any such order gives the same links; the sketch only decides how few candidates there are.
2. Classes. Documents with equal sets are one class from here on.
3. Candidates. Two sets with Jaccard similarity t share l tokens of their prefixes of n - ceil(t n) + l tokens; l is half
   of n - ceil(t n), so a class stays only where about a third of its prefix is in other prefixes, which a common
   passage or line does not bring about. Each token that two remaining classes have has a hub, the smallest of them; a
   class goes once to each hub of its tokens, so two classes with a common token meet at its hub.
4. Join. A hub's sets meet in one task, or, where they have more than UNIT_SHINGLES shingles, in one task for each two
   of its blocks. There the sets form a trie; a set is matched with the trie's candidates by one walk that shares
   the overlaps of common beginnings and leaves a subtree when the remaining lengths cannot reach the similarity.
   A link between two sets that are connected already need not be looked at, so a task gives a spanning forest of its
   links, never all pairs.
5. Components of the links give each document the smallest doc_id that it is linked with, directly or not.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_batches, discard, signed, split_join, vacate, written
from .graph import components

SHINGLE, PERCENT = 3, 90
#: Slots of the sketch of shingle frequencies (2 ** SLOT_BITS), shingles of sets that meet in one task, and bits by which
#: texts that no task wants are told (2 ** WANTED_BITS).
SLOT_BITS, UNIT_SHINGLES, WANTED_BITS = 22, 1_000_000, 24
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def prefix_length(n, percent: int = PERCENT):
    """n - ceil(t n) + 1."""
    return n - -(-n * percent // 100) + 1


def extra(n, percent: int = PERCENT):
    """The number l of tokens that the prefixes of two similar sets, the smaller one of n tokens, share at least."""
    return max(1, (n - -(-n * percent // 100)) // 2)


def long_prefix(n, percent: int = PERCENT):
    return n - -(-n * percent // 100) + extra(n, percent)


class Shingler:
    def __init__(self, k: int = SHINGLE):
        self.k, self.words = k, Memo(xxhash.xxh3_64_intdigest)

    def set(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles; with fewer words, one of the whole sequence."""
        ws = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        if not ws:
            return np.zeros(0, np.uint64)
        k = min(self.k, len(ws))
        h = np.fromiter(map(self.words.__getitem__, ws), np.uint64, len(ws))
        out = np.full(len(ws) - k + 1, k, np.uint64)
        for j in range(k):
            out = (out ^ h[j : j + len(out)]) * _A
            out ^= out >> np.uint64(31)
            out *= _B
        out ^= out >> np.uint64(29)
        return np.unique(out * _C)


def ordered(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Keys whose numeric order is the global one: six bits of magnitude, 58 of the hash."""
    level = levels[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(58)) | (hashes & np.uint64((1 << 58) - 1)))


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.tobytes(), 1)


def frequencies(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Magnitudes of the slots' counts over all documents: 2 ** SLOT_BITS bytes, whatever the input."""
    slots, part = 1 << SLOT_BITS, 1 << 17

    def run(batches):
        vacate()
        own, counts = Shingler(shingle), np.zeros(slots, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(counts, (own.set(t) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
        used = [i for i in range(slots // part) if counts[i * part : (i + 1) * part].any()]
        yield pa.RecordBatch.from_pydict({"i": pa.array(used, pa.int32()), "n": pa.array([_packed(counts[i * part : (i + 1) * part]) for i in used], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(part, np.int64)
        for x in table.column("n").to_pylist():
            total += np.frombuffer(zstandard.decompress(x), np.int64)
        return pa.table({"i": table.column("i")[:1], "n": pa.array([np.ceil(np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())})

    levels = np.zeros(slots, np.uint8)
    for r in docs.select(text).mapInArrow(run, "i int, n binary").groupBy("i").applyInArrow(add, "i int, n binary").collect():
        levels[r.i * part : (r.i + 1) * part] = np.frombuffer(r.n, np.uint8)
    return levels


class Node:
    __slots__ = ("children", "depth", "keys", "leaves", "least", "most", "parent")

    def __init__(self, parent, keys, depth, n):
        self.parent, self.keys, self.depth, self.least, self.most = parent, keys, depth, n, n
        self.children: dict[int, Node] = {}
        self.leaves: list[int] = []


class PrefixTree:
    """A trie of ordered sets whose unbranched runs are one node. depth: tokens before the node's own."""

    PIECE = 32

    def __init__(self, percent: int):
        self.root, self.percent = Node(None, [], 0, 0), percent
        self.root.least = 1 << 62

    def insert(self, leaf: int, keys: list[int]) -> Node:
        n, node, at = len(keys), self.root, 0
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if at == n:
                node.leaves.append(leaf)
                return node
            child = node.children.get(keys[at])
            if child is None:
                child = node.children[keys[at]] = Node(node, keys[at:], at, n)
                child.leaves.append(leaf)
                return child
            same, own = 1, child.keys
            while same < len(own) and at + same < n and own[same] == keys[at + same]:
                same += 1
            if same < len(own):  # the run branches here
                top = Node(node, own[:same], at, child.least)
                top.most = child.most
                node.children[keys[at]] = top
                child.parent, child.keys, child.depth = top, own[same:], at + same
                top.children[own[same]] = child
                child = top
            node, at = child, at + same

    def enough(self, overlap: int, n: int, m: int) -> bool:
        return 100 * overlap >= self.percent * (n + m - overlap)

    def walk(self, keys: list[int], wanted: set[Node]):
        """Leaf nodes among the wanted ones (which include the way to them) that are similar to the ordered set keys."""
        have, n = set(keys), len(keys)
        stack = [(c, 0) for c in self.root.children.values() if c in wanted]
        while stack:
            node, overlap = stack.pop()
            own, most, least = node.keys, node.most, node.least
            for a in range(0, len(own), self.PIECE):
                piece = own[a : a + self.PIECE]
                overlap += sum(map(have.__contains__, piece))
                used = node.depth + a + len(piece)
                # No set below can have a larger overlap than this, and the shortest needs the smallest one.
                bound = overlap + min(n - bisect_right(keys, piece[-1]), most - used)
                if not self.enough(bound, n, max(least, bound)):
                    break
            else:
                if node.leaves and self.enough(overlap, n, node.depth + len(own)):
                    yield node
                stack += [(c, overlap) for c in node.children.values() if c in wanted]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def join_sets(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between ordered sets, as pairs of their places."""
    tree, forest, out = PrefixTree(percent), Forest(len(sets)), []
    index: dict[int, dict[int, list[int]]] = {}
    nodes: dict[int, Node] = {}
    for x in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
        keys = sets[x].tolist()
        if not keys:
            continue
        prefix = keys[: prefix_length(len(keys), percent)]
        while True:  # one walk for each component that may hold a partner
            mine, wanted = forest.find(x), set()
            for token in prefix:
                for root, held in list(index.get(token, {}).items()):
                    now = forest.find(root)
                    if now != root:  # lists follow their components
                        held = index[token].pop(root)
                        index[token].setdefault(now, []).extend(held)
                    if now == mine:
                        continue
                    for y in held:
                        if 100 * len(sets[y]) >= percent * len(keys):
                            node = nodes[y]
                            while node is not None and node not in wanted:
                                wanted.add(node)
                                node = node.parent
            if not wanted:
                break
            linked = False
            for node in tree.walk(keys, wanted):
                for y in node.leaves:
                    if forest.union(x, y):
                        out.append((x, y))
                        linked = True
                if linked:
                    break
            if not linked:
                break
        nodes[x] = tree.insert(x, keys)
        root = forest.find(x)
        for token in prefix:
            index.setdefault(token, {}).setdefault(root, []).append(x)
        for y in nodes[x].leaves:  # inserting may have split the node that others end in
            nodes[y] = nodes[x]
    return out


def _classes(docs: DataFrame, text: str, key: str, levels, shingle: int, percent: int) -> DataFrame:
    """Of each row: key, th (hash of the text), n (set size), lo and hi (hash of the set), prefix."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(levels)  # 2 ** SLOT_BITS bytes

    def run(batches):
        vacate()
        own = Shingler(shingle)
        for b in batches:
            n, lo, hi, prefix = [], [], [], []
            for t in b.column(2).to_pylist():
                s = own.set(t)
                keys = ordered(s, known.value)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                lo.append(signed(d & ((1 << 64) - 1)))
                hi.append(signed(d >> 64))
                prefix.append(keys[: long_prefix(len(s), percent) if len(s) else 0].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], names=[key, "th", "n", "lo", "hi", "prefix"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.xxhash64(text).alias("th"), F.col(text)).mapInArrow(run, f"`{key}` {kind}, th long, n long, lo long, hi long, prefix array<long>")
    return written(rows, "sets")


def link(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id: one row for each row of docs.

    Two rows are linked where 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    key that links reach. A null or empty text, or one of white space, has an empty set and is linked with nothing, not
    even its like: its component is its own key. A null key is never the smallest unless all of the component are null.
    Rows that repeat a key or a text are rows like any other. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(key, text)
    levels = frequencies(docs, text, shingle)
    rows = _classes(docs, text, key, levels, shingle, percent)
    # Sets are equal where 128 bits of hash and the size are. A class gets a number of its own, so no two are taken for one.
    first = F.min(F.struct(F.col(key).isNull(), F.col(key).alias("k"), F.col("th")))
    classes = rows.filter("n > 0").groupBy("lo", "hi", "n").agg(first.alias("first"), F.any_value("prefix").alias("prefix"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("c"), "lo", "hi", "n", F.col("first.k").alias("k"), F.col("first.th").alias("th"), "prefix"), "classes")
    tokens = classes.select("c", "n", F.explode("prefix").alias("token"))
    total = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0

    def counted(of: DataFrame) -> DataFrame:
        """Tokens of two classes or more: m, and the smallest class as their hub."""
        return written(of.groupBy("token").agg(F.count("*").alias("m"), F.min("c").alias("hub")).filter("m > 1"), "shared")

    several = counted(tokens)
    left = written(split_join(tokens, several.drop("hub"), ["token"], total), "tokens")
    discard(several)
    # A partner has at least t n tokens, and so shares the l of that size at least.
    least = F.ceil(F.col("n") * percent / 100)
    need = F.greatest(F.lit(1), F.floor((least - F.ceil(least * percent / 100)) / 2))
    for _ in range(2):  # classes that go leave fewer shared tokens to the others
        stay = left.groupBy("c", "n").agg(F.count("*").alias("m")).filter(F.col("m") >= need).select("c")
        kept = written(left.join(stay, "c"), "tokens")
        several = counted(kept)
        old, left = left, written(split_join(kept, several.drop("hub"), ["token"], left.count()), "tokens")
        discard(old, kept, several)
    hubs = counted(left)
    near = split_join(left.select("c", "token"), hubs, ["token"], left.count()).select("hub", "c").distinct()
    links = _joined(docs, classes, near, text, key, levels, shingle, percent)
    discard(left, hubs)
    comp = components(links, "x", "y")
    discard(links)
    named = classes.select("c", "lo", "hi", "n", "k").join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    smallest = named.groupBy("component").agg(F.min("k").alias("component_id"))
    sizes = rows.filter("n > 0").groupBy("lo", "hi", "n").agg(F.count("*").alias("m"))
    of = named.join(smallest, "component").join(sizes, ["lo", "hi", "n"]).select("lo", "hi", "n", "m", "component_id")
    linked = split_join(rows.filter("n > 0").select(key, "lo", "hi", "n"), of, ["lo", "hi", "n"], rows.count()).select(key, "n", "component_id")
    alone = rows.filter("n = 0").select(key, "n", F.col(key).alias("component_id"))
    out = written(linked.unionByName(alone).withColumnRenamed("n", "n_shingles"), "linked")
    discard(rows, classes, comp)
    return out


def wanted(texts: DataFrame, want: DataFrame, key: str, bits: int = WANTED_BITS) -> DataFrame:
    """texts (key, th and others) without rows that no row of want (wk, wth) asks for. Bits of hashes are told to all
    tasks, 64 to a number and at most 2 ** bits: a row whose bit is not set stays where it is, and some others go along."""
    slot = lambda *columns: F.shiftrightunsigned(F.xxhash64(*columns), 64 - bits)
    asked = want.select(slot("wk", "wth").alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("set"))
    told = texts.withColumn("slot", slot(key, "th")).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(asked), "word")
    return told.filter(F.expr("getbit(set, cast(slot & 63 AS int)) = 1")).select(*texts.columns)


def _joined(docs, classes, near, text, key, levels, shingle, percent) -> DataFrame:
    """x, y: links between classes, a spanning forest of each task; a written table."""
    spark = docs.sparkSession
    members = written(near.withColumnRenamed("hub", "cluster").join(classes.drop("prefix", "lo", "hi"), "c"), "members")
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    units = max(1, -(-total // UNIT_SHINGLES))
    blocks = F.ceil(F.col("size") * 2 / UNIT_SHINGLES).cast("int")
    placed = members.join(sizes, "cluster").withColumn("nb", F.when(F.col("size") > UNIT_SHINGLES, F.greatest(blocks, F.lit(2))).otherwise(1))
    block = F.pmod(F.xxhash64("c"), F.col("nb")).cast("int")
    several = F.transform(F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: j != F.col("block")), lambda j: F.concat_ws("/", F.lit("b"), F.col("cluster"), F.least("block", j), F.greatest("block", j)))
    one = F.array(F.concat_ws("/", F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(units))))
    placed = placed.withColumn("block", block).withColumn("units", F.when(F.col("nb") > 1, several).otherwise(one))
    # A text goes to a task once, whatever the number of its hubs there.
    each = placed.select("c", "cluster", F.col("k").alias("wk"), F.col("th").alias("wth"), F.explode("units").alias("unit"))
    want = written(each.groupBy("c", "wk", "wth", "unit").agg(F.collect_set("cluster").alias("clusters")), "wanted")
    discard(members)
    # Texts are shuffled at any size, but only those that are asked for.
    asked = wanted(docs.withColumn("th", F.xxhash64(text)), want, key)
    texts = asked.join(want.hint("merge"), (F.col("th") == F.col("wth")) & F.col(key).eqNullSafe(F.col("wk")))
    rows = texts.select("unit", "clusters", "c", F.col(text).alias("t"))
    known = spark.sparkContext.broadcast(levels)

    def run(table: pa.Table) -> pa.Table:
        vacate()
        own = Shingler(shingle)
        groups: dict[int, dict[int, np.ndarray]] = {}
        for chunk in table.to_batches(1000):
            for clusters, c, t in zip(*(chunk.column(n).to_pylist() for n in ("clusters", "c", "t"))):
                keys = ordered(own.set(t), known.value)
                for cluster in clusters:
                    groups.setdefault(cluster, {})[c] = keys
        x, y = [], []
        for held in groups.values():
            ids = sorted(held)
            for i, j in join_sets([held[c] for c in ids], percent):
                x.append(ids[i])
                y.append(ids[j])
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    links = written(rows.groupBy("unit").applyInArrow(run, "x long, y long"), "links")
    discard(want)
    return links


def op8(docs: DataFrame) -> DataFrame:
    return link(docs).select("doc_id", "n_shingles", "component_id")
