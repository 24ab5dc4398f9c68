"""SimHash near-duplicates: different fingerprints are compared tile by tile, exactly, by exclusive-or and bit counts.

1. Fingerprints. One pass over the texts; a fingerprint's bit is set where over half of its shingles' hashes have it.
2. Tiles. Different fingerprints are sorted by the population counts of their parts. A tile has at most TILE of them, all
   with the same counts, so even a very common count vector is many tiles of a bounded size.
3. Pairs. Two fingerprints differ in at least as many bits as their counts differ in all, so tiles whose counts differ by
   more than the radius are never paired. A tile names the count vectors within the radius and meets these tiles by an
   equality join of the tiles' directory. More fingerprints have more parts, which keeps tiles apart.
4. Links of a pair of tiles are given as a spanning forest; components of all of them give classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, partitions, salted_join, written
from .graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
TILE = 4096
#: Elements of a matrix of differences in a task, hashes of a text that are counted at once.
CELLS, PIECE = 1 << 18, 1 << 16
#: Parts of a fingerprint, by the number of different fingerprints up to which they are used.
PARTS = ((4, 1 << 23), (8, 1 << 31), (16, 1 << 62))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed number; zero without words. Of fewer words than a shingle the sequence is hashed."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    k = min(shingle, len(words))
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - k + 1], ends[k - 1 :]
    del words
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), PIECE):
        a, b = starts[at : at + PIECE].tolist(), ends[at : at + PIECE].tolist()
        h = np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a, b, strict=True)), np.uint64, len(a))
        by = h.view(np.uint8).reshape(-1, 8)
        ones += np.concatenate([np.bincount(by[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """key, fp: one row for each row of docs."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, fp long")


def count_key(fp: Column, parts: int, radius: int) -> Column:
    """The parts' population counts as digits of one number."""
    bits, base = 64 // parts, _base(parts, radius)
    count = lambda i: F.bit_count(F.shiftrightunsigned(fp, bits * i).bitwiseAND(F.lit((1 << bits) - 1)))
    return sum((count(i).cast("long") * base**i for i in range(1, parts)), count(0).cast("long"))


def _base(parts: int, radius: int) -> int:
    return max(64 // parts, 2 * radius) + 1


def offsets(parts: int, radius: int) -> list[int]:
    """What is added to a count key for each way in which counts differ by radius at most, of two opposite ways one."""

    def ways(n: int, left: int):
        if n == 0:
            yield ()
            return
        for d in range(-left, left + 1):
            for rest in ways(n - 1, left - abs(d)):
                yield (d, *rest)

    base = _base(parts, radius)
    return sorted(o for w in ways(parts, radius) if (o := sum(d * base**i for i, d in enumerate(w))) >= 0)


def tiles(different: DataFrame, parts: int, radius: int, tile: int = TILE) -> DataFrame:
    """tile, key, fps (packed): at most so many fingerprints of one count key."""
    spark = different.sparkSession
    rows = different.select(count_key(F.col("fp"), parts, radius).alias("key"), "fp")

    def run(batches):
        from pyspark import TaskContext

        number, held, key = TaskContext.get().partitionId() << 32, [], None

        def packed():
            fps = np.concatenate(held)
            return pa.RecordBatch.from_pydict({"tile": pa.array([number], pa.int64()), "key": pa.array([key], pa.int64()), "fps": pa.array([fps.tobytes()], pa.binary())})

        for b in batches:
            keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
            for x, y in zip(cuts := [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist()], [*cuts[1:], len(keys)], strict=True) if len(keys) else ():
                while x < y:
                    have = sum(map(len, held))
                    if held and (key != keys[x] or have == tile):
                        yield packed()
                        number, held, have = number + 1, [], 0
                    key, more = int(keys[x]), min(y - x, tile - have)
                    held.append(fps[x : x + more])
                    x += more
        if held:
            yield packed()

    ordered = rows.repartitionByRange(partitions(spark), "key", "fp").sortWithinPartitions("key", "fp")
    return written(ordered.mapInArrow(run, "tile long, key long, fps binary"), "tiles")


def tile_pairs(held: DataFrame, parts: int, radius: int) -> DataFrame:
    """x, y: tiles whose counts differ by radius at most, each pair once; a tile is paired with itself too."""
    shift = F.explode(F.array(*[F.lit(o).cast("long") for o in offsets(parts, radius)]))
    a = held.select(F.col("tile").alias("x"), "key", shift.alias("o")).withColumn("key", F.col("key") + F.col("o"))
    return a.join(held.select(F.col("tile").alias("y"), "key"), "key").filter("o > 0 OR x <= y").select("x", "y")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links i, j between n nodes: its other nodes, and its least one."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[i], low[j])
        now = low.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == low).all():
            break
        low = now
    own = np.flatnonzero(low != np.arange(n))
    return own, low[own]


def compared(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints of two tiles, or within one; as pairs of fingerprints."""
    both = a if b is None else np.concatenate([a, b])
    other, first, i, j = (a, 0, [], []) if b is None else (b, len(a), [], [])
    step = max(1, CELLS // len(other))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ other[None, :]) <= radius
        x, y = np.nonzero(near)
        x, y = x + at, y + first
        new = x < y
        x, y = forest(len(both), np.concatenate([*i, x[new]]), np.concatenate([*j, y[new]]))
        i, j = [x], [y]
    return both[i[0]], both[j[0]]


def links(different: DataFrame, radius: int = RADIUS, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """u, v: links between different fingerprints fp, enough of them to hold their components together."""
    if parts is None:
        n = different.count()
        parts = next(p for p, most in PARTS if n <= most)
    held = tiles(different, parts, radius, tile)
    pairs = tile_pairs(held, parts, radius)
    side = lambda t, f: held.select(F.col("tile").alias(t), F.col("fps").alias(f))
    both = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y")

    def run(batches):
        for batch in batches:
            u, v = [], []
            for x, y, a, b in zip(*(batch.column(c).to_pylist() for c in "xyab"), strict=True):
                i, j = compared(np.frombuffer(a, np.uint64), None if x == y else np.frombuffer(b, np.uint64), radius)
                u.append(i.view(np.int64))
                v.append(j.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u) if u else [], pa.int64()), pa.array(np.concatenate(v) if v else [], pa.int64())], names=["u", "v"])

    out = written(both.select("x", "y", "a", "b").mapInArrow(run, "u long, v long"), "simhash-links")
    discard(held)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """key, fp (signed), component_id: one row for each row of docs.

    Rows are linked where their fingerprints differ in radius bits at most; component_id is the smallest key that links
    reach. Null and empty texts, and those of white space, have fingerprint zero and are linked like any others. A null
    key is never the smallest unless all of the component are null. Repeated rows are rows like any other; other columns
    of docs, whatever their names, play no part. An empty table gives an empty one."""
    rows = written(fingerprints(docs, text, key, shingle), "simhash")
    different = written(rows.groupBy("fp").agg(F.min("key").alias("k"), F.count("*").alias("m")), "simhash-classes")
    found = links(different, radius)
    comp = components(found, "u", "v")
    discard(found)
    named = different.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = written(named, "simhash-components")
    discard(comp)
    smallest = written(named.groupBy("component").agg(F.min("k").alias("component_id"), F.count("*").alias("m")), "simhash-smallest")
    of = salted_join(named.select("component", "fp", F.col("m").alias("copies")), smallest, ["component"])
    of = of.select("fp", "component_id", F.col("copies").alias("m"))
    out = salted_join(rows, of, ["fp"]).select(F.col("key").alias(key), "fp", "component_id")
    out._written_to = [t._written_to for t in (rows, different, named, smallest)]
    return out


def op12(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id, as near_duplicates gives them."""
    found = near_duplicates(docs)
    out = found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    out._written_to = found._written_to
    return out
