"""Hard-negative mining by one-dimensional distance keys: an exact search for inner products, certified by distance bounds.

1. Augmented vectors. With one more component, sqrt(M - |x|^2) for stored rows (M: the largest squared length) and 0 for
   anchors, a larger inner product is a smaller distance: d^2 = |q|^2 + M - 2 q.x.
2. Store. A row's key is (nearest pivot, distance to it). Rows are sorted by their keys and packed into blocks of at most
   BLOCK rows of one pivot; a block's keys are an annulus around its pivot. Anchors are packed alike into chunks.
3. Rounds. A want is a list to be filled for an anchor: rows of its label, or of others, with scores in an interval. Its
   radius grows; each round meets the blocks whose annuli the radius has newly reached, which the triangle inequality
   finds by intervals of keys. A want is certified once its last place is nearer than any annulus left.
4. Tiles. A chunk and a block meet in one task: a matrix product, of which each want keeps the best rows.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, partitions, written

#: Rows of a block, anchors of a chunk, pivots, rows of the sample that pivots are fitted to, rounds of that fit.
BLOCK, CHUNK, PIVOTS, SAMPLE, FITS = 4096, 1024, 64, 4096, 5
#: Blocks of one pivot are dealt to so many tasks when pairs are made.
SALTS = 16
MOST = (1 << 62) - 1


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Means of the sample's rows nearest to them, after a few rounds."""
    held = sample[:: max(1, len(sample) // count)][:count].astype(float)
    for _ in range(FITS):
        near = np.argmin(distances(sample, held), axis=1)
        held = np.stack([sample[near == p].mean(axis=0) if (near == p).any() else held[p] for p in range(len(held))])
    return held


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T
    return np.sqrt(np.maximum(square, 0))


class Space:
    """dims, the largest squared length and component, and pivots; small, and sent along with tasks."""

    def __init__(self, dims: int, longest: int, largest: int):
        self.dims, self.longest, self.kind, self.pivots = dims, longest, np.dtype(np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64), None
        self.reach = sqrt(longest)
        self.slack = 1e-6 * (1 + self.reach)

    def stored(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.column_stack([x, np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))])

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q.astype(float), np.zeros(len(q))])

    def unpacked(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.kind).reshape(-1, self.dims)

    def distance(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(square + self.longest - 2.0 * score, 0))


def keyed(rows: DataFrame, space: Space) -> DataFrame:
    """key, label, v, anchor, and the row's key of the store: pivot and distance."""

    def run(batches):
        for b in batches:
            x = space.stored(matrix(b.column("v"), space.dims))
            d = distances(x, space.pivots)
            near = np.argmin(d, axis=1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(x)), near], pa.float64())], names=[*b.schema.names, "pivot", "distance"])

    return rows.select("key", "label", "v", "anchor").mapInArrow(run, "key long, label long, v array<long>, anchor boolean, pivot int, distance double")


def packed(rows: DataFrame, space: Space, size: int, name: str) -> DataFrame:
    """place, pivot, low, high, keys, labels, vectors: at most size rows of one pivot in the order of distances; within
    a pack they ascend by key."""
    kind, dims = space.kind, space.dims

    def run(batches):
        from pyspark import TaskContext

        place, held, pivot = TaskContext.get().partitionId() << 32, [], None

        def flushed():
            keys, labels, far, v = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((labels, keys))
            values = [place, pivot, far.min(), far.max(), keys[order].tobytes(), labels[order].tobytes(), v[order].astype(kind).tobytes()]
            types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], names=["place", "pivot", "low", "high", "keys", "labels", "vectors"])

        for b in batches:
            of, at = b.column("pivot").to_numpy(), 0
            columns = [b.column(c).to_numpy() for c in ("key", "label", "distance")] + [matrix(b.column("v"), dims)]
            while at < len(of):
                have = sum(len(h[0]) for h in held)
                if held and (pivot != of[at] or have == size):
                    yield flushed()
                    place, held, have = place + 1, [], 0
                pivot = int(of[at])
                others = np.flatnonzero(of[at : at + size - have] != pivot)
                end = at + (others[0] if len(others) else min(size - have, len(of) - at))
                held.append([c[at:end] for c in columns])
                at = end
        if held:
            yield flushed()

    order = ["pivot", "distance", "key"]
    rows = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return written(rows.mapInArrow(run, "place long, pivot int, low double, high double, keys binary, labels binary, vectors binary"), name)


#: What is known of a want: its anchor's chunk and place there, same label or another, scores from least to top, the
#: radius that was searched and that to be searched now, the score that a row needs by now, the most rows.
_WANT = "chunk long, spot int, slot int, same boolean, top long, least long, searched double, radius double, need long"
_FOUND = "chunk long, spot int, slot int, score long, key long"


def _chunks(active: DataFrame, chunks: DataFrame) -> DataFrame:
    names = [w.split()[0] for w in _WANT.split(", ")[1:]]
    wants = active.groupBy("chunk").agg(F.collect_list(F.struct(*names)).alias("wants"))  # five for an anchor at most
    return wants.join(chunks.select(F.col("place").alias("chunk"), F.col("keys").alias("qk"), F.col("labels").alias("ql"), F.col("vectors").alias("qv")), "chunk")


def _columns(wants: pa.Array) -> dict[str, np.ndarray]:
    return {f.name: wants.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(wants.type)}


def _pairs(asked: DataFrame, blocks: DataFrame, space: Space) -> DataFrame:
    """chunk, place: blocks whose annuli meet the key intervals of a chunk's wants."""

    def run(batches):
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                w = _columns(b.column("wants")[r].values)
                d = distances(space.asked(space.unpacked(b.column("qv")[r].as_py())), space.pivots)[w["spot"]]
                reach = w["radius"][:, None] + space.slack
                rows += [(b.column("chunk")[r].as_py(), p, x, y) for p, (x, y) in enumerate(zip((d - reach).min(axis=0), (d + reach).max(axis=0), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.float64()))], names=["chunk", "pivot", "x", "y"])

    ranges = asked.select("chunk", "wants", "qv").mapInArrow(run, "chunk long, pivot int, x double, y double")
    ranges = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    directory = blocks.select("place", "pivot", "low", "high", F.pmod("place", F.lit(SALTS)).cast("int").alias("salt"))
    return ranges.join(directory, ["pivot", "salt"]).filter("high >= x AND low <= y").select("chunk", "place")


def best(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the largest allowed scores of each row, of equal ones those of the smallest columns."""
    n = scores.shape[1]
    ranks = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), -np.iinfo(np.int64).max)
    columns = np.argpartition(-ranks, most - 1, axis=1)[:, :most] if n > most else np.broadcast_to(np.arange(n), ranks.shape)
    row = np.repeat(np.arange(len(scores)), columns.shape[1])
    column = columns.ravel()
    held = allowed[row, column]
    return row[held], column[held]


def _tiles(asked: DataFrame, blocks: DataFrame, space: Space, most: int) -> DataFrame:
    """What the wants find in the blocks that their radius has newly reached."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                one = {c: b.column(c)[r] for c in b.schema.names}
                w = _columns(one["wants"].values)
                q, keys, labels = space.unpacked(one["qv"].as_py()), np.frombuffer(one["qk"].as_py(), np.int64), np.frombuffer(one["ql"].as_py(), np.int64)
                own, theirs = np.frombuffer(one["keys"].as_py(), np.int64), np.frombuffer(one["labels"].as_py(), np.int64)
                d = distances(space.asked(q), space.pivots[[one["pivot"].as_py()]])[:, 0]
                near = np.maximum(np.maximum(d - one["high"].as_py(), one["low"].as_py() - d) - space.slack, 0)[w["spot"]]
                square = (q.astype(float) ** 2).sum(axis=1)[w["spot"]]
                far = (d + one["high"].as_py() + space.slack)[w["spot"]]
                use = (near > w["searched"]) & (near <= w["radius"]) & (far >= space.distance(square, w["top"]))
                if not use.any():
                    continue
                spots, index = np.unique(w["spot"][use], return_inverse=True)
                scores = np.rint(q[spots].astype(float) @ space.unpacked(one["vectors"].as_py()).astype(float).T).astype(np.int64)
                w = {c: v[use] for c, v in w.items()}
                out = []
                for slot in np.unique(w["slot"]):
                    mine = np.flatnonzero(w["slot"] == slot)
                    s, at = scores[index[mine]], w["spot"][mine]
                    allowed = (theirs[None, :] == labels[at][:, None]) == w["same"][mine].astype(bool)[:, None]
                    allowed &= (s <= w["top"][mine][:, None]) & (s >= np.maximum(w["least"], w["need"])[mine][:, None]) & (own[None, :] != keys[at][:, None])
                    i, j = best(s, allowed, most)
                    out.append((at[i], np.full(len(i), slot), s[i, j], own[j]))
                spot, slot, score, key = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(spot), one["chunk"].as_py()), pa.int64()), pa.array(spot, pa.int32()), pa.array(slot, pa.int32()), pa.array(score, pa.int64()), pa.array(key, pa.int64())], names=["chunk", "spot", "slot", "score", "key"])

    met = _pairs(asked, blocks, space).join(asked, "chunk").join(blocks, "place")
    return met.select("chunk", "wants", "qk", "ql", "qv", "pivot", "low", "high", "keys", "labels", "vectors").mapInArrow(run, _FOUND)


def search(wants: DataFrame, chunks: DataFrame, blocks: DataFrame, space: Space, most: int) -> DataFrame:
    """chunk, spot, slot, score, key, rank: the first rows of each want. wants: chunk, spot, slot, same, top, least, square
    (the anchor's), radius (to begin with)."""
    spark, by = wants.sparkSession, ["chunk", "spot", "slot"]
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.desc("score"), "key")
    now = written(wants.withColumns({"searched": F.lit(-1.0), "need": F.lit(-MOST)}), "wants")
    found = None
    while True:
        asked = written(_chunks(now, chunks), "asked")
        new = _tiles(asked, blocks, space, most)
        ranked = (new if found is None else new.unionByName(found.drop("rank"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        old, found = found, written(ranked, "found")
        last = found.groupBy(*by).agg(F.count("*").alias("n"), F.min("score").alias("last"))
        step = now.drop("need").join(last, by, "left")
        full, at = F.col("n") >= most, lambda s: F.sqrt(F.greatest(F.col("square") + space.longest - 2 * s.cast("double"), F.lit(0.0)))
        # A row with the least score allowed, or with that of the last place, may be as far as this.
        furthest = F.when(F.coalesce(full, F.lit(False)), at(F.greatest("last", "least"))).otherwise(F.least(at(F.greatest(F.col("least"), F.lit(-space.longest))), F.lit(2 * space.reach))) + space.slack
        step = step.select(*by, "same", "top", "least", "square", F.col("radius").alias("searched"), F.when(F.coalesce(full, F.lit(False)), furthest).otherwise(F.least(F.col("radius") * 2, furthest)).alias("radius"), F.when(full, F.col("last")).otherwise(-MOST).alias("need"), furthest.alias("furthest"))
        left = written(step.filter("searched < furthest").drop("furthest"), "wants")
        discard(now, asked, *([old] if old is not None else []))
        now = left
        if now.isEmpty():
            discard(now)
            return found


def mine(rows: DataFrame, anchor: Column, key: str = "key", label: str = "label", vector: str = "v", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vector: whole numbers; shorter vectors count as filled up with zeros. An anchor's positives are the first rows of its
    label, by inner product and then smaller key; a positive's negatives the first rows of other labels that satisfy low *
    positive_score <= 100 * negative_score <= high * positive_score. Rows without key, label, vector or component take no
    part; rows that are repeated whole count once, and no row of the anchor's own key is its positive or negative. An
    anchor without others of its label, and a positive without such negatives, give no row; an empty table gives an
    empty one. Other columns, whatever their names, play no part. Raises ValueError where dims * the largest component
    squared reaches 2 ** 51, beyond which scores are not exact."""
    spark = rows.sparkSession
    bounded_batches(spark)
    whole = rows.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    whole = whole.filter("key IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)").distinct()
    whole = written(whole, "vectors")
    biggest = F.max(F.greatest(F.array_max("v"), -F.array_min("v")))
    n, dims, largest = whole.agg(F.count("*"), F.max(F.size("v")), biggest).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    dims, largest = max(1, dims), max(1, largest or 0)
    if dims * largest * largest >= 1 << 51:
        raise ValueError("dims * largest component ** 2 must be below 2 ** 51")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    space = Space(dims, whole.agg(F.max(square)).first()[0], largest)
    sample = [r.v + [0] * (dims - len(r.v)) for r in whole.orderBy(F.xxhash64("key", "v"), "key").limit(SAMPLE).select("v").collect()]
    space.pivots = pivots(space.stored(np.array(sample, np.int64)), PIVOTS)
    with_keys = written(keyed(whole, space), "keyed")
    blocks = packed(with_keys, space, BLOCK, "blocks")
    chunks = packed(with_keys.filter("anchor"), space, CHUNK, "chunks")
    discard(whole, with_keys)

    def anchors(batches):
        for b in batches:
            for r in range(b.num_rows):
                keys, v = np.frombuffer(b.column("keys")[r].as_py(), np.int64), space.unpacked(b.column("vectors")[r].as_py()).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b.column("place")[r].as_py()), pa.int64()), pa.array(np.arange(len(keys)), pa.int32()), pa.array(keys, pa.int64()), pa.array((v * v).sum(axis=1), pa.int64())], names=["chunk", "spot", "anchor_id", "square"])

    asking = written(chunks.select("place", "keys", "vectors").mapInArrow(anchors, "chunk long, spot int, anchor_id long, square long"), "anchors")
    wants = asking.select("chunk", "spot", F.lit(0).alias("slot"), F.lit(True).alias("same"), F.lit(MOST).alias("top"), F.lit(-MOST).alias("least"), "square", F.lit(space.reach / 4).alias("radius"))
    likes = search(wants, chunks, blocks, space, positives).select("chunk", "spot", F.col("rank").alias("slot"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    each = likes.join(asking, ["chunk", "spot"])
    p = F.col("positive_score")
    whole_from = F.ceil(p * low / F.lit(100).cast("decimal(20,0)")).cast("long")
    at = lambda s: F.sqrt(F.greatest(F.col("square") + space.longest - 2 * F.col(s).cast("double"), F.lit(0.0)))
    bounds = each.withColumns({"top": F.floor(p * high / F.lit(100).cast("decimal(20,0)")).cast("long"), "least": whole_from}).filter("least <= top")
    wants = bounds.select("chunk", "spot", "slot", F.lit(False).alias("same"), "top", "least", "square", (at("top") + (at("least") - at("top")) / 4).alias("radius"))
    others = search(wants, chunks, blocks, space, negatives)
    out = each.join(others, ["chunk", "spot", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11(embeddings: DataFrame) -> DataFrame:
    """mine's rows for anchors whose vec_id is divisible by 100; components are floor(256 x), and the label of every row whose
    vec_id is divisible by 7 becomes (label + 1) % 10. Rows with a null or non-finite component take no part."""
    v, known = F.col("embedding"), F.col("vec_id")
    moved = F.when(known % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.when(usable(v), F.transform(v, lambda x: F.floor(x.cast("double") * 256)))
    return mine(embeddings.select(known.alias("key"), moved.alias("label"), whole.alias("v")), F.col("key") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER w <= 5
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
"""
