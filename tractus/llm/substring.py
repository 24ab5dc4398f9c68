"""Removal of repeated byte strings, with suffix arrays of shards.

Every window of ``length`` bytes is named by the smallest hash of its 24-byte grams. Equal windows have equal names, so
windows of one name meet in one shard. A run of consecutive windows of one name is a segment; a name that one segment
has, with its gram in one place only, is done with. Equal segments are kept once, with their number. A shard's segments are put end to
end, sorted by induced sorting, and the common prefixes of neighbours, in text order, tell which windows occur again;
windows of a segment that is there more than once occur again as well. What is covered goes back to the documents.

A name whose segments have more than UNIT_BYTES is not sorted in one task: its segments are split into blocks, and each
two blocks meet in a task of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bounded_batches, discard, signed, written
from .suffix import permuted_lcp, suffix_array

LENGTH, GRAM = 200, 24
#: Bytes of text that are hashed together, and bytes of segments that are sorted in one task: what fits in caches.
PIECE, UNIT_BYTES = 1 << 16, 2 << 20
_BYTE = (np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(t: np.ndarray) -> np.ndarray:
    """Of the GRAM bytes from each place on: those of twice as many bytes from those of half as many."""

    def twice(h, k):
        out = (h[:-k] ^ (h[k:] * _M1)) * _M2
        out ^= out >> np.uint64(29)
        return out

    h2 = twice(_BYTE[t], 1)
    h8 = twice(twice(h2, 2), 4)
    h16 = twice(h8, 8)
    out = (h16[: len(t) - GRAM + 1] ^ (h8[16:] * _M1)) * _M2
    return out ^ (out >> np.uint64(31))


def sliding(best, h: np.ndarray, want: int) -> np.ndarray:
    """best (np.minimum or np.maximum) of each want consecutive numbers."""
    have = 1
    while 2 * have <= want:
        h = best(h[:-have], h[have:])
        have *= 2
    return h if have == want else best(h[: len(h) - (want - have)], h[want - have :])


def segments(texts: list[bytes], length: int):
    """For texts end to end: (place in the list, first byte, bytes, name, hash of the bytes, whether the name's gram is
    there more than once) of each run of windows of one name. A long text is taken in pieces; a run that a piece's end cuts is two segments."""
    flat: list[tuple[int, int, bytes]] = []
    for i, b in enumerate(texts):
        for a in range(0, len(b) - length + 1, PIECE):
            flat.append((i, a, b[a : a + PIECE + length - 1] if len(b) > PIECE else b))
    at = 0
    while at < len(flat):
        size, end = 0, at
        while end < len(flat) and (end == at or size + len(flat[end][2]) <= PIECE):
            size += len(flat[end][2])
            end += 1
        part = flat[at:end]
        at = end
        raw = b"".join(p[2] for p in part)
        t = np.frombuffer(raw, np.uint8)
        grams, wide = gram_hashes(t), length - GRAM + 1
        names = sliding(np.minimum, grams, wide)
        sizes = np.array([len(p[2]) for p in part])
        first = np.cumsum(sizes) - sizes
        change = np.zeros(len(names) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + sizes - length + 1, -1)
        inside = np.cumsum(change[:-1]) > 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | (names[1:] != names[:-1])
        begin[first] = True
        starts = np.flatnonzero(begin)
        stop = np.flatnonzero(inside & np.append(begin[1:] | ~inside[1:], True))
        owner = np.searchsorted(first, starts, "right") - 1
        # Places of grams that name a window; each belongs to one run, the first that ends late enough and has its name.
        pad = np.zeros(wide - 1, np.uint64)
        named = np.concatenate([pad, np.where(inside, names, 0), pad])
        places = np.flatnonzero(sliding(np.maximum, named, wide) == grams) if len(starts) else starts
        of, run_names = np.searchsorted(stop, places - (wide - 1)), names[starts]
        while len(wrong := np.flatnonzero(run_names[np.minimum(of, len(starts) - 1)] != grams[places]) if len(starts) else starts):
            of[wrong] += 1
        several = np.bincount(of, minlength=len(starts)) > 1
        for s, e, o, name, x in zip(starts.tolist(), stop.tolist(), owner.tolist(), run_names.view(np.int64).tolist(), several.tolist()):
            i, a, _ = part[o]
            yield i, a + s - int(first[o]), e - s + length, name, signed(xxhash.xxh3_64_intdigest(raw[s : e + length])), x


def covered(parts: list[bytes], counts: list[int], length: int) -> list[list[int]]:
    """For each of the different segments: begins and ends of the bytes in windows that occur again, flat."""
    sizes = np.array([len(p) for p in parts])
    first = np.cumsum(sizes + 1) - sizes - 1
    # No byte of UTF-8 is 0xFF, so all can be shifted up and 0 closes a segment.
    t = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)
    sa = suffix_array(t)
    before, lcp = permuted_lcp(t, sa)
    again = lcp >= length
    again[before[again]] = True
    out = []
    for f, n, c in zip(first.tolist(), sizes.tolist(), counts):
        if c > 1:
            out.append([0, n])
            continue
        hit = np.flatnonzero(again[f : f + n - length + 1])
        if not len(hit):
            out.append([])
            continue
        gap = np.flatnonzero(np.diff(hit) > length)
        begins, ends = np.append(hit[0], hit[gap + 1]), np.append(hit[gap], hit[-1]) + length
        out.append(np.stack([begins, ends], 1).ravel().tolist())
    return out


def merged(flat: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(flat[::2], flat[1::2])):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """docs with removed: array<struct<start, end>>, the bytes to remove, as maximal runs in order.

    A row is known by its key and its text, so rows that repeat both are judged alike (each is the other's copy). Null
    keys and null, empty or short texts are rows like any other; they have nothing to remove. Other columns are kept,
    one named removed is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("removed")
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))

    def cut(batches):
        for b in batches:
            keys, ths, texts = (b.column(i) for i in range(3))
            at, cols = [], [[], [], [], [], []]
            for i, *row in segments([(x or "").encode() for x in texts.to_pylist()], length):
                at.append(i)
                for c, v in zip(cols, row):
                    c.append(v)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(at), ths.take(at), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_())], names=["k", "th", "a", "n", "h", "g", "x"])

    found = written(slim.filter(F.octet_length("t") >= length).mapInArrow(cut, f"k {kind}, th long, a int, n int, h long, g long, x boolean"), "segments")
    several = found.groupBy("h").agg(F.count("*").alias("m"), F.max("x").alias("x")).filter("m > 1 OR x").select("h")
    again = written(found.drop("x").join(several, "h"), "repeated")
    discard(found)
    distinct = again.groupBy("h", "g").agg(F.count("*").alias("m"), F.min(F.struct("th", "k", "a", "n")).alias("r")).select("h", "g", "m", F.col("r.th").alias("th"), F.col("r.k").alias("k"), F.col("r.a").alias("a"), F.col("r.n").alias("n"))
    distinct = written(distinct, "distinct")
    answers = written(_sorted(slim, distinct, length), "covered")
    discard(distinct)
    # A segment's answer goes to all its places; blocks of one name may answer for one segment more than once.
    flat = again.join(answers, ["h", "g"]).select("k", "th", F.transform("spans", lambda x: x + F.col("a")).alias("s")).groupBy(F.col("k").alias("_k"), F.col("th").alias("_t")).agg(F.flatten(F.collect_list("s")).alias("_flat"))
    names = docs.columns
    both = docs.withColumn("_th", F.xxhash64(text)).join(flat, (F.col("_th") == F.col("_t")) & F.col(f"`{key}`").eqNullSafe(F.col("_k")), "left").select(*[F.col(f"`{c}`") for c in names], "_flat")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            rows = [[{"start": s, "end": e} for s, e in merged(x)] if x else [] for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(rows, span)], names=[*names, "removed"])

    return both.mapInArrow(run, ", ".join([*arrow_schema(docs, names), "removed array<struct<start:int,end:int>>"]))


def _sorted(slim: DataFrame, distinct: DataFrame, length: int) -> DataFrame:
    """h, g, spans of the distinct segments that have something covered."""
    total = distinct.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // UNIT_BYTES))
    big = distinct.groupBy("h").agg(F.sum("n").alias("size")).filter(F.col("size") > UNIT_BYTES).select("h", F.ceil(F.col("size") * 2 / UNIT_BYTES).cast("int").alias("nb"))
    block = F.pmod(F.xxhash64("g"), F.col("nb")).cast("int")
    several = F.transform(F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: j != block), lambda j: F.concat_ws("/", F.lit("b"), F.col("h"), F.least(block, j), F.greatest(block, j)))
    one = F.array(F.concat_ws("/", F.lit("s"), F.pmod(F.xxhash64("h"), F.lit(shards))))
    want = distinct.join(big, "h", "left").withColumn("units", F.when(F.col("nb").isNull(), one).otherwise(several)).drop("nb")
    wanted = want.groupBy(F.col("th").alias("wth"), F.col("k").alias("wk")).agg(F.collect_list(F.struct("h", "g", "m", "a", "n", "units")).alias("want"))
    texts = slim.join(wanted, (F.col("th") == F.col("wth")) & F.col("k").eqNullSafe(F.col("wk"))).select("t", "want")
    schema = pa.schema([("unit", pa.string()), ("h", pa.int64()), ("g", pa.int64()), ("m", pa.int64()), ("s", pa.binary())])

    def pieces(batches):
        for b in batches:
            rows, size = [], 0
            for t, want in zip(b.column(0), b.column(1)):
                raw = t.as_py().encode()
                for w in want.as_py():
                    for u in w["units"]:
                        rows.append((u, w["h"], w["g"], w["m"], raw[w["a"] : w["a"] + w["n"]]))
                        size += w["n"]
                if size > 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def sort(table: pa.Table) -> pa.Table:
        # A row that repeats another's key and text brings the same segments again.
        held = {(h, g): (m, s) for h, g, m, s in zip(*(table.column(c).to_pylist() for c in ("h", "g", "m", "s")))}
        ids = sorted(held)
        spans = covered([held[i][1] for i in ids], [held[i][0] for i in ids], length)
        kept = [(i, s) for i, s in zip(ids, spans) if s]
        return pa.table({"h": pa.array([i[0] for i, _ in kept], pa.int64()), "g": pa.array([i[1] for i, _ in kept], pa.int64()), "spans": pa.array([s for _, s in kept], pa.list_(pa.int32()))})

    return texts.mapInArrow(pieces, "unit string, h long, g long, m long, s binary").groupBy("unit").applyInArrow(sort, "h long, g long, spans array<int>")


def without(text: str | None, removed: list) -> bytes:
    raw, out, at = (text or "").encode(), [], 0
    for x in removed:
        out.append(raw[at : x["start"]])
        at = x["end"]
    return b"".join([*out, raw[at:]])


def op5(docs: DataFrame) -> DataFrame:
    found = repeats(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches):
        for b in batches:
            ids, texts, spans = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            sizes = [len((t or "").encode()) for t in texts]
            gone = [sum(x["end"] - x["start"] for x in s) for s in spans]
            sha = [hashlib.sha256(without(t, s)).hexdigest() for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
