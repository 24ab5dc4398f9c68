"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows (``window`` consecutive words) are sets of word shingles with places. All of a window must occur, so
of its shingles, ordered by how rare they are in the documents, one is a necessary prefix: the rarest (of |S| tokens
with containment t the prefix has |S| - ceil(t |S|) + 1, which is 1 at t = 1). A document is a candidate where it has
the prefix token; the token's place in the window gives the only place where the window can begin (positional bound),
the document must have room for the whole window there (length bound), and then the words are compared one by one.

Rarity is counted over all documents in a first pass. Items are handled in blocks of a bounded number of words: one
block is broadcast at a time, so a benchmark of any size is only more passes.
"""

from __future__ import annotations

from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bounded_batches

WINDOW, SHINGLE = 10, 3
#: Words of items in one block: bounds what is broadcast (about 100 bytes a word).
BLOCK_WORDS = 300_000
#: Words of a document looked at together; longer ones are taken in overlapping pieces.
PIECE = 400_000
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and whatever is not ASCII, A-Z in lower case; as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def shingle_keys(ids: np.ndarray, k: int) -> np.ndarray:
    """A number for each k consecutive word ids (1 and up)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ (ids[j : j + n].astype(np.uint64) * _MULT[j])) * _MULT[0]
        out ^= out >> np.uint64(29)
    return out


class Block:
    """Windows of some items by their distinct word sequences: vocabulary, windows with their items, shingles."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.ids: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, ws in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in ws]
            for i in range(max(1, len(ids) - window + 1)):
                windows.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.windows = sorted(windows)
        self.items = [sorted(windows[w] - {None}) for w in self.windows]
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.windows})
        self.shingles = {k: np.unique(np.concatenate([shingle_keys(np.array(w), k) for w in self.windows if min(SHINGLE, len(w)) == k])) for k in self.sizes}
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Sets each window's prefix token: its rarest shingle, of equally rare ones the smallest key, then the first."""
        self.prefix = {k: {} for k in self.sizes}
        for n, w in enumerate(self.windows):
            k = min(SHINGLE, len(w))
            keys = shingle_keys(np.array(w), k).tolist()
            _, key, at = min((counts.get((k, key), 0), key, at) for at, key in enumerate(keys))
            self.prefix[k].setdefault(key, []).append((n, at))
        self.tokens = {k: np.array(sorted(p), np.uint64) for k, p in self.prefix.items()}

    def pieces(self, ws: list[bytes]):
        """(first word, ids) of overlapping pieces; unknown words have the id 0."""
        get, step = self.ids.get, PIECE
        for a in range(0, max(1, len(ws)), step):
            part = ws[a : a + step + self.longest]
            yield a, np.fromiter(map(get, part, repeat(0)), np.int64, len(part))

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.windows), default=0)

    def known(self, ids: np.ndarray, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose shingle of k known words is among the sorted keys, and those shingles."""
        n = len(ids) - k + 1
        if n <= 0 or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = ids[:n] > 0
        for j in range(1, k):
            ok = ok & (ids[j : j + n] > 0)
        at = np.flatnonzero(ok)
        if not len(at):
            return at, np.zeros(0, np.uint64)
        found = shingle_keys(ids, k)[at]
        slot = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        hit = keys[slot] == found
        return at[hit], found[hit]

    def count(self, ws: list[bytes], counts: dict[tuple[int, int], int]) -> None:
        for a, ids in self.pieces(ws):
            for k in self.sizes:
                at, found = self.known(ids, k, self.shingles[k])
                if not len(at):
                    continue
                keys, n = np.unique(found[at < PIECE], return_counts=True)
                for key, c in zip(keys.tolist(), n.tolist()):
                    counts[k, key] = counts.get((k, key), 0) + c

    def find(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Places (first word, end) of all occurrences of windows, merged where they overlap or touch; their items."""
        spans, items = set(), set()
        for a, ids in self.pieces(ws):
            for k in self.sizes:
                at, found = self.known(ids, k, self.tokens[k])
                for p, key in zip(at.tolist(), found.tolist()):
                    for n, offset in self.prefix[k][key]:
                        w = self.windows[n]
                        s = p - offset
                        if s >= 0 and s + len(w) <= len(ids) and tuple(ids[s : s + len(w)].tolist()) == w:
                            spans.add((a + s, a + s + len(w)))
                            items.update(self.items[n])
        return merge(spans), items


def merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def blocks(items: DataFrame, window: int, item: str, text: str):
    """Items come to the driver one partition at a time; a block ends at BLOCK_WORDS words. Items without words
    have no windows; those with a null id have, but no id to be listed by. Rows with one id are windows of one item."""
    held, size = [], 0
    for r in items.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        if ws := words(r.t):
            held.append((r.i, ws))
            size += len(ws)
            if size >= BLOCK_WORDS:
                yield Block(held, window)
                held, size = [], 0
    if held:
        yield Block(held, window)


def _rarity(docs: DataFrame, text: str, block) -> dict[tuple[int, int], int]:
    def run(batches):
        counts: dict[tuple[int, int], int] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                block.value.count(words(t), counts)
        yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in counts], pa.int32()), "key": pa.array([np.uint64(x).astype(np.int64).item() for _, x in counts], pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = docs.select(text).mapInArrow(run, "k int, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n"))
    # No more rows than the block has shingles.
    return {(r.k, r.key % (1 << 64)): r.n for r in rows.collect()}


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds n_words (long), hits (array<struct<start, end>> of words, merged) and items (sorted array<string>).

    A null or empty text has no words and no hits. Repeated rows are judged alike. Other columns are kept, whatever
    their names but those of the outputs. Without items, or with items that have no words, nothing is hit.
    The windows of an item with a null id are hit like others; it is not in the list of items.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    added = {"n_words": "bigint", "hits": "array<struct<start:int,end:int>>", "items": "array<string>"}
    names = [c for c in docs.columns if c not in added]
    base = docs.select(*[F.col(f"`{n}`") for n in names])
    at = names.index(text)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def judged(df: DataFrame, block, first: bool) -> DataFrame:
        n = len(names)

        def run(batches):
            for b in batches:
                cols = [b.column(i) for i in range(n)]
                texts = b.column(at).to_pylist()
                split = [words(t) for t in texts]
                found = [block.value.find(ws) if block is not None else ([], set()) for ws in split]
                hits, names_ = [f[0] for f in found], [sorted(f[1]) for f in found]
                if not first:
                    hits = [merge([(x["start"], x["end"]) for x in old] + new) for old, new in zip(b.column(n + 1).to_pylist(), hits)]
                    names_ = [sorted({*old, *new}) for old, new in zip(b.column(n + 2).to_pylist(), names_)]
                rows = [[{"start": s, "end": e} for s, e in h] for h in hits]
                cols += [pa.array([len(ws) for ws in split], pa.int64()), pa.array(rows, span), pa.array(names_, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *added])

        return df.mapInArrow(run, ", ".join([*arrow_schema(docs, names), *(f"{k} {v}" for k, v in added.items())]))

    out = None
    for block in blocks(items, window, item, item_text):
        counting = spark.sparkContext.broadcast(block)
        block.order(_rarity(base, text, counting))
        counting.unpersist()
        out = judged(base if out is None else out, spark.sparkContext.broadcast(block), out is None)
    return judged(base, None, True) if out is None else out


def n_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))


def op1(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = decontaminate(docs.select("doc_id", "text"), items)
    return out.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
