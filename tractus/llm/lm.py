"""Language-model scores from a hierarchical Pitman-Yor model of words.

The model is a hierarchy of Chinese restaurants. Every training token sits in the restaurant of its preceding word (the
end of a text, before the first one). All these share one parent, the restaurant of the shortened, empty context, whose
customers are their tables; its base spells words byte by byte.

Seating is sampled by Gibbs. Two auxiliary draws make a sweep a set of independent steps: a gamma variate g of shape
s / d + T stands for the concentration of a restaurant with T tables, and a draw of the parent's measure stands for its
seating. Given these the dishes of all restaurants are independent: a dish has the rate d * g * (parent's probability),
and its tables are moved by seating.moved(). Then the parent's customers follow from the tables, and it is seated alike.
Scores average the predictive probabilities of several samples, P(w | u) = (c - d t + (s + d T) P(w)) / (s + C).

Distribution. Texts are coded in buckets; a bucket has its distinct words and pairs with counts. Words are dealt to parts
by ranges of their hash, pairs to shards by a hash of context and word, in which the word is reduced so that a context
spreads over a number of shards that grows with all shards: a context that follows a third of all tokens fills none.
A pair that occurs once has one table whatever the seating, so sweeps move only pairs that repeat; the others enter as
sums for each word. In a sweep each shard sends its tables' sums for its words to their parts, and gets the words'
draws back in the same order. All of it are packed arrays in tables of the shared folder, written once for each sweep;
only a few sums reach the driver. Random numbers are hashes of words and pairs, so scores do not depend on partitions.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, arrow_schema, bounded_batches, bucket_count, discard, released, text_bytes, written
from .langid import held_out
from .seating import gamma, keyed, mixed, moved

#: The end of a text as a dish. No word contains a space.
END_TOKEN = b" "
#: Sweeps before the first sample, and samples that are averaged.
BURN_IN, SAMPLES = 2, 3
DISCOUNT, STRENGTH = 0.7, 1.0
#: Bytes of text to a shard of pairs, to a part of the words, and to a bucket; bytes that are split into words together.
SHARD_BYTES, PART_BYTES, BUCKET_BYTES, PIECE = 16 << 20, 32 << 20, 16 << 20, 4 << 20
#: Packed arrays are stored in pieces of this size, so that nothing on the way holds large values.
BLOB = 192 << 10
#: Shards and buckets are taken in so many turns, so that no more than that share of coded texts is in shuffle files at once.
TURNS = 6
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
STOP = 256


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case, without the end; as UTF-8, where bytes.split() parts at the same six characters."""
    return [w for part in pieces(text) for w in part.split()] if text else []


def pieces(text: str):
    """A text as bytes whose words are parted by spaces, in pieces of bounded size; a word is never cut."""
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    at = 0
    while at < len(raw):
        stop = raw.find(b" ", at + PIECE)
        stop = len(raw) if stop < 0 else stop
        yield raw[at:stop]
        at = stop


def worded(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words parted by spaces: their bytes end to end, their lengths, and where they begin in raw."""
    a = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], a != 0x20, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return a[inside[1:-1]], (edges[1::2] - edges[::2]).astype(np.int32), edges[::2]


# ---- packed arrays ----------------------------------------------------------


def packed(*arrays) -> bytes:
    """Arrays as bytes, their bytes grouped by significance so that small numbers compress; bytes stay as they are."""
    rows = [a if isinstance(a, bytes) else (a.dtype.str, len(a), _planes(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T)) for a in arrays]
    return zstandard.compress(pickle.dumps(rows), 1)


def _planes(x: np.ndarray) -> bytes:
    """x.tobytes(), row by row."""
    out = np.empty(x.shape, np.uint8)
    for i in range(len(x)):
        out[i] = x[i]
    return out.tobytes()


def unpacked(blob: bytes) -> list:
    out = []
    for row in pickle.loads(zstandard.decompress(blob)):
        if not isinstance(row, bytes):
            kind, n, raw = row
            kind = np.dtype(kind)
            row = np.empty((n, kind.itemsize), np.uint8)
            for i, plane in enumerate(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n)):
                row[:, i] = plane
            row = row.view(kind).reshape(n)
        out.append(row)
    return out


def steps(h: np.ndarray) -> np.ndarray:
    """Of sorted hashes, and back by summed()."""
    return np.diff(h, prepend=np.uint64(0))


def summed(h: np.ndarray) -> np.ndarray:
    return np.cumsum(h, dtype=np.uint64)


def parts_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the hash, so that sorted words are sorted by part."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def shards_of(u: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    spread = np.uint64(max(8, shards // 4))
    return (mixed(u ^ mixed(w % spread)) % np.uint64(shards)).astype(np.int64)


def runs(ids: np.ndarray):
    """(id, begin, end) of sorted ids."""
    cuts = np.flatnonzero(np.diff(ids, prepend=-1))
    return zip(ids[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(ids)])


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


# ---- coded texts ------------------------------------------------------------

#: Kinds of rows. id: the bucket, part or shard that a row is for; src: where it comes from.
DOCS, WORDS, PAIRS, STATE, ASK, ONCE, SUMS, CODES, SPELT = range(9)
_SCHEMA = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("src", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("piece", pa.int32()), ("blob", pa.binary())])
_DDL = "kind int, id long, src long, a double, b double, piece int, blob binary"


def _batches(rows):
    """Rows as batches of bounded size, their blobs in pieces."""
    held, size = [], 0
    for kind, to, src, a, b, blob in rows:
        for i in range(0, max(1, len(blob or b"")), BLOB):
            held.append((kind, to, src, a, b, i // BLOB, blob and blob[i : i + BLOB]))
            size += len(held[-1][-1] or b"")
            if size >= 4 * BLOB:
                yield _batch(held)
                held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _rows(rows: list[tuple]) -> pa.Table:
    out = pa.Table.from_batches(list(_batches(rows)), schema=_SCHEMA)
    released()
    return out


def _read(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """(kind, src, blob) of a group's rows, in that order, with their blobs whole again."""
    columns = (table.column(c).to_pylist() for c in ("kind", "src", "piece", "blob"))
    out: list[tuple[int, int, list[bytes]]] = []
    for kind, src, piece, blob in sorted(zip(*columns), key=lambda r: r[:3]):
        if piece == 0 or not out:
            out.append((kind, src, []))
        out[-1][2].append(blob)
    return [(kind, src, b"".join(x)) for kind, src, x in out]


def _row(kind: int, to: int, src: int, blob: bytes | None, a: float = 0.0, b: float = 0.0) -> tuple:
    return kind, to, src, a, b, blob


class Bucket:
    """Texts that are coded together: word ids of all tokens end to end, ends included."""

    def __init__(self):
        self.raw, self.learn, self.bytes, self.carried = [], [], 0, []
        self.held, self.begins, self.room = [], [], 0

    def add(self, text: str | None, learn: bool) -> None:
        for k, raw in enumerate(pieces(text) if text else [b""]):
            if self.held and self.room + len(raw) > PIECE:
                self._flush()
            if k == 0:
                self.begins.append(self.room)
            self.held.append(raw)
            self.room += len(raw) + 1
        self.learn.append(bool(learn))
        self.bytes += len(text or "")

    def _flush(self) -> None:
        """What is held goes to raw: bytes of words, their lengths, and how many words of it come before each text that begins here."""
        what, sizes, at = worded(b" ".join(self.held))
        self.raw.append((what, sizes, np.searchsorted(at, np.array(self.begins, np.int64))))
        self.held, self.begins, self.room = [], [], 0

    def _words(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Different words (the end first), their ids in all texts, ends included, and the number of tokens of each text."""
        self._flush()
        lengths = np.concatenate([r[1] for r in self.raw])
        before = np.cumsum([0, *[len(r[1]) for r in self.raw]])
        first = np.concatenate([r[2] + n for r, n in zip(self.raw, before)])
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        whole = np.concatenate([r[0] for r in self.raw])
        self.raw = []
        found = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(whole)]).dictionary_encode()
        del offsets, whole
        w = np.insert(found.indices.to_numpy(zero_copy_only=False).astype(np.int32) + np.int32(1), np.append(first[1:], len(lengths)), 0)
        return [END_TOKEN, *found.dictionary.to_pylist()], w, np.diff(np.append(first, len(lengths))) + 1

    def rows(self, b: int, shards: int, parts: int):
        words, w, sizes = self._words()
        h = hashes(words)
        order = np.argsort(h)
        rank = np.empty(len(h), np.int32)
        rank[order] = np.arange(len(h), dtype=np.int32)
        h = h[order]
        w = rank[w]
        learn = np.repeat(np.array(self.learn), sizes)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.carried[0].schema) as out:
            for x in self.carried:
                out.write_batch(x)
        yield _row(DOCS, b, -1, packed(w, sizes, sink.getvalue().to_pybytes()))
        count = np.bincount(w[learn], minlength=len(h))
        for p, i, j in runs(parts_of(h, parts)):
            own = b"\n".join([b"" if words[k] == END_TOKEN else words[k] for k in order[i:j].tolist()])
            yield _row(WORDS, p, b, packed(steps(h[i:j])))
            yield _row(SPELT, p, b, packed(count[i:j], own))
        pairs, at = _pairs(w, h, shards)
        count = np.bincount(at[learn], minlength=len(pairs[0]))
        u, w, shard = pairs
        for s, i, j in runs(shard):
            us, n = np.unique(u[i:j], return_counts=True)
            ws, wi = np.unique(w[i:j], return_inverse=True)
            yield _row(PAIRS, s, b, packed(steps(h[us]), n.astype(np.int32), steps(h[ws]), wi.astype(np.int32), count[i:j]))


def _pairs(w: np.ndarray, h: np.ndarray, shards: int):
    """Distinct pairs (context, word, shard) of texts end to end, by shard, and the place of each token's pair among them.
    The context of a text's first token is the end of the text before it: all ends are one word."""
    u = np.concatenate([w[-1:], w[:-1]]).astype(np.int64)
    key = u * len(h) + w
    bits = len(key).bit_length()
    if 2 * len(h).bit_length() + bits < 64:  # places sorted with their keys are an order
        key = np.sort((key << bits) | np.arange(len(key)))
        order, key = key & ((1 << bits) - 1), key >> bits
    else:
        order = np.argsort(key)
        key = key[order]
    first = np.diff(key, prepend=-1) != 0
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(first) - 1
    key = key[first]
    u, w = key // len(h), key % len(h)
    shard = shards_of(h[u], h[w], shards)
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return (u[order], w[order], shard[order]), place[at]


class Coded:
    """Texts in the shared folder as packed buckets."""

    def __init__(self, table: DataFrame, shards: int, parts: int, names: list[str], ddl: list[str]):
        self.table, self.shards, self.parts, self.names, self.ddl = table, shards, parts, names, ddl

    def of(self, kind: int) -> DataFrame:
        return self.table.filter(F.col("kind") == kind).select(*_SCHEMA.names)

    def turns(self) -> list[DataFrame]:
        """The coded pairs, by turns of their shards."""
        return [self.of(PAIRS).filter(F.col("id") % TURNS == i) for i in range(TURNS)]


def coded(docs: DataFrame, text: str = "text", train: str | None = None, keep: list[str] | None = None, like: Model | None = None) -> Coded:
    """train: a boolean column, the texts to learn from (none by default); keep: columns that score() gives back, by
    default all; like: a model whose shards and parts are to be used."""
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    size = text_bytes(docs, text)
    shards, parts = (like.shards, like.parts) if like else (bucket_count(size, SHARD_BYTES), bucket_count(size, PART_BYTES))
    n = len(keep)

    def run(batches):
        first, made, bucket = TaskContext.get().partitionId() << 32, 0, Bucket()
        for batch in batches:
            left = pa.RecordBatch.from_arrays(batch.columns[:n], names=[str(i) for i in range(n)])
            begin = 0
            for i, (t, learn) in enumerate(zip(batch.column(n), batch.column(n + 1).to_pylist()), 1):
                bucket.add(t.as_py(), learn)
                if bucket.bytes > BUCKET_BYTES or i == batch.num_rows:
                    bucket.carried.append(left.slice(begin, i - begin))
                    begin = i
                if bucket.bytes > BUCKET_BYTES:
                    yield from _batches(bucket.rows(first + made, shards, parts))
                    bucket, made = Bucket(), made + 1
                    released()
        if bucket.learn:
            yield from _batches(bucket.rows(first + made, shards, parts))

    learn = F.coalesce(F.col(f"`{train}`"), F.lit(False)) if train else F.lit(False)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"), learn.alias("_learn"))
    renamed = rows.toDF(*[f"_{i}" for i in range(n + 2)])
    return Coded(written(renamed.mapInArrow(run, _DDL), "lm-coded", **PACKED), shards, parts, list(keep), arrow_schema(docs, keep))


# ---- the base: spelling -----------------------------------------------------


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (two bytes of context, symbol: context << 9 | symbol) of all words end to end, and where each word begins.
    Contexts before a word are spaces; the end of a text spells nothing but the stop."""
    raw = [b"" if w == END_TOKEN else w for w in words]
    b = np.frombuffer(b"".join([b"  %s " % r for r in raw]), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    first = np.concatenate([[0], np.cumsum(size + 3)[:-1]]) if len(raw) else np.zeros(0, np.int64)
    symbol = b.copy()
    if len(raw):
        symbol[first + size + 2] = STOP
    keep = np.ones(len(b), bool)
    keep[first] = keep[first + 1] = False
    at = np.flatnonzero(keep)
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(raw) else first
    return (b[at - 2] << 17) | (b[at - 1] << 9) | symbol[at], starts


def _spellings(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of the words and their counts."""
    codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(words), 20_000):
        more, m = np.unique(spelled(words[a : a + 20_000])[0], return_counts=True)
        codes, inv = np.unique(np.concatenate([codes, more]), return_inverse=True)
        n = np.bincount(inv, np.concatenate([n, m])).astype(np.int64)
    return codes, n


class Spelling:
    """Probabilities of words from those of their bytes after two, one and no bytes; each backs off to the next in
    proportion to the number of different symbols seen after the context, and the last one to all symbols alike.
    codes, counts: how often the different words of the training texts have them."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        symbols = STOP + 1
        table = np.full((1, symbols), 1 / symbols)
        self.index = np.zeros(1 << 16, np.int32)
        for bits in (0, 8, 16):
            key = ((codes >> 9) & ((1 << bits) - 1)) * 512 + (codes & 511)
            keys, inv = np.unique(key, return_inverse=True)
            n = np.bincount(inv, counts, len(keys)) if len(keys) else np.zeros(0)
            contexts, row = np.unique(keys >> 9, return_inverse=True)
            total, kinds = np.bincount(row, n, len(contexts)), np.bincount(row, minlength=len(contexts))
            above = np.zeros(len(contexts), np.int64) if bits == 0 else self.index[contexts & ((1 << (bits - 8)) - 1)]
            rows = table[above] * (kinds / (total + kinds))[:, None]
            np.add.at(rows, (row, keys & 511), n / (total + kinds)[row])
            low = np.arange(1 << 16) & ((1 << bits) - 1)
            where = np.full(1 << bits, -1)
            where[contexts] = len(table) + np.arange(len(contexts))
            self.index = np.where(where[low] >= 0, where[low], self.index).astype(np.int32)
            table = np.concatenate([table, rows])
        self.logs = np.log(table).astype(np.float32)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Of whole words, natural logarithms."""
        out = np.zeros(len(words))
        for a in range(0, len(words), 20_000):
            codes, starts = spelled(words[a : a + 20_000])
            out[a : a + len(starts)] = np.add.reduceat(self.logs[self.index[codes >> 9], codes & 511].astype(np.float64), starts)
        return out


def _spelling(table: DataFrame) -> Spelling:
    """CODES rows, blocks of 2 ** 18 codes, are added up before they reach the driver: at most 256 * 256 * 257 sums."""

    def add(rows: pa.Table) -> pa.Table:
        found = [unpacked(x) for _, _, x in _read(rows)]
        codes, inv = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        counts = np.bincount(inv, np.concatenate([f[1] for f in found]))
        return pa.table({"blob": pa.array([packed(codes, counts)], pa.binary())})

    found = [unpacked(r.blob) for r in table.filter(F.col("kind") == CODES).groupBy("id").applyInArrow(add, "blob binary").collect()]
    codes, counts = (np.concatenate([*[f[i] for f in found], np.zeros(0)]) for i in range(2))
    order = np.argsort(codes)
    return Spelling(codes[order].astype(np.int64), counts[order])


# ---- learning ---------------------------------------------------------------


def _decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    us, n, ws, wi, c = unpacked(blob)
    return np.repeat(summed(us), n), summed(ws)[wi], c


def counted(blobs: list[bytes]):
    """Pairs of a shard: distinct ones of the training texts (context, word, count), and for each blob the places of its
    pairs among them (-1: not in training texts)."""
    found = [_decoded(x) for x in blobs]
    u, w, c = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((w, u))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(u[order]) != 0) | (np.diff(w[order]) != 0)
    c = np.add.reduceat(c[order], np.flatnonzero(first)) if len(order) else c
    known = np.where(c > 0, np.cumsum(c > 0) - 1, -1)
    at = np.empty(len(order), np.int64)
    at[order] = known[np.cumsum(first) - 1]
    keep = order[first][c > 0]
    return (u[keep], w[keep], c[c > 0]), np.split(at, np.cumsum([len(f[0]) for f in found])[:-1])


def _by_count(c: np.ndarray) -> np.ndarray:
    """Order of the repeated pairs in a shard's state: the most frequent first, so that seating finds them sorted."""
    return np.argsort(-c[c > 1], kind="stable")


def _tally(at: np.ndarray, size: int, weights=None) -> np.ndarray:
    return np.bincount(at, weights, size).astype(np.int64)


def _shard(parts: int):
    """PAIRS of a shard -> its STATE, what it ASKs of the parts, and sums over pairs that occur ONCE."""

    def build(table: pa.Table) -> pa.Table:
        s = table.column("id")[0].as_py()
        (u, w, c), _ = counted([blob for _, _, blob in _read(table)])
        more = c > 1
        out = [_row(SUMS, -1, s, None, float((~more).sum()), float((c == 2).sum()))]
        own = np.unique(np.concatenate([u[more], w[more]]))
        ui, wi = np.searchsorted(own, u[more]).astype(np.int32), np.searchsorted(own, w[more]).astype(np.int32)
        n, order = len(ui), _by_count(c)
        ui, wi = ui[order], wi[order]
        out.append(_row(STATE, s, -1, packed(steps(own), ui, wi, c[more][order].astype(np.int32), np.zeros(n, np.float32), np.zeros(n, np.int16), np.ones(n, np.int32))))
        for p, i, j in runs(parts_of(own, parts)):
            out.append(_row(ASK, p, s, packed(steps(own[i:j]), _tally(wi, len(own))[i:j], _tally(ui, len(own))[i:j])))
        own = np.unique(np.concatenate([u[~more], w[~more]]))
        ends, begins = _tally(np.searchsorted(own, w[~more]), len(own)), _tally(np.searchsorted(own, u[~more]), len(own))
        for p, i, j in runs(parts_of(own, parts)):
            out.append(_row(ONCE, p, s, packed(steps(own[i:j]), ends[i:j], begins[i:j])))
        return _rows(out)

    return build


def _part(table: pa.Table) -> pa.Table:
    """WORDS of a part, as they are SPELT, -> its STATE before the first sweep, and CODES of the different words of training texts."""
    p = table.column("id")[0].as_py()
    rows = _read(table)  # by kind and bucket: hashes, then counts and spellings of the same words
    h = np.concatenate([summed(unpacked(x)[0]) for k, _, x in rows if k == WORDS])
    found = [unpacked(x) for k, _, x in rows if k == SPELT]
    c = np.concatenate([f[0] for f in found])
    words = [w for f in found for w in f[1].split(b"\n")]
    h, first, at = np.unique(h, return_index=True, return_inverse=True)
    c, words = _tally(at, len(h), c), [words[i] for i in first.tolist()]
    codes, n = _spellings([w or END_TOKEN for w, k in zip(words, c.tolist()) if k])
    out = [_row(STATE, p, -1, packed(steps(h), c, b"\n".join(words))), _row(SUMS, -1, p, None, float(c.sum()), float((c > 0).sum()))]
    out += [_row(CODES, k, p, packed(codes[i:j], n[i:j])) for k, i, j in runs(codes >> 18)]
    return _rows(out)


class _Part:
    """State of a part while it learns. Arrays follow the words' hashes; asked: for each shard the places of its words."""

    NAMES = ("h", "c", "log_base", "ends", "begins", "x", "k", "asked", "shards", "sizes")

    def __init__(self, values, samples):
        self.__dict__.update(zip(self.NAMES, values))
        self.h, self.samples = summed(self.h), samples

    @classmethod
    def first(cls, state: bytes, spelling: Spelling, rows) -> _Part:
        h, c, words = unpacked(state)
        n = len(h)
        log_base = spelling.log_probabilities([w or END_TOKEN for w in words.split(b"\n")]).astype(np.float32)
        own = summed(h)
        ends, begins, asked = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        for kind, src, blob in rows:
            if kind == ONCE:
                what, e, b = unpacked(blob)
                at = np.searchsorted(own, summed(what))
                ends[at] += e
                begins[at] += b
            if kind == ASK:
                asked.append((src, np.searchsorted(own, summed(unpacked(blob)[0])).astype(np.int32)))
        asked.sort(key=lambda r: r[0])
        places = np.concatenate([*[a for _, a in asked], np.zeros(0, np.int32)])
        return cls([h, c, log_base, ends, begins, np.zeros(n, np.float32), np.zeros(n, np.int16), places, np.array([s for s, _ in asked], np.int64), np.array([len(a) for _, a in asked], np.int64)], [])

    def blob(self) -> bytes:
        values = [steps(self.h) if n == "h" else getattr(self, n) for n in self.NAMES]
        return packed(*values, *[a for s in self.samples for a in s])

    @classmethod
    def read(cls, blob: bytes) -> _Part:
        values = unpacked(blob)
        n = len(cls.NAMES)
        return cls(values[:n], [tuple(values[i : i + 2]) for i in range(n, len(values), 2)])

    def sweep(self, messages: dict[int, list[np.ndarray]], g: float, d: float, sweep: int, kept: bool):
        """messages: for each shard the sums of tables by word and by context. Gives rows for the shards."""
        n, tables = self.ends.copy(), self.begins.copy()
        places = dict(zip(self.shards.tolist(), np.split(self.asked, np.cumsum(self.sizes)[:-1])))
        for s, (by_word, by_context) in messages.items():
            np.add.at(n, places[s], by_word)
            np.add.at(tables, places[s], by_context)
        rate = d * g * np.exp(np.maximum(self.log_base.astype(np.float64), -80.0))
        _, t, self.x, self.k = moved(n, self.x, self.k, rate, keyed(self.h, 1), sweep, d)
        t = np.where(n > 0, t, 0)
        if kept:
            self.samples.append(((n - d * t).astype(np.float32), tables))
        return n, t, tables, places


def _words_pass(spelling, g: float, outer: float, inner: float, sweep: int, kept: bool):
    """A part's rows -> its next STATE, draws for the shards (ASK), and SUMS."""

    def run(table: pa.Table) -> pa.Table:
        p = table.column("id")[0].as_py()
        rows = _read(table)
        state = next(b for k, _, b in rows if k == STATE)
        part = _Part.first(state, spelling.value, rows) if sweep == 1 else _Part.read(state)
        n, t, tables, places = part.sweep({s: unpacked(b)[-2:] for k, s, b in rows if k == ASK}, g, outer, sweep, kept)
        seed = keyed(part.h, sweep + 1000)
        draw = gamma(n - outer * t, keyed(seed, 1))
        concentration = inner * gamma(np.where(part.c > 0, STRENGTH / inner + tables, 0), keyed(seed, 2))
        out = [_row(STATE, p, -1, part.blob()), _row(SUMS, -1, p, None, float(draw.sum()), float(t.sum())), _row(SUMS, -2, p, None, float(n.sum()), 0.0)]
        for s, at in places.items():
            base = [part.log_base[at]] if sweep == 1 else []
            out.append(_row(ASK, s, p, packed(draw[at].astype(np.float32), concentration[at].astype(np.float32), *base)))
        return _rows(out)

    return run


def _pairs_pass(own_share: float, total: float, inner: float, sweep: int, kept: bool, parts: int):
    """A shard's rows -> its next STATE and sums of its tables for the parts (ASK). own_share: what the draw of the
    parent's measure leaves to the base; total: all of the draw."""

    def run(table: pa.Table) -> pa.Table:
        s = table.column("id")[0].as_py()
        rows = _read(table)
        own, ui, wi, c, x, k, t, *more = unpacked(next(b for kind, _, b in rows if kind == STATE))
        told = [unpacked(b) for kind, _, b in rows if kind == ASK]
        draw, concentration = (np.concatenate([*[a[i] for a in told], np.zeros(0, np.float32)]).astype(np.float64) for i in range(2))
        log_base = np.concatenate([*[a[2] for a in told], np.zeros(0, np.float32)]) if sweep == 1 else more.pop(0)
        h = summed(own)
        p = (draw + own_share * np.exp(np.maximum(log_base.astype(np.float64), -80.0))) / total
        rate = np.maximum(concentration[ui] * p[wi], 1e-30)
        before, t, x, k = moved(c, x, k, rate, mixed(h[ui] ^ mixed(h[wi])), sweep, inner)
        if kept:
            more.append(before.astype(np.int32))
        t = t.astype(np.int32)
        out = [_row(STATE, s, -1, packed(own, ui, wi, c, x, k, t, log_base, *more))]
        by_word, by_context = _tally(wi, len(h), t), _tally(ui, len(h), t)
        out += [_row(ASK, q, s, packed(by_word[i:j], by_context[i:j])) for q, i, j in runs(parts_of(h, parts))]
        return _rows(out)

    return run


def _all(tables: list[DataFrame]) -> DataFrame:
    """Written tables as one."""
    out = reduce(DataFrame.unionByName, tables)
    out._written_to = [t._written_to for t in tables]
    return out


def _of(table: DataFrame, *kinds: int) -> DataFrame:
    return table.filter(F.col("kind").isin(*kinds)).select(*_SCHEMA.names)


def _sums(table: DataFrame, to: int = -1) -> tuple[float, float]:
    """Added up as decimals, so that their order does not count."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,9)"))
    return tuple(float(x or 0) for x in table.filter((F.col("kind") == SUMS) & (F.col("id") == to)).agg(exact("a"), exact("b")).first())


def _discount(once: float, twice: float) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else DISCOUNT


class Model:
    """words, pairs: last states of parts and shards; coded: the coded training texts; n, v: tokens and different tokens
    of these; inner, outer: discounts of contexts and of words; outside: for each sample what the words' restaurant gives
    to its base and its customers, both with the strength."""

    def __init__(self, coded: Coded, words: DataFrame, pairs: DataFrame, n: int, v: int, inner: float, outer: float, outside: list):
        self.coded, self.words, self.pairs, self.n, self.v = coded, words, pairs, n, v
        self.inner, self.outer, self.outside, self.shards, self.parts = inner, outer, outside, coded.shards, coded.parts


def fit(texts: Coded, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """Learns from the coded texts that are marked to learn from; every word of the others gets a probability too.

    A null or empty text has only its end. Without training texts all words have the spelling base's probabilities.
    """
    spark = texts.table.sparkSession
    pairs = _all([written(x.groupBy("id").applyInArrow(_shard(texts.parts), _DDL), "lm-pairs", **PACKED) for x in texts.turns()])
    words = written(_of(texts.table, WORDS, SPELT).groupBy("id").applyInArrow(_part, _DDL), "lm-words", **PACKED)
    n, v = _sums(words)
    inner = outer = _discount(*_sums(pairs))
    spelling = spark.sparkContext.broadcast(_spelling(words))  # at most 65 793 rows of 257 numbers
    tables, outside = v, []
    for sweep in range(1, burn_in + samples + 1):
        kept, rng = sweep > burn_in, np.random.default_rng(sweep)
        g = rng.gamma(STRENGTH / outer + tables)
        rows = _of(words, STATE).unionByName(_of(pairs, ASK, ONCE))
        old, words = words, written(rows.groupBy("id").applyInArrow(_words_pass(spelling, g, outer, inner, sweep, kept), _DDL), "lm-words", **PACKED)
        discard(old)
        (drawn, tables), (customers, _) = _sums(words), _sums(words, -2)
        if kept:
            outside.append((STRENGTH + outer * tables, STRENGTH + customers))
        if sweep < burn_in + samples:
            share = rng.gamma(STRENGTH + outer * tables)
            rows = _of(pairs, STATE).unionByName(_of(words, ASK))
            old, pairs = pairs, written(rows.groupBy("id").applyInArrow(_pairs_pass(share, drawn + share, inner, sweep, kept, texts.parts), _DDL), "lm-pairs", **PACKED)
            discard(old)
    spelling.unpersist()
    return Model(texts, words, pairs, int(n), int(v), inner, outer, outside)


#: Logarithms of probabilities below which sums are taken in logarithms.
DEEP = -600.0


# ---- scores -----------------------------------------------------------------


def _word_answers(outside: list):
    """STATE of a part and WORDS of buckets -> for each bucket count, log probability in each sample, and its
    restaurant's tables in each sample, of its words."""

    def run(table: pa.Table) -> pa.Table:
        p = table.column("id")[0].as_py()
        rows = _read(table)
        part = _Part.read(next(b for k, _, b in rows if k == STATE))
        far, logs = part.log_base.astype(np.float64), []
        base, deep = np.exp(far), np.flatnonzero(far < DEEP)
        for (a, _), (s, z) in zip(part.samples, outside):
            with np.errstate(divide="ignore"):
                logs.append(np.log((a.astype(np.float64) + s * base) / z).astype(np.float32))
            # Without customers only the base is left; its logarithm stands where the number itself is too small.
            alone = deep[a[deep] == 0]
            logs[-1][alone] = np.log(s / z) + far[alone]
        out = []
        for k, b, blob in rows:
            if k == WORDS and b >= 0:
                at = np.searchsorted(part.h, summed(unpacked(blob)[0]))
                out.append(_row(WORDS, b, p, packed(part.c[at], *[x[at] for x in logs], *[t[at] for _, t in part.samples])))
        return _rows(out)

    return run


def _pair_answers(samples: int):
    """STATE of a shard and PAIRS of buckets -> for each bucket the counts of its pairs, and the tables in each sample of
    those that repeat."""

    def run(table: pa.Table) -> pa.Table:
        s = table.column("id")[0].as_py()
        rows = _read(table)
        asked = [(b, blob) for k, b, blob in rows if k == PAIRS]
        (_, _, c), places = counted([blob for _, blob in asked])
        state = [unpacked(b) for k, _, b in rows if k == STATE]
        tables = [state[0][6]] if state else [np.zeros(0, np.int32)] * samples
        if state and samples > 1:
            tables = [*state[0][-(samples - 1) :], *tables]
        order, repeated = _by_count(c), np.zeros(len(c) + 1, np.int64)
        repeated[np.flatnonzero(c > 1)[order]] = np.arange(len(order))
        c = np.append(c, 0)
        out = []
        for (b, _), at in zip(asked, places):
            if b >= 0:
                more = repeated[at[c[at] > 1]]
                out.append(_row(PAIRS, b, s, packed(c[at], *[t[more] for t in tables])))
        return _rows(out)

    return run


_ADDED = pa.schema([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(texts: Coded, model: Model, last: bool = False) -> DataFrame:
    """The kept columns with n_tokens, n_known, base_score and score (log10 probabilities of the text, its end included),
    one row for each text; kept columns of these names are replaced. Texts may be those that the model learned from, or
    others that were coded like it. Rows are independent of each other.

    last: neither the texts nor the model are used again, and their tables are deleted as soon as they can be.

    A bucket's words and pairs are answered by their parts and shards in the bucket's own order, and its texts added up.
    """
    shards, n, v, inner, samples = model.shards, model.n, model.v, model.inner, len(model.outside)
    asked, turns = texts.of(WORDS), texts.turns()
    if texts is not model.coded:  # what was learned is counted again, without an answer
        turns = [x.unionByName(y.withColumn("src", F.lit(-1).cast("long"))) for x, y in zip(turns, model.coded.turns())]
    words = written(asked.unionByName(_of(model.words, STATE)).groupBy("id").applyInArrow(_word_answers(model.outside), _DDL), "lm-answers", **PACKED)
    if last:
        discard(model.words)
    states = [_of(model.pairs, STATE).filter(F.col("id") % TURNS == i) for i in range(TURNS)]
    pairs = _all([written(x.unionByName(y).groupBy("id").applyInArrow(_pair_answers(samples), _DDL), "lm-answers", **PACKED) for x, y in zip(turns, states)])
    if last:
        discard(model.pairs)
    keep = [i for i, c in enumerate(texts.names) if c not in _ADDED.names]
    names, ddl = [texts.names[i] for i in keep], [texts.ddl[i] for i in keep]

    def tell(table: pa.Table) -> pa.Table:
        rows = _read(table)
        w, sizes, carried = unpacked(rows[0][2])
        told = [unpacked(b) for k, _, b in rows if k == WORDS]
        c, *rest = (np.concatenate(x) for x in zip(*told))
        logs, tables = rest[:samples], rest[samples:]
        told = [unpacked(b) for k, _, b in rows if k == PAIRS]
        pair_c, *pair_t = (np.concatenate(x) for x in zip(*told))
        h = _hashes_of(rows)
        (u, word, _), at = _pairs(w, h, shards)
        p, more = np.zeros(len(u)), pair_c > 1
        for k in range(samples):
            t = np.minimum(pair_c, 1).astype(np.float64)
            t[more] = pair_t[k]
            p += (pair_c - inner * t + (STRENGTH + inner * tables[k][u]) * np.exp(logs[k].astype(np.float64)[word])) / (STRENGTH + c[u])
        starts = np.cumsum(sizes) - sizes
        total = lambda x: np.add.reduceat(x, starts)
        out = pa.ipc.open_stream(carried).read_all()
        columns = [out.column(i) for i in keep]
        columns += [pa.array(sizes, pa.int64()), pa.array(total((c[w] > 0).astype(np.int64)), pa.int64())]
        with np.errstate(divide="ignore"):
            log_p = np.log10(p / samples)
        # Pairs without customers whose word is too unlikely for a number: the same sum in logarithms.
        low = np.max(logs, axis=0) < DEEP
        deep = np.flatnonzero((pair_c == 0) & low[word]) if low.any() else ()
        if len(deep):
            each = [np.log(STRENGTH + inner * tables[k][u[deep]]) + logs[k].astype(np.float64)[word[deep]] for k in range(samples)]
            log_p[deep] = (np.logaddexp.reduce(each, axis=0) - np.log(samples) - np.log(STRENGTH + c[u[deep]])) / np.log(10)
        columns += [pa.array(total(x), pa.float64()) for x in (np.log10((c + 1) / (n + v + 1))[w], log_p[at])]
        return pa.table(columns, names=[*names, *_ADDED.names])

    hashed = asked.select(F.lit(ASK).alias("kind"), F.col("src").alias("id"), F.col("id").alias("src"), "a", "b", "piece", "blob")
    rows = texts.of(DOCS).unionByName(hashed).unionByName(words).unionByName(pairs)
    ddl = ", ".join([*ddl, "n_tokens long, n_known long, base_score double, score double"])
    turns = [rows.filter(F.pmod(F.xxhash64("id"), F.lit(TURNS)) == i) for i in range(TURNS)]
    out = _all([written(x.groupBy("id").applyInArrow(tell, ddl), "lm-scores") for x in turns])
    discard(words, pairs)
    return out


def _hashes_of(rows) -> np.ndarray:
    return np.concatenate([summed(unpacked(b)[0]) for k, _, b in rows if k == ASK])


def perplexity(scored: DataFrame) -> DataFrame:
    """One row: n_tokens, perplexity and that of the base, over all rows."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.agg(F.sum("n_tokens").alias("n_tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def op4(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out(7, 2)).withColumn("_train", ~F.col("held_out"))
    texts = coded(rows, train="_train", keep=["doc_id", "held_out"])
    model = fit(texts)
    out = score(texts, model, last=True).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
    discard(texts.table)
    return out
