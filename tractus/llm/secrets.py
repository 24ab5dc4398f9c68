"""Secret scans: fixed patterns, and a likelihood ratio of two character Markov models.

The patterns find assignments, access keys and long hexadecimal strings. What they leave of other tokens is compared
under two Markov models of characters, one of random strings and one of ordinary identifiers and words. Both learn from
labelled samples: what the patterns find in a bounded number of rows of the input is random, the other tokens of these
rows are ordinary; made strings of several alphabets and identifiers of common words are added to both. Half of the
samples are held out and give the threshold: a token whose log-likelihood ratio passes it is a secret too.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bounded_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Tokens that the models judge, of LEAST_RANDOM characters or more.
LEAST_RANDOM = 12
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Words from which ordinary text is learned besides: letters alone, shorter than what is judged.
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,11}(?![A-Za-z0-9+/_=-])")
HINTS = ("passw", "secret", "token", "api")
LEAST_ASSIGNED = 12
#: Rows of the input that the models learn from, those of at most ROW_CHARS characters before longer ones.
LABELLED_ROWS, ROW_CHARS = 2_000, 20_000
#: The ratio (in nats) that a token must pass at least, for secrets are rare; and the share of held-out ordinary samples
#: that may pass the threshold.
LEAST_RATIO, FALSE_ALARMS = 9.2, 0.0005
DOUBT = 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PARTS = (
    "user account profile session request response handler config default value index count total item list table column row key name type "
    "file path folder image video audio text page link button label color width height size border margin style class method function object "
    "array string number integer float double date time year month day hour minute second start end begin finish first last next previous "
    "create read update delete insert remove select filter sort group order limit search find get set put post send receive open close load "
    "save import export build test debug release version server client network socket port host address domain email phone country city "
    "street price amount balance payment order invoice customer product category stock store cart checkout shipping discount tax report chart"
).split()


def labelled_samples(n: int = 4000) -> list[tuple[str, int]]:
    """(text, 1 for random and 0 for ordinary), the same on every machine: digests in several alphabets, and
    identifiers put together of common words in the usual styles."""
    out = []
    for i in range(n):
        d = hashlib.sha512(b"sample%d" % i).digest()
        wide = ALPHABET[: (62, 62, 36, 65)[i % 4]] if i % 4 != 2 else ALPHABET[26:62]
        out.append(("".join(wide[b % len(wide)] for b in d[: 20 + d[63] % 21]), 1))
        words = [PARTS[d[k] % len(PARTS)] for k in range(2 + d[40] % 4)]
        style = d[50] % 5
        text = "_".join(words) if style == 0 else "-".join(words) if style == 1 else words[0] + "".join(w.title() for w in words[1:]) if style == 2 else "/".join(words) if style == 3 else "_".join(words).upper()
        out.append((text + (f"{'_-'[d[51] % 2] if style < 2 else ''}{d[52] % 100}" if d[53] % 2 else ""), 0))
    return out


class Ratio:
    """Log-likelihood ratio of two chains over ALPHABET: of the next character after two, which backs off to that after
    one and this to that after none, each in proportion to BACK_OFF observations."""

    BACK_OFF = 20.0

    def __init__(self, samples: list[tuple[str, int]]):
        self.symbols = bytes(ALPHABET.index(chr(b)) if b < 128 and chr(b) in ALPHABET else len(ALPHABET) for b in range(256))
        k = len(ALPHABET) + 1
        logs = []
        for label in (0, 1):
            three = np.zeros((k, k, k))
            for text, y in samples:
                if y == label:
                    c = self.codes(text)
                    np.add.at(three, (c[:-2], c[1:-1], c[2:]), 1)
            p = np.full(k, 1 / k)
            for n in (three.sum(axis=(0, 1)), three.sum(axis=0), three):
                p = (n + self.BACK_OFF * p) / (n.sum(axis=-1, keepdims=True) + self.BACK_OFF)
            logs.append(np.log(p))
        self.table = (logs[1] - logs[0]).astype(np.float32)
        self.threshold = LEAST_RATIO

    def codes(self, text: str) -> np.ndarray:
        """Before the first character stand two outside the alphabet."""
        return np.frombuffer((b"\0\0" + text.encode("ascii", "replace")).translate(self.symbols), np.uint8)

    def score(self, text: str) -> float:
        c = self.codes(text)
        return float(self.table[c[:-2], c[1:-1], c[2:]].sum())


def trained(samples: list[tuple[str, int]]) -> Ratio:
    """Both chains from one half of the samples, dealt by a hash of the text; the threshold from the other half. Ordinary
    text is learned in capitals too."""
    half = lambda t: hashlib.md5(t.encode()).digest()[0] & 1
    own = [x for x in samples if half(x[0])]
    ratio = Ratio([*own, *((t.upper(), 0) for t, y in own if not y)])
    held = np.sort([ratio.score(t) for t, y in samples if not y and not half(t)])
    if len(held):
        ratio.threshold = max(LEAST_RATIO, float(held[-1 - int(FALSE_ALARMS * len(held))]))
    return ratio


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and without overlap within a kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS) or not text.isascii():
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def uncovered(text: str, spans: list[tuple[int, int, int]]):
    """(start, end) of what the spans (by start) leave of tokens, LEAST_RANDOM characters or more. One pass over both."""
    i, reach = 0, 0
    for m in TOKEN.finditer(text):
        at, end = m.span()
        while True:
            while i < len(spans) and spans[i][0] <= at:
                reach = max(reach, spans[i][2])
                i += 1
            at = max(at, reach)
            stop = min(end, spans[i][0]) if i < len(spans) else end
            if stop - at >= LEAST_RANDOM:
                yield at, stop
            if stop >= end:
                break
            at = stop


def scan_text(text: str, ratio: Ratio) -> list[tuple[int, int, int]]:
    """All spans: those of the patterns, and random tokens between these."""
    found = base_spans(text)
    return sorted(found + [(a, 3, b) for a, b in uncovered(text, found) if ratio.score(text[a:b]) >= ratio.threshold])


def _smallest(texts: DataFrame, n: int, count: int) -> DataFrame:
    """The n of count rows with the smallest h, ties by t. Rows of larger hashes go before any are sorted, so what meets in
    one task does not grow with the table."""
    share = 4 * n / max(count, 1)
    while share < 1:
        few = texts.filter(F.col("h") < int(share * 2**64) - 2**63)
        if few.count() >= n:
            return few.orderBy("h", "t").limit(n)
        share *= 16  # copies have one hash, so a share may have fewer rows than expected
    return texts.orderBy("h", "t").limit(n)


def labelled(docs: DataFrame, text: str = "text", rows: int = LABELLED_ROWS) -> list[tuple[str, int]]:
    """Distinct tokens of a bounded number of rows: 1 where a pattern finds them, else 0, as have all their words. Rows of at
    most ROW_CHARS characters come before longer ones, and among these those of the smallest hashes."""
    texts = docs.select(F.col(f"`{text}`").alias("t")).filter("t IS NOT NULL").select("t", F.xxhash64("t").alias("h"), (F.length("t") > ROW_CHARS).alias("long"))
    of = texts.agg(F.count_if("long").alias("long"), F.count_if(~F.col("long")).alias("short")).first()
    kept = _smallest(texts.filter("NOT long"), rows, of["short"])
    if of["short"] < rows:
        kept = kept.unionByName(_smallest(texts.filter("long"), rows - of["short"], of["long"]))
    kept = kept.select("t")

    def run(batches):
        for b in batches:
            found = set()
            for t in b.column(0).to_pylist():
                spans = base_spans(t)
                for a, k, e in spans:
                    s = ASSIGN.match(t, a).group(2) if k == 0 else t[a:e]
                    found.add((s, 1))
                found.update((t[a:e], 0) for a, e in uncovered(t, spans))
                found.update((w, 0) for w in WORD.findall(t))
            found = sorted(found)
            yield pa.RecordBatch.from_pydict({"s": pa.array([s for s, _ in found], pa.string()), "y": pa.array([y for _, y in found], pa.int32())})

    return sorted({(r.s, r.y) for r in kept.mapInArrow(run, "s string, y int").collect()})


def learn(docs: DataFrame, text: str = "text", rows: int = LABELLED_ROWS) -> Ratio:
    """The chains of made samples and of the input's. Tokens of the input that no pattern finds but that the made samples
    alone call random by DOUBT times the least ratio get no label: secrets without a pattern must not count as ordinary."""
    bounded_batches(docs.sparkSession)
    made = labelled_samples()
    first = Ratio(made)
    return trained([*made, *((t, y) for t, y in labelled(docs, text, rows) if y or first.score(t) < DOUBT * LEAST_RATIO)])


def scan(docs: DataFrame, ratio: Ratio | None = None, text: str = "text") -> DataFrame:
    """Adds spans: array<struct<kind, start, end>> in code points, end exclusive, by start and then kind.

    Null and empty texts have no spans. Rows are independent; other columns are kept, one named spans is replaced.
    ratio: the trained chains, by default those that learn() makes of docs.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "spans"]
    at = names.index(text)
    ratio = docs.sparkSession.sparkContext.broadcast(ratio or learn(docs, text))  # a table of 68 ** 3 numbers
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan_text(t, ratio.value)] if t else [] for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array(found, kind)], names=[*names, "spans"])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, ", ".join([*arrow_schema(docs, names), "spans array<struct<kind:string,start:int,end:int>>"]))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each run of overlapping spans replaced by the mark; needs scan()'s spans, and drops them."""
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "spans"]
    at, spans = docs.columns.index(text), docs.columns.index("spans")

    def cut(t, found):
        if not t or not found:
            return t
        out, end = [], 0
        for s in found:
            if s["start"] >= end:
                out += [t[end : s["start"]], mark]
            end = max(end, s["end"])
        return "".join([*out, t[end:]])

    def run(batches):
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(docs_columns)}
            cols[text] = pa.array([cut(*x) for x in zip(b.column(at).to_pylist(), b.column(spans).to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    docs_columns = list(docs.columns)
    return docs.mapInArrow(run, ", ".join(arrow_schema(docs, names)))


def op7(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text")).drop("text")
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(line(F.filter("spans", lambda x: x["kind"] != KINDS[3])), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )
