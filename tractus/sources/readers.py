"""Readers of text alignments: FASTA, GDE, CLUSTAL or MUSCLE, MEGA, NEXUS and PHYLIP.

A file is the unit: each is read whole, parsed in a Python worker and becomes rows (path, format, seq_id, name, seq).
A file that cannot be read gives one row with an error instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..ship import ensure

SCHEMA = "path string, format string, seq_id int, name string, seq string, error string"
UNKNOWN = "The format is not one of FASTA, GDE, CLUSTAL, MEGA, NEXUS and PHYLIP."
_DROPPED = re.compile(r"[^A-Za-z.?!*-]")
Records = list[tuple[str, str]]


def residues(text: str) -> str:
    return _DROPPED.sub("", text).upper()


class Gathered:
    """Fragments by name, in the order in which names are first seen."""

    def __init__(self):
        self.parts: dict[str, list[str]] = {}

    def add(self, name: str, text: str) -> None:
        if name and (seq := residues(text)):
            self.parts.setdefault(name, []).append(seq)

    def records(self) -> Records:
        return [(n, "".join(p)) for n, p in self.parts.items()]


def read_fasta(lines: list[str]) -> Records:
    """Also GDE. A name ends at its first blank; names that repeat are records of their own; ';' begins a comment."""
    out: list[tuple[str, list[str]]] = []
    for line in filter(None, map(str.strip, lines)):
        if line[0] in ">%":
            out.append(((line[1:].split() or [""])[0], []))
        elif out and line[0] != ";":
            out[-1][1].append(residues(line))
    return [(n, "".join(p)) for n, p in out if n]


def read_clustal(lines: list[str]) -> Records:
    out = Gathered()
    for raw in lines[1:]:
        fields = raw.split()
        conservation = raw[:1].isspace() and not raw.strip("*:. \t\r\n")
        if len(fields) >= 2 and not conservation:
            out.add(fields[0], fields[1])
    return out.records()


def read_mega(lines: list[str]) -> Records:
    out, name = Gathered(), ""
    for line in filter(None, map(str.strip, lines)):
        if line.startswith("!") or re.match(r"#(mega|title|format)", line, re.I):
            continue
        if line.startswith("#"):
            name, _, line = re.sub(r"\t", " ", line[1:]).partition(" ")
        out.add(name, line if line and not line.startswith("#") else "")
    return out.records()


def read_nexus(lines: list[str]) -> Records:
    """From the word matrix to the next semicolon; names may be quoted, lines that begin with '[' are comments."""
    out, inside = Gathered(), False
    for line in filter(None, map(str.strip, lines)):
        if line.startswith("["):
            continue
        if not inside:
            before, word, line = re.match(r"(?is)(.*?)(matrix|$)(.*)", line).groups()
            if not word:
                continue
            inside = True
        row, end, _ = line.partition(";")
        quoted = re.match(r"""\s*(['"])(.*?)\1(.*)""", row)
        if quoted:
            out.add(quoted[2], quoted[3])
        elif len(row.split()) >= 2:
            out.add(*row.split()[:2])
        if end:
            break
    return out.records()


def _phylip_row(raw: str) -> tuple[str, str]:
    fields = raw.split()
    if len(fields) >= 2:
        return fields[0], residues("".join(fields[1:]))
    return raw[:10].strip(), residues(raw[10:])


def _interleaved(rows: list[str], n: int, length: int) -> Records:
    """n named rows, then blocks; a continuation may repeat its name, else rows go round in order."""
    rows_left = iter(rows)
    named = [_phylip_row(r) for _, r in zip(range(n), (r for r in rows_left if r.strip()))]
    where = {name: i for i, (name, _) in enumerate(named)}
    if len(named) < n or len(where) < n or any(not a or not s or len(s) > length for a, s in named):
        return []
    seqs, turn = [s for _, s in named], 0
    for raw in rows_left:
        fields = raw.split()
        if not fields:
            turn = 0
            continue
        known = len(fields) > 1 and fields[0] in where
        at = where[fields[0]] if known else turn % n
        seqs[at] += residues("".join(fields[1:]) if known else raw)
        turn += 1
    return [(a, s) for (a, _), s in zip(named, seqs)] if all(len(s) == length for s in seqs) else []


def _sequential(rows: list[str], n: int, length: int) -> Records:
    out, filled = [], iter(r for r in rows if r.strip())
    for raw in filled:
        name, seq = _phylip_row(raw)
        while name and seq and len(seq) < length:
            more = next(filled, None)
            if more is None:
                return []
            seq += residues(more)
        if not name or len(seq) != length:
            return []
        out.append((name, seq))
        if len(out) == n:
            break
    return out if len(out) == n else []


def read_phylip(lines: list[str]) -> Records:
    n, length = map(int, lines[0].split()[:2])
    return (_interleaved(lines[1:], n, length) or _sequential(lines[1:], n, length)) if n and length else []


def sniff(first: str) -> tuple[str, object] | None:
    low = first.lower()
    for head, kind, reader in ((">", "FASTA", read_fasta), ("%", "GDE", read_fasta), ("clustal", "CLUSTAL", read_clustal), ("muscle", "CLUSTAL", read_clustal), ("#nexus", "NEXUS", read_nexus), ("#mega", "MEGA", read_mega)):
        if low.startswith(head):
            return kind, reader
    fields = first.split()
    if len(fields) >= 2 and all(f.isascii() and f.isdigit() for f in fields[:2]):
        return "PHYLIP", read_phylip
    return None


def problem(records: Records) -> str | None:
    """Why records are not an alignment."""
    if len(records) < 3:
        return "At least three sequences are needed."
    length = len(records[0][1])
    if not length:
        return "The alignment has no columns."
    odd = next((i for i, (_, s) in enumerate(records) if len(s) != length), None)
    return None if odd is None else f"Sequence {odd + 1} ({records[odd][0]}) has {len(records[odd][1])} columns instead of {length}."


def parse(text: str) -> tuple[str | None, Records, str | None]:
    """Format, records, error. Blank names become Sequence_n."""
    lines = text.replace("\r", "").split("\n")
    first = next((i for i, x in enumerate(lines) if x.strip()), None)
    if first is None:
        return None, [], "The file is empty."
    found = sniff(lines[first].strip())
    records = found[1](lines[first:]) if found else []
    if not records:
        return found and found[0], [], UNKNOWN
    error = problem(records)
    return found[0], [] if error else [(n.strip() or f"Sequence_{i}", s) for i, (n, s) in enumerate(records, 1)], error


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "format", "seq_id", "name", "seq", "error"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            kind, records, error = parse(content.decode("utf-8", "replace"))
            rows = [(path, kind, i, n, s, None) for i, (n, s) in enumerate(records)] or [(path, kind, None, None, None, error)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    ensure(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parsed, SCHEMA)


def parse_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The same for alignments that are values of a column."""
    ensure(texts.sparkSession)
    return texts.select(texts[key].cast("string").alias("path"), texts[text].cast("binary").alias("content")).mapInArrow(_parsed, SCHEMA)
