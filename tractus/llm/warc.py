"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

Writing: the payload becomes an HTTP response, framed in chunks (RFC 9112). A record whose block is longer than the
segment size is written as a first segment and continuation records, which carry the origin's id and their number; the
last one has the total length. Of records with equal payloads the one with the smallest page id is a response, the
others are revisits with headers only. Spark's own text writer puts the records into files: each row is one record and
the line separator is the two line ends that close a record; files are compressed. It writes to whatever store the
shared folder is in.

Reading: files are parsed record by record by their Content-Length. Continuation records are grouped by origin id,
ordered by segment number, their total length is verified, and the joined block is decoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, shared_dir, split_join, written

#: Bytes of a block in one record, bytes of a chunk, and records in one file: together they bound what a task holds.
SEGMENT, CHUNK, RECORDS_PER_FILE = 16 << 10, 4 << 10, 500
DATE = "2000-01-01T00:00:00Z"
END = "\r\n\r\n"
#: Bytes of a packed archive that are unpacked at a time.
STEP = 256 << 10


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if n < 0:
            raise ValueError("broken chunk")
        if n == 0:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + n])
        if len(out[-1]) != n or body[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        at = line + 4 + n


def decode_response(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of an HTTP response (names in lower case) and its decoded body."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = headers(head.split(b"\r\n")[1:])
    return fields, unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def headers(lines) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


#: What a header field may hold as it is: printable ASCII but the percent sign.
_PLAIN = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"


def escaped(x: str | None) -> str | None:
    """x as one field without blanks or line ends; unquote() gives it back."""
    return None if x is None else quote(x, safe=_PLAIN, errors="surrogatepass")


def unescaped(x: str | None) -> str | None:
    return None if x is None else unquote(x, errors="surrogatepass")


def _record(kind: str, rid: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{rid}>"), ("WARC-Date", DATE), *fields, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block


def records(page: str | None, url: str | None, payload: bytes, kind: str, refers_to: str | None, segment: int = SEGMENT):
    """The records of one page, without the line ends that close them."""
    # Header fields are lines: line ends in a url would begin another field.
    target = "".join(c if c > " " else "%%%02X" % ord(c) for c in url) if url else None
    about = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Page-Id", escaped(page))]
    rid = str(uuid.uuid4())
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        block = b"\r\n".join([*http, b"Content-Length: %d" % len(payload), b"", b""])
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record(kind, rid, [*about, profile, ("X-Refers-To-Page-Id", escaped(refers_to)), ("Content-Type", "application/http; msgtype=response")], block)
        return
    block = b"\r\n".join([*http, b"Transfer-Encoding: chunked", b"", chunked(payload)])
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    typed = ("Content-Type", "application/http; msgtype=response")
    yield _record(kind, rid, [*about, typed, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        yield _record("continuation", str(uuid.uuid4()), [("WARC-Segment-Origin-ID", f"<urn:uuid:{rid}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part)


def with_kinds(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """Adds kind (response or revisit) and refers_to. Payloads are equal where digest and length are. A group's
    smallest key is the response; a null key is larger than all others, and a group of null keys is all responses.
    Repeated rows with the smallest key are all responses. Other columns are kept. The smallest key of each payload is
    aggregated before the shuffle; it goes to the rows of frequent payloads, which are few, by a broadcast, so that none
    of these is gathered in one place."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    names = [c for c in pages.columns if c not in ("kind", "refers_to")]
    df = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{key}`").alias("key"), F.unhex(F.sha1(body)).alias("d"), F.octet_length(body).alias("n"))
    groups = df.groupBy("d", "n").agg(F.min("key").alias("first"), F.count("*").alias("m"))
    joined = split_join(df, groups, ["d", "n"], pages.count())
    again = F.col("first").isNotNull() & (F.col("n") >= least) & ~F.col("key").eqNullSafe(F.col("first"))
    return joined.select(*[F.col(f"row.`{c}`") for c in names], F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, segment: int = SEGMENT) -> None:
    """One record, or one and its continuations, for each row. A null payload is empty. Keys may hold any characters, line
    ends and outer blanks too: fields have them percent-encoded, and read() gives them back."""
    bounded_batches(pages.sparkSession)
    rows = with_kinds(pages.select(key, url, payload), key, payload, least).select(F.col(key).cast("string"), url, F.col(payload).cast("binary"), "kind", F.col("refers_to").cast("string"))
    schema = pa.schema([("value", pa.binary())])

    def run(batches):
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                made = list(records(row[0], row[1], row[2] or b"", row[3], row[4], segment))
                for i in range(0, len(made), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(made[i : i + 64], pa.binary())], schema=schema)

    out = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


class Stream:
    """The bytes of an archive, compressed or not, unpacked as they are taken."""

    def __init__(self, content):
        self.left, self.held, self.at = memoryview(content), bytearray(), 0
        self.packed = bytes(self.left[:2]) == b"\x1f\x8b"
        self.member = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bool:
        """Unpacks some more; False at the end."""
        if self.at > 1 << 20:
            del self.held[: self.at]
            self.at = 0
        if not len(self.left):
            return False
        if not self.packed:
            self.held += self.left[:STEP]
            self.left = self.left[STEP:]
            return True
        step = bytes(self.left[:STEP])
        self.held += self.member.decompress(step)
        self.left = self.left[len(step) - len(self.member.unused_data) :]
        if self.member.eof:
            self.member = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, and goes on after it; None where there is none."""
        seen = self.at
        while (found := self.held.find(mark, seen)) < 0:
            seen = max(self.at, len(self.held) - len(mark) + 1) - self.at
            if not self.more():
                return None
            seen += self.at
        out = bytes(self.held[self.at : found])
        self.at = found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self.more():
            pass
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out


def parse(content):
    """(fields, block, error) of each record of an archive, compressed or not. A record whose block is cut short or that
    does not end as it says has an error, as has what stands before the next record; the records after it are read."""
    stream = Stream(content)
    while True:
        try:
            head = stream.until(b"\r\n\r\n")
        except zlib.error as e:
            yield {}, b"", f"archive is damaged: {e}"
            return
        if head is None:
            if rest := stream.take(1 << 30).strip():
                yield {}, b"", f"no record in the last {len(rest)} bytes"
            return
        begin = head.find(b"WARC/")
        if begin < 0:
            yield {}, b"", "no record"
            continue
        fields = headers(head[begin:].split(b"\r\n")[1:])
        size = fields.get("content-length", "")
        if not size.isdigit():
            yield fields, b"", "no Content-Length"
            continue
        try:
            block, end = stream.take(int(size)), stream.take(4)
        except zlib.error as e:
            yield fields, b"", f"archive is damaged: {e}"
            return
        yield fields, block, None if len(block) == int(size) and end == END.encode() else "record does not end as it says"


READ = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"
_SEGMENTS = "origin string, segment int, total long, page_id string, url string, record_type string, refers_to string, payload_digest string, block binary, error string"


def _finished(kind, page, url, refers, said: str | None, block: bytes, error: str | None) -> tuple:
    """A row of READ. What cannot be decoded is a row with an error, without digest, length and payload."""
    try:
        if error:
            raise ValueError(error)
        fields, payload = decode_response(block)
        if kind == "revisit":
            return page, url, kind, refers, said, int(fields["content-length"]), None, None
        found = digest(payload)
        if said and found != said:
            raise ValueError("payload does not have its digest")
        return page, url, kind, refers, found, len(payload), payload, None
    except (ValueError, KeyError) as e:
        return page, url, kind, refers, None, None, None, str(e)


def reassembled(group: pd.DataFrame) -> pd.DataFrame:
    """One origin's segments: ordered by number, complete, and as long as the last one says; else a row with an error."""
    g = group.sort_values("segment")
    null = lambda x: None if pd.isna(x) else x
    block, first, error = b"".join(map(bytes, g["block"])), g.iloc[0], next((x for x in g["error"] if not pd.isna(x)), None)
    if g["segment"].tolist() != list(range(1, len(g) + 1)):
        error = error or f"segments of {first['origin']} are {g['segment'].tolist()}"
    elif len(block) != g["total"].iloc[-1]:
        error = error or f"segments of {first['origin']} have {len(block)} bytes instead of {g['total'].iloc[-1]}"
    row = _finished(null(first["record_type"]), null(first["page_id"]), null(first["url"]), null(first["refers_to"]), null(first["payload_digest"]), block, error)
    return pd.DataFrame([row], columns=[c.split()[0] for c in READ.split(", ")])


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdigit() else None


def read(spark, path: str) -> DataFrame:
    """Rows of all responses and revisits in the archives; a revisit's payload is null, its digest and length are not.
    A record that cannot be read is a row with an error; other records (requests, metadata and such) are left out.
    A file is held packed (below 2 GB, Spark's bound for one value) and unpacked record by record."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for f, block, error in parse(b.column(0)[i].as_buffer()):
                    kind = f.get("warc-type")
                    if not error and kind not in ("response", "revisit", "continuation"):
                        continue
                    more = kind == "continuation"
                    said = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    origin = f.get("warc-segment-origin-id") if more else f.get("warc-record-id")
                    number = _number(f.get("warc-segment-number"))
                    rows.append((origin, number if origin else None, _number(f.get("warc-segment-total-length")), unescaped(f.get("x-page-id")), f.get("warc-target-uri"), kind, unescaped(f.get("x-refers-to-page-id")), said, block, error))
                    size += len(block)
                    if size >= 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    parsed = files.mapInArrow(run, _SEGMENTS)
    whole = parsed.filter("segment IS NULL").mapInArrow(_decode, READ)
    cut = parsed.filter("segment IS NOT NULL").groupBy("origin").applyInPandas(reassembled, READ)
    return whole.unionByName(cut)


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_ARROW, _OUT = (pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ddl.split(", ")]) for ddl in (_SEGMENTS, READ))


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def _decode(batches):
    for b in batches:
        d = {n: b.column(i).to_pylist() for i, n in enumerate(_ARROW.names)}
        rows = [_finished(*x) for x in zip(d["record_type"], d["page_id"], d["url"], d["refers_to"], d["payload_digest"], d["block"], d["error"])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)], schema=_OUT)


def op10(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/tractus-warc-{uuid.uuid4().hex}"
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    typed = lambda c: F.col(c).cast(kind).alias(c)
    out = written(read(spark, path).select(typed("page_id"), "payload_bytes", "payload_digest", "record_type", typed("refers_to")), "warc-read")
    archive = pages.limit(0)
    archive._written_to = path
    discard(archive)
    return out


def _base32() -> str:
    """SQL for the base32 text of a SHA-1 in hexadecimal digits h: eight digits for each five bytes."""
    value = "(CAST('0x' || substr(h, {a}, 10) AS BIGINT))"
    parts = [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({value.format(a=1 + 10 * g)} >> {35 - 5 * i}) & 31 AS INTEGER) + 1, 1)" for g in range(4) for i in range(8)]
    return " || ".join(parts)


OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, {_base32()} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM f
"""
