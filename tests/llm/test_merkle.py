"""The manifest against a plain tree over all rows, at the real sizes and with a small top tree and small ranges."""

import zlib
from hashlib import sha256

import pytest

from tractus.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(nodes, places):
    """The root over nodes, and for each of places its siblings level by level."""
    paths = {p: [] for p in places}
    at = {p: p for p in places}
    while len(nodes) > 1:
        for p in places:
            run = at[p] // 16 * 16
            paths[p].append((nodes[run : at[p]], nodes[at[p] + 1 : run + 16]))
            at[p] //= 16
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, paths = {}, {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        subs[s], paths[s] = tree([leaf(r, r["text"]) for r in groups[s]], range(len(groups[s])))
    root, tops = tree([subs[s] for s in order], range(len(order)))
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path = paths[s][i] + tops[k]
            text, crc = r["text"], None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
            if crc is not None and crc % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            now = leaf(r, text)
            for left, right in path:
                now = h(*left, now, *right)
            proof = h(*(d for left, right in path for d in (*left, *right)))
            out.append((r["doc_id"], leaf(r, r["text"]), subs[s], root, proof, now, now == root))
    return out


def same(df, rows):
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(brute(rows), key=key)


def rows_of(df):
    return [r.asDict() for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = merkle.op13(docs)
    same(out, rows_of(docs))
    verified = {r.verified for r in out.collect()}
    assert verified == {True, False}


@pytest.mark.parametrize("top", [4096, 3, 20])
@pytest.mark.parametrize("sources", [1, 3, 70])
def test_small_blocks(spark, top, sources):
    """Blocks of 16 leaves, a top tree of few nodes: several rounds of blocks below it, and trees of groups."""
    rows = [(i * 7 % 701, f"s{i % sources}" if i % sources else None, None if i % 5 else "en", i, f"Text {i} É" if i % 3 else None) for i in range(701)]
    docs = spark.createDataFrame(rows, SCHEMA)
    same(merkle.op13(docs, merkle.Shape(1, top, 60)), rows_of(docs))


def test_odd_rows(spark):
    rows = [(1, "a", "en", 1, "X"), (1, "a", "en", 1, "X"), (1, "a", "en", 1, "Y"), (None, None, None, None, None), (None, None, None, None, None), (2, "", "", 0, ""), (3, "é", "x", -5, "Long WORD " * 50_000), (7, "\U0001f600", None, 1, "A"), (8, "￿", None, 1, "A")]
    docs = spark.createDataFrame(rows, SCHEMA)
    same(merkle.op13(docs), rows_of(docs))
    extra = docs.selectExpr("*", *[f"'own' AS {c}" for c in ("tree", "key", "digest", "now", "_place", "_tie", "block", "path", "subroot", "root")])
    same(merkle.op13(extra), rows_of(docs))
    one = docs.filter("doc_id = 2")
    same(merkle.op13(one), rows_of(one))
    assert merkle.op13(docs.limit(0)).collect() == []


def test_repeated_rows_and_one_large_group(spark):
    """A group with nearly all rows goes through many ranges."""
    rows = [(5, "big", "en", 1, "same")] * 3000 + [(i, "big", "en", 1, "t") for i in range(6000)] + [(i, f"z{i % 40}", "en", 1, "t") for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    same(merkle.op13(docs), rows_of(docs))
