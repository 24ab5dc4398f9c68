"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest

from tractus.llm import bpe, decontam, jaccard, langid, lm, quality, secrets, substring, urlfilter, warc
from tractus.llm.queries import vocabulary

LONG = "the quick brown fox jumps over the lazy dog and runs away 12345 " * 3000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and then it runs away", "en", "src", 1),
    (1, "The quick brown fox jumps over the lazy dog and then it runs away", "en", "src", 1),
    (2, None, None, None, None),
    (3, "", "en", "", 0),
    (4, " \n\t ", "en", "", 0),
    (None, "der Hund und die Katze laufen durch den Wald und sehen das Haus", None, "src", 3),
    (5, LONG, "en", "src", len(LONG)),
    (6, "日本語 テキスト <|endoftext|> é \x00   x", "xx", None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["n_words", "hits", "items", "ids", "decoded", "score", "lang_pred", "spans", "removed", "kept", "_w", "_l", "c", "word", "h", "k", "th"]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("own") for c in CLASH})


def items(spark):
    return spark.createDataFrame([(7, "quick brown fox jumps over the lazy dog and then it"), (8, None), (9, "!!"), (10, "Katze laufen")], "item_id long, text string")


OPS = {
    "op1": lambda s, d: decontam.op1(d, items(s)),
    "op3": lambda s, d: quality.op3(d),
    "op4": lambda s, d: lm.op4(d),
    "op5": lambda s, d: substring.op5(d),
    "op6": lambda s, d: langid.op6(d),
    "op7": lambda s, d: secrets.op7(d),
    "op8": lambda s, d: jaccard.op8(d),
    "op9": lambda s, d: bpe.op9(d, vocabulary()),
}


@pytest.mark.parametrize("name", OPS)
def test_odd_rows(spark, name):
    got = OPS[name](spark, clashing(docs(spark))).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    twins = [tuple(r) for r in got if r.doc_id == 1]
    assert twins[0] == twins[1]


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    out = OPS[name](spark, docs(spark, []))
    assert out.collect() == [] and "doc_id" in out.columns


def test_general_interfaces_keep_clashing_columns(spark):
    df = clashing(docs(spark))
    for out, added in [
        (decontam.decontaminate(df, items(spark)), {"n_words", "hits", "items"}),
        (quality.judge(df), {"n_words", "kept"}),
        (substring.repeats(df), {"removed"}),
        (langid.identify(df, {"en": ["the dog"]}), {"lang_pred", "score"}),
        (secrets.scan(df), {"spans"}),
        (bpe.encode_decode(df, vocabulary()), {"ids", "decoded"}),
    ]:
        rows = out.collect()
        assert len(rows) == len(ROWS)
        for c in set(CLASH) - added:
            assert {r[c] for r in rows} == {"own"}, c


def test_pages(spark):
    rows = [(1, "http://A.Example.org/en/12?x", "<p>a</p>"), (2, None, None), (3, "no scheme", ""), (None, "https://x.com#y", "<p>a</p>"), (4, "http://sub.example.org/es/\r\nX: y", "z" * 100_000), (4, "http://sub.example.org/es/\r\nX: y", "z" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert urlfilter.op2(pages).count() == len(rows)
    assert warc.op10(pages).count() == len(rows)
    assert urlfilter.op2(pages.limit(0)).count() == 0
    assert warc.op10(pages.limit(0)).count() == 0
    other = pages.selectExpr("*", *[f"'own' AS {c}" for c in ("host", "path", "rule", "verdict", "_rest", "key", "salt", "kind", "d", "n", "m", "first", "row", "stack")])
    assert urlfilter.op2(other).count() == len(rows) and warc.op10(other).count() == len(rows)
    kept = urlfilter.match(urlfilter.with_host_path(other), urlfilter.rule_table(spark)).collect()
    assert len(kept) == len(rows) and all({r[c] for r in kept} == {"own"} for c in ("_rest", "key", "salt", "kind", "stack"))
    kept = warc.with_kinds(other).collect()
    assert len(kept) == len(rows) and all({r[c] for r in kept} == {"own"} for c in ("d", "n", "m", "first", "row", "host"))
    near = spark.createDataFrame([(1, "http://community/x"), (2, "http://com/x"), (3, "http://a.com/x")], "page_id long, url string")
    none = urlfilter.match(urlfilter.with_host_path(near), urlfilter.rule_table(spark, (("block", "com", ""),)))
    assert {r.page_id: r.rule for r in none.collect()} == {1: None, 2: "com", 3: "com"}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.op2(pages).collect()}
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("", "", None, "allow") and got[None] == ("x.com", "", None, "allow")


def test_hostile_page_ids_come_back(spark, tmp_path):
    ids = ["a\r\nWARC-Type: request", " lead", "trail ", "", "x\r\n\r\ny", "100%25", "é \x85", "plain", None]
    rows = [(i, "http://a.org/", f"<p>{k % 4}</p>") for k, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = warc.op10(pages).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(map(str, ids))
    first = {p: min(i for i, _, q in rows if q == p and i is not None) for _, _, p in rows}
    want = {i: None if i in (None, first[p]) else first[p] for i, _, p in rows}
    assert all(r.refers_to == want[r.page_id] for r in got if r.page_id is not None)


def test_items_without_an_id_are_hit(spark):
    d = spark.createDataFrame([(1, "one two three four"), (2, "five six"), (3, "other words")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "two three"), ("k", "five six"), (None, "five"), (None, None)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontam.op1(d, b).collect()}
    assert got == {1: (2, 0, True), 2: (2, 1, True), 3: (0, 0, False)}


def test_longer_unknown_words_are_less_likely(spark):
    rows = [(i, "the old house stands by the river and the old mill " * 3) for i in range(30)]
    import zlib

    free = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows += [(i, "the " + "q" * n) for i, n in zip(free, (100, 300, 3000, 30000), strict=True)]
    scores = {r.doc_id: r.score for r in lm.op4(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b, c, d = (scores[i] for i in free)
    assert a > b > c > d and d < 5 * c < -100 and d > float("-inf")


def test_long_tokens_are_learned_whole(spark):
    token = "ab/" * 150 + "Zz9=" * 60
    got = secrets.labelled(spark.createDataFrame([(1, f"so {token} it is")], "doc_id long, text string"))
    assert (token, 0) in got


def test_judge_keeps_all_other_columns(spark):
    d = clashing(docs(spark))
    out = quality.judge(d).collect()
    assert all(r["_w"] == "own" and r["_l"] == "own" for r in out) and len(out) == len(ROWS)
