"""The pipeline against a brute-force version on the smallest tables."""

import re
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from tractus.llm import decontam, secrets
from tractus.llm.queries import vocabulary


def test_run(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [decontam.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {i: t for i, t in docs.items() if t and any(map(str.isalpha, t))}
    sets = {}
    for i, t in kept.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = {k: min(a, b) if x in (a, b) else x for k, x in up.items()}
    windows = {tuple(ws[k : k + 10]) for ws in items if ws for k in range(max(1, len(ws) - 9))}
    clean = {}
    for i, t in kept.items():
        ws = decontam.words(t)
        if up[i] == i and not any(tuple(ws[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(ws) - n + 1)):
            clean[i] = t
    library, ratio = Tokenizer.from_file(vocabulary()), secrets.learn(spark.createDataFrame(list(clean.items()), "doc_id long, text string"))
    want = {}
    for i, t in clean.items():
        out, end = [], 0
        for s, _, e in secrets.scan_text(t, ratio):
            if s >= end:
                out += [t[end:s], "[secret]"]
            end = max(end, e)
        want[i] = len(library.encode("".join([*out, t[end:]]), add_special_tokens=False).ids)
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n_chars", F.col("n_chars"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert "tractus" in sys.modules


ODD = [
    (1, "The quick brown fox jumps over the lazy dog and then it runs away", "en", "s", 64),
    (1, "The quick brown fox jumps over the lazy dog and then it runs away", "en", "s", 64),
    (1, "der Hund und die Katze laufen durch den Wald und sehen das Haus am See", None, "s", 70),
    (2, None, None, None, None),
    (3, "", "en", "", 0),
    (3, "", "en", "", 0),
    (4, " ² 12 \n", "en", "", 6),
    (None, "The quick brown fox jumps over the lazy dog and then it runs away", "en", "s", 64),
    (5, 'password = "24be64439e3e49cf46b2d7c90f3602a3" and so on and on', None, None, 60),
    (6, "the dog and the cat " * 5000, "en", "s", 100_000),
]
CLASH = ["_gone", "_twice", "spans", "lang_pred", "score", "n_words", "hits", "items", "_row", "_k", "_id", "_h", "component_id", "lo", "hi", "n", "c", "k", "th", "prefix", "token", "m", "ids", "decoded"]


def _odd(spark, rows=ODD):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("own") for c in CLASH})


def test_odd_rows_in_every_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs, kept = _odd(spark), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        assert all({r[c] for r in rows} == {"own"} for c in CLASH)
        kept[name] = sorted(str(r.doc_id) for r in rows)
    everything = sorted(str(r[0]) for r in ODD)
    assert kept["language_id"] == sorted(["1", "1", "1", "None", "5", "6"])
    assert kept["jaccard_join"] == sorted(["1", "1", "2", "3", "3", "4", "5", "6"])
    assert kept["decontamination"] == kept["secret_scan"] == everything
    assert len(corpus_pipeline.encoding(spark, docs, sf).collect()) == len(ODD)
    redacted = {r.doc_id: r for r in corpus_pipeline.secrets(spark, docs, sf).collect()}
    assert "24be6443" not in redacted[5].text and redacted[5].n_chars == len(redacted[5].text) and redacted[2].text is None


def test_empty_table_in_every_stage(spark):
    docs = _odd(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.collect() == []
        assert name == "bpe_codec" or out.columns == docs.columns
