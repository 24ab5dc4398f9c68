"""Texts are told from those that no task of the join wants before they are shuffled."""

from pyspark.sql import functions as F

from tractus.llm import jaccard


def test_only_wanted_texts_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(2000)] + [(None, "text 0"), (None, None)], "doc_id long, text string")
    docs = docs.withColumn("th", F.xxhash64("text"))
    want = docs.filter("doc_id % 100 = 0 OR doc_id IS NULL").select(F.col("doc_id").alias("wk"), F.col("th").alias("wth"))
    asked = {(r.wk, r.wth) for r in want.collect()}
    for bits, most in ((24, len(asked)), (10, 150), (6, len(asked) * 40)):
        got = [(r.doc_id, r.th) for r in jaccard.wanted(docs, want, "doc_id", bits).collect()]
        assert asked <= set(got) and len(got) == len(set(got)) <= most
    assert jaccard.wanted(docs, want.filter("false"), "doc_id").isEmpty()


def test_text_shuffle_is_that_of_linked_texts(spark, monkeypatch):
    """The rows that reach the join of texts are those of sets that share their prefixes with others."""
    wanted, counts = jaccard.wanted, []
    monkeypatch.setattr(jaccard, "wanted", lambda *a: counts.append(wanted(*a).count()) or wanted(*a))
    alike = [" ".join(f"w{i}x{j if j != 20 else k}" for j in range(80)) for i in range(3) for k in (20, 99)]
    other = [" ".join(f"v{i}x{j}" for j in range(80)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(alike + other)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.op8(docs).collect()}
    assert got == {i: i - i % 2 if i < 6 else i for i in range(206)}
    assert counts == [6]
