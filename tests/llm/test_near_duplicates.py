"""The near-duplicate stage of the pipeline: shingles of five words, similarity 0.8."""

import corpus_pipeline


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    row = docs.first().asDict()
    words = [f"word{i}" for i in range(100)]
    near = ["changed" if i in (30, 70) else w for i, w in enumerate(words)]
    far = ["other" if i % 20 == 10 else w for i, w in enumerate(words)]
    planted = [row | {"doc_id": 10_000_000 + i, "text": " ".join(ws)} for i, ws in enumerate((words, near, far))]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    sets = {r.doc_id: shingles(r.text or "") for r in docs.collect()}
    up = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = {k: min(a, b) if x in (a, b) else x for k, x in up.items()}
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert got == {i for i in up if up[i] == i}
    assert 10_000_001 not in got and 10_000_002 in got
