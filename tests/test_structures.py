"""Trees, masking, breakpoint ranges, projects and exports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_kernels import lineage, mosaic, mutated

from tractus.operators import breakpoints, events, exports, masking, trees
from tractus.sources import project


def additive(n=6, seed=5):
    """Distances along a random tree, and its edges."""
    r = np.random.default_rng(seed)
    d = r.random((n, n)) * 0.01
    d = (d + d.T) / 2
    for i in range(n):
        for j in range(n):
            d[i, j] += 0.0 if i == j else 0.1 if i // 2 == j // 2 else 0.4
    np.fill_diagonal(d, 0)
    return d


def test_neighbour_joining_shape_and_siblings():
    d = additive()
    edges = trees.neighbour_joining(d)
    assert len(edges) == 10 and max(p for p, _, _ in edges) == 10
    assert {frozenset({2, 3}), frozenset({4, 5})} <= trees.splits(edges, 6)
    assert trees.newick(edges, list("abcdef")).count(",") == 5
    rooted = trees.midpoint_rooted(edges, 6)
    assert np.allclose(trees.paths(rooted, 6), trees.paths(edges, 6), atol=1e-9)
    r = trees.ranks(rooted, 6)
    assert (np.diag(r) == 0).all() and (r == r.T).all() and r.max() <= 15
    assert all(v == 1 for v in trees.support(edges, [edges] * 4, 6).values())


def test_neighbour_joining_is_exact_on_a_tree():
    edges = trees.neighbour_joining(additive())
    d = trees.paths(edges, 6)
    assert np.allclose(trees.paths(trees.neighbour_joining(d), 6), d, atol=1e-6)


def test_wpgma():
    merges, coph = trees.wpgma(additive())
    assert len(merges) == 5 and {merges[i][:2] for i in range(3)} == {(0, 1), (2, 3), (4, 5)}
    assert coph[0, 1] < coph[0, 2] and (np.diag(coph) == 0).all()


def test_suggested_mask():
    assert masking.suggested(np.ones((5, 5)), np.full(5, 9), 9).tolist() == [False] * 3 + [True] * 2
    rows = [lineage(600, 1)]
    rows += [mutated(rows[0], 0.005, 2), *(mutated(rows[0], 0.4, s) for s in (3, 4, 5))]
    s = np.stack(rows)
    identity = (s[:, None] == s[None]).mean(axis=2)
    assert masking.suggested(identity, np.array([600, 500, 600, 600, 600]), 600).tolist() == [False, True, False, False, False]


def test_breakpoint_ranges_hold_the_planted_ones():
    states = mosaic()
    found = breakpoints.ranges(states)
    for true in (300, 600):
        assert any(abs(r["position"] - true) < 25 for r in found)
    for r in found:
        a, b = r["range_0.995"], r["range_0.999"]
        assert b[0] <= a[0] <= r["position"] <= a[1] <= b[1]
    assert breakpoints.ranges(np.ones((3, 20), np.int8)) == []


def test_project_versions(spark, tmp_path):
    rows = [{"seq_id": i, "name": f"s{i}", "seq": "ACGT"} for i in range(3)]
    doc = project.migrated({"version": 1, "sequences": rows})
    assert doc["version"] == project.VERSION and all(r["row_state"] == "enabled" and r["ref_group"] == 0 for r in doc["sequences"])
    assert project.migrated(json.loads(project.document("x", doc["sequences"], [], {})))["sequences"] == doc["sequences"]
    for bad in ({"version": 9, "sequences": rows}, {"version": 1, "sequences": rows[:2]}, {"version": 3, "sequences": [r | {"row_state": "?"} for r in doc["sequences"]]}):
        with pytest.raises(ValueError):
            project.migrated(bad)
    df = spark.createDataFrame([(d, i, f"s{i}", "AC-T", "masked", 2) for d in (0, 1) for i in range(3)], "dataset_id long, seq_id int, name string, seq string, row_state string, ref_group int")
    project.save(df, str(tmp_path / "p"))
    back = project.load(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_export_gate_and_files(spark, tmp_path):
    ev = spark.createDataFrame([(0, 1), (0, 2)], "dataset_id long, event_id long")
    log = lambda rows: spark.createDataFrame(rows, "event_id long, decision_id long, at long, state string")
    with pytest.raises(ValueError, match="1 events"):
        exports.ready(ev, log([(1, 1, 1, "accepted")]))
    exports.ready(ev, log([(1, 1, 1, "accepted"), (2, 2, 1, "undecided"), (2, 3, 2, "rejected")]))
    with pytest.raises(ValueError):
        exports.ready(ev.limit(0), log([]))
    rows = spark.createDataFrame([(0, 0, [1, 2, 0, 4])], "dataset_id long, seq_id int, states array<tinyint>")
    exports.write_fasta(events.fasta(rows, F.lit("a")), str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).count() == 2
    with pytest.raises(ValueError):
        exports.write_fasta(events.fasta(rows.limit(0), F.lit("a")), str(tmp_path / "g"))
    exports.write_csv(ev, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert exports.stem("a/b\\c.d.fas") == "c.d" and exports.stem("x") == "x"
