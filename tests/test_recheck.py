"""Rechecks of events: BootScan's support gate, and the events of all rounds."""

import numpy as np

from tractus.operators.kernels import review
from tractus.operators.kernels.common import Options
from tractus.plans import catalog

SF = "/root/testdata/sf0.001"


def test_bootscan_needs_support():
    # Matches of pair 12 gather in the tract, but no pair leads in its windows: sites of 12 and 13 alternate there.
    rng = np.random.default_rng(2)
    base = rng.integers(1, 5, 600).astype(np.int8)
    rows = np.stack([base, base % 4 + 1, (base + 1) % 4 + 1]).astype(np.int8)
    tract = np.arange(200, 400)
    rows[1, tract[::2]], rows[2, tract[1::2]] = base[tract[::2]], base[tract[1::2]]
    o = Options(boot_window=100)
    assert not review.supported(rows, 201, 400, o) and review.recheck("BootScan", rows, 201, 400, o) == 1.0
    rows[1, tract] = base[tract]
    assert review.supported(rows, 201, 400, o) and review.recheck("BootScan", rows, 201, 400, o) < 1e-3


def test_events_of_every_round(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a, b, far = (rng.integers(1, 5, 600).astype(np.int8) for _ in range(3))
    site = np.arange(600)
    rows = [a, b, np.where((site >= 100) & (site < 200), b, a), np.where((site >= 400) & (site < 500), far, b), far]
    planted = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(rows)], "dataset_id long, seq_id int, states array<tinyint>")
    monkeypatch.setattr(catalog, "_planted", lambda s, sf: planted)
    events = {(r.dataset_id, r["round"]) for r in catalog.queries()["cyclic_scan"](spark, SF).collect()}
    assert max(n for _, n in events) > 1
    got = [(r.dataset_id, r["round"], r.method) for r in catalog.queries()["event_recheck"](spark, SF).collect()]
    assert len(got) == len(set(got)) and {g[:2] for g in got} == events
    assert {(r.dataset_id, r["round"]) for r in catalog.queries()["event_plots"](spark, SF).collect()} == events
