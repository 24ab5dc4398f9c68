"""SISCAN's fourth sequence."""

import numpy as np

from tractus.operators import scan
from tractus.operators.kernels import outlier, windows
from tractus.operators.kernels.common import Options
from tractus.plans import catalog


def alignment():
    rng = np.random.default_rng(5)
    old = rng.integers(1, 5, 900).astype(np.int8)
    changed = lambda row, share: np.where(rng.random(900) < share, row % 4 + 1, row).astype(np.int8)
    a, b, far = changed(old, 0.15), changed(old, 0.15), changed(old, 0.3)
    mosaic = np.where((np.arange(900) >= 300) & (np.arange(900) < 600), b, a).astype(np.int8)
    return np.stack([a, b, changed(mosaic, 0.01), far])


def test_nearest_outlier():
    rows = alignment()
    context = outlier.similarities(rows)
    assert outlier.nearest((0, 1, 2), rows, *context) == 3
    assert outlier.nearest((0, 1, 2), rows, *context, [0, 1, 2, 2]) is None
    assert outlier.nearest((0, 1, 2), rows[:3], *outlier.similarities(rows[:3])) is None
    # A row without a site of the triplet is the last resort.
    more = np.concatenate([rows, np.where(np.arange(900) == 5, 0, rows[3])[None]])
    assert outlier.nearest((0, 1, 2), more, *outlier.similarities(more)) == 3


def test_scan_uses_the_alignments_rows(spark):
    rows, o = alignment(), Options(sis_window=100, sis_step=10)
    df = spark.createDataFrame([(7, i, r.tolist()) for i, r in enumerate(rows)], "dataset_id long, seq_id int, states array<tinyint>")
    found = [r for r in scan.scan(df, o, ("SISCAN",)).collect() if (r.a, r.b, r.c) == (0, 1, 2)]
    want = windows.siscan(rows[:3], o, None, rows[3])
    assert want and sorted((r.begin, r.end, r.local_p) for r in found) == sorted((c.begin, c.end, c.local_p) for c in want)
    assert not scan.scan(df.filter("seq_id < 3"), o, ("SISCAN",)).count()


def test_registered_scan_has_rows(spark):
    assert catalog.queries()["scan_siscan"](spark, "/root/testdata/sf0.001").count() > 0
