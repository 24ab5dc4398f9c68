"""Exact probabilities of walks, one for each different walk of a scan.

The chance of a descent depends on the numbers of ups and downs and on its size alone, and triplets share these by the
thousands. So the dynamic program runs once for each different key of a whole scan, and its results are joined back.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ensure
from .kernels import threeseq

KEY = ["plus", "minus", "drop"]


def descent_table(keys: DataFrame) -> DataFrame:
    """plus, minus, drop, p, exact: a row for each different key; p is the chance that a random order of the steps falls by
    drop at least from a maximum, exact where the program is affordable, else Siegmund's approximation. Keys are dealt to
    tasks by their hash, as costs differ."""
    ensure(keys.sparkSession)

    def run(batches):
        for b in batches:
            found = [threeseq.probability(*k) for k in zip(*(b.column(c).to_pylist() for c in KEY), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p for p, _ in found], pa.float64()), pa.array([e for _, e in found], pa.bool_())], names=[*KEY, "p", "exact"])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = keys.select(*[F.col(k).cast("long") for k in KEY]).distinct().repartition(4 * parts, *KEY)
    return once.mapInArrow(run, "plus long, minus long, drop long, p double, exact boolean")


def with_probability(excursions: DataFrame) -> DataFrame:
    """excursions (n_sites, plus and descent of each target's walk) with minus, p and exact."""
    each = excursions.withColumns({"minus": (F.col("n_sites") - F.col("plus")).cast("long"), "plus": F.col("plus").cast("long"), "drop": F.col("descent").cast("long")})
    return each.join(descent_table(each.select(*KEY)), KEY).drop("drop")
