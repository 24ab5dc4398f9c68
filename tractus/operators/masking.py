"""Automatic masking: of rows too close to each other, the less useful ones are taken out of a scan."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import ensure


def suggested(identity: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """While four rows or more are left and the closest two are closer than chance allows for so many triplets, one of
    them goes: the one with fewer sites, or, if both are within 5 %, the one that is less distinct from all rows.
    Identical rows: the first three stay."""
    n = len(valid)
    masked = np.zeros(n, bool)
    if n <= 3:
        return masked
    off = ~np.eye(n, dtype=bool)
    if identity[off].min() >= 1 - 1e-7:
        masked[3:] = True
        return masked
    total = (1 - identity).sum(axis=1)
    while (left := int((~masked).sum())) >= 4:
        room = math.comb(left, 3) * length / 30
        if room <= 0.05:
            break
        seen = np.where(off & ~masked[:, None] & ~masked[None, :], identity, -1.0)
        first = int(seen.max(axis=1).argmax())
        second = int(seen[first].argmax())
        if 1 - seen[first, second] >= math.log(room / 0.05) / math.log(4) / length:
            break
        a, b = valid[first], valid[second]
        alike = b > a * 0.95 and a > b * 0.95
        masked[(second if total[first] > total[second] else first) if alike else (second if a > b else first)] = True
    return masked


def auto_mask(sequences: DataFrame) -> DataFrame:
    """dataset_id, seq_id, masked."""
    ensure(sequences.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        d = table.select(["dataset_id", "seq_id", "states"]).sort_by("seq_id").to_pydict()
        s = np.array(d["states"], np.int8)
        here = s > 0
        n = len(s)
        identity = np.ones((n, n), np.float32)
        for i in range(n):
            both = here[i] & here
            common = both.sum(axis=1)
            identity[i] = np.where(common > 0, (both & (s[i] == s)).sum(axis=1) / np.maximum(common, 1), 0)
        np.fill_diagonal(identity, 1)
        masked = suggested(identity, here.sum(axis=1), s.shape[1])
        return pa.table({"dataset_id": d["dataset_id"], "seq_id": pa.array(d["seq_id"], pa.int32()), "masked": pa.array(masked.tolist(), pa.bool_())})

    return sequences.select("dataset_id", "seq_id", "states").groupBy("dataset_id").applyInArrow(run, "dataset_id long, seq_id int, masked boolean")
