"""Tables between the rounds of a loop: written to the folder that driver and executors share, so lineage ends there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Tables of settled groups that are written as one.
FOLD = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session that has none gets one here; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tractus-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/tractus-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


def settled(start: DataFrame, step: Callable[[DataFrame], DataFrame], name: str, most: int) -> DataFrame:
    """The fixed point of step, in rounds of written tables.

    step(rows) has the columns of rows and changed, which is one value for all rows of a group that step treats apart. Groups
    that a round leaves as they were are done and not worked on again. Rows that still change after `most` rounds are an error.
    """
    done, rows = [], start
    for _ in range(most):
        new = written(step(rows), name)
        done.append(new.filter("NOT changed").drop("changed"))
        rows = new.filter("changed").drop("changed")
        if rows.isEmpty():
            break
        if len(done) == FOLD:
            done = [written(_union(done), name)]
    else:
        if not rows.isEmpty():
            raise RuntimeError(f"{name}: not settled after {most} rounds")
    return _union(done or [start])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
