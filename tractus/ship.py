"""Sends this package to the executors, so that Python workers can import it on any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ensure(spark: SparkSession) -> None:
    """Adds the package to the context's Python files, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tractus_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tractus-py-"), "tractus_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tractus", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tractus_shipped = True
