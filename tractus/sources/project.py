"""Projects: an alignment with its settings, events and review state as one JSON document, with a version."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3
#: What each older version lacks, with the value that it gets.
ADDED = {2: {"row_state": "enabled"}, 3: {"ref_group": 0}}
STATES = ("enabled", "masked", "disabled")
DECISIONS = ("undecided", "accepted", "rejected")


def document(name: str, sequences: list[dict], events: list[dict], options: dict) -> str:
    return json.dumps({"version": VERSION, "name": name, "sequences": sequences, "events": events, "options": options}, sort_keys=True)


def migrated(doc: dict) -> dict:
    """The document in the present version; a missing or unknown version, too few rows, rows of different lengths, or an
    unknown state is an error."""
    version = doc.get("version")
    if not isinstance(version, int) or not 1 <= version <= VERSION:
        raise ValueError(f"version {version} is not supported")
    rows = doc.get("sequences") or []
    if len(rows) < 3 or len({len(r["seq"]) for r in rows}) != 1:
        raise ValueError("a project needs three sequences or more of one length")
    for v in range(version + 1, VERSION + 1):
        for r in rows:
            for k, value in ADDED[v].items():
                r.setdefault(k, value)
    if any(r["row_state"] not in STATES for r in rows) or any(e.get("state", "undecided") not in DECISIONS for e in doc.get("events", [])):
        raise ValueError("unknown state")
    return doc | {"version": VERSION, "sequences": rows, "events": doc.get("events", []), "options": doc.get("options", {})}


def documents(sequences: DataFrame) -> DataFrame:
    """value: one document for each data set, dataset_id, version and its rows."""
    row = F.struct("seq_id", "name", "seq", "row_state", "ref_group")
    docs = sequences.groupBy("dataset_id").agg(F.array_sort(F.collect_list(row)).alias("sequences")).withColumn("version", F.lit(VERSION))
    return docs.select(F.to_json(F.struct("version", "dataset_id", "sequences")).alias("value"))


def parsed(texts: DataFrame) -> DataFrame:
    """Rows of all documents in column value; fields that an older version lacks get their defaults."""
    schema = "version int, dataset_id long, sequences array<struct<seq_id:int,name:string,seq:string,row_state:string,ref_group:int>>"
    d = texts.select(F.from_json("value", schema).alias("d")).filter(F.col("d.version").between(1, VERSION))
    rows = d.select("d.dataset_id", F.inline("d.sequences"))
    return rows.withColumns({"row_state": F.coalesce("row_state", F.lit(ADDED[2]["row_state"])), "ref_group": F.coalesce("ref_group", F.lit(ADDED[3]["ref_group"]))})


def save(sequences: DataFrame, path: str) -> None:
    """The documents, one a line, written in parallel."""
    documents(sequences).write.text(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))
