"""Sinks: event tables as CSV and alignments as FASTA, written in parallel; the gate before event-derived exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import latest_decisions


def ready(events: DataFrame, decisions: DataFrame) -> None:
    """Raises where an event is not decided yet, or there is none."""
    state = events.join(latest_decisions(decisions), "event_id", "left").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("state"), F.lit("")).isin("accepted", "rejected")).alias("done")).first()
    if not state.n:
        raise ValueError("there are no events to export")
    if state.done < state.n:
        raise ValueError(f"{state.n - state.done} events are not decided")


def write_csv(events: DataFrame, path: str) -> None:
    events.write.option("header", True).csv(path)


def write_fasta(records: DataFrame, path: str) -> None:
    """records: a column ``record`` with header and sequence. An empty result is an error."""
    if records.limit(1).count() == 0:
        raise ValueError("no sequences are left to export")
    records.select("record").write.text(path)


def stem(filename: str) -> str:
    """A file's name without folder and last ending."""
    base = filename.replace("\\", "/").rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[0] if "." in base[1:] else base
