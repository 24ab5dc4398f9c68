"""Project documents of versions 1 to 19 as relations: a chain of projections by version, and a reject for what cannot be read."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.events import METHOD_ORDER

NEWEST = 19
# The field that switches a method, the version that brought it, and whether it is on where that version or
# a later one does not say.
SWITCHES = {
    "MaxChi": ("maxChiEnabled", 10, True),
    "CHIMAERA": ("chimaeraEnabled", 12, True),
    "GENECONV": ("geneconvEnabled", 13, True),
    "3SEQ": ("threeSeqEnabled", 14, True),
    "BootScan": ("bootscanPrimaryEnabled", 17, False),
    "SISCAN": ("siscanPrimaryEnabled", 19, False),
}
# Settings that a document may lack.
SETTINGS = {"circular": True, "correction": "bonferroni", "pValueCutoff": 0.05, "windowSites": 30, "maxChiWindowSites": 70, "chimaeraWindowSites": 60, "bootscanWindowSites": 200, "bootscanStepSites": 20, "siscanWindowSites": 200, "siscanStepSites": 20}
#: Query and reference groups, and thus the mode of analysis, came with this version.
GROUPS_FROM = 11
REVIEW_STATES = ("pending", "accepted", "rejected")

_TYPES = {bool: "boolean", str: "string", float: "double", int: "int"}
_EVENT = "recombinant int, majorParent int, minorParent int, beginning int, ending int, reviewState string, detectionRound int, anchorSignalId int, supportSignalIds array<int>, coRecombinantSequenceIndices array<int>"
_ANALYSIS = [f"{k} {_TYPES[type(v)]}" for k, v in SETTINGS.items()] + [f"{f} boolean" for f, *_ in SWITCHES.values()]
_ANALYSIS += ["analysisMode string", *[f"{x} array<int>" for x in ("maskedSequenceIndices", "disabledSequenceIndices", "referenceGroupIndices")]]
_ANALYSIS += ["downstreamReconciliationRequiredAfter int", "signals array<struct<method string>>", f"events array<struct<{_EVENT}>>"]
DOCUMENT = f"schema string, sourceFilename string, dataset struct<sequences array<struct<name string, sequence string>>>, analysis struct<{', '.join(_ANALYSIS)}>, _bad string"


class Imported(NamedTuple):
    """projects: key, version, name, methods, mode and the settings. sequences: key, seq_id, name, seq, row_state, ref_group.
    events: key, event_id, its fields, members. rejects: key, reason."""

    projects: DataFrame
    sequences: DataFrame
    events: DataFrame
    rejects: DataFrame


def parsed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, version, reason (null if the document can be read) and the document's parts. Only the end of the schema's name
    tells the version."""
    # The corrupt-record field is found in the parsed value, which must therefore be whole.
    d = texts.select(F.col(key), F.from_json(text, DOCUMENT, {"columnNameOfCorruptRecord": "_bad"}).alias("d")).select(key, "d.*")
    d = d.withColumn("version", F.try_to_number(F.regexp_extract("schema", "/v1alpha([0-9]{1,3})$", 1), F.lit("999")).cast("int"))
    return d.withColumn("reason", _reason())


def _reason() -> Column:
    """The first rule that a document breaks."""
    seqs, events, signals = F.col("dataset.sequences"), F.col("analysis.events"), F.col("analysis.signals")
    n, marker = F.size(seqs), F.coalesce("analysis.downstreamReconciliationRequiredAfter", F.lit(-1))
    known = [m.upper() for m in METHOD_ORDER]
    row = lambda x: x.isNotNull() & (x >= 0) & (x < n)
    whole = lambda e: row(e["recombinant"]) & row(e["majorParent"]) & row(e["minorParent"]) & e["beginning"].isNotNull() & e["ending"].isNotNull()
    anchored = lambda e: F.coalesce(e["anchorSignalId"], F.lit(-1)) < F.coalesce(F.size(signals), F.lit(0))
    rules = {
        "not JSON": F.col("_bad").isNotNull() | (F.col("schema").isNull() & seqs.isNull()),
        "unknown version": ~F.coalesce(F.col("version").between(1, NEWEST), F.lit(False)),
        "no alignment": seqs.isNull(),
        "fewer than three sequences": n < 3,
        "sequence without name or data": F.exists(seqs, lambda s: s["name"].isNull() | s["sequence"].isNull()),
        "sequences of different lengths": F.size(F.array_distinct(F.transform(seqs, lambda s: F.length(s["sequence"])))) > 1,
        "no signals": F.col("analysis").isNotNull() & signals.isNull(),
        "unknown method": F.exists(signals, lambda s: s["method"].isNull() | ~F.upper(s["method"]).isin(known)),
        "marker of an unknown event": marker >= F.greatest(F.coalesce(F.size(events), F.lit(0)), F.lit(0)),
        "event of unknown rows or signals": F.exists(events, lambda e: ~(whole(e) & anchored(e))),
        "unknown review state": F.exists(events, lambda e: ~F.coalesce(e["reviewState"], F.lit("pending")).isin(*REVIEW_STATES)),
    }
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])


def migrated(documents: DataFrame) -> DataFrame:
    """Readable documents in the newest version: methods that a version did not have yet are off, then missing fields get their
    defaults, and events behind one that was changed last are dropped, as they must be found anew."""
    d = documents.filter("reason IS NULL")
    steps: dict[int, list[str]] = {}
    for field, since, _ in SWITCHES.values():
        steps.setdefault(since, []).append(field)
    d = d.withColumns({f: F.col(f"analysis.{f}") for f, *_ in SWITCHES.values()}).withColumns({"mode": F.col("analysis.analysisMode"), "groups": F.col("analysis.referenceGroupIndices"), "now": F.col("version")})
    for since in sorted({*steps, GROUPS_FROM, NEWEST}):
        older = F.col("now") < since
        d = d.withColumns({f: F.when(~older, F.col(f)).otherwise(F.lit(False)) for f in steps.get(since, [])})
        if since == GROUPS_FROM:
            d = d.withColumns({"mode": F.when(~older, F.col("mode")), "groups": F.when(~older, F.col("groups"))})
    d = d.withColumns({f: F.coalesce(f, F.lit(on)) for f, _, on in SWITCHES.values()}).withColumns({k: F.coalesce(f"analysis.{k}", F.lit(v)) for k, v in SETTINGS.items()})
    methods = F.array_compact(F.array(F.lit("RDP"), *[F.when(F.col(f), F.lit(m)) for m, (f, *_) in SWITCHES.items()]))
    marker = F.coalesce("analysis.downstreamReconciliationRequiredAfter", F.lit(-1))
    kept = F.when(marker >= 0, F.slice("analysis.events", 1, marker + 1)).otherwise(F.col("analysis.events"))
    return d.withColumns({"methods": methods, "events": kept, "mode": F.coalesce("mode", F.lit("exploratory"))}).drop("now")


def imported(texts: DataFrame, key: str, text: str) -> Imported:
    """All parts of the documents in column text. A document is in projects or in rejects; null texts are rejected."""
    documents = parsed(texts, key, text)
    d = migrated(documents)
    rows = d.select(key, "groups", "analysis.maskedSequenceIndices", "analysis.disabledSequenceIndices", F.posexplode("dataset.sequences").alias("seq_id", "s"))
    listed = lambda x: F.coalesce(F.array_contains(x, F.col("seq_id")), F.lit(False))
    state = F.when(listed("disabledSequenceIndices"), "disabled").when(listed("maskedSequenceIndices"), "masked").otherwise("enabled")
    sequences = rows.select(key, "seq_id", "s.name", F.col("s.sequence").alias("seq"), state.alias("row_state"), F.coalesce(F.try_element_at("groups", F.col("seq_id") + 1), F.lit(0)).alias("ref_group"))
    events = d.select(key, F.posexplode("events").alias("event_id", "e")).select(
        key, "event_id", "e.recombinant", F.col("e.majorParent").alias("major"), F.col("e.minorParent").alias("minor"), F.col("e.beginning").alias("begin"), F.col("e.ending").alias("end"),
        F.coalesce("e.reviewState", F.lit("pending")).alias("state"), F.coalesce("e.detectionRound", F.col("event_id") + 1).alias("round"),
        F.coalesce("e.coRecombinantSequenceIndices", F.array().cast("array<int>")).alias("members"))
    projects = d.select(key, "version", F.col("sourceFilename").alias("name"), "methods", "mode", *SETTINGS)
    return Imported(projects, sequences, events, documents.filter("reason IS NOT NULL").select(key, "reason"))
