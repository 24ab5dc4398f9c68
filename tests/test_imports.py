"""Project documents of every version, and each reason for a reject."""

import json

import pytest

from tractus.sources import imports as I

FIELDS = {"maxChiEnabled": 10, "chimaeraEnabled": 12, "geneconvEnabled": 13, "threeSeqEnabled": 14, "bootscanPrimaryEnabled": 17, "siscanPrimaryEnabled": 19}
NAMES = dict(zip(FIELDS, ("MaxChi", "CHIMAERA", "GENECONV", "3SEQ", "BootScan", "SISCAN"), strict=True))


def doc(version, analysis=None, sequences=("ACGT", "AC-T", "ACGA", "TTTT"), **more):
    out = {"schema": f"any.project/v1alpha{version}", "dataset": {"sequences": [{"name": f"s{i}", "sequence": s} for i, s in enumerate(sequences)]}}
    return out | ({} if analysis is None else {"analysis": {"signals": [{"method": "RDP"}], **analysis}}) | more


def event(**more):
    return {"recombinant": 0, "majorParent": 1, "minorParent": 2, "beginning": 2, "ending": 3, "anchorSignalId": 0} | more


def read(spark, docs):
    texts = [(k, d if d is None or isinstance(d, str) else json.dumps(d)) for k, d in docs.items()]
    return I.imported(spark.createDataFrame(texts, "key string, text string"), "key", "text")


def test_every_version(spark):
    docs = {f"{v}{x}": doc(v, dict.fromkeys(FIELDS, True) | {"analysisMode": "query-reference", "referenceGroupIndices": [1, 2]} if x == "all" else {}) for v in range(1, 20) for x in ("all", "none")}
    out = read(spark, docs)
    assert out.rejects.count() == 0
    for r in out.projects.collect():
        says = r.key.endswith("all")
        assert r.version == int(r.key.removesuffix("all").removesuffix("none"))
        assert r.methods == ["RDP", *[NAMES[f] for f, since in FIELDS.items() if r.version >= since and (says or since < 17)]]
        assert r.mode == ("query-reference" if says and r.version >= 11 else "exploratory")
        assert (r.windowSites, r.pValueCutoff, r.circular) == (30, 0.05, True)
    groups = {(r.key, r.seq_id): r.ref_group for r in out.sequences.collect()}
    assert groups["10all", 0] == 0 and [groups["11all", i] for i in range(4)] == [1, 2, 0, 0]


def test_states_and_events(spark):
    events = [event(), event(reviewState="accepted", detectionRound=7, coRecombinantSequenceIndices=[3]), event()]
    held = {"maskedSequenceIndices": [1, 2], "disabledSequenceIndices": [2], "events": events, "circular": False}
    out = read(spark, {"a": doc(19, held), "b": doc(19, held | {"downstreamReconciliationRequiredAfter": 1}), "c": doc(3)})
    assert [r.row_state for r in out.sequences.filter("key = 'a'").orderBy("seq_id").collect()] == ["enabled", "masked", "disabled", "enabled"]
    got = {(r.key, r.event_id): (r.state, r["round"], r.members) for r in out.events.collect()}
    assert got == {(k, i): (("pending", i + 1, []), ("accepted", 7, [3]))[i == 1] for k, n in (("a", 3), ("b", 2)) for i in range(n)}
    assert out.projects.filter("NOT circular").count() == 2


@pytest.mark.parametrize(("reason", "text"), [
    ("not JSON", "{"), ("not JSON", None), ("not JSON", ""), ("unknown version", doc(20)), ("unknown version", doc(0)), ("unknown version", doc("1b")),
    ("no alignment", {"schema": "x/v1alpha3"}), ("fewer than three sequences", doc(2, sequences=("A", "C"))),
    ("sequences of different lengths", doc(2, sequences=("A", "C", "GG"))), ("sequence without name or data", doc(2, sequences=("A", "C", None))),
    ("no signals", doc(4, {"signals": None})), ("unknown method", doc(4, {"signals": [{"method": "Guess"}]})),
    ("marker of an unknown event", doc(5, {"downstreamReconciliationRequiredAfter": 0})), ("event of unknown rows or signals", doc(5, {"events": [event(recombinant=4)]})),
    ("event of unknown rows or signals", doc(5, {"events": [event(anchorSignalId=1)]})), ("unknown review state", doc(5, {"events": [event(reviewState="maybe")]})),
])
def test_rejects(spark, reason, text):
    out = read(spark, {"bad": text, "good": doc(1)})
    assert [tuple(r) for r in out.rejects.collect()] == [("bad", reason)]
    assert [r.key for r in out.projects.collect()] == ["good"] and out.sequences.filter("key = 'bad'").count() == 0
