"""One alignment in six formats, and what is wrong with files."""

import pytest

from tractus.sources import readers

SEQS = [("one", "ACGTACGTAC"), ("two", "ACGTACGA-C"), ("three", "ACGTTCGAAC")]
TEXTS = {
    "FASTA": "\n" + "".join(f">{n} note\n;comment\n{s[:4]}\n{s[4:].lower()}\n" for n, s in SEQS),
    "GDE": "".join(f"%{n}\n{s}\n" for n, s in SEQS),
    "CLUSTAL": "CLUSTAL W\n\n" + "".join(f"{n}   {s[:6]}\n" for n, s in SEQS) + "      *** *\n\n" + "".join(f"{n}   {s[6:]} 10\n" for n, s in SEQS),
    "MEGA": "#mega\n!Title x;\n" + "".join(f"#{n} {s[:5]}\n{s[5:]}\n" for n, s in SEQS),
    "NEXUS": "#NEXUS\nbegin data;\n[note]\nmatrix\n'one' ACGTACGTAC\n\"two\" ACGTACGA-C\nthree ACGTTCGAAC\n;\nend;",
    "PHYLIP": "3 10\n" + "".join(f"{n} {s[:5]}\n" for n, s in SEQS) + "\n" + "".join(f"{s[5:]}\n" for _, s in SEQS),
}


@pytest.mark.parametrize("kind", TEXTS)
def test_formats(kind):
    assert readers.parse(TEXTS[kind]) == (kind, SEQS, None)


def test_sequential_phylip_and_windows_line_ends():
    text = "3 10\r\n" + "".join(f"{n} {s[:4]}\r\n{s[4:8]}\r\n{s[8:]}\r\n" for n, s in SEQS)
    assert readers.parse(text) == ("PHYLIP", SEQS, None)


def test_problems():
    assert readers.parse("\n \n")[2]
    assert readers.parse("hello")[2] == readers.UNKNOWN
    assert "three sequences" in readers.parse(">a\nAC\n>b\nAC\n")[2]
    assert "(c)" in readers.parse(">a\nAC\n>b\nAC\n>c\nA\n")[2]
    assert [n for n, _ in readers.parse(">x\nAC\n>x\nAC\n>x\nAA\n")[1]] == ["x", "x", "x"]


def test_files(spark, tmp_path):
    for k, t in TEXTS.items():
        (tmp_path / f"{k}.txt").write_text(t)
    (tmp_path / "bad.txt").write_text("nothing")
    rows = readers.read_alignments(spark, str(tmp_path)).collect()
    assert len(rows) == 3 * len(TEXTS) + 1
    assert {r.format for r in rows if r.error is None} == set(TEXTS)
    assert sum(r.error is not None for r in rows) == 1
