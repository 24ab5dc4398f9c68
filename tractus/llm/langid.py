"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from a bounded number of labelled rows, with their whole texts. A text is
cross-parsed against each automaton: from a position the longest match is one phrase, whatever words it spans, and the
parse goes on after it. With c phrases over n symbols and a sample of m symbols, c * log2(m) / n estimates the
cross-entropy, so the language with the fewest normalised phrases wins. Texts are parsed as their words in lower case
with single spaces between, from the first to the last.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, bounded_batches, resident

WORD = re.compile(r"[^\W\d_]+")
#: The labelled sample: rows of each language, those of at most so many characters before longer ones.
SAMPLE_ROWS, ROW_CHARS = 24, 6_000
#: Words that are put together and parsed at a time; the parse goes on from one such part to the next.
PART_WORDS = 50_000
UNKNOWN = "und"


class SuffixAutomaton:
    """Blumer's construction: states with one dict of transitions, suffix links and longest lengths."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for ch in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

        # From here on a state is the dict of its transitions, which lead to such dicts.
        for moves in self.next:
            for ch, to in moves.items():
                moves[ch] = self.next[to]
        self.root = self.next[0]

    def phrases(self, text: str, state: dict | None = None) -> tuple[int, dict]:
        """Longest matches that end in the text, and the state of the one that has not ended (the root: none); a symbol
        that the sample lacks is a phrase of its own."""
        root, count = self.root, 0
        now = root if state is None else state
        for ch in text:
            if ch in now:
                now = now[ch]
            else:
                count += now is not root
                if ch in root:
                    now = root[ch]
                else:
                    count += 1
                    now = root
        return count, now


def parsed(text: str):
    """The text as it is parsed, in parts that follow each other."""
    words = WORD.findall(text.lower())
    for a in range(0, len(words), PART_WORDS):
        yield ("" if a else " ") + " ".join(words[a : a + PART_WORDS]) + " "


class Model:
    """samples: language -> texts. Ties go to the language that sorts first. A language whose samples have no letter is
    not learned."""

    def __init__(self, samples: dict[str, list[str]]):
        text = {k: "".join(x for t in v for x in parsed(t)) for k, v in samples.items()}
        self.langs = sorted(k for k in text if text[k].strip())
        self.automata = [SuffixAutomaton(text[k]) for k in self.langs]
        self.bits = np.array([math.log2(max(4, len(text[k]))) for k in self.langs])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        count, states = np.zeros(len(self.langs), np.int64), [None] * len(self.langs)
        for part in parsed(text):
            for i, a in enumerate(self.automata):
                n, states[i] = a.phrases(part, states[i])
                count[i] += n
        cost = (count + [s is not a.root for s, a in zip(states, self.automata)]) * self.bits
        best = int(cost.argmin())
        return self.langs[best], float(1 - cost[best] / np.partition(cost, 1)[1])


def sample(labelled: DataFrame, text: str, lang: str, key: str, rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """Whole texts of at most rows labelled rows of each language: those of at most ROW_CHARS characters first, and of
    these those of the smallest hashes of key and text. The languages are few, so what reaches the driver is bounded."""
    order = Window.partitionBy("l").orderBy("long", "h", "k")
    kept = (
        labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(lang).cast("string").alias("l"), F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.xxhash64(key, text).alias("h"), (F.length(text) > ROW_CHARS).alias("long"))
        .withColumn("i", F.row_number().over(order))
        .filter(F.col("i") <= rows)
    )
    out: dict[str, list[str]] = {}
    for r in sorted(kept.select("l", "i", "t").collect()):
        out.setdefault(r.l, []).append(r.t)
    return out


def identify(docs: DataFrame, samples: dict[str, list[str]], text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1: how much cheaper the parse is than that of the second-best language).

    Null texts and texts without a letter are UNKNOWN with score 0, as is every text where nothing was learned; with
    one learned language each text with a letter is that one with score 1. Rows are independent, other columns kept.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index(text)
    learned = docs.sparkSession.sparkContext.broadcast(samples)  # SAMPLE_ROWS texts a language

    def run(batches):
        model = resident(("langid", hash(repr(sorted(learned.value.items())))), lambda: Model(learned.value))
        for b in batches:
            found = [model.predict(t) for t in b.column(at).to_pylist()]
            cols = [b.column(i) for i in range(b.num_columns)]
            cols += [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, ", ".join([*arrow_schema(docs, names), "lang_pred string", "score double"]))


def held_out(mod: int, remainder: int):
    """crc32(doc_id as text) mod ...; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod == remainder


def op6(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(5, 0))
    return identify(rows.drop("lang"), sample(rows.filter(~F.col("held_out")), "text", "lang", "doc_id")).select("doc_id", "held_out", "lang_pred", "score")
