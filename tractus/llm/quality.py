"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java's pattern for the characters that separate words, and for words.
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
#: Frequent function words of the four languages; fixed values of this table.
STOP_WORDS = "the of and to in is that it for de la le les des et que der die und den das el los las en un y".split()


@dataclass(frozen=True)
class Rule:
    """A document fails where numerator / denominator lies outside [low, high]; a denominator of 0 passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The method's thresholds. Names of measures are columns of measures().
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.5),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.4),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", None, 0.3),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.01, None),
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: it is bound as the variable of a one-element transform."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _repeated_words(words: Column) -> Column:
    """Words in windows of REPEAT_WINDOW words that occur twice or more. Window hashes are sorted with their places;
    equal neighbours are compared word by word, and the places of repeated windows are merged from left to right."""
    k = REPEAT_WINDOW

    def marked(order: Column) -> Column:
        n = F.size(order)
        at = lambda i: F.get(order, i)
        twin = lambda i: (at(i)["h"] == at(i + 1)["h"]) & (F.slice(words, at(i)["i"] + 1, k) == F.slice(words, at(i + 1)["i"] + 1, k))
        # Pairs of equal neighbours; each names two places, and a place may be named twice.
        pairs = F.filter(F.sequence(F.lit(0), n - 2), twin)
        places = F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, lambda i: F.array(at(i)["i"], at(i + 1)["i"])))))
        cover = lambda p: F.aggregate(
            p,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct((acc["n"] + i + k - F.greatest(acc["end"], i)).alias("n"), (i + k).alias("end")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(pairs) == 0, F.lit(0).cast("long")).otherwise(let(places, cover))

    def windows(hashes: Column) -> Column:
        span = F.sequence(F.lit(0), F.size(hashes) - k)
        return F.array_sort(F.transform(span, lambda i: F.struct(F.xxhash64(F.slice(hashes, i + 1, k)).alias("h"), i.alias("i"))))

    return F.when(F.size(words) <= k, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), marked)))


def _of_words(words: Column) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        _repeated_words(words).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.array_contains(stop, F.lower(w)))).cast("long").alias("n_stop_words"),
    )


def _of_lines(lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* ") | F.ltrim(x).startswith("• "))).cast("long").alias("n_bullet_lines"),
    )


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures that rules may use; a null text counts as empty. An existing column of such a name is replaced, others stay."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    ws, ls = ((f"{x}_" * (1 + max(map(len, docs.columns)))) for x in "wl")  # longer than any name of docs
    both = docs.withColumn(ws, let(_words(t), _of_words)).withColumn(ls, let(lines, _of_lines))
    return both.withColumns(
        {n: F.col(f"{ws}.{n}") for n in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")}
        | {n: F.col(f"{ls}.{n}") for n in ("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines")}
        | {"n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")}
    ).drop(ws, ls)


def compiled(rules=RULES) -> Column:
    """One boolean column: whether all rules hold."""
    out = F.lit(True)
    for r in rules:
        n, d = F.col(r.numerator).cast("double"), F.col(r.denominator)
        ok = F.lit(True)
        if r.low is not None:
            ok &= n >= F.lit(r.low) * d
        if r.high is not None:
            ok &= n <= F.lit(r.high) * d
        out &= (d == 0) | ok
    return out


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Adds the measures, base_failed and kept. Base: under 20 words, or over 30 % of the words in repeated windows.

    Null and empty texts have no words and so fail. Rows are independent, so ties and repeated rows need no rule.
    """
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return measures(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def op3(docs: DataFrame) -> DataFrame:
    out = judge(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM p) GROUP BY r),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             len(list_filter(ls, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ell,
             len(list_filter(ls, lambda x: ltrim(x) LIKE '- %' OR ltrim(x) LIKE '* %' OR ltrim(x) LIKE '• %')) AS n_bul,
             len(list_filter(ws, lambda x: list_contains([{stop}], lower(x)))) AS n_stop
      FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 15.0 * n_words AND n_symbols <= 0.5 * n_words
       AND n_dup_lines <= 0.4 * n_lines AND n_ell <= 0.3 * n_lines AND n_bul <= 0.9 * n_lines AND n_stop >= 0.01 * n_words AS kept
FROM b
""".replace("{stop}", ", ".join(f"'{w}'" for w in STOP_WORDS))
