"""A training-text pipeline over ``documents``: five stages, each a filter or rewriting by one operator.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet to the shared folder and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractus.llm.bpe import op9
from tractus.llm.common import discard, table, written
from tractus.llm.decontam import decontaminate
from tractus.llm.jaccard import link
from tractus.llm.langid import UNKNOWN, held_out, identify, sample
from tractus.llm.queries import vocabulary
from tractus.llm.secrets import redact, scan


def _carried(docs: DataFrame) -> DataFrame:
    """_row: all columns of docs as one, so that no stage's names meet the caller's; besides doc_id and text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")


def _unpacked(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of docs again; changed: new values of some."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no learned language is found go: null and empty texts and those without a letter, and all where
    nothing is learned (no row with a language). It learns as op6 does. Repeated rows are judged alike; all columns of docs
    are kept, whatever their names; an empty table gives an empty one. The scores' ties go to the first language, which
    does not matter here."""
    learned = sample(docs.filter(~held_out(5, 0)), "text", "lang", "doc_id")
    return _unpacked(identify(_carried(docs), learned).filter(F.col("lang_pred") != UNKNOWN), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: that with the smallest doc_id, of several rows with this id one with
    the smallest text hash. A null id counts as larger than all others. Rows without words are linked with nothing and
    stay, repeated ones too. Rows with one id and different texts are different documents. All columns of docs are kept,
    whatever their names; an empty table gives an empty one."""
    # Rows are linked by what orders them, so that the smallest of a group is the row that stays.
    rows = _carried(docs).withColumn("_id", F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("h")))
    linked = link(rows.select("_id", "text"), key="_id", shingle=SHINGLE, percent=PERCENT)
    stay = linked.filter("n_shingles = 0 OR _id = component_id").groupBy("_id").agg(((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("_again"))
    stay = stay.select("_again", *[F.col(f"_id.{c}").alias(f"_{c}") for c in "nih"])
    same = (F.col("_id.h") == F.col("_h")) & (F.col("_id.n") == F.col("_n")) & F.col("_id.i").eqNullSafe(F.col("_i"))
    once = rows.join(stay.filter("NOT _again"), same).select("_row", "_id")
    out = _unpacked(once.unionByName(rows.join(stay.filter("_again"), same).select("_row", "_id").dropDuplicates(["_id"])), docs)
    out._written_to = linked._written_to
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go. Null and empty texts, which have no words, stay, as all do where
    the benchmark is empty. Repeated rows are judged alike, all columns of docs kept, whatever their names; an empty table
    gives an empty one."""
    found = decontaminate(_carried(docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(found.filter(F.size("hits") == 0), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay. n_chars, where docs has it, follows the text. Null
    and empty texts have no secrets; repeated rows are treated alike, other columns of docs kept, whatever their names;
    an empty table gives an empty one."""
    rows = redact(scan(_carried(docs)))
    return _unpacked(rows, docs, text=F.col("text"), n_chars=F.coalesce(F.length("text").cast("long"), F.col("_row.n_chars")) if "n_chars" in docs.columns else F.lit(None))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op9's result for each document. Null and empty texts have no tokens; an empty table gives an empty one."""
    return op9(docs, vocabulary())


#: The near-duplicate rule of this pipeline: shingles of five words, similarity 0.8. op8 has its own.
SHINGLE, PERCENT = 5, 80

STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("bpe_codec", encoding),
]

#: Language identification, similarity components and encoding have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        before, docs = docs, written(made, f"pipeline-{name}")
        discard(before, made)
    return STAGES[-1][1](spark, docs, sf_dir)
