"""Alignments as relations: ``sequences`` (one row a sequence, states as an array) and ``cells`` (one row a site).

A corpus of alignments is keyed by ``dataset_id``; everything that compares sequences stays within one data set, so the
work grows with the number of alignments, and a data set is the unit that is dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: States: 0 missing, 1 A, 2 C, 3 G, 4 T or U.
BASES = "ACGT"
#: Sequences of one data set in alignments that are derived from vectors.
ROWS_PER_DATASET = 10


def encode_base(c: Column) -> Column:
    """State of one residue; letters of either case, U as T, all else missing."""
    u = F.upper(c)
    return F.when(u == "A", 1).when(u == "C", 2).when(u == "G", 3).when(u.isin("T", "U"), 4).otherwise(0).cast("tinyint")


def encode_sequence(seq: Column) -> Column:
    """States of all residues, in order."""
    digits = F.translate(F.upper(seq), "ACGTU", "12344")
    return F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: F.when(c.isin("1", "2", "3", "4"), c.cast("tinyint")).otherwise(F.lit(0).cast("tinyint")))


def sequence_fragment(text: Column) -> Column:
    """Keeps letters, in upper case, and the signs - . ? ! *"""
    return F.upper(F.regexp_replace(text, "[^A-Za-z.?!*-]", ""))


def from_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset_id, seq_id, vec_id, label, states: a vector's numbers fall into four bands, one a state, and an arithmetic
    rule leaves gaps. All rows of the table are used."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")

    def state(x, i):
        d = x.cast("double")
        gap = (F.col("vec_id") * 7 + (i + 1) * 13) % 17 == 0
        return F.when(gap, 0).when(d < -0.085, 1).when(d < 0, 2).when(d < 0.085, 3).otherwise(4).cast("tinyint")

    return v.select(
        F.floor(F.col("vec_id") / ROWS_PER_DATASET).cast("long").alias("dataset_id"),
        (F.col("vec_id") % ROWS_PER_DATASET).cast("int").alias("seq_id"),
        "vec_id",
        "label",
        F.transform("embedding", state).alias("states"),
    )


def cells(sequences: DataFrame) -> DataFrame:
    """One row for each site, pos from 1."""
    names = [c for c in sequences.columns if c != "states"]
    return sequences.select(*names, F.posexplode("states").alias("i", "st")).select(*names, (F.col("i") + 1).cast("int").alias("pos"), "st")
