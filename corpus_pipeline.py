"""A corpus from raw documents: language, exact copies, near copies, benchmark leaks, mix.

STAGES are applied in order, each to all rows that the one before it kept.  The first four return
the columns of documents; the last returns the mix: doc_id, source, size, source_size, target and
taken of the documents that it takes words of.

Defined results, for every stage: an empty table gives an empty one; further columns, whatever their
names, come through the filtering stages unchanged; rows that repeat are rows of their own until the
stage that drops copies, where exactly one stays.  Null and empty texts go in the first stage, since
they have no language; given to a later stage alone, they count as empty texts, of which one stays, and
have no shingles, no leaks and size 0.  A null id is lower than any other among exact copies and higher
among near ones; ties of ids go by the rows' places in their files.  A null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readingforge.llm import decontam, exact_dedup, langid, mixing, neardup, oracle
from readingforge.llm.common import table, written

#: A document has a language if it has a letter, and near copies are found by comparing all pairs.
ORACLE_SQL = oracle.PIPELINE


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no text, no letters) go; where `lang` is null, the
    others get the language that their text is identified as."""
    return langid.label_languages(docs, langid.learn(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays."""
    return neardup.drop_near_duplicates(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; documents that it takes nothing of go."""
    out = mixing.mix(docs).filter(F.col("taken") > 0)
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language", identified),
    ("exact_copies", without_copies),
    ("near_copies", without_near_copies),
    ("benchmark_leaks", without_leaks),
    ("mix", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
