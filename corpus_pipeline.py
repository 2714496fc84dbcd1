"""A corpus pipeline: quality rules, toxicity, near duplicates, packing. Part of the training-data subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import jaccard_join, packing, quality_rules, toxicity
from sieveline.llm.common import fresh, read_table, without, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and go. Rows that share a doc_id are judged by their own texts (known by a hash);
    repeated rows go or stay together. Null ids, languages and sources are values like others; columns of any name stay as
    they are; an empty table gives an empty one.
    """
    rejected = written(quality_rules.judged(docs).where("not kept").select("doc_id", "text_hash").distinct(), "rejected")
    name = fresh(docs, "text_hash")
    return without(docs.withColumn(name, quality_rules.text_hash()), rejected.withColumnRenamed("text_hash", name)).select(*docs.columns)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model calls toxic go. It learns from the labelled rows of the documents table.

    Every row is scored by its own whole text, a null text as an empty one; repeated rows go or stay together. Without
    labels or lexicon all rows have the rate of the labels as their score. Columns of any name stay as they are.
    """
    return toxicity.without_toxic(docs, toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words to a shingle, a similarity of 0.8 or more.

    The smallest doc_id of a group stays. Texts without words and rows without id are like no others and stay; of repeated
    rows one stays; rows of one doc_id with different texts are documents of their own. Columns of any name stay as they are.
    """
    return jaccard_join.one_of_each(docs, k=5, num=80, den=100)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens.

    A null or empty text is its end token alone; repeated rows are packed each; other columns play no part; no rows, no pieces.
    """
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("toxicity", harmless), ("near duplicates", near_duplicates), ("packing", packed)]

#: SQL can express neither the learned toxicity model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table, each written and read again for the next.

    What each stage does with nulls, repeated rows, empty tables and other columns is said there; rows that no stage
    rejects reach the last one with all their columns.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
