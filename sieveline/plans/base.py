"""Shared inputs of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and the assistant turns that follow them: conv_id, turn, source, output."""
    c = table(spark, sf_dir, "conversations")
    users = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    replies = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return users.join(replies, ["conv_id", "turn"])


PAIRS_SQL = "(select u.conv_id, u.turn, u.text as source, a.text as output from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score: doc_id, score (length), quality, toxic, lang, source."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"), "lang", "source")
    return d.join(table(spark, sf_dir, "labels"), "doc_id")


JUDGED_SQL = "(select d.doc_id, d.n_chars as score, d.lang, d.source, l.quality, l.toxic from documents d join labels l using (doc_id))"


def r6(c, name: str):
    """A double rounded to six digits, for comparison with other engines."""
    return F.round(c, 6).alias(name)
