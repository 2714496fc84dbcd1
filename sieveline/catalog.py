"""Every query of the library outside the training-data subpackage, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics_queries, curation_queries, judging_queries, text_queries

_PLANS = (text_queries, curation_queries, analytics_queries, judging_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for p in _PLANS for k, q in p.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.conversation_measures(spark, sf_dir)
