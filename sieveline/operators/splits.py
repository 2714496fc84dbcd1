"""Frozen, hash-based, stratified splits that do not move when the pool grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_bucket


def canonical_groups(rows: DataFrame, key: str, row_id: str, stratum: str, salt: str, stored: str | None = None) -> DataFrame:
    """One row a group of equal keys: its smallest id, that row's stratum and stored split (train, if none is stored), its size and its bucket."""
    kept = F.min_by(stored, row_id) if stored else F.lit("train")
    groups = rows.groupBy(key).agg(F.min(row_id).alias("canonical_id"), F.min_by(stratum, row_id).alias("stratum"), kept.alias("stored"), F.count(F.lit(1)).alias("members"))
    return groups.withColumn("bucket", hash_bucket("canonical_id", salt))


def thresholds(groups: DataFrame, frozen: DataFrame | None = None, test_share: float = 0.1, dev_share: float = 0.1) -> DataFrame:
    """stratum, test_threshold, dev_width in buckets of ten thousand; strata in `frozen` keep what they have.

    The test target is a share of all groups, spread evenly over strata: a stratum's threshold is its part of the target
    over its own share of groups, at most everything.
    """
    counts = groups.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("strata"))
    share = F.col("n") / F.col("total")
    limit = lambda target: F.least(F.bround(target / F.col("strata") / share * 10_000), F.lit(10_000)).cast("long")
    new = counts.crossJoin(F.broadcast(whole)).select("stratum", limit(test_share).alias("test_threshold"), limit(dev_share).alias("dev_width"))  # whole is one row
    if frozen is None:
        return new
    old = frozen.select("stratum", F.col("test_threshold").alias("old_test"), F.col("dev_width").alias("old_dev"))
    return new.join(old, "stratum", "full").select("stratum", F.coalesce("old_test", "test_threshold").alias("test_threshold"), F.coalesce("old_dev", "dev_width").alias("dev_width"))


def assigned(groups: DataFrame, limits: DataFrame) -> DataFrame:
    """Groups with split: test below the threshold if the stored split is train, dev below threshold and width, else train."""
    split = F.when((F.col("stored") == "train") & (F.col("bucket") < F.col("test_threshold")), "test").when(F.col("bucket") < F.col("test_threshold") + F.col("dev_width"), "dev").otherwise("train")
    return groups.join(limits, "stratum").withColumn("split", split)


def split_rows(rows: DataFrame, key: str, row_id: str, stratum: str, salt: str, frozen: DataFrame | None = None, stored: str | None = None) -> DataFrame:
    """rows with stratum and split of their group; rows of one key share a split. stored: a column with an earlier split."""
    groups = canonical_groups(rows, key, row_id, stratum, salt, stored)
    found = assigned(groups, thresholds(groups, frozen)).select(F.col(key).alias("group_key"), F.col("stratum").alias("group_stratum"), "split")
    return rows.join(found, F.col(key).eqNullSafe(F.col("group_key"))).drop("group_key")


def crossing_keys(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split (none, if the split is sound)."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def standardised_difference(rows: DataFrame, value: str, split: str = "split", base: str = "train", flag: float = 0.1) -> DataFrame:
    """Per other split: |difference of means| over the pooled population deviation; 0 where both are constant."""
    stats = rows.groupBy(split).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    first = stats.where(F.col(split) == base).select(F.col("mean").alias("base_mean"), F.col("var").alias("base_var"))
    spread = F.sqrt((F.col("var") + F.col("base_var")) / 2)
    smd = F.when(spread == 0, F.lit(0.0)).otherwise(F.abs(F.col("mean") - F.col("base_mean")) / spread)
    return stats.where(F.col(split) != base).crossJoin(F.broadcast(first)).select(split, smd.alias("smd")).withColumn("flagged", F.col("smd") >= flag)  # first is one row
