"""As-of and band lookups, runs of failures, and duration statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.reading import sentence_ranges
from .prefix import quantiles, same


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, start: str, values: list[str]) -> DataFrame:
    """left with the values of right's last row of the same key that starts at or before `at`; null before the first.

    One union sorted by (key, time): no row meets more than its predecessor, whatever the number of matches. Of rows
    that start at once, the one with the largest values counts.
    """
    taken = F.struct(*values)
    l = left.select(F.col(by).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(taken).schema[0].dataType).alias("_v"))  # noqa: E741
    r = right.select(F.col(by).alias("_k"), F.col(start).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), taken.alias("_v"))
    order = Window.partitionBy("_k").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_found", F.last("_v", ignorenulls=True).over(order))
    return both.where("_side = 1").select("_row.*", *(F.col(f"_found.{v}").alias(v) for v in values))


def sentence_at(positions: DataFrame, key: str, position: str, texts: DataFrame, text: str) -> DataFrame:
    """positions (key, position) with the start and stop of the sentence of their text that is read at this place: the last
    one that starts at or before it; null before the first and for unknown texts."""
    ranges = texts.select(key, F.explode(sentence_ranges(text)).alias("s")).select(key, F.col("s.start").alias("_start"), F.col("s.start").alias("start"), F.col("s.stop").alias("stop"))
    return as_of(positions, ranges, key, position, "_start", ["start", "stop"])


def band(items: DataFrame, by: str, order: str, weight: str, lookups: DataFrame, fraction: str) -> DataFrame:
    """lookups with the first item of their key whose running weight reaches fraction * total."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = items.groupBy(by).agg(F.sum(weight).alias("_total"))
    run = items.withColumn("_upto", F.sum(weight).over(w)).select(by, F.col(order).alias("_item"), "_upto")
    hit = lookups.join(total, by).join(run, by).where(F.col("_upto") >= F.col(fraction) * F.col("_total"))
    return hit.groupBy(*lookups.columns).agg(F.min("_item").alias("item"))


def stop_after_failures(rows: DataFrame, by: str, order: str, failed: str, limit: int) -> DataFrame:
    """Rows up to the one that makes `limit` failures in a row; later ones go (gaps and islands)."""
    w = Window.partitionBy(by).orderBy(order)
    island = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w)
    streak = F.sum(F.col(failed).cast("int")).over(Window.partitionBy(by, "_island").orderBy(order))
    marked = rows.withColumn("_island", island).withColumn("_streak", F.when(F.col(failed), streak).otherwise(0))
    hits = F.sum((F.col("_streak") >= limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("_hits", F.coalesce(hits, F.lit(0))).where("_hits = 0").drop("_island", "_streak", "_hits")


def latency(rows: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """Median, 95th percentile and rows per second of each group; the quantiles are exact, by running counts over ranges."""
    speed = rows.groupBy(*by).agg((F.count(F.lit(1)) / F.sum(seconds)).alias("per_second"))
    found = quantiles(rows, by, seconds, {"median": 0.5, "p95": 0.95})
    return same(found, speed, by) if by else found.crossJoin(speed)  # one row each without groups


def latest(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The committed state of progressive results: the last of each key."""
    return rows.groupBy(by).agg(F.max_by(value, order).alias(value))
