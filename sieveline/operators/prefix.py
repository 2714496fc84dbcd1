"""Running sums, ranks and exact quantiles of groups of any size: ranges of the order, one total a range, sums inside ranges.

A window over a whole group puts the group into one task. Here rows are dealt into ranges of (group, order), which cut
large groups; the totals of the ranges before, one row a range, are added to the sums inside each range.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where that is unset on a local master."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sieveline-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df computed once, to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ranged(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows sorted within partitions that are ranges of `order`, with the range's number in `_range`; stored.

    Ranges are sampled anew by each job, hence the stored copy. Rows of equal order are in one range.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))


def same(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, joined on `by`, where nulls are equal to nulls."""
    other = right.withColumnsRenamed({c: f"_by_{i}" for i, c in enumerate(by)})
    on = [left[c].eqNullSafe(other[f"_by_{i}"]) for i, c in enumerate(by)]
    return left.join(other, on, how).drop(*(f"_by_{i}" for i in range(len(by))))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column | str]) -> DataFrame:
    """rows with, for each of `sums`, the sum over the rows of their group that come before in the order (0 before the first).

    The order should be unique within groups; rows of equal order come in any order, but each has its own place. Nulls
    come first. Null values add nothing; without `by` all rows are one group.
    """
    keys = {f"_order_{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    values = {f"_sum_{i}": F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0)) for i, v in enumerate(sums.values())}
    placed = ranged(rows.withColumns({**keys, **values}), [*by, *keys])
    totals = placed.groupBy(*by, "_range").agg(*(F.sum(v).alias(f"{v}_all") for v in values))
    earlier = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = totals.select(*by, "_range", *(F.coalesce(F.sum(f"{v}_all").over(earlier), F.lit(0)).alias(f"{v}_start") for v in values))
    inside = Window.partitionBy(*by, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns({f"{v}_in": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    joined = same(summed, starts, [*by, "_range"])
    return joined.select(*rows.columns, *((F.col(f"{v}_start") + F.col(f"{v}_in")).alias(name) for name, v in zip(sums, values, strict=True)))


def ranks(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """rows with their place in their group's order, from 0."""
    return running(rows, by, order, {name: F.lit(1).cast("long")})


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """by and, for each of `shares` (name: share from 0 to 1), the exact quantile of value between its two neighbours, linearly.

    Null values do not count; a group without others has no row. Without `by` there is one row, or none.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counts, by, ["_value"], {"_before": "_n"})
    if by:
        sized = same(placed, counts.groupBy(*by).agg(F.sum("_n").alias("_all")), by)
    else:
        sized = placed.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all"))))  # one row
    inside = lambda place: (F.col("_before") <= place) & (place < F.col("_before") + F.col("_n"))
    ends, out = [], []
    for i, (name, share) in enumerate(shares.items()):
        place = (F.col("_all") - 1) * F.lit(float(share))
        ends += [F.max(F.when(inside(F.floor(place)), F.col("_value"))).alias(f"_low_{i}"), F.max(F.when(inside(F.ceil(place)), F.col("_value"))).alias(f"_high_{i}"), F.max(place - F.floor(place)).alias(f"_part_{i}")]
        low, high, part = (F.col(f"{c}_{i}") for c in ("_low", "_high", "_part"))
        out.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(name))
    found = sized.groupBy(*by).agg(F.max("_all").alias("_all"), *ends)
    return found.where("_all is not null").select(*by, *out)
