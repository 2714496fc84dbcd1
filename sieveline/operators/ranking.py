"""Choosing rows: winners, bottom and top k, capped and stratified samples, first and last records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import hash_order
from .prefix import ranks, same


def winner(candidates: DataFrame, by: list[str], merit: list[Column], position: str) -> DataFrame:
    """The best row of each group by merits in turn; the smallest position wins ties. Partial maxima keep it mergeable."""
    order = F.struct(*(m.alias(f"m{i}") for i, m in enumerate(merit)), (-F.col(position)).alias("first"))
    rest = [c for c in candidates.columns if c not in by]
    return candidates.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("best")).select(*by, "best.*")


def keep_first(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """One row a group: the first in the order (min_by, so the group is never gathered)."""
    rest = [c for c in rows.columns if c not in by]
    key = F.struct(*(F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)))
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("kept")).select(*by, "kept.*")


def keep_last(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("kept")).select(*by, "kept.*")


def first_k(rows: DataFrame, by: list[str], order: list[Column], k: Column | int, keep_rank: str | None = None) -> DataFrame:
    """The first k rows of each group; k may be a column that is constant in a group. Spark prunes groups before the shuffle where k is a number."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = ranked.where(F.col("_rank") <= k)
    return kept.withColumnRenamed("_rank", keep_rank) if keep_rank else kept.drop("_rank")


def bottom_share(rows: DataFrame, by: list[str], value: str, row_id: str, fractions: DataFrame, target: int) -> DataFrame:
    """Per group, the rows of smallest value, target * fraction of them, rounded half to even. fractions: by, fraction.

    k grows with the target, so places are counted over ranges and no task holds a group.
    """
    sized = rows.join(fractions, by)
    return ranks(sized, by, [F.col(value).isNull(), value, row_id], "_place").where(F.col("_place") < F.bround(target * F.col("fraction"))).drop("fraction", "_place")


def capped_sample(rows: DataFrame, by: list[str], row_id: str, cap: int, seed: str) -> DataFrame:
    """At most `cap` rows a group, in a reproducible random order."""
    return first_k(rows, by, [hash_order(row_id, seed), F.col(row_id)], cap)


def stratified_sample(rows: DataFrame, by: list[str], row_id: str, fraction: float, seed: str) -> DataFrame:
    """floor(fraction * size) rows of each group; `by` may be several columns, nulls are a stratum. Places are counted over ranges."""
    sizes = rows.groupBy(*by).agg(F.floor(F.count(F.lit(1)) * fraction).alias("_size"))
    placed = same(ranks(rows, by, [hash_order(row_id, seed), row_id], "_place"), sizes, by)
    return placed.where(F.col("_place") < F.col("_size")).drop("_size", "_place")


def seeded_limit(rows: DataFrame, row_id: str, n: int, seed: str) -> DataFrame:
    """n rows in a reproducible random order."""
    return rows.orderBy(hash_order(row_id, seed), row_id).limit(n)


def top_k(rows: DataFrame, k: int, score: str, row_id: str) -> DataFrame:
    """The k rows of the highest score, ties to the smaller id (heap per task, merged)."""
    return rows.orderBy(F.desc(score), F.col(row_id)).limit(k)


def least_confident(rows: DataFrame, score: str, row_id: str, share: float) -> DataFrame:
    """The share of rows (rounded half to even) of the lowest score; their number grows with the table, so places are counted over ranges."""
    n = int(rows.agg(F.bround(F.count(F.lit(1)) * share)).first()[0] or 0)
    return ranks(rows, [], [score, row_id], "_place").where(F.col("_place") < n).drop("_place")


def batches(rows: DataFrame, by: str, row_id: str, size: int, seed: str) -> DataFrame:
    """batch number of each row within its sample after a reproducible shuffle; a sample may be of any size."""
    placed = ranks(rows, [by], [hash_order(row_id, seed), row_id], "_place")
    return placed.withColumn("batch", F.floor(F.col("_place") / size).cast("long")).drop("_place")


def upsert_history(rows: DataFrame, by: str, key: str, created: str, row_id: str, k: int = 50) -> DataFrame:
    """Each user's newest k items, one a key."""
    unique = keep_last(rows, [by, key], [created, row_id])
    return first_k(unique, [by], [F.desc(created), F.desc(row_id)], k)


def unless_beaten(candidates: DataFrame, by: list[str], score: str, position: str, copy_score: float) -> DataFrame:
    """The best candidate of each group with `use_copy`: true where it does not beat the score of leaving the text alone."""
    return winner(candidates, by, [F.col(score)], position).withColumn("use_copy", F.col(score) <= copy_score)


def checkpoint_choice(runs: DataFrame, score: str, guard: str, least_guard: float, slack: float = 1.0) -> DataFrame:
    """The run of the highest guard value among those within `slack` of the best score and with the guard held. Runs are few."""
    best = runs.agg(F.max(score).alias("_best"))
    fine = runs.crossJoin(F.broadcast(best)).where((F.col(score) >= F.col("_best") - slack) & (F.col(guard) >= least_guard))  # best is one row
    return fine.drop("_best").orderBy(F.desc(guard), F.desc(score)).limit(1)


def tagged_examples(rows: DataFrame, tags: dict[str, Column], row_id: str, k: int, seed: str) -> DataFrame:
    """Up to k rows of each tag in a reproducible random order, with the tag's whole count."""
    each = rows.withColumn("tag", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in tags.items())))))
    counts = each.groupBy("tag").agg(F.count(F.lit(1)).alias("tag_rows"))
    return first_k(each, ["tag"], [hash_order(row_id, seed), F.col(row_id)], k).join(counts, "tag")
