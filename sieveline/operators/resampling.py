"""Bootstrap intervals over resampled clusters of any statistic, for groups of any number of clusters.

Each cluster weighs in each draw as often as a Poisson variable of mean 1 says, which its hash and the seed fix: results
depend neither on partitions nor on order, and tasks need no other cluster's rows. A row thus stands for a vector of
weights, one a draw (and a first entry for the rows as they are); all sums are sums of such vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix import ranged

#: Groups whose sums of all draws a task holds at once.
HELD_GROUPS = 500


def weights(seed: int, draws: int) -> np.ndarray:
    """How often a cluster counts: once as it is, then in each draw."""
    return np.concatenate(([1.0], np.random.Generator(np.random.Philox(seed)).poisson(1, draws)))


def _seed(cluster: str, seed: int) -> Column:
    return F.xxhash64(cluster, F.lit(seed)).alias("_seed")


def _key_schema(rows: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)


def _keys(pdf: pd.DataFrame, by: Sequence[str]) -> Iterator[tuple]:
    return zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in by), strict=True) if by else iter([()] * len(pdf))


def _lines(by: Sequence[str], key: tuple, draws: int, columns: Mapping[str, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({**{c: [k] * (draws + 1) for c, k in zip(by, key, strict=True)}, "_draw": np.arange(-1, draws, dtype=np.int32), **columns})


def resampled_sums(rows: DataFrame, by: Sequence[str], cluster: str, sums: Mapping[str, Column], draws: int = 2000, seed: int = 1) -> DataFrame:
    """by, _draw (-1: the rows as they are) and each of `sums` added up under the draw's weights; null values add 0."""
    names = list(sums)
    summed = rows.groupBy(*by, cluster).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(f"_s{i}") for i, c in enumerate(sums.values())))
    seeded = summed.select(*by, *(f"_s{i}" for i in range(len(names))), _seed(cluster, seed))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for key, lines in held.items():
                yield _lines(by, key, draws, {f"_s{i}": line for i, line in enumerate(lines)})
            held.clear()

        for pdf in batches:
            values = pdf[[f"_s{i}" for i in range(len(names))]].to_numpy()
            for key, x, row in zip(_keys(pdf, by), pdf["_seed"].to_numpy().view(np.uint64).tolist(), values, strict=True):
                held[key] = held.get(key, 0.0) + row[:, None] * weights(x, draws)
                if len(held) > HELD_GROUPS:
                    yield from flush()
        yield from flush()

    schema = _key_schema(rows, by) + "_draw int, " + ", ".join(f"_s{i} double" for i in range(len(names)))
    return seeded.mapInPandas(weigh, schema).groupBy(*by, "_draw").agg(*(F.sum(f"_s{i}").alias(name) for i, name in enumerate(names)))


def interval(drawn: DataFrame, by: Sequence[str], value: Column, scale: Column | float = 1.0) -> DataFrame:
    """by, value (of the rows as they are), low, high, draws: the 95 % percentile interval over the draws that have a value.

    Draws whose value is null or NaN (an empty denominator) are left out, and the places of the ends follow the number
    that remains; `draws` is that number.
    """
    fine = F.when(~F.isnan(value), value)
    held = drawn.select(*by, "_draw", fine.alias("_value"))
    of_draws = F.sort_array(F.collect_list(F.when(F.col("_draw") >= 0, F.col("_value"))))  # as many numbers as draws at most
    found = held.groupBy(*by).agg(F.max(F.when(F.col("_draw") == -1, F.col("_value"))).alias("value"), of_draws.alias("_values"))
    at = lambda share: F.get("_values", F.floor(F.size("_values") * share).cast("int"))
    scaled = (("value", F.col("value")), ("low", at(0.025)), ("high", at(0.975)))
    return found.select(*by, *((c * scale).alias(name) for name, c in scaled), F.size("_values").alias("draws"))


def bootstrap_of(rows: DataFrame, by: Sequence[str], cluster: str, sums: Mapping[str, Column], statistic: Callable[..., Column], scale: Column | float = 1.0, draws: int = 2000, seed: int = 1) -> DataFrame:
    """by, value, low, high, draws of any statistic of sums: `statistic` gets the sums' columns by name, e.g. hits / rows."""
    drawn = resampled_sums(rows, by, cluster, sums, draws, seed)
    return interval(drawn, by, statistic(**{name: F.col(name) for name in sums}), scale)


def ratio(of: Column, over: Column) -> Column:
    """of / over, null where there is nothing to divide by."""
    return F.when(over != 0, of / over)


def kappa_of(tp: Column, fn: Column, fp: Column, tn: Column) -> Column:
    """Cohen's kappa of two binary labels from their four counts; null where chance agreement is certain."""
    n = tp + fn + fp + tn
    agreement, chance = ratio(tp + tn, n), ratio((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn), n * n)
    return ratio(agreement - chance, 1 - chance)


def drawn_auc(rows: DataFrame, cluster: str, score: str, label: str, by: Sequence[str] = (), draws: int = 2000, seed: int = 1) -> DataFrame:
    """by, _draw, won, positives, negatives: under each draw's weights, the pairs that the positives win (ties half).

    Rows are dealt into ranges of the score. A task goes through its range once, with one vector of the negatives so far;
    what negatives of the ranges before add is the product of two vectors of each range. Rows without score or label are
    left out. Each group sends one line a draw and range, so `by` is for few groups.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    counts = known.groupBy(*by, cluster, F.col(score).cast("double").alias("_score")).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    placed = ranged(counts.select(*by, "_score", "_pos", "_neg", _seed(cluster, seed)), [*by, "_score"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(draws + 1)
        at, score_at, place = None, None, 0
        below, won, positives, pos, neg = none, none, none, none, none

        def close() -> None:
            nonlocal below, won, positives, pos, neg
            won, positives, below = won + pos * (below + neg / 2), positives + pos, below + neg
            pos, neg = none, none

        def line() -> pd.DataFrame:
            return _lines(by, at, draws, {"_range": np.full(draws + 1, place, np.int32), "won": won, "positives": positives, "negatives": below})

        for pdf in batches:
            rows_of = zip(_keys(pdf, by), pdf["_score"].tolist(), pdf["_pos"].tolist(), pdf["_neg"].tolist(), pdf["_seed"].to_numpy().view(np.uint64).tolist(), pdf["_range"].tolist(), strict=True)
            for key, x, p, n, s, r in rows_of:
                if at is not None and (key != at or x != score_at):
                    close()
                if at is not None and key != at:
                    yield line()
                    below, won, positives = none, none, none
                at, score_at, place = key, x, r
                w = weights(s, draws)
                pos, neg = pos + p * w, neg + n * w
        if at is not None:
            close()
            yield line()

    schema = _key_schema(rows, by) + "_draw int, _range int, won double, positives double, negatives double"
    parts = placed.mapInPandas(count, schema)
    before = F.coalesce(F.sum("negatives").over(Window.partitionBy(*by, "_draw").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # one row a range
    whole = parts.withColumn("won", F.col("won") + F.col("positives") * before)
    return whole.groupBy(*by, "_draw").agg(*(F.sum(c).alias(c) for c in ("won", "positives", "negatives")))


def bootstrap_auc(rows: DataFrame, cluster: str, score: str, label: str, by: Sequence[str] = (), scale: Column | float = 1.0, draws: int = 2000, seed: int = 1) -> DataFrame:
    """by, value, low, high, draws of the chance that a positive scores above a negative. Draws without both are left out."""
    return interval(drawn_auc(rows, cluster, score, label, by, draws, seed), by, ratio(F.col("won"), F.col("positives") * F.col("negatives")), scale)
