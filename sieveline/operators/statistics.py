"""Agreement, ranking quality, calibration and cluster-bootstrap intervals."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import quantiles, running, same
from .resampling import ratio, resampled_sums


def score_table(rows: DataFrame, score: str, label: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Per distinct score: positives, negatives and the negatives below it, by running sums over ranges of scores.

    Rows whose score or label is missing (null; NaN scores) say nothing and are left out.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    counts = known.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return running(counts, by, ["score"], {"pos_below": "pos", "neg_below": "neg"})


def auc(rows: DataFrame, score: str, label: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Chance that a positive scores above a negative, ties half; null without both. Rows without score or label are left out."""
    t = score_table(rows, score, label, by)
    sums = t.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(*by, F.when(F.col("p") * F.col("n") > 0, F.col("won") / (F.col("p") * F.col("n"))).alias("auc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def roc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, fpr, tpr at each distinct score, from the highest; the start (0, 0), above all scores, has no threshold.

    Rows without score or label are left out; rates without negatives (positives) are null.
    """
    t = score_table(rows, score, label)
    whole = t.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    rate = lambda c: ratio(F.col(f"all_{c}") - F.col(f"{c}_below"), F.col(f"all_{c}"))
    points = t.crossJoin(F.broadcast(whole)).select(F.col("score").alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr"))  # one row of totals
    start = rows.sparkSession.range(1).select(F.lit(None).cast(points.schema["threshold"].dataType).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def threshold_sweep(rows: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """threshold, accuracy, tpr, tnr, balanced, accept_rate; the grid is a short list on the rows' side."""
    grid = rows.select(score, label, F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    yes, pos = F.col(score) >= F.col("threshold"), F.col(label) == 1
    out = grid.groupBy("threshold").agg(
        F.avg((yes == pos).cast("double")).alias("accuracy"), F.avg(F.when(pos, yes.cast("double"))).alias("tpr"), F.avg(F.when(~pos, (~yes).cast("double"))).alias("tnr"), F.avg(yes.cast("double")).alias("accept_rate")
    )
    return out.withColumn("balanced", (F.col("tpr") + F.col("tnr")) / 2)


def picked_thresholds(swept: DataFrame, accept: float = 0.5) -> DataFrame:
    """One row of a threshold_sweep(): `best`, of the highest balanced accuracy, and `nearest`, whose rate of acceptance is
    nearest to `accept`, each with its balanced accuracy; of equal ones the smallest threshold. A sweep is a short list."""
    best, nearest = F.struct("balanced", (-F.col("threshold")).alias("t")), F.struct((-F.abs(F.col("accept_rate") - accept)).alias("d"), (-F.col("threshold")).alias("t"))
    return swept.where("balanced is not null").agg(
        F.max_by("threshold", best).alias("best"), F.max("balanced").alias("best_balanced"), F.max_by("threshold", nearest).alias("nearest"), F.max_by("balanced", nearest).alias("nearest_balanced")
    )


def catch_at_false_reject(rows: DataFrame, score: str, label: str, kind: str, rate: float = 0.05, least: int = 8) -> DataFrame:
    """Per kind of planted defect (label 0) with `least` rows: share below the score that rejects `rate` of the good rows."""
    bar = quantiles(rows.where(F.col(label) == 1), [], score, {"bar": rate})
    bad = rows.where(F.col(label) != 1).crossJoin(F.broadcast(bar))  # one row
    return bad.groupBy(kind).agg(F.avg((F.col(score) <= F.col("bar")).cast("double")).alias("caught"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("label"), F.col(b).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """kappa and observed agreement; NaN when chance agreement is certain. Works on the confusion table."""
    c = confusion(rows, a, b)
    total = c.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("same"))
    left, right = c.groupBy("label").agg(F.sum("n").alias("l")), c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("r"))
    chance = left.join(right, "label").agg(F.sum(F.col("l") * F.col("r")).alias("chance"))
    po, pe = F.col("same") / F.col("total"), F.coalesce("chance", F.lit(0)) / (F.col("total") * F.col("total"))
    return total.crossJoin(chance).select(F.when(pe == 1, F.lit(float("nan"))).otherwise((po - pe) / (1 - pe)).alias("kappa"), po.alias("agreement"))  # one row each


def binary_counts(truth: Column, predicted: Column, prefix: str = "") -> list[Column]:
    """Aggregates tp, fn, fp, tn of two boolean columns; rows where either is null count nowhere."""
    cells = {"tp": truth & predicted, "fn": truth & ~predicted, "fp": ~truth & predicted, "tn": ~truth & ~predicted}
    return [F.count_if(c).alias(f"{prefix}{name}") for name, c in cells.items()]


def binary_rates(prefix: str = "", digits: int = 3) -> list[Column]:
    """kappa, recall and clean_pass from the counts of binary_counts(), with denominators of one at least, rounded."""
    tp, fn, fp, tn = (F.col(f"{prefix}{c}") for c in ("tp", "fn", "fp", "tn"))
    least = lambda c: F.greatest(F.lit(1), c)
    n = least(tp + fn + fp + tn)
    by_chance = ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n)
    kappa = ((tp + tn) / n - by_chance) / F.greatest(F.lit(1e-9), 1 - by_chance)
    found = {"kappa": kappa, "recall": tp / least(tp + fn), "clean_pass": tn / least(tn + fp)}
    return [F.bround(c, digits).alias(f"{prefix}{name}") for name, c in found.items()]


def binary_agreement(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """kappa, recall and clean_pass of a binary judge, with denominators of one at least, rounded to three digits."""
    return rows.agg(*binary_counts(F.col(truth) == 1, F.col(predicted) == 1)).select(*binary_rates())


def krippendorff_alpha(ratings: DataFrame, unit: str, value: str, metric: str = "nominal") -> DataFrame:
    """alpha by nominal, ordinal or interval distance; 1 - observed / expected disagreement, 1 where all values are equal.

    Only values that are there count, in units that have two or more. No pairs are made: the squared differences within a
    unit, and those of all values, are variances; the ordinal distance is that of the values' middle ranks, and the
    nominal one follows from the values' frequencies.
    """
    known = ratings.where(F.col(value).isNotNull()).select(F.col(unit).alias("unit"), F.col(value).alias("v"))
    rated = same(known, known.groupBy("unit").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), ["unit"])
    values = rated.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    if metric == "nominal":
        cells = rated.groupBy("unit", "v").agg(F.count(F.lit(1)).alias("c"), F.max("m").alias("m"))
        observed = cells.groupBy("unit").agg(((F.max("m") * F.max("m") - F.sum(F.col("c") * F.col("c"))) / (F.max("m") - 1)).alias("d")).agg(F.sum("d").alias("observed"))
        total = F.sum("n").cast("double")
        whole = values.agg(total.alias("n"), (total * total - F.sum(F.col("n").cast("double") * F.col("n"))).alias("expected"))
    else:
        if metric == "ordinal":
            middle = running(values, [], ["v"], {"below": "n"}).select("v", (F.col("below") + F.col("n") / 2).alias("x"))
            rated = rated.join(middle, "v")
        else:
            rated = rated.withColumn("x", F.col("v").cast("double"))
        observed = rated.groupBy("unit").agg((2 * F.max("m") * F.var_samp("x")).alias("d")).agg(F.sum("d").alias("observed"))
        total = F.count(F.lit(1)).cast("double")
        whole = rated.agg(total.alias("n"), (2 * total * total * F.var_pop("x")).alias("expected"))
    return whole.crossJoin(observed).select(F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(1 - (F.col("n") - 1) * F.col("observed") / F.col("expected")).alias("alpha"))  # one row each


def rater_pairs(ratings: DataFrame, unit: str, rater: str, value: str) -> DataFrame:
    """Share of agreeing pairs of raters over all units, and the number of pairs; raters of a unit are few."""
    other = ratings.select(unit, F.col(rater).alias("other"), F.col(value).alias("other_value"))
    pairs = ratings.join(other, unit).where(F.col(rater) < F.col("other"))
    return pairs.agg(F.avg((F.col(value) == F.col("other_value")).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("pairs"))


def majority(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """Each unit's plurality of the ratings that are there; `tie` if two values are as frequent, null without any."""
    counts = ratings.groupBy(unit, value).agg(F.count(F.lit(1)).alias("n"))
    votes = F.when(F.col(value).isNotNull(), F.col("n"))
    # The values in the order of their votes: a unit has few different ones.
    ordered = counts.groupBy(unit).agg(F.array_sort(F.collect_list(F.when(votes.isNotNull(), F.struct((-votes).alias("n"), F.col(value).cast("string").alias("v"))))).alias("o"))
    first, second = F.get("o", F.lit(0)), F.get("o", F.lit(1))
    return ordered.select(unit, F.when(first["n"] == second["n"], F.lit("tie")).otherwise(first["v"]).alias("majority"))


def calibration(rows: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Per equal-width bin (the last closed): mean prediction, share of positives, n.

    Predictions below 0 count in the first bin and those above 1 in the last; rows without prediction (null, NaN) or
    label are left out.
    """
    known = rows.where(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")) & F.col(label).isNotNull())
    b = F.greatest(F.lit(0), F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))).cast("long")
    return known.groupBy(b.alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg((F.col(label) == 1).cast("double")).alias("positive"), F.count(F.lit(1)).alias("n"))


def recall_at_false_alarm(deltas: DataFrame, forward: str, reverse: str, far: float = 0.1) -> DataFrame:
    """Share of forward deltas above the reverse delta of rank max(1, floor(far * n)) from the top.

    The rank is found by running counts over ranges of distinct deltas; rows without a reverse delta come last.
    """
    counts = deltas.groupBy(F.col(reverse).alias("_bar")).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"))
    placed = running(counts, [], ["_bar"], {"_below": "_n"}).crossJoin(F.broadcast(whole))  # one row
    above, rank = F.col("_all") - F.col("_below") - F.col("_n"), F.greatest(F.lit(1), F.floor(F.col("_all") * far))
    bar = placed.where((above < rank) & (rank <= above + F.col("_n"))).agg(F.max("_bar").alias("bar"))
    return deltas.crossJoin(F.broadcast(bar)).agg(F.avg((F.col(forward) > F.col("bar")).cast("double")).alias("recall"))  # bar is one row


def quantile_histogram(rows: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """by, bin, n, share (of the group): rows between the exact quantiles of all values; a value on an edge counts below it.

    Null values are in no bin. The edges are one row, found by running counts over ranges of values.
    """
    names = [f"_edge_{i}" for i in range(len(shares))]
    edges = quantiles(rows, [], value, dict(zip(names, sorted(shares), strict=True)))
    above = sum((F.col(value) > F.col(e)).cast("int") for e in names)
    n = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(*by, above.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row of edges
    whole = n.groupBy(*by).agg(F.sum("n").alias("_all"))
    found = same(n, whole, by) if by else n.crossJoin(F.broadcast(whole))  # one row without groups
    return found.select(*by, "bin", "n", (F.col("n") / F.col("_all")).alias("share"))


def classifier_report(rows: DataFrame, truth: str, predicted: str, easy_upto: int) -> DataFrame:
    """exact, off_by_one, band accuracy, and precision and recall of the easy band."""
    t, p = F.col(truth), F.col(predicted)
    te, pe = t <= easy_upto, p <= easy_upto
    mean = lambda c: F.avg(c.cast("double"))
    return rows.agg(
        mean(t == p).alias("exact"), mean(F.abs(t - p) <= 1).alias("off_by_one"), mean(te == pe).alias("band"),
        (F.count_if(te & pe) / F.greatest(F.lit(1), F.count_if(pe))).alias("precision"), (F.count_if(te & pe) / F.greatest(F.lit(1), F.count_if(te))).alias("recall"),
    )


def class_weights(rows: DataFrame, label: str, classes: int) -> DataFrame:
    """N / (classes * size) of each class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(label, (F.col("total") / (classes * F.col("n"))).alias("weight"))  # one row


def tallies(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """wins of a, ties and losses per contrast."""
    return rows.groupBy(by).agg(F.count_if(F.col(a) > F.col(b)).alias("wins"), F.count_if(F.col(a) == F.col(b)).alias("ties"), F.count_if(F.col(a) < F.col(b)).alias("losses"))


def drawn_means(sums: np.ndarray, sizes: np.ndarray, draws: int, seed: int = 1) -> list[float]:
    """Means of resampled clusters, bit for bit those of random.Random(seed).choices() and sum(), with numpy's copy of the generator."""
    _, state, _ = random.Random(seed).getstate()
    rng, n, means = np.random.RandomState(), len(sums), []
    rng.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    whole = bool((sums == np.rint(sums)).all()) and float(np.abs(sums).sum()) * n < 2**53  # such sums are exact in any order
    for _ in range(draws):
        at = (rng.random_sample(n) * n).astype(np.intp)
        means.append(float(sums[at].sum() if whole else sum(sums[at].tolist())) / int(sizes[at].sum()))
    return means


def cluster_bootstrap(rows: DataFrame, by: list[str], cluster: str, value: str, order: str, scale: Column | float = 1.0, draws: int = 2000, upper_offset: int = 0) -> DataFrame:
    """by, mean, low, high, n: percentile intervals over resampled clusters, in the clusters' first-seen order, seeded.

    Rows are summed to (cluster, sum, n) by Spark first; only these sums meet in a group's task. The interval is null
    without rows. upper_offset moves the upper index, as some reports take one place less.
    """
    v = F.col(value).cast("double")
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(v).alias("_sum"), F.count(F.lit(1)).alias("_rows"), F.min(order).alias("_first"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by) + ", mean double, low double, high double, n long"

    def draw(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_first", kind="stable")
        means = sorted(drawn_means(pdf["_sum"].to_numpy(), pdf["_rows"].to_numpy(), draws))
        low, high = means[int(0.025 * draws)], means[int(0.975 * draws) + upper_offset]
        return pd.DataFrame([(*key, pdf["_sum"].sum() / pdf["_rows"].sum(), low, high, int(pdf["_rows"].sum()))])

    found = sums.groupBy(*by).applyInPandas(draw, schema)
    return found.select(*by, *((F.col(c) * scale).alias(c) for c in ("mean", "low", "high")), "n")


def spread_bootstrap(rows: DataFrame, by: list[str], cluster: str, value: str, scale: Column | float = 1.0, draws: int = 2000, seed: int = 1) -> DataFrame:
    """by, mean, low, high, n as cluster_bootstrap(), for groups of any number of clusters: no task holds a whole group.

    Each cluster weighs in each draw as often as a Poisson variable of mean 1 says, which its hash and the seed fix, so
    the intervals depend neither on partitions nor on order. Tasks send `draws` sums a group; those of a draw are added.
    """
    known = rows.where(F.col(value).isNotNull())
    drawn = resampled_sums(known, by, cluster, {"_sum": F.col(value).cast("double"), "_rows": F.lit(1)}, draws, seed)
    whole = F.col("_draw") == -1
    means = F.sort_array(F.collect_list(F.when(~whole & (F.col("_rows") > 0), F.col("_sum") / F.col("_rows"))))  # `draws` numbers at most
    found = drawn.groupBy(*by).agg(F.max(F.when(whole, F.col("_sum") / F.col("_rows"))).alias("mean"), F.max(F.when(whole, F.col("_rows"))).cast("long").alias("n"), means.alias("_means"))
    at = lambda share: F.get("_means", F.floor(F.size("_means") * share).cast("int"))
    return found.select(*by, *((c * scale).alias(name) for name, c in (("mean", F.col("mean")), ("low", at(0.025)), ("high", at(0.975)))), "n")


def paired_difference(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], item: str, cluster: str, value: str, order: str, spread: bool = False, **more) -> DataFrame:
    """Interval of a - b over the items that both have; by spread_bootstrap() if `spread`."""
    other = b.select(*by, item, F.col(value).alias("other"))
    both = a.join(other, [*by, item]).withColumn("difference", F.col(value).cast("double") - F.col("other").cast("double"))
    return spread_bootstrap(both, by, cluster, "difference", **more) if spread else cluster_bootstrap(both, by, cluster, "difference", order, **more)


def cross_validated(rows: DataFrame, features: list[str], label: str, row_id: str, folds: int = 5, c: float = 1.0) -> DataFrame:
    """rows with `p` from a logistic regression (ridge of 1 / (c * n), not standardised) that never saw the row's fold.

    Folds are hashes of ids within each label, so they are stable and nearly stratified. Fits run on Spark.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    fold = F.pmod(F.xxhash64(row_id, label), F.lit(folds))
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(rows).withColumn("_fold", fold).withColumn("_y", F.col(label).cast("double"))
    out = None
    for k in range(folds):
        train = data.where(F.col("_fold") != k)
        model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1 / (c * max(1, train.count())), standardization=False).fit(train)
        part = model.transform(data.where(F.col("_fold") == k)).withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")
        out = part if out is None else out.unionByName(part)
    return out
