"""Running sums, ranks and quantiles over ranges, bootstrap of any statistic, and what missing values do."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import prefix, ranking, selection
from sieveline.operators import resampling as RS
from sieveline.operators import statistics as ST


def test_running_sums_of_hot_null_and_small_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice([None, 1, 2, 5])) for i in range(500)]
    found = prefix.running(spark.createDataFrame(rows, "g string, i long, v long").repartition(5), ["g"], [-F.col("i")], {"before": "v", "place": F.lit(1)})
    got = {r["i"]: (r["before"], r["place"]) for r in found.collect()}
    for g, i, _ in rows:
        above = [x for x in rows if x[0] == g and x[1] > i]
        assert got[i] == (sum(v or 0 for _, _, v in above), len(above))
    assert found.columns == ["g", "i", "v", "before", "place"]
    whole = prefix.ranks(spark.range(100).repartition(7), [], ["id"], "place")
    assert all(r["id"] == r["place"] for r in whole.collect())
    assert prefix.ranks(spark.range(0), [], ["id"], "place").count() == 0
    plan = prefix.running(spark.range(100), [], ["id"], {"s": "id"})._jdf.queryExecution().toString()
    assert "Window" in plan


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(v)) for v in rng.integers(0, 9, 301)] + [("b", 1.5)] + [(None, float(v)) for v in rng.standard_normal(40)] + [("a", None), ("none", None)]
    shares = {"low": 0.0, "q": 0.31, "median": 0.5, "p95": 0.95, "high": 1.0}
    got = {r["g"]: r for r in prefix.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        values = [v for k, v in rows if k == g and v is not None]
        assert [r[c] for c in shares] == pytest.approx([np.quantile(values, q) for q in shares.values()])
    table = spark.createDataFrame(rows, "g string, v double")
    assert prefix.quantiles(table, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert prefix.quantiles(table.limit(0), [], "v", {"m": 0.5}).count() == 0


def plain_draws(spark, rows, statistic, draws, seed):
    """The statistic under each draw's weights, in plain Python; rows: (cluster, x)."""
    names = spark.createDataFrame([(c,) for c in {c for c, _ in rows}], "c string").select("c", F.xxhash64("c", F.lit(seed)).alias("h")).collect()
    w = {r["c"]: RS.weights(r["h"] % 2**64, draws) for r in names}
    out = [statistic([(x, w[c][d]) for c, x in rows]) for d in range(draws + 1)]
    kept = sorted(x for x in out[1:] if x is not None)
    return out[0], kept[int(0.025 * len(kept))], kept[int(0.975 * len(kept))], len(kept)


def plain_auc(weighted):
    pos, neg = [(s, w) for (s, y), w in weighted if y == 1], [(s, w) for (s, y), w in weighted if y != 1]
    p, n = sum(w for _, w in pos), sum(w for _, w in neg)
    return sum(a * b * ((x > y) + 0.5 * (x == y)) for x, a in pos for y, b in neg) / (p * n) if p * n else None


def test_bootstrap_of_rank_statistics_equals_plain_python(spark):
    rng = random.Random(4)
    rows = [("g", f"c{rng.randrange(4)}", float(rng.randrange(6)), rng.randrange(2)) for _ in range(30)] + [("h", "c1", 1.0, 1), ("h", "c2", 0.0, 0)]
    odd = [("g", "c1", None, 1), ("g", "c1", 3.0, None), ("g", "c1", float("nan"), 0), ("only", "c1", 1.0, 1)]
    table = spark.createDataFrame(rows + odd, "g string, c string, s double, y int").repartition(6)
    got = {r["g"]: r for r in RS.bootstrap_auc(table, "c", "s", "y", ["g"], draws=150).collect()}
    for g in ("g", "h"):  # of h, many draws lack one side and are left out
        mine = plain_draws(spark, [(c, (s, y)) for k, c, s, y in rows if k == g], plain_auc, 150, 1)
        assert tuple(got[g])[1:] == pytest.approx(mine)
    assert got["h"]["draws"] < 150
    assert tuple(got["only"])[1:] == (None, None, None, 0)
    whole = RS.bootstrap_auc(table, "c", "s", "y", draws=50).first()
    assert whole["value"] == pytest.approx(ST.auc(table, "s", "y").first()["auc"])


def test_bootstrap_of_sums_equals_plain_python(spark):
    rng = random.Random(5)
    rows = [(f"c{rng.randrange(6)}", (rng.randrange(2), rng.randrange(2))) for _ in range(60)]
    table = spark.createDataFrame([(c, t, p) for c, (t, p) in rows], "c string, t int, p int")
    cells = {"tp": (1, 1), "fn": (1, 0), "fp": (0, 1), "tn": (0, 0)}
    counts = {n: F.when((F.col("t") == t) & (F.col("p") == p), 1) for n, (t, p) in cells.items()}

    def kappa(weighted):
        n = {name: sum(w for x, w in weighted if x == cell) for name, cell in cells.items()}
        total = sum(n.values())
        if not total:
            return None
        po = (n["tp"] + n["tn"]) / total
        pe = ((n["tp"] + n["fn"]) * (n["tp"] + n["fp"]) + (n["tn"] + n["fp"]) * (n["tn"] + n["fn"])) / total**2
        return (po - pe) / (1 - pe) if pe != 1 else None

    got = RS.bootstrap_of(table, [], "c", counts, RS.kappa_of, draws=200, seed=9).first()
    assert tuple(got) == pytest.approx(plain_draws(spark, rows, kappa, 200, 9))
    assert RS.bootstrap_of(table.limit(0), [], "c", counts, RS.kappa_of).collect()[0]["value"] is None


def test_missing_values(spark):
    facts = spark.createDataFrame([("a", None, 1.0), ("b", "x", 2.0)], "d string, e string, v double")
    grid = {(r["d"], r["e"]): r["v"] for r in selection.report_grid(facts, ["d", "e"], "v").collect()}
    assert grid == {("a", None): 1.0, ("a", "x"): None, ("b", None): None, ("b", "x"): 2.0}
    with pytest.raises(ValueError, match="no report"):
        selection.report_grid(spark.range(2000).select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("id").alias("v")), ["a", "b"], "v")
    votes = spark.createDataFrame([(1, "x"), (1, None), (1, None), (2, None), (3, "x"), (3, "y")], "u int, v string")
    assert {r["u"]: r["majority"] for r in ST.majority(votes, "u", "v").collect()} == {1: "x", 2: None, 3: "tie"}
    p = spark.createDataFrame([(-0.2, 1), (1.7, 1), (float("nan"), 1), (None, 0), (0.5, None), (0.55, 0)], "p double, y int")
    assert sorted((r["bin"], r["n"]) for r in ST.calibration(p, "p", "y").collect()) == [(0, 1), (5, 1), (9, 1)]
    scores = spark.createDataFrame([(2.0, 1), (1.0, 0), (None, 1), (None, 0), (3.0, None)], "s double, y int")
    assert tuple(ST.auc(scores, "s", "y").first()) == (1.0, 1, 1)
    assert sorted((r["threshold"], r["fpr"], r["tpr"]) for r in ST.roc(scores, "s", "y").where("threshold is not null").collect()) == [(1.0, 1.0, 1.0), (2.0, 0.0, 1.0)]


def test_alpha_of_many_values_and_missing_ratings(spark):
    rng = random.Random(8)
    rows = [(u, rng.choice([None, rng.random() * 10, 3.0, 4.0])) for u in range(40) for _ in range(3)]
    units = [[v for x, v in rows if x == u and v is not None] for u in range(40)]
    units = [u for u in units if len(u) > 1]
    every = sorted(v for u in units for v in u)
    middle = {v: sum(x < v for x in every) + every.count(v) / 2 for v in every}

    def alpha(distance):
        observed = sum(distance(a, b) / (len(u) - 1) for u in units for i, a in enumerate(u) for j, b in enumerate(u) if i != j)
        expected = sum(distance(a, b) for a in every for b in every)
        return 1 - (len(every) - 1) * observed / expected

    table = spark.createDataFrame(rows, "u int, v double")
    for metric, distance in (("nominal", lambda a, b: a != b), ("interval", lambda a, b: (a - b) ** 2), ("ordinal", lambda a, b: (middle[a] - middle[b]) ** 2)):
        assert ST.krippendorff_alpha(table, "u", "v", metric).first()["alpha"] == pytest.approx(alpha(distance))
    assert ST.krippendorff_alpha(spark.createDataFrame([(1, 2.0), (1, 2.0)], "u int, v double"), "u", "v", "interval").first()["alpha"] == 1.0


def test_samples_of_whole_groups(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 10 else None, float(i % 7)) for i in range(200)], "i long, g string, v double").repartition(6)
    sample = ranking.stratified_sample(rows, ["g"], "i", 0.25, "s")
    assert {r["g"]: r["n"] for r in sample.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()} == {"hot": 45, None: 5}
    low = [(r["v"], r["i"]) for r in ranking.least_confident(rows, "v", "i", 0.1).collect()]
    assert sorted(low) == sorted((float(i % 7), i) for i in range(200))[:20]
    sizes = ranking.batches(rows, "g", "i", 40, "s").groupBy("g", "batch").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r["g"] or "", r["batch"], r["n"]) for r in sizes) == [("", 0, 20)] + [("hot", b, 40) for b in range(4)] + [("hot", 4, 20)]
    deltas = spark.createDataFrame([(float(i), float(i % 5) if i else None) for i in range(50)], "f double, r double")
    wanted = sorted((float(i % 5) for i in range(1, 50)), reverse=True)[4]
    assert ST.recall_at_false_alarm(deltas, "f", "r", 0.1).first()["recall"] == sum(i > wanted for i in range(50)) / 50
