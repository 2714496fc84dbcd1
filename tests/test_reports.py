"""Reports: leaks that stop a run, thresholds, edit rates, score look-ups, readability and the scorecard's text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sieveline.functions.scalars import pair_key
from sieveline.operators import leakage, rewriting, scorecard
from sieveline.operators import statistics as ST


def test_leaks_stop_a_run(spark):
    found = spark.createDataFrame([("a", True, False), ("a", False, False), ("b", True, True), ("c", True, False), ("c", True, False)], "file string, substantive boolean, explained boolean")
    reported = leakage.report(found, "file")
    assert {r["file"]: (r["real"], r["short"], r["explained"]) for r in reported.collect()} == {"a": (1, 1, 0), "b": (0, 0, 1), "c": (2, 0, 0)}
    with pytest.raises(ValueError, match=r"leakage: c \(2 matches\), a \(1 matches\)"):
        leakage.require_no_leakage(reported, "file")
    leakage.require_no_leakage(reported.where("file = 'b'"), "file")
    rows = spark.createDataFrame([(1, "A text!"), (2, "Another"), (3, None), (4, "..."), (5, "a  text")], "id int, s string")
    leaked = spark.createDataFrame([("A text",), (None,), ("!!",)], "t string")
    assert sorted(r["id"] for r in leakage.without_leaked_sources(rows, "s", leaked, "t").collect()) == [2, 3, 4, 5]


def test_thresholds_are_picked(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.9, 1), (0.2, 0)], "s double, y int")
    grid = [x / 100 for x in range(1, 100)]
    got = ST.picked_thresholds(ST.threshold_sweep(rows, "s", "y", grid)).first()
    data = [(r["s"], r["y"]) for r in rows.collect()]
    balanced = lambda t: (sum(s >= t for s, y in data if y) / 3 + sum(s < t for s, y in data if not y) / 3) / 2
    best = max(grid, key=balanced)
    nearest = min(grid, key=lambda t: abs(sum(s >= t for s, _ in data) / 6 - 0.5))
    assert (got["best"], got["nearest"]) == (best, nearest)
    assert got["best_balanced"] == pytest.approx(balanced(best))
    assert got["nearest_balanced"] == pytest.approx(balanced(nearest))


def test_edit_rates(spark):
    rows = spark.createDataFrame([("a b c", "a b c", "a b c"), ("a b c", "a x c", "a b c"), ("a b c", "a x y", "z"), ("a b", " a b ", "c"), ("a b c", "a b", "c")], "source string, output string, target string")
    got = rewriting.edit_rates(rows, []).first()
    assert tuple(got) == (pytest.approx(0.4), pytest.approx(0.5), pytest.approx(1 / 3), 5)
    assert rewriting.edit_rates(rows.where("target = 'z'"), []).first()["over_edit_rate"] is None


def test_scores_by_content(spark):
    pairs = spark.createDataFrame([(1, "نص أول", "نص  أول"), (2, "نص أول", "آخر"), (3, "نص", "غيره"), (4, "نص", "ثالث")], "item int, source string, output string")
    keys = {r["item"]: r["k"] for r in pairs.select("item", pair_key("source", "output").alias("k")).collect()}
    scores = spark.createDataFrame([(keys[1], 0.2, 0.9, 1, "x"), (keys[2], 0.7, 0.1, 3, "x"), (keys[2], 0.6, 0.2, 2, "x"), (keys[3], 0.5, 0.5, 4, "other"), (keys[4], None, None, 5, "x")], "pair_key string, same double, contradict double, position int, scorer string")
    got = {r["item"]: (r["same"], r["contradict"]) for r in scorecard.with_scores(pairs, scores, "x").collect()}
    assert got == {1: (1.0, 0.0), 2: (0.6, 0.2), 3: (None, None), 4: (None, None)}


def test_readability_drop(spark):
    pairs = spark.createDataFrame([("a", "صَعب", "سهل"), ("a", "صعب", "أسهل"), ("a", "صعب", "مجهول"), ("b", "x", "y")], "g string, source string, output string")
    levels = spark.createDataFrame([("صعب", 12.0), ("سهل", 7.0), ("أسهل", 4.0)], "text string, level double")
    assert {r["g"]: tuple(r)[1:] for r in scorecard.readability_drop(pairs, ["g"], levels).collect()} == {"a": (6.5, 2, 3), "b": (None, 0, 1)}


def test_scorecard_as_text(spark):
    rows = [("core", "checks", "numbers kept", 95.5, 90.2, 99.0, 20, 0, True, 1.25, 0.4, 2.6, True), ("core", "simpler", "longest clause: words shorter", 1.5, -0.25, 3.0, 8, 0, True, None, None, None, None), ("core", "meaning", "meaning kept", 50.0, 40.0, 60.0, 5, 5, False, None, None, None, None), ("core", "checks", "none", None, None, None, 0, 0, True, None, None, None, None)]
    card = spark.createDataFrame(rows, "set string, block string, measure string, mean double, low double, high double, n long, pending long, complete boolean, diff double, diff_low double, diff_high double, significant boolean")
    lines = {r["measure"]: r["line"] for r in scorecard.card_lines(card).collect()}
    assert lines["numbers kept"] == f"{'numbers kept':62}  95.5 [ 90- 99]  n=20, vs baseline +1.3 [+0,+3]*" or lines["numbers kept"] == f"{'numbers kept':62}  95.5 [ 90- 99]  n=20, vs baseline +1.2 [+0,+3]*"
    assert lines["longest clause: words shorter"] == f"{'longest clause: words shorter':62}  +1.50 [-0.25, +3.00]  n=8"
    assert lines["meaning kept"] == f"{'meaning kept':62} incomplete (5 of 10 scored)  n=5, pending 5"
    assert lines["none"] == f"{'none':62}     —  n=0"
    plain = scorecard.card_lines(card.drop("diff", "diff_low", "diff_high", "significant")).where(F.col("measure") == "numbers kept").first()["line"]
    assert plain.endswith("n=20")


def test_best_marks_compute_their_values_once(spark):
    import random

    import pandas as pd

    # Values that differ when computed again, as sums of doubles do when their rows arrive in another order.
    drawn = F.pandas_udf(lambda x: pd.Series([random.SystemRandom().random() for _ in x]), "double").asNondeterministic()
    table = spark.range(20).select((F.col("id") % 4).alias("m"), (F.col("id") % 4 < 2).alias("up"), drawn("id").alias("v"))
    found = scorecard.best_marks(table, "m", "v", "up").collect()
    assert all(len(of) == 5 for of in ([r for r in found if r["m"] == m] for m in range(4)))
    for m in range(4):
        own = [r for r in found if r["m"] == m]
        assert [r["v"] for r in own if r["best"]] == [(max if m < 2 else min)(r["v"] for r in own)]


def test_drawn_means_equal_pythons_generator():
    import random

    import numpy as np

    for sums in (np.random.default_rng(1).integers(0, 9, 301).astype(float), np.random.default_rng(2).normal(size=301), np.array([0.1])):
        sizes = np.arange(len(sums)) % 7 + 1
        groups, rng, want = list(zip(sums.tolist(), sizes.tolist(), strict=True)), random.Random(1), []
        for _ in range(40):
            g = rng.choices(groups, k=len(groups))
            want.append(sum(x for x, _ in g) / sum(k for _, k in g))
        assert ST.drawn_means(sums, sizes, 40) == want


def test_scorecard_computes_its_measures_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            ran.add(len(b))
            yield b

    rows = spark.range(40).selectExpr("id as item", "id % 7 as doc", "'s' as set", "'B' as track", "'checks' as block", "'numbers kept' as measure", "double(id % 2) as value", "'value' as state")
    scorecard.scorecard(rows.mapInPandas(counted, rows.schema)).collect()
    assert ran.value == 40


def test_contained_reads_only_long_texts_of_pairs_again(spark):
    words = [f"w{i}" for i in range(40)]
    long = [(1, " ".join(words)), (2, "A, " + " ".join(words[3:14]) + "!"), (3, " ".join(words[5:14])), (4, "w3 w4"), (5, None), (6, ""), (None, " ".join(words))]
    short = [(1, " ".join(words[3:13])), (2, " ".join(words[:7])), (3, " ".join([*words[3:11], "x"])), (4, None), (5, " ".join(words[5:13]))]
    found = leakage.contained(spark.createDataFrame(long, "i long, text string"), spark.createDataFrame(short, "j long, text string"), "i", "j")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (1, 5), (2, 1), (2, 5), (3, 5)]
    assert "left_semi" in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftsemi", "left_semi")
