"""Copied selections: cleaning, steps, repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import guards as G
from sieveline.functions import reading as R
from sieveline.operators import lexicon, ranking


def test_cleaning(spark):
    cases = {
        "ذهب الولد\nإلى المدرسة.\nثم عاد": "ذهب الولد إلى المدرسة.\nثم عاد",
        "ذهب  \r\n  الولد \r إلى\n\nالبيت": "ذهب الولد إلى\n\nالبيت",  # a blank line parts paragraphs
        "قائمة: • قلم • كتاب": "قائمة:\n• قلم\n• كتاب",
        "قال:\nنعم…\nلا\n1) أولا\nثانيا": "قال:\nنعم…\nلا\n1) أولا ثانيا",
        "عام2020م...": "عام 2020 م…",
        "﴿الحمد﴾\nلله": "﴿الحمد﴾\nلله",
        "لله\n﴿الحمد﴾": "لله\n﴿الحمد﴾",
        "قال «نعم.»\nثم": "قال «نعم.»\nثم",
        "  بداية\nوسط": "  بداية وسط",
        "": "",
        None: None,
    }
    rows = spark.createDataFrame(list(cases.items()), "t string, wanted string")
    assert [(r["x"], r["wanted"]) for r in rows.select(R.clean("t").alias("x"), "wanted").collect()] == [(w, w) for w in cases.values()]
    forms = spark.createDataFrame([("ﻻ یک", "لا يك"), ("ﺍﻟﻌﺮﺑﻴﺔ ﷲ", "العربية الله"), ("﴿abc﴾", "﴿abc﴾")], "t string, wanted string")
    assert all(r["x"] == r["wanted"] for r in forms.select(R.plain_forms("t").alias("x"), "wanted").collect())


def test_steps_and_repairs(spark):
    rows = spark.createDataFrame([("1. ذهب الولد إلى المدرسة في الصباح. عاد.\nقال تعالى شيئا.",)], "t string")
    steps = [(s["paragraph"], s["kind"], s["text"], s["to_model"]) for s in rows.select(R.plan("t").alias("p")).first()["p"]]
    assert steps == [(0, "bullet", "1.", False), (0, "sentence", "ذهب الولد إلى المدرسة في الصباح.", True), (0, "sentence", "عاد.", False), (1, "protected", "قال تعالى شيئا.", False)]
    pairs = spark.createDataFrame([("ذهب الولد لأنه جائع", "ذهب الولد. لأنه جائع"), ("ذهب ٣ أولاد إلى", "ذهب 3 أولاد إلى البيت."), ("قال ق. م. ثم", "قال ق. م. ثم")], "s string, o string")
    got = pairs.select(R.fix_punctuation("s", "o").alias("a"), R.match_digit_style("s", "o").alias("b"), R.keep_open_ending("s", "o").alias("c"), R.is_open_ended("s").alias("d")).collect()
    assert got[0]["a"] == "ذهب الولد؛ لأنه جائع"
    assert got[1]["b"] == "ذهب ٣ أولاد إلى البيت."
    assert got[1]["c"] == "ذهب 3 أولاد إلى"
    assert got[2]["a"] == "قال ق. م. ثم"
    assert got[0]["d"]
    styles = spark.createDataFrame([("٣ ثم 3", "3 و 4"), ("١٫٥ و ۲", "2 ثم 1.5 و12"), (None, "3"), ("3", None), ("", "7.")], "s string, o string")
    assert [r[0] for r in styles.select(R.match_digit_style("s", "o")).collect()] == ["3 و 4", "۲ ثم 1.5 و12", "3", None, "7."]
    joined = spark.createDataFrame([([(0,), (0,), (1,)], ["a", "b", "c"])], "s array<struct<paragraph int>>, o array<string>").select(R.reassembled("s", "o").alias("x"))
    assert joined.first()["x"] == "a b\n\nc"
    assert spark.range(1).select(G.is_protected(F.lit("كلمة عادية")).alias("x"), G.is_protected(F.lit("صدق الله العظيم")).alias("y")).first().asDict() == {"x": False, "y": True}


def test_choices(spark):
    runs = spark.createDataFrame([("a", 80.0, 0.5), ("b", 79.5, 0.7), ("c", 70.0, 0.9)], "run string, sari double, p double")
    assert ranking.checkpoint_choice(runs, "sari", "p", 0.4).first()["run"] == "b"
    rows = spark.range(10)
    got = ranking.tagged_examples(rows, {"even": F.col("id") % 2 == 0, "big": F.col("id") > 7}, "id", 3, "s").collect()
    assert sorted((r["tag"], r["tag_rows"]) for r in got) == [("big", 2)] * 2 + [("even", 5)] * 3
    pairs = spark.createDataFrame([(1, "صعب.", "سهل. أسهل.")], "item int, source string, output string")
    levels = spark.createDataFrame([("صعب.", 12), ("سهل.", 7), ("أسهل.", 5)], "text string, level int")
    assert lexicon.hardest_lead(pairs, "item", levels).first()["lead"] == 5
