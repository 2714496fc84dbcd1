"""Targeted defects under quotas and the planted bench."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.operators import synthesis as S


def one(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("t"))).collect()]


def test_phrases_go_whole(spark):
    words = "ذهب الولد الصغير إلى البيت الكبير بعد صلاة الفجر مع أخيه ثم عاد إلى أمه"
    rows = spark.range(60).select("id", F.lit(words + ".").alias("t"))
    w, starts = (words + ".").split(), set()
    for r in rows.select(S.phrase_dropped("t", "id")).collect():
        left = r[0].split()
        i = next(i for i in range(len(w)) if i >= len(left) or left[i] != w[i])
        n = len(w) - len(left)
        assert w[:i] + w[i + n :] == left
        assert 2 <= n <= 5
        starts.add(i)
    assert len(starts) > 2
    assert one(spark, lambda t: S.phrase_dropped(t, F.lit(1)), "كلمات قليلة هنا", None, "") == [None, None, None]
    # A sign at the end of the phrase stays at the word before.
    signed = "نام الولد الصغير وحده في البيت، وقام أخوه"
    got = {r[0] for r in spark.range(80).select(S.phrase_dropped(F.lit(signed), "id")).collect()} - {None}
    assert got == {"نام الولد الصغير وحده، وقام أخوه"}


def test_adjectives_questions_and_splits(spark):
    assert one(spark, lambda t: S.adjective_dropped(t, F.lit(1)), "ركض الولد خلف الحصان الأبيض، ثم عاد", "ركض ولد خلف حصان أبيض هنا", "الحصان الأبيض جميل") == ["ركض الولد خلف الحصان، ثم عاد", None, None]
    assert one(spark, S.as_question, "نام. ذهب الولد إلى البيت.", "هل ذهب الولد إلى البيت؟", "نام الولد.", "اختر: (أ) بيت أو قلم كبير", "", None) == ["نام. هل ذهب الولد إلى البيت؟", None, None, None, None, None]
    texts = ("ذهب الولد باكرا، ونام أخوه في البيت", "أكل الولد خبزا ثم شرب كأس ماء", "نعم، ولا", "بلا علامات هنا")
    assert one(spark, lambda t: S.split_in_two(t, F.lit(1)), *texts) == ["ذهب الولد باكرا. نام أخوه في البيت", "أكل الولد خبزا. ثم شرب كأس ماء", None, None]
    cut = {r[0] for r in spark.range(40).select(S.split_in_two(F.lit("أ ب ت، وث ج ح، خ د ذ ثم ر ز س"), "id")).collect()}
    assert cut == {"أ ب ت. ث ج ح، خ د ذ ثم ر ز س", "أ ب ت، وث ج ح. خ د ذ ثم ر ز س", "أ ب ت، وث ج ح، خ د ذ. ثم ر ز س"}


def test_quotas(spark):
    rows = spark.range(50).select("id", F.concat(F.lit("مصدر "), F.col("id")).alias("s"), F.concat(F.lit("ذهب الولد الصغير إلى البيت الكبير بعد صلاة الفجر، ونام أخوه هناك مرة "), F.col("id") % 20).alias("o"))
    rows = rows.unionByName(rows.limit(5)).unionByName(spark.createDataFrame([(99, "x", None), (98, None, "قصير")], "id long, s string, o string"))
    quotas = {"phrase": 12, "question": 30, "split": 70}
    kept, report = S.targeted(rows, "s", "o", "id", quotas)
    got = kept.collect()
    counts = {k: sum(r["kind"] == k for r in got) for k in quotas}
    assert counts == {"phrase": 12, "question": 30, "split": 50}
    assert {r["kind"]: (r["quota"], r["made"], r["short"]) for r in report.collect()} == {"phrase": (12, 12, 0), "question": (30, 30, 0), "split": (70, 50, 20)}
    assert len({(r["source"], r["candidate"]) for r in got}) == len(got)
    assert {r["label"] for r in got if r["kind"] == "split"} == {"same"}
    assert sorted(map(str, S.targeted(rows.repartition(7), "s", "o", "id", quotas)[0].collect())) == sorted(map(str, got))
    assert S.targeted(rows.limit(0), "s", "o", "id", quotas)[0].count() == 0


def test_bench_slices(spark):
    text = "this is a long text number 7 of the list"
    pairs = spark.range(30).select("id", F.lit(text).alias("original"), F.concat(F.lit(text + " "), F.col("id")).alias("candidate"), F.when(F.col("id") < 20, "same").otherwise("minor").alias("label"))
    made = S.bench(pairs.withColumn("label", F.lit("faithful")), pairs.withColumn("label", F.when(F.col("id") < 3, "unsure").otherwise("same")), pairs, 8, 5).collect()
    slices = {s: [r for r in made if r["slice"] == s] for s in ("adv", "human", "silver", "planted", "identity")}
    assert {s: len(r) for s, r in slices.items() if s != "planted"} == {"adv": 30, "human": 27, "silver": 30, "identity": 5}
    sources = {r["id"][2:].split("_")[0] for r in slices["planted"]}
    assert len(sources) == 8
    assert all(sum(r["id"].startswith(f"pl{s}_") for r in slices["planted"]) == 3 for s in sources)  # two and the number
    assert sources.isdisjoint(r["id"][2:] for r in slices["identity"])
    assert all(r["candidate"] == r["original"] for r in slices["identity"])
    assert len({r["id"] for r in made}) == len(made)
