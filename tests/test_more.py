"""Values from replies, stores, evaluation rows and cross-validation."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sieveline.functions import scalars as S
from sieveline.functions import text
from sieveline.operators import rewriting, splits
from sieveline.operators import statistics as ST
from sieveline.sources import io


def test_values_from_replies(spark):
    reply = 'SCORE: 2 then {"a": 1} and {"items": [{"x": 3}]} {bad score: 4.5'
    row = spark.createDataFrame([(reply, "1: 5\n2: 6\n2: 7\n3) 1")], "t string, n string").select(
        S.score_from_text("t").alias("s"), S.json_from_text("t", "items array<struct<x int>>", "items").alias("j"), S.numbered_ratings("n", 3).alias("m"), S.numbered_ratings("n", 10).alias("few")
    ).first()
    assert row["s"] == 4.5
    assert row["j"]["items"][0]["x"] == 3
    assert row["m"] == {1: 5, 2: 7, 3: 1}
    assert row["few"] is None
    assert spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double").agg(S.nan_mean("x").alias("m")).first()["m"] == 2.0


def test_store_and_eval_rows(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"score": len(name)}))
    assert {r["submission"] for r in io.read_store(spark, [str(tmp_path)], "score int").collect()} == {"one", "two"}
    df = spark.range(100, 150).select("id", F.concat(F.lit(" s"), "id").alias("src"), F.lit("r").alias("r1"), F.lit(" ").alias("r2"))
    got = io.eval_rows(df, "id", "src", ["r1", "r2"], "t-", 50).collect()
    assert {r["id"]: r["source"] for r in got} == {f"t-{i}": f"s{100 + i}" for i in range(50)}
    assert got[0]["references"] == ["r"]
    with pytest.raises(ValueError, match="50 rows"):
        io.eval_rows(df, "id", "src", ["r1"], "t-", 51)


def test_cross_validation(spark):
    rows = spark.range(200).select("id", (F.col("id") % 2).alias("y"), ((F.col("id") % 2) * 2.0 + (F.col("id") % 7) / 7.0).alias("x"))
    out = ST.cross_validated(rows, ["x"], "y", "id")
    assert out.count() == 200
    assert ST.auc(out, "p", "y").first()["auc"] == 1.0


def test_eval_rows_numbers_many_rows_once(spark):
    rows = spark.range(300_000, numPartitions=16).select(F.xxhash64("id").cast("string").alias("key"), F.lit("x").alias("src"))
    got = io.eval_rows(rows, "key", "src", ["src"], "", 300_000).select(F.col("id").cast("long").alias("n")).agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(got) == (300_000, 0, 299_999)


def test_added_commas_become_stops(spark):
    rows = [
        ("ذهب الولد إلى البيت وأكل الطعام مع أخيه", "ذهب الولد إلى البيت، وأكل الطعام مع أخيه", "ذهب الولد إلى البيت. وأكل الطعام مع أخيه"),
        ("ذهب الولد إلى البيت، وأكل الطعام مع أخيه", "ذهب الولد إلى البيت، وأكل الطعام مع أخيه", "ذهب الولد إلى البيت، وأكل الطعام مع أخيه"),  # the source's own comma
        ("ذهب الولد إلى البيت وأكل", "ذهب الولد إلى البيت، وأكل", "ذهب الولد إلى البيت، وأكل"),  # a clause of one word
        ("ذهب الولد إلى البيت", "ذهب الولد إلى البيت، أكل الطعام مع أخيه", "ذهب الولد إلى البيت، أكل الطعام مع أخيه"),  # no clause opens
        ("ذهب الولد إلى البيت", "ذهب الولد إلى البيت، وأكل هنا. مع أخيه الكبير", "ذهب الولد إلى البيت، وأكل هنا. مع أخيه الكبير"),  # the clause ends after two words
        (None, "ذهب، ثم", None), ("", "", ""),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a string, b string, c string")
    got = {r["i"]: r["x"] for r in df.select("i", rewriting.commas_to_stops("a", "b").alias("x")).collect()}
    assert got == {i: r[2] for i, r in enumerate(rows)}


def test_persian_letters_and_stored_splits(spark):
    assert spark.range(1).select(text.arabic_letters(F.lit("یکۀھہ"))).first()[0] == "يكةهه"
    rows = spark.createDataFrame([(i, f"t{i}", "s", ("train", "dev", "test")[i % 3]) for i in range(300)], "id long, key string, stratum string, old string")
    whole = spark.createDataFrame([("s", 10_000, 0)], "stratum string, test_threshold long, dev_width long")
    got = splits.split_rows(rows, "key", "id", "stratum", "salt", whole, "old").groupBy("old", "split").count().collect()
    assert {(r["old"], r["split"]): r["count"] for r in got} == {("train", "test"): 100, ("dev", "dev"): 100, ("test", "dev"): 100}  # the threshold alone leaves no room for train
    assert splits.split_rows(rows, "key", "id", "stratum", "salt", whole).where("split = 'test'").count() == 300
