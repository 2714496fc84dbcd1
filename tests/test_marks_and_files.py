"""Vowel marks and their alignment, sentence ranges, numbered lines, manifests, and runs ended by timers."""

from __future__ import annotations

import difflib
import unicodedata

import pytest
from pyspark.sql import functions as F

from sieveline.functions import reading as R
from sieveline.operators import diacritics as D
from sieveline.operators import timeline
from sieveline.sources import io
from sieveline.streaming import incremental

PAIRS = [
    (1, "كَتَبَ الوَلَدُ", "كَتَبَ الوَلَدُ"), (2, "كَتَبَ", "كَتِبَ"), (3, "مَدَّ يَدَهُ", "مَدَ يَدَهُ"), (4, "إلى البيتِ الكبيرِ", "الى البيتِ الصغيرِ جدا"),
    (5, "ذَهَبَ", ""), (6, "", "ذهب"), (7, "قَالَ نَعَمْ ثُمَّ مَضَى", "قَالَ ثُمَّ نَعَمْ مَضَى"), (8, "رَبِّ abc 12 رُبَّ", "رَبَّ رُبَّ"), (9, "مَدُّ", "مَدُّ"), (10, None, "x"), (11, "123", "456"),
]


def plain_units(text):
    """Words as lists of (letter, marks before it)."""
    words, word, pending = [], [], ""
    for c in unicodedata.normalize("NFC", text):
        if "ً" <= c <= "ْ" or c == "ٰ":
            pending += c
        elif "ء" <= c <= "غ" or "ف" <= c <= "ي" or c == "ٱ":
            word.append((c, ("ّ" if "ّ" in pending else "") + pending.replace("ّ", "")))
            pending = ""
        else:
            words, word, pending = words + [word], [], ""
    return [w for w in words + [word] if w]


def plain_rates(a, b):
    form = lambda c: "ا" if c in "أإآٱ" else c

    def pairs(x, y):
        out = []
        for _, i, i2, j, j2 in difflib.SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes():
            out += [(i + k, j + k if j + k < j2 else None) for k in range(i2 - i)]
        return out

    wa, wb = plain_units(a), plain_units(b)
    la, lb = ([(*u, k == len(w) - 1) for w in ws for k, u in enumerate(w)] for ws in (wa, wb))
    of_letters = pairs([form(x[0]) for x in la], [form(x[0]) for x in lb])
    case = sum(j is None or la[i][1] != lb[j][1] for i, j in of_letters)
    bare = lambda u: "" if u[2] else u[1]
    no_case = sum(j is None or bare(la[i]) != bare(lb[j]) for i, j in of_letters)
    plain = lambda w: [(form(x), m) for x, m in w]
    of_words = pairs(["".join(form(x) for x, _ in w) for w in wa], ["".join(form(x) for x, _ in w) for w in wb])
    wrong = sum(j is None or plain(wa[i]) != plain(wb[j]) for i, j in of_words)
    return len(la), case, no_case, len(wa), wrong, [x[0] for x in la] != [x[0] for x in lb]


def test_error_rates_equal_plain_python(spark):
    rows = spark.createDataFrame(PAIRS, "id int, r string, o string")
    got = {r["id"]: r for r in D.error_rates(rows, ["id"], "r", "o").collect()}
    assert 10 not in got
    for i, a, b in PAIRS:
        if a is not None:
            letters, case, no_case, words, wrong, corrupt = plain_rates(a, b)
            share = lambda x, n: x / max(1, n)
            assert [got[i][c] for c in ("letters", "words", "der", "der_no_case", "wer", "corrupt_rate")] == [letters, words, share(case, letters), share(no_case, letters), share(wrong, words), float(corrupt)], i
    assert got[2]["der_no_case"] == 0 < got[2]["der"]
    whole = D.error_rates(rows, [], "r", "o").first()
    sums = [plain_rates(a, b) for _, a, b in PAIRS if a is not None]
    assert whole["der_no_case"] == sum(s[2] for s in sums) / sum(s[0] for s in sums)
    assert D.error_rates(rows.limit(0), ["id"], "r", "o").count() == 0


def test_first_errors(spark):
    rows = spark.createDataFrame([("m", *p) for p in PAIRS], "model string, id int, r string, o string")
    found = {r["id"]: tuple(r["error"]) for r in D.error_examples(rows, ["model"], "r", "o", "id", 99).collect()}
    assert found[2] == ("marks", "ب", "َ", "ِ")
    assert found[4] == ("length", None, "14", "17")
    assert found[5] == ("length", None, "3", "0")
    assert {1, 3, 9, 10, 11}.isdisjoint(found)  # marks at the end of a word stand before no letter
    variants = spark.createDataFrame([("m", 1, "إلى", "الى"), ("m", 2, "قال", "مال")], "model string, id int, r string, o string")
    assert [tuple(r["error"]) for r in D.error_examples(variants, ["model"], "r", "o", "id").orderBy("id").collect()] == [("variant", "إ", "إ", "ا"), ("letter", "ق", "ق", "م")]
    many = spark.range(30).select((F.col("id") % 2).alias("model"), "id", F.lit("قال").alias("r"), F.lit("مال").alias("o"))
    assert sorted(r["id"] for r in D.error_examples(many, ["model"], "r", "o", "id").collect()) == list(range(10))


def test_marks_return_into_texts(spark):
    letters = "بتكلو "
    rows = spark.createDataFrame([(1, "كتب abc ٣ ول", ["َ", "ِ", "ُ", "", "", "#", "x", "ْ"]), (2, "كَتَبَ", ["ُ"]), (3, "abc", ["َ"]), (4, None, ["َ"]), (5, "كتب", None), (6, "", []), (7, "\n«كت»\n", ["َ", "ِ", "ُ"])], "id int, t string, m array<string>")
    got = {r["id"]: (r["i"], r["x"]) for r in rows.select("id", D.prediction_input("t", letters).alias("i"), D.restored("t", "m", letters).alias("x")).collect()}
    assert got[1] == ("كتب  # ول", "كَتِبُ abc ٣# xوْل")
    assert got[2] == ("كتب", "كُتب")
    assert got[3] == ("", "abc")
    assert got[4] == (None, None)
    assert got[5][1] == "كتب"
    assert got[6] == ("", "")
    assert got[7] == ("كت", "\n«كَتِ»\n")
    doubled = spark.createDataFrame([("كت", ["َّ", "ّ"])], "t string, m array<string>").select(D.restored("t", "m", letters).alias("x")).first()["x"]
    assert doubled == unicodedata.normalize("NFC", "ك" + "َّ" + "ت" + "ّ")
    predictions = spark.createDataFrame([("كتب", ["َ", "َ", "َ"]), ("كتب", ["َ", "َ", "َ"])], "input string, marks array<string>")
    assert [r["restored"] for r in D.with_predictions(rows.where("id in (2, 3)"), "t", predictions, letters).orderBy("id").collect()] == ["كَتَبَ", "abc"]


def test_sentence_ranges(spark):
    texts = ["One. Two!  Three? \n four", "  . !\n", "", None, "نعم؟ لا.\n\n\tثم 1.5", "a" * 5000 + ". b", "𝒜. b", "x .  y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for start in (0, 3):
        for r in rows.select("t", R.sentence_ranges("t", start).alias("s")).collect():
            if r["t"] is None:
                assert r["s"] is None
                continue
            import re

            wanted = []
            for m in re.finditer(r"[^.!?؟\n]+[.!?؟]*", r["t"][start:]):
                a, b = m.start() + start, m.end() + start
                a, b = a + len(m[0]) - len(m[0].lstrip()), b - (len(m[0]) - len(m[0].rstrip()))
                wanted += [(a, b)] if a < b else []
            assert [tuple(x) for x in r["s"]] == wanted, r["t"][:20]
    places = spark.createDataFrame([(0, 0), (0, 6), (0, 18), (2, 2), (9, 0)], "id int, place int")
    got = {(r["id"], r["place"]): (r["start"], r["stop"]) for r in timeline.sentence_at(places, "id", "place", rows, "t").collect()}
    assert got == {(0, 0): (0, 4), (0, 6): (5, 9), (0, 18): (11, 17), (2, 2): (None, None), (9, 0): (None, None)}


def test_strict_lines_are_named(spark, tmp_path):
    good = "".join(f'{{"id": {i}, "source": "x{"y" * (i % 50)}"}}\n' + ("\n" if i % 7 == 0 else "") for i in range(3000))
    (tmp_path / "a.jsonl").write_text(good)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        numbered = {(r["file"].rsplit("/", 1)[-1], r["line"]): r["value"] for r in io.numbered_lines(spark, str(tmp_path)).collect()}
        assert numbered == {("a.jsonl", i): x for i, x in enumerate(good.split("\n")[:-1], 1)}
        assert io.read_jsonl(spark, str(tmp_path), "id long, source string", strict=True, required=["source"]).count() == 3000
        (tmp_path / "b.jsonl").write_text(good + '{"id": 1,\n' + good + '{"id": "word", "source": "s"}\n{"id": 2}\n[1]')
        line = good.count("\n")
        with pytest.raises(ValueError, match=f"b.jsonl: line {line + 1} malformed; .*b.jsonl: line {2 * line + 2} malformed; .*b.jsonl: line {2 * line + 3} without source; .*b.jsonl: line {2 * line + 4} malformed"):
            io.read_jsonl(spark, str(tmp_path), "id long, source string", strict=True, required=["source"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError, match="line 3001"):
        (tmp_path / "c").mkdir()
        (tmp_path / "c" / "d.jsonl").write_text(good.replace("\n\n", "\n") + "{]\n")
        io.read_jsonl(spark, str(tmp_path / "c"), strict=True)


def test_manifests(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "b.csv").write_text('﻿x,y\n1,"two\nlines"\n2,3\n')
    (tmp_path / "c.tsv").write_text("x\ty\n")
    (tmp_path / "d.json").write_text('[{"x": 1}, {"x": 2}, {"x": 3}]')
    (tmp_path / "e.txt").write_text("words")
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("part-*.parquet")).rename(tmp_path / "f.parquet")
    paths = [str(tmp_path / n) for n in ("a.jsonl", "b.csv", "c.tsv", "d.json", "e.txt")] + [str(part)]
    files = io.manifest(spark, paths)
    assert {r["file"]: r["rows"] for r in files.collect()} == {"a.jsonl": 2, "b.csv": 2, "c.tsv": 0, "d.json": 3, "e.txt": None, "f.parquet": 7}
    expected = files.withColumn("sha256", F.when(F.col("file") == "b.csv", "0").otherwise(F.col("sha256"))).where("file <> 'e.txt'").unionByName(files.limit(1).withColumn("file", F.lit("gone.csv")))
    differences = {r["file"]: r["difference"] for r in io.manifest_differences(files, expected).collect()}
    assert differences == {"b.csv": "changed", "gone.csv": "missing", "e.txt": "extra"}
    with pytest.raises(ValueError, match=r"b.csv \(changed\).*gone.csv \(missing\)"):
        io.verify_manifest(files, expected)
    io.verify_manifest(files, files.where("file <> 'e.txt'"))
    with pytest.raises(ValueError, match=r"e.txt \(extra\)"):
        io.verify_manifest(files, files.where("file <> 'e.txt'"), extra_allowed=False)


def test_runs_of_a_stream_that_starts_again(spark, tmp_path):
    second = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    rows = spark.createDataFrame([("a", 0), ("a", 50), ("a", 500), ("b", 20), (None, 30), ("b", None)], "k string, s long").withColumn("t", second(F.col("s")))
    schema = rows.select("k", "t").schema
    source, checkpoint, output = (str(tmp_path / n) for n in ("in", "checkpoint", "out"))
    run = lambda: {(r["k"], r["start"].timestamp() - 1_700_000_000, r["stop"].timestamp() - 1_700_000_000, r["n"]) for r in incremental.table_sessions(spark, source, schema, "k", "t", 100, 10, checkpoint, output).collect()}
    rows.select("k", "t").coalesce(1).write.mode("append").parquet(source)
    first = {("a", 0, 50, 2), ("b", 20, 20, 1)}  # the second by the timer; the run from 500 on is open
    assert run() == first
    assert run() == first
    more = spark.createDataFrame([("a", 590), ("b", 595), ("c", 2000)], "k string, s long").withColumn("t", second(F.col("s")))
    more.select("k", "t").coalesce(1).write.mode("append").parquet(source)
    assert run() == first | {("a", 500, 590, 2), ("b", 595, 595, 1)}


def test_alignments_leave_python_as_blocks():
    import pyarrow as pa

    texts = ["كتب ولد " * 60, "كتب", "", None, "ب ت ث"]
    others = ["كتب ولد " * 60, "كتاب", "ب", "x", "ت ب ث"]
    for split in (str, str.split):
        found = D._blocks(split)(pa.array(texts * 500, pa.string()), pa.array(others * 500, pa.string()))
        for x, y, blocks in zip(texts, others, found.to_pylist()[:5], strict=True):
            if x is None:
                assert blocks is None
            else:
                assert [(D._OPS[b["op"]], b["i"], b["i_end"], b["j"], b["j_end"]) for b in blocks] == difflib.SequenceMatcher(a=split(x), b=split(y), autojunk=False).get_opcodes()
        assert found.nbytes < 100 * len(found)  # a step a letter took some hundred bytes a letter
