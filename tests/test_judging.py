"""Judges, selection among candidates, the corpus audit, stems and readings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators import judging, lexicon, scorecard, selection
from sieveline.operators import statistics as ST


def _plain_stems(word):
    found = {word}
    for p in ("", *T.STEM_PREFIXES):
        for s in ("", *T.STEM_SUFFIXES):
            rest = word[len(p) : len(word) - len(s)]
            if word.startswith(p) and word.endswith(s) and len(p) + len(s) + 2 <= len(word):
                found.add(rest)
    return sorted(found, key=lambda x: (-len(x), x))


def test_stems_equal_plain_python(spark):
    words = ["والكتاب", "كتابها", "ب", "للمدارس", "ليلى", "وفي", "المعلمون", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem_candidates("w").alias("s"), T.lexical_key("w").alias("k")).collect()
    assert {r["w"]: r["s"] for r in rows} == {w: _plain_stems(w) for w in words}
    assert {r["w"]: r["k"] for r in rows}["المعلمون"] == "معلمون" and {r["w"]: r["k"] for r in rows}["ب"] == "ب"


def test_ambiguous_merges_spellings_that_lack_marks(spark):
    # kataba and kutub are two readings; a bare spelling and one without all vowels fit the first; the last vowel tells nothing apart.
    counts = {"كَتَبَ": 5, "كُتُب": 4, "كتب": 3, "كَتب": 2, "كَتَبُ": 1, "عِلْم": 6, "علم": 2, "عَلَم": 2, "بَيت": 9, "بيت": 3}
    tokens = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "token string")
    spelled = lexicon.spellings(tokens, "token")
    assert {r["bare"]: sorted(r["c"], reverse=True) for r in spelled.select("bare", lexicon.reading_counts("spellings").alias("c")).collect()} == {"كتب": [11, 4], "علم": [8, 2], "بيت": [12]}
    assert [(r["bare"], r["readings"]) for r in lexicon.ambiguous(spelled).collect()] == [("كتب", 2)]
    assert {r["token"] for r in lexicon.repeated(tokens, "token", 5).collect()} == {"كَتَبَ", "عِلْم", "بَيت"}


VIOLATIONS = [
    ("الولد يقرأ الكتاب الجديد في البيت كل يوم.", "الولد يقرأ الكتاب في البيت كل يوم.", "generated", "news", "A", 2.5, []),
    ("الولد يقرأ الكتاب الجديد في البيت كل يوم.", "الولد يقرأ الكتاب", "generated", "odes", None, None, ["protected source", "ending differs", "tier", "lead"]),
    ("نص قصير", "نص", "short", "news", None, None, ["short: output differs"]),
    ("نص قصير", "نص قصير", "identity", "odes", None, None, []),
    ("نَص قصير", "نَص قصير", "protected", "odes", None, None, ["diacritics"]),
    ("نص", "نص", "other", "news", "A", 3.0, ["unknown kind other"]),
    ("نص قصير جدا.", "نص قصير.", "generated", "news", "B", 2.0, ["short source"]),
]


def test_violations(spark):
    rows = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(VIOLATIONS)], "i int, s string, t string, kind string, src string, tier string, lead double")
    found = rows.select("i", selection.violations("s", "t", "kind", "src", "tier", "lead", ["odes"]).alias("v")).orderBy("i").collect()
    for r, case in zip(found, VIOLATIONS, strict=True):
        if case[2] == "generated" and case[4] is None:
            assert {"protected source", "tier", "lead"} <= set(r["v"])
        else:
            assert r["v"] == case[6]


def test_track_verdicts(spark):
    schema = "item int, track string, source string, output string, meaning boolean, language boolean, hard_source int, hard_output int, level_source double, level_output double"
    rows = [
        (1, "A1", "عنده 3 كتب", "عنده 3 كتب كبيرة", False, False, 2, 1, 12.0, 10.0),
        (2, "A1", "عنده 3 كتب", "عنده 4 كتب", False, True, 0, 0, 9.0, 8.0),
        (3, "C", "نص سهل", "نص آخر", True, False, 4, 1, 12.0, 10.0),
        (4, "E3", "نص", "نص آخر", None, None, 1, 1, None, None),
        (5, "E4", "نص", "نَص", None, None, None, None, None, None),
        (6, "F", "نص", "نص", False, False, None, None, None, None),
        (7, "A2", "لا أحب", "أحب", False, False, 0, 0, 11.0, 12.0),
    ]
    got = {(r["item"], r["verdict"]): r["passed"] for r in judging.track_verdicts(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v for k, v in got.items() if k != (5, "D")} == {
        (1, "A1"): True, (1, "D"): True, (1, "B2"): True, (1, "B3"): True, (2, "A1"): False, (2, "D"): False, (3, "C"): False, (3, "D"): True,
        (4, "E3"): None, (4, "D"): None, (4, "B2"): None, (5, "E4"): True, (7, "A2"): False, (7, "D"): True, (7, "B3"): False,
    }
    assert got[5, "D"] is False  # a mark was added, which breaks a house rule


def test_selection_handles_gaps_and_ties(spark):
    c = spark.createDataFrame([(1, "a", 1, 0.9, 1.0), (1, "b", 2, 0.8, 1.0), (2, "c", 1, None, None), (2, "d", 2, None, None), (3, "e", 1, None, 3.0), (3, "f", 2, 0.9, 3.0), (3, "g", 3, 0.9, 3.0)], "id int, text string, position int, score double, lead double")
    assert [tuple(r) for r in selection.fallbacks(c, "id", "position").orderBy("id").collect()] == [(1, "a", 1.0), (2, "c", 0.0)]
    assert [(r["id"], r["text"], r["tier"]) for r in selection.reselected(c, "id", "position", 0.7).collect()] == [(3, "f", "A")]
    assert selection.reselected(c.limit(0), "id", "position", 0.7).count() == 0
    same = selection.identity_pairs(c, "text", "identity").first()
    assert same["source_text"] == same["output_text"] and same["tier"] is None and same["kind"] == "identity"


def test_flags_and_gaps(spark):
    e = spark.createDataFrame([(1, [("deletion", "major"), ("grammar", "minor")]), (2, [("punctuation", "major"), (None, None)]), (3, []), (4, None)], "i int, errors array<struct<type:string,severity:string>>")
    got = {r["i"]: r["f"] and (r["f"]["meaning"], r["f"]["language"]) for r in e.select("i", judging.major_flags("errors").alias("f")).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, False), 4: None}
    c = judging.closeness(spark.createDataFrame([(1.0, 1.5), (0.0, 0.25), (1.0, None)], "t double, p double"), "t", "p").first()
    assert (c["closeness"], c["accuracy"], c["scored"], c["failed"]) == (pytest.approx(0.875), 1.0, 2, 1)
    r = spark.createDataFrame([("identity", True, False, None, None), ("generated", False, True, 0.8, 1.0), ("generated", False, False, 0.8, 1.0), ("generated", False, True, None, -1.0)], "k string, u boolean, g boolean, m double, l double")
    assert [x[0] for x in r.select(selection.reward("k", "u", "g", "m", "l")).collect()] == [1.0, 0.4, 0.0, 0.0]
    assert [x[0] for x in r.select(selection.reward("k", "u", "g", "m", "l", meaning_gate=0.9)).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert r.select(F.count(F.lit(1))).first()[0] == 4


def test_spread_bootstrap(spark):
    rows = spark.createDataFrame([(g, i % 40, float((i * 7919) % 11 < 4), i) for i in range(400) for g in ("a", None)] + [("one", 1, 1.0, 1), ("gap", 1, None, 1)], "g string, d long, v double, i long")
    got = {r["g"]: r for r in ST.spread_bootstrap(rows, ["g"], "d", "v", scale=100.0).collect()}
    again = {r["g"]: r for r in ST.spread_bootstrap(rows.repartition(7), ["g"], "d", "v", scale=100.0).collect()}
    assert got.keys() == again.keys() == {"a", None, "one"}
    for g in got:
        assert got[g]["n"] == again[g]["n"] and all(got[g][c] == pytest.approx(again[g][c]) for c in ("mean", "low", "high"))
    plain = {r["g"]: r for r in ST.cluster_bootstrap(rows, ["g"], "d", "v", "i", scale=100.0).collect()}
    for c in ("mean", "low", "high"):
        assert got["a"][c] == pytest.approx(plain["a"][c], abs=1.5) and got[None][c] == pytest.approx(got["a"][c])
    assert (got["one"]["low"], got["one"]["mean"], got["one"]["high"], got["a"]["n"]) == (100, 100, 100, 400)
    whole = ST.spread_bootstrap(rows.where("g = 'a'"), [], "d", "v", scale=100.0).first()
    assert whole["low"] == pytest.approx(got["a"]["low"])
    assert ST.spread_bootstrap(rows.limit(0), ["g"], "d", "v").count() == 0


def test_measures_of_meaning_and_hard_words(spark):
    long = "كلمة " * 18
    items = spark.createDataFrame(
        [(1, "d", "core", "A1", long + "أخيرة", "كلمة قصيرة", 0.9, 12.0, 9.0, 3, 1), (2, "d", "core", "A1", long + "أخيرة", long + "أخيرة", 0.9, 12.0, 12.0, 0, 2), (3, "d", "core", "A1", long + "أخيرة", "كلمة", None, None, None, 2, 0), (4, "d", "core", "A1", "نص", "نص", 0.9, None, None, None, None)],
        "item long, doc string, set string, track string, source string, output string, same double, level_source double, level_output double, hard_source int, hard_output int",
    )
    rows = scorecard.item_measures(items, simpler_least=(3, 1.0)).collect()
    got = {(r["item"], r["measure"]): (r["value"], r["state"]) for r in rows}
    joint = "meaning kept and simpler"
    assert [got.get((i, joint)) for i in (1, 2, 3, 4)] == [(1, "value"), (0, "value"), (None, "pending"), None]
    assert [got.get((i, "hard words: fewer")) for i in (1, 2, 3, 4)] == [(2, "value"), None, (2, "value"), None]
    bare = scorecard.item_measures(items.drop("same"), simpler_least=(3, 1.0))
    assert bare.where("block = 'meaning'").count() == 0 and bare.where("measure = 'hard words: fewer'").count() == 2
