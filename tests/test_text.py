"""Text functions and guards, on Arabic and other literals with expectations worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sieveline.functions import guards as G
from sieveline.functions import scalars as S
from sieveline.functions import text as T


def value(spark, column, **columns):
    df = spark.createDataFrame([tuple(columns.values()) or (1,)], list(columns) or ["one"])
    return df.select(column.alias("v")).first()["v"]


def cases_test_text():
    """Made inside a session, as Columns need one."""
    return [
        (T.norm("t"), "كتب الولد"), (T.strip_marks("t", "vowels"), "كتب  الولـد "), (T.words("t"), ["كتب", "الولد"]), (T.word_count("t"), 2), (T.is_short("t"), True),
        (T.match_key(F.lit("أَإة، ى!")), "ااه ي"), (T.western_digits(F.lit("٣ و ۴")), "3 و 4"), (T.longest_clause(F.lit("واحد اثنان، ثلاثة.")), 2), (T.longest_clause(F.lit("")), 0),
        (T.char_ngrams(F.lit("abcdabcd"), 5), ["abcda", "bcdab", "cdabc", "dabcd"]), (T.char_ngrams(F.lit("abc"), 5), ["abc"]), (T.word_stem(F.lit("والمدرسة")), "مدرسه"), (T.word_stem(F.lit("ولد")), "ولد"),
        (T.option_labels(F.lit("ما هذا؟ (أ) قلم (ب) كتاب")), ["أ", "ب"]), (T.question_stem(F.lit("ما هذا؟ (أ) قلم (ب) كتاب")), "ما هذا؟"), (T.readability_units(F.lit("هذا قلم. هذا كتاب.")), ["هذا قلم.", "هذا كتاب."]),
        (T.sari_tokens(F.lit("Costs 3.50, yes.")), ["costs", "3.50", ",", "yes", "."]), (T.single_spaces(F.lit("a\x1c  b")), "a b"),
    ]


def test_text(spark):
    for n, (column, expected) in enumerate(cases_test_text()):
        assert value(spark, column, t="كَتَبَ  الولـد ") == expected, n


def pair(spark, column, source, output):
    return value(spark, column, s=source, o=output)


def cases_test_guards():
    """Made inside a session, as Columns need one."""
    return [
        (G.numbers_equal("s", "o"), "لديه ٣ كتب و 2.5", "2.5 و 3", True), (G.numbers_equal("s", "o"), "3 3", "3", False), (G.numbers_contained("s", "o"), "3", "3 4", True),
        (G.flags("s", "o")["negation changed"], "لا يعلم", "يعلم", True), (G.flags("s", "o")["negation changed"], "يعلم", "يعلم", None), (G.flags("s", "o")["limit changed"], "لا يقل عن خمسة", "على الأقل خمسة", False),
        (G.flags("s", "o")["limit changed"], "على الأكثر خمسة", "على الأقل خمسة", True), (G.flags("s", "o")["condition changed"], "إذا جاء", "جاء", True),
        (G.options_preserved("s", "o"), "(أ) قلم (ب) كتاب", "(ب) كتاب (أ) قلم", False), (G.options_preserved("s", "o"), "قلم", "كتاب", True), (G.verses_preserved("s", "o"), "قال ﴿ الحمد  لله ﴾", "﴿الحمد لله﴾", True), (G.verses_preserved("s", "o"), "﴿الحمد لله﴾", "الشكر", False),
        (G.honorifics_preserved("s", "o"), "عمر رضي الله عنه", "عمر رضي الله عنهم", False), (G.honorifics_preserved("s", "o"), "عمر رضي الله عنه", "عمر رضي الله عنه رضي الله عنه", True),
        (G.end_mark("s"), "نعم.»", "", "."), (G.end_mark("s"), "نعم", "", ""), (G.normalize_ending("s", "o"), "جاء الولد،", "جاء الولد.", "جاء الولد،"), (G.normalize_ending("s", "o"), "جاء الولد", "جاء الولد. .", "جاء الولد"), (G.normalize_ending("s", "o"), "جاء.", "جاء. ", "جاء."),
        (G.retention("s", "o"), "ذهب الولد المدرسة", "الولد ذهب", 2 / 3), (G.retention("s", "o"), "في", "x", 1.0), (G.fallback("s", "o"), "ذهب الولد إلى المدرسة", " ", "empty"), (G.fallback("s", "o"), "ذهب الولد إلى المدرسة", "قلم", "drifted"),
        (G.fallback("s", "o"), "ذهب 3 أولاد", "ذهب 4 أولاد", "numbers"), (G.fallback("s", "o"), "لا ذهب الولد", "ذهب الولد", "negation"), (G.fallback("s", "o"), "ذهب الولد", "ذهب الولد", None), (G.punctuation_only("s", "o"), "نعم، هو", "نعم هو.", True),
        (G.rule_breaks("s", "o"), "ذهب الولد ولعب", "ذهب الولد. ثم لعب", [G.FULL_STOP]), (G.rule_breaks("s", "o"), "ذهب، لأن", "ذهب، لأن الجو", ["comma before a cause"]), (G.repeats("o"), "", "نعم نعم", True), (G.repeats("o"), "", "نعم هو", False),
    ]


def test_guards(spark):
    for n, (column, source, output, expected) in enumerate(cases_test_guards()):
        assert pair(spark, column, source, output) == (pytest.approx(expected) if isinstance(expected, float) else expected), n


def cases_test_scalars():
    """Made inside a session, as Columns need one."""
    return [
        (S.hash_bucket(F.lit(42), "s"), int(__import__("hashlib").sha256(b"s:42").hexdigest()[:8], 16) % 10_000), (S.hash_shard(F.lit("x"), 7), int(__import__("hashlib").md5(b"x").hexdigest(), 16) % 7),
        (S.tier(F.lit(0.9), F.lit(True), F.lit(True)), "A"), (S.tier(F.lit(0.8), F.lit(True), F.lit(True)), "B"), (S.tier(F.lit(0.9), F.lit(None).cast("boolean"), F.lit(True)), "C"), (S.gate(F.lit(None).cast("double"), F.lit(0.0)), None),
        (S.expected_level(F.array(F.lit(0.25), F.lit(0.75))), 1.75), (S.most_likely(F.array(F.lit(0.5), F.lit(0.5))), 1), (S.five_level(F.lit(19)), 5), (S.five_level(F.lit(8)), 2), (S.ordinal_encode(F.lit(3), 5), [1, 1, 0, 0]), (S.ordinal_decode(F.array(F.lit(2.0), F.lit(-1.0))), 2),
        (S.item_set(F.lit(""), F.lit("legal")), "held-out"), (S.item_set(F.lit(None).cast("string"), F.lit("x")), "core"), (S.reference_status(F.lit("a"), F.array(F.lit(" a "))), "unchanged"), (S.without_style_tag(F.lit("[EASY-1] x")), "x"), (S.clamp(F.lit(1.5)), 1.0),
        (S.banned_tokens(F.array(*(F.lit(x) for x in "abcab")), 3), ["c"]), (S.multiset_intersection_size(F.array(*(F.lit(x) for x in "aab")), F.array(*(F.lit(x) for x in "abb"))), 2),
        (S.yes_probability(F.array(F.struct(F.lit(" Yes").alias("token"), F.lit(0.0).alias("logprob")), F.struct(F.lit("no").alias("token"), F.lit(0.0).alias("logprob")))), 0.5),
    ]


def test_scalars(spark):
    for n, (column, expected) in enumerate(cases_test_scalars()):
        assert value(spark, column) == expected, n
