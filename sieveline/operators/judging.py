"""Judges of rewrites: their flags, verdicts by track, acceptance, and how they compare with people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions import scalars as V
from ..functions import text as T
from . import statistics as S
from .prefix import quantiles

# Kinds of errors, and the planted kinds that a judge of meaning must catch.
MEANING_ERRORS, LANGUAGE_ERRORS = ("insertion", "deletion", "substitution"), ("grammar", "punctuation")
PLANTED_MEANING = ("number changed", "negation dropped", "quantifier swapped", "clause deleted", "detail invented")


def major_flags(errors: Column | str) -> Column:
    """Struct of `meaning` and `language`: some error (type, severity) of that sort is major. Null without a verdict."""
    errors = T.as_column(errors)
    some = lambda kinds: F.exists(errors, lambda e: F.coalesce((e["severity"] == "major") & e["type"].isin(*kinds), F.lit(False)))
    return F.when(errors.isNotNull(), F.struct(some(MEANING_ERRORS).alias("meaning"), some(LANGUAGE_ERRORS).alias("language")))


def track_verdicts(rows: DataFrame) -> DataFrame:
    """item, verdict, passed: each item's own track and the overlays D (language), B2 (hard words), B3 (level) that apply.

    rows: item, track, source, output, meaning and language (major flags, null where no judge has seen the pair),
    hard_source, hard_output, level_source, level_output (null where unknown). Verses (F) have no verdicts; a copy needs
    no judge; a verdict that applies but is not judged yet is null.
    """
    copy = T.norm("source") == T.norm("output")
    known = F.col("meaning").isNotNull() & F.col("language").isNotNull()
    rows = rows.where("track <> 'F'").select(
        "item", "track", "source", "output", "hard_source", "hard_output", "level_source", "level_output", (copy | known).alias("judged"),
        *(F.when(copy, F.lit(False)).otherwise(F.col(c)).alias(c) for c in ("meaning", "language")),
    )
    same_numbers, kept, track = G.numbers_equal("source", "output"), ~F.col("meaning"), F.col("track")
    own = (
        F.when(track.isin("A1", "A3", "E2"), kept & same_numbers).when(track == "A2", kept & same_numbers & (G.negations("source") == G.negations("output")))
        .when(track == "B", kept & (T.longest_clause("output") <= 15)).when(track == "C", kept & ~F.col("language")).when(track == "E1", kept & (G.end_mark("source") == G.end_mark("output")))
        .when(track.isin("E3", "E4"), kept)
    )
    entries = (
        (track, own, own.isNotNull() | ~F.col("judged")), (F.lit("D"), ~F.col("language") & (F.size(G.rule_breaks("source", "output")) == 0), F.lit(True)),
        (F.lit("B2"), kept & (F.col("hard_output") < F.col("hard_source")), (track != "C") & (F.col("hard_source") > 0)),
        (F.lit("B3"), kept & (F.col("level_output") < F.col("level_source")), (track != "C") & (F.col("level_source") >= 10) & F.col("level_output").isNotNull()),
    )
    listed = F.array(*(F.when(applies, F.struct(name.alias("verdict"), F.when(F.col("judged"), passed).alias("passed"))) for name, passed, applies in entries))
    return rows.select("item", F.explode(F.array_compact(listed)).alias("e")).select("item", "e.*")


def acceptance(rows: DataFrame, rule: dict[str, float]) -> DataFrame:
    """One row: recall, clean pass and kappa of a judge's flags against the official ones, planted errors caught, and `accept`.

    rows: official_meaning, official_language (null without an official verdict), meaning, language, planted (kind or
    null). rule: least meaning_recall, meaning_clean_pass, meaning_kappa, planted_meaning, language_recall.
    """
    of_meaning = F.col("planted").isin(*PLANTED_MEANING)
    counts = rows.agg(
        *(c for name in ("meaning", "language") for c in S.binary_counts(F.col(f"official_{name}"), F.col(name), f"{name}_")), F.count_if(of_meaning).alias("planted_rows"), F.count_if(of_meaning & F.col("meaning")).alias("caught")
    )
    found = counts.select(*S.binary_rates("meaning_"), *S.binary_rates("language_"), F.bround(F.col("caught") / F.greatest(F.lit(1), F.col("planted_rows")), 3).alias("planted_meaning"))
    accept = F.lit(True)
    for name, least in rule.items():
        accept = accept & (F.col(name) >= least)
    return found.withColumn("accept", accept)


def planted_caught(rows: DataFrame) -> DataFrame:
    """planted, caught, n: kinds of meaning by the meaning flag, all others by the language flag."""
    hit = F.when(F.col("planted").isin(*PLANTED_MEANING), F.col("meaning")).otherwise(F.col("language"))
    return rows.where("planted is not null").groupBy("planted").agg(F.count_if(hit).alias("caught"), F.count(F.lit(1)).alias("n"))


def separation(rows: DataFrame, by: list[str], score: str, label: str, least: int = 10) -> DataFrame:
    """Per scorer: t95 (95th percentile of the changed rows, label 0), frr (same rows, label 1, at or below it) and catch
    (changed rows at or below the 5th percentile of the same ones). Scorers with fewer than `least` rows of either are left out.

    Both bars are exact quantiles by running counts over ranges of scores, so no task holds a scorer's scores.
    """
    x, same, changed = F.col(score), F.col(label) == 1, F.col(label) == 0
    rows = rows.where(x.isNotNull())
    counts = rows.groupBy(*by).agg(F.count_if(changed).alias("n_changed"), F.count_if(same).alias("n_same")).where((F.col("n_changed") >= least) & (F.col("n_same") >= least))
    bars = counts.join(quantiles(rows.where(changed), by, score, {"t95": 0.95}), by).join(quantiles(rows.where(same), by, score, {"t5": 0.05}), by)
    share = lambda of, bar: F.avg(F.when(of, (x <= F.col(bar)).cast("double")))
    return rows.join(bars, by).groupBy(*by).agg(F.first("t95").alias("t95"), share(same, "t95").alias("frr"), share(changed, "t5").alias("catch"), F.first("n_changed").alias("n_changed"), F.first("n_same").alias("n_same"))


def closeness(rows: DataFrame, truth: str, predicted: str, threshold: float = 0.7) -> DataFrame:
    """One row: mean of 1 - |truth - predicted| (clamped to 0..1), accuracy at a threshold, rows scored, and failed (null) ones."""
    t, p = F.col(truth), V.clamp(predicted)
    return rows.agg(F.avg(1 - F.abs(t - p)).alias("closeness"), F.avg(((t >= threshold) == (p >= threshold)).cast("double")).alias("accuracy"), F.count(p).alias("scored"), F.count_if(p.isNull()).alias("failed"))


def second_judge(rows: DataFrame, kept: str, first: str, second: str, least_auc: float = 0.79) -> DataFrame:
    """One row: does a second judge's score separate what people call kept, and side with them where the first does not?

    Rows without a second score are left out. `passes`: its AUC reaches `least_auc`, and of the rows where the first
    judge (from 0.5 on: kept) disagrees with people it agrees with them on more than half.
    """
    scored = rows.where(F.col(second).isNotNull()).withColumn("_kept", F.col(kept).cast("int"))
    auc = lambda c: S.auc(scored, c, "_kept").select(F.col("auc").alias(f"{c}_auc"))
    human = F.col("_kept") == 1
    disagree, sides = (F.col(first) >= 0.5) != human, (F.col(second) >= 0.5) == human
    counts = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(disagree).alias("disagreements"), F.count_if(disagree & sides).alias("sides_with_people"))
    out = counts.crossJoin(auc(first)).crossJoin(auc(second))  # one row each
    return out.withColumn("passes", F.coalesce((F.col(f"{second}_auc") >= least_auc) & (F.col("sides_with_people") > F.col("disagreements") / 2), F.lit(False)))


def overridden(flags: DataFrame, annotations: DataFrame, key: str, flag: str) -> DataFrame:
    """key and target: people's verdicts over a judge's flag. ok keeps the flag; other verdicts than these three are dropped."""
    v = F.col("verdict")
    target = F.when(v == "ok", F.col(flag).cast("double")).when(v == "should_be_equivalent", 1.0).when(v == "should_not_be_equivalent", 0.0)
    return annotations.select(key, "verdict").join(flags.select(key, flag), key).select(key, target.alias("target")).where("target is not null")
