"""Per-item measures of rewrites, and their grouped scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import guards as G
from ..functions import text as T
from . import statistics as S
from .prefix import stored

#: Blocks whose missing values are pending and not inapplicable.
PENDING_BLOCKS = ("meaning", "judge")
CONTINUOUS = ("P(same meaning)", "longest clause: words shorter", "reading level: levels lower", "hard words: fewer")


def item_measures(pairs: DataFrame, same_threshold: float = 0.5, contradict_threshold: float | None = None, simpler_least: tuple[int, float] | None = None) -> DataFrame:
    """Long rows (item, doc, set, track, block, measure, value, state) of (item, doc, set, track, source, output[, same, contradict, level_source, level_output, hard_source, hard_output]).

    A measure that does not apply to a track or text has no row; state is pending where a meaning score is missing.
    Without a column `same` there are no rows on meaning. simpler_least: by how many words of the longest clause (beyond
    punctuation), or levels, a text must be simpler for the joint measure; without it that has no rows.
    """
    cols = pairs.columns
    scored = F.lit("same" in cols)
    opt = lambda c: F.col(c) if c in cols else F.lit(None).cast("double")
    number = lambda c: c.cast("double")
    # What several measures share is computed once, in columns of its own.
    pairs = pairs.select(
        "item", "doc", "set", "track", "source", "output", *(opt(c).alias(c) for c in ("same", "contradict", "level_source", "level_output", "hard_source", "hard_output")),
        T.norm("source").alias("norm_source"), T.norm("output").alias("norm_output"), G.numbers("source").alias("numbers_source"), G.numbers("output").alias("numbers_output"),
        G.rule_breaks("source", "output").alias("breaks"), T.longest_clause("source").alias("clause_source"), T.longest_clause("output").alias("clause_output"),
        *(f(c).alias(f"{f.__name__}_{c}") for f in (G.negations, G.conditions, G.limits) for c in ("source", "output")), G.retention("source", "output").alias("kept"),
        G.end_mark("source").alias("end_source"), G.end_mark("output").alias("end_output"),
    )
    track = F.col("track")
    verse, easy = track == "F", track == "C"
    unchanged, nums_ok = F.col("norm_output") == F.col("norm_source"), F.col("numbers_source") == F.col("numbers_output")
    both = lambda name: (F.col(f"{name}_source"), F.col(f"{name}_output"))
    flags = {}
    for label, name, some in (("negation changed", "negations", lambda x: x > 0), ("limit changed", "limits", lambda x: F.size(x) > 0), ("condition changed", "conditions", lambda x: x > 0)):
        a, b = both(name)
        flags[label] = G.flag(a != b, some(a) | some(b))
    raised = F.lit(False)
    for c in flags.values():
        raised = raised | F.coalesce(c, F.lit(False))
    contra = raised & (F.col("contradict") >= contradict_threshold) if contradict_threshold is not None else F.lit(False)
    ls, lo = both("clause")
    drop = F.when(F.col("level_source") >= 10, F.col("level_source") - F.col("level_output"))
    clause_drop, hard = F.when(ls > 15, number(ls - lo)), F.col("hard_source")
    meaning_kept = (F.col("same") >= same_threshold) & nums_ok & ~F.coalesce(contra, F.lit(False))
    words_least, levels_least = simpler_least or (0, 0)
    simpler = (F.coalesce(clause_drop, F.lit(0.0)) >= words_least) & ~G.punctuation_only("source", "output") | (F.coalesce(drop, F.lit(0.0)) >= levels_least)
    joint = scored & F.lit(simpler_least is not None) & ~verse & ~easy & (clause_drop.isNotNull() | drop.isNotNull())
    entries: list[tuple[str, str, Column, Column]] = [  # block, measure, value, applies
        ("behaviour", "F: letters unchanged", number(unchanged), verse),
        ("behaviour", "F: exactly unchanged", number(F.trim("output") == F.trim("source")), verse),
        ("checks", "numbers kept", F.when(F.size("numbers_source") > 0, number(nums_ok)), ~verse),
        ("checks", "no house-rule break", number(F.size(F.array_remove("breaks", G.FULL_STOP)) == 0), ~verse),
        ("behaviour", "C: easy text left unchanged", number(unchanged), easy),
        ("behaviour", "E1: end mark kept", number(F.col("end_source") == F.col("end_output")), track == "E1"),
        *(("flags", name, number(c), ~verse) for name, c in flags.items()),
        ("meaning", "P(same meaning)", F.col("same"), ~verse & scored),
        ("meaning", "meaning kept", F.when(F.col("same").isNotNull(), number(meaning_kept)), ~verse & scored),
        ("meaning", "meaning kept and simpler", F.when(F.col("same").isNotNull(), number(meaning_kept & simpler)), joint),
        ("simpler", "longest clause: words shorter", clause_drop, ~verse & ~easy),
        ("simpler", "hard words: fewer", F.when(hard > 0, number(hard - F.col("hard_output"))), ~verse & ~easy),
        ("simpler", "reading level: levels lower", drop, ~verse & ~easy),
        ("diagnostics", "kept 60%+ of words", number(F.col("kept") >= 0.6), ~verse & ~easy),
        ("diagnostics", "no clause over 15 words", number(lo <= 15), track.isin("B", "E2", "E3")),
        ("diagnostics", "negations kept", F.when(F.col("negations_source") > 0, number(F.col("negations_source") == F.col("negations_output"))), ~verse),
        ("diagnostics", "mid-sentence full stop added", number(F.array_contains("breaks", G.FULL_STOP)), ~verse),
        ("diagnostics", "B: not left as copy", number(~unchanged), track == "B"),
    ]
    listed = F.array(*(F.when(applies, F.struct(F.lit(b).alias("block"), F.lit(m).alias("measure"), v.alias("value"))) for b, m, v, applies in entries))
    long = pairs.select("item", "doc", "set", "track", F.explode(F.array_compact(listed)).alias("e")).select("item", "doc", "set", "track", "e.*")
    pending = F.col("value").isNull() & F.col("block").isin(*PENDING_BLOCKS)
    return long.where(F.col("value").isNotNull() | pending).withColumn("state", F.when(pending, "pending").otherwise("value"))


def summary(measures: DataFrame, complete: float = 0.9) -> DataFrame:
    """set, block, measure, mean, n, pending, complete."""
    out = measures.groupBy("set", "block", "measure").agg(F.avg("value").alias("mean"), F.count("value").alias("n"), F.count_if(F.col("state") == "pending").alias("pending"))
    return out.withColumn("complete", F.col("n") >= complete * (F.col("n") + F.col("pending")))


def scorecard(measures: DataFrame, baseline: DataFrame | None = None, spread: bool = False) -> DataFrame:
    """summary() with intervals clustered by document; rates in percent; with a baseline, the paired difference.

    By default a measure's sums of documents meet in one task, which draws with Python's generator as printed reports do;
    with `spread` the documents are weighed in all tasks instead (spread_bootstrap), for any number of documents.
    """
    scaled = F.when(F.col("measure").isin(*CONTINUOUS), 1.0).otherwise(100.0)
    by = ["set", "block", "measure"]
    measures = stored(measures)  # three steps read them, and their patterns take most of the time
    ci = (S.spread_bootstrap(measures, by, "doc", "value", scale=scaled) if spread else S.cluster_bootstrap(measures, by, "doc", "value", "item", scale=scaled)).drop("n")
    out = summary(measures).drop("mean").join(ci, by, "left")
    if baseline is not None:
        diff = S.paired_difference(measures, baseline, by, by, "item", "doc", "value", "item", spread, scale=scaled)
        out = out.join(diff.select(*by, F.col("mean").alias("diff"), F.col("low").alias("diff_low"), F.col("high").alias("diff_high"), F.col("n").alias("diff_n")), by, "left")
        out = out.withColumn("significant", (F.col("diff_low") > 0) | (F.col("diff_high") < 0))
    return out


def covered(items: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """items joined with predictions; raises unless each item has one prediction and each prediction an item."""
    i, p = items.select(F.col(key).alias("k"), F.lit(1).alias("i")), predictions.select(F.col(key).alias("k"), F.lit(1).alias("p"))
    gaps = i.join(p, "k", "full").where("i is null or p is null").agg(F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("i").isNull()).alias("unknown")).first()
    if gaps["missing"] or gaps["unknown"]:
        raise ValueError(f"{gaps['missing']} items without prediction, {gaps['unknown']} predictions without item")
    return items.join(predictions, key)


def copy_baseline(items: DataFrame) -> DataFrame:
    return items.withColumn("output", F.col("source"))


def pending_pairs(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Distinct pairs without a score; copies need none, and verses (track F) are never scored."""
    open_ = pairs.where((F.col("track") != "F") & (T.norm("source") != T.norm("output"))).select("pair_key", "source", "output").dropDuplicates(["pair_key"])
    return open_.join(scores.select("pair_key"), "pair_key", "left_anti")


def with_scores(pairs: DataFrame, scores: DataFrame, scorer: str | None = None) -> DataFrame:
    """pairs (source, output, ...) with `same` and `contradict`: a copy keeps its meaning (1 and 0) whoever scored it, other
    pairs have the first score of their content key, null if there is none. scores: pair_key, same, contradict, position[, scorer]."""
    from ..functions.scalars import pair_key

    known = scores.where(F.col("same").isNotNull() & (F.col("scorer") == scorer if scorer is not None else F.lit(True)))
    first = known.groupBy("pair_key").agg(F.min_by(F.struct("same", "contradict"), "position").alias("_score"))
    copy = T.norm("output") == T.norm("source")
    found = pairs.withColumn("pair_key", pair_key("source", "output")).join(first, "pair_key", "left")
    pick = lambda c, of_copy: F.when(copy, of_copy).otherwise(F.col(f"_score.{c}")).alias(c)
    return found.select(*(c for c in pairs.columns if c not in ("same", "contradict", "pair_key")), "pair_key", pick("same", 1.0), pick("contradict", 0.0))


def readability_drop(pairs: DataFrame, by: list[str], levels: DataFrame) -> DataFrame:
    """by, drop (mean level of the source less that of the output; positive: easier), scored, n. levels: text, level.

    Texts are looked up without marks; pairs with a text that has no level do not count in the mean.
    """
    bare = lambda c: T.norm(c)
    of = levels.groupBy(bare("text").alias("_text")).agg(F.max("level").alias("_level"))
    source, output = (of.withColumnsRenamed({"_text": f"_{c}_text", "_level": f"_{c}_level"}) for c in ("source", "output"))
    keyed = pairs.withColumns({"_source_text": bare("source"), "_output_text": bare("output")})
    both = keyed.join(source, "_source_text", "left").join(output, "_output_text", "left").withColumn("_drop", F.col("_source_level") - F.col("_output_level"))
    return both.groupBy(*by).agg(F.avg("_drop").alias("drop"), F.count("_drop").alias("scored"), F.count(F.lit(1)).alias("n"))


def card_lines(card: DataFrame) -> DataFrame:
    """set, block, measure, line: a scorecard() row as text: rates with one digit, means with two and a sign, intervals, n,
    what is pending, and the difference from the baseline with * where its interval leaves out 0."""
    mean = F.col("measure").isin(*CONTINUOUS)
    text = lambda pattern, *c: F.format_string(pattern, *c)
    interval = F.when(mean, text("%+6.2f [%+.2f, %+.2f]", F.col("mean"), F.col("low"), F.col("high"))).otherwise(text("%5.1f [%3.0f-%3.0f]", F.col("mean"), F.col("low"), F.col("high")))
    waiting = F.col("block").isin(*PENDING_BLOCKS) & ~F.col("complete")
    cell = F.when(waiting, text("incomplete (%d of %d scored)", F.col("n"), F.col("n") + F.col("pending"))).when(F.col("mean").isNull(), F.lit("    —")).otherwise(interval)
    extra = [text("n=%d", F.col("n")), F.when(F.col("pending") > 0, text("pending %d", F.col("pending")))]
    if "diff" in card.columns:
        star = F.when(F.col("significant"), "*").otherwise("")
        parts = (F.col("diff"), F.col("diff_low"), F.col("diff_high"), star)
        extra.append(F.when(F.col("diff").isNotNull(), F.when(mean, text("vs baseline %+.2f [%+.2f,%+.2f]%s", *parts)).otherwise(text("vs baseline %+.1f [%+.0f,%+.0f]%s", *parts))))
    return card.select("set", "block", "measure", F.concat(F.rpad(F.left("measure", F.lit(62)), 62, " "), F.lit(" "), cell, F.lit("  "), F.concat_ws(", ", *extra)).alias("line"))


def by_status(rows: DataFrame, values: list[Column]) -> DataFrame:
    """Overall and per reference status (grouping sets), each status present even if empty."""
    return rows.groupingSets([["system"], ["system", "status"]], "system", "status").agg(*values)


def best_marks(table: DataFrame, measure: str, value: str, higher_is_better: str) -> DataFrame:
    """Whether a value is its measure's best, in the measure's direction. The reports are small grids."""
    own = Window.partitionBy(measure)  # a measure's few values; they are computed once, as sums of doubles may differ when they are computed again
    best = F.when(F.col(higher_is_better), F.max(value).over(own)).otherwise(F.min(value).over(own))
    return table.withColumn("best", F.col(value) == best)


def leaderboard(cards: DataFrame, measures: list[str]) -> DataFrame:
    """submission by measure, with `pending` for rates that are not complete."""
    shown = F.when(F.col("complete"), F.format_number("mean", 1)).otherwise(F.lit("pending"))
    return cards.withColumn("shown", shown).groupBy("submission").pivot("measure", measures).agg(F.first("shown"))
