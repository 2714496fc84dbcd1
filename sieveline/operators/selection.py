"""Choosing among candidate rewrites of several runs, grading them, and auditing what was chosen."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions import scalars as V
from ..functions import text as T
from .prefix import same
from .ranking import hash_order, winner

#: Least readability lead of an accepted rewrite, and the kinds of pairs that keep their source.
LEAST_LEAD, KEEP_KINDS = 2.0, ("protected", "short", "identity")
#: Cells of a report's grid at most.
MOST_CELLS = 1_000_000


def merged_candidates(candidates: DataFrame, whole: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Candidates (key, text, score, ...) with `lead_whole` of an earlier run and the later judge's score where they have none.

    whole: key, text, lead_whole; judged: key, text, score; each with one row a (key, text).
    """
    later = judged.select(key, "text", F.col("score").alias("_later"))
    rows = candidates.join(whole.select(key, "text", "lead_whole"), [key, "text"], "left").join(later, [key, "text"], "left")
    return rows.withColumn("score", F.coalesce("score", "_later")).drop("_later")


def reselected(candidates: DataFrame, key: str, position: str, least_score: float, least_lead: float = LEAST_LEAD, high: float = 0.85) -> DataFrame:
    """The best eligible candidate of each source (tier A first, then lead, then score; the first wins ties), with its tier.
    Sources without an eligible candidate have no row; candidates never judged are not eligible."""
    eligible = candidates.where((F.col("score") >= least_score) & (F.col("lead") >= least_lead))
    best = winner(eligible, [key], [F.col("score") >= high, F.col("lead"), F.col("score")], position)
    return best.withColumn("tier", F.when(F.col("score") >= high, "A").otherwise("B"))


def fallbacks(candidates: DataFrame, key: str, position: str, least_lead: float = LEAST_LEAD) -> DataFrame:
    """key, text, lead of sources none of whose candidates reaches the lead: the one that comes nearest (the first wins
    ties); if no lead is known, the first candidate with a lead of 0."""
    order = F.struct("lead", (-F.col(position)).alias("p"))
    sums = candidates.groupBy(key).agg(
        F.max("lead").alias("_most"), F.max_by("text", F.when(F.col("lead").isNotNull(), order)).alias("_near"), F.min_by("text", position).alias("_first")
    )
    return sums.where(F.coalesce(F.col("_most") < least_lead, F.lit(True))).select(key, F.coalesce("_near", "_first").alias("text"), F.coalesce("_most", F.lit(0.0)).alias("lead"))


def pair_kind(source: Column | str, target: Column | str, short: int = 4) -> Column:
    """generated if the pair differs in more than diacritics; else short below `short` words, or identity."""
    s = T.as_column(source)
    words = F.size(T.non_empty(F.split(s, r"(?U)\s+")))
    return F.when(T.strip_marks(s) != T.strip_marks(target), "generated").when(words < short, "short").otherwise("identity")


def severity(is_copy, gates_ok, same, missing, contradict, flagged, lead) -> Column:
    """How bad a rejected candidate is: 5 contradiction, 4 broken gate, 3 meaning lost, 2 copy, 1 no simpler, 0 nothing."""
    c = T.as_column
    return (
        F.when(c(is_copy), 2).when(~c(gates_ok), 4).when((c(contradict) >= 0.5) | c(flagged) & (c(contradict) >= 0.3), 5)
        .when((c(missing) >= 0.5) | (c(same) < 0.5), 3).when(c(lead) <= 0, 1).otherwise(0)
    )


def qualifies(is_copy, gates_ok, same, missing, contradict, flagged, lead) -> Column:
    """Whether a candidate may be preferred; false where something is unknown."""
    c = T.as_column
    fine = ~c(is_copy) & c(gates_ok) & (c(same) >= 0.75) & (c(missing) < 0.5) & (c(contradict) < 0.3) & ~(c(flagged) & (c(contradict) >= 0.15)) & (c(lead) >= 1)
    return F.coalesce(fine, F.lit(False))


def reward(kind, unchanged, gates_ok, meaning, lead, target: float = 2.0, meaning_gate: float | None = None) -> Column:
    """Pairs to be kept: 1 if unchanged. Others: 0 unless the gates hold and the lead is positive; then the lead's share of
    its target, times the meaning score, or if that passes `meaning_gate`."""
    c = T.as_column
    simpler = V.clamp(c(lead) / target)
    scored = c(meaning) * simpler if meaning_gate is None else F.when(c(meaning) >= meaning_gate, simpler).otherwise(0.0)
    return F.when(c(kind).isin(*KEEP_KINDS), c(unchanged).cast("double")).when(c(gates_ok) & (c(lead) > 0), scored).otherwise(0.0)


def violations(source, output, kind, source_name, tier, lead, protected: list[str], least_lead: float = LEAST_LEAD) -> Column:
    """Names of the corpus rules that a pair breaks; pairs to be kept are held to the first two alone."""
    s, t, kind = T.as_column(source), T.as_column(output), T.as_column(kind)
    marked = lambda x: F.length(T.strip_marks(x)) != F.length(x)
    keep, made = kind.isin(*KEEP_KINDS), kind == "generated"
    rules = (
        (marked(s) | marked(t), F.lit("diacritics")), (keep & (s != t), F.concat(kind, F.lit(": output differs"))), (~keep & ~made, F.concat(F.lit("unknown kind "), kind)),
        (made & T.as_column(source_name).isin(*protected), F.lit("protected source")), (made & G.has_verse_marker(s), F.lit("verse in source")), (made & T.is_short(s), F.lit("short source")),
        (made & ~G.options_preserved(s, t), F.lit("options changed")), (made & ~G.honorifics_preserved(s, t), F.lit("honorific dropped")), (made & ~G.verses_preserved(s, t), F.lit("verse changed")),
        (made & (G.normalize_ending(s, t) != F.trim(t)), F.lit("ending differs")), (made & ~F.coalesce(T.as_column(tier).isin("A", "B"), F.lit(False)), F.lit("tier")),
        (made & (F.coalesce(T.as_column(lead), F.lit(0.0)) < least_lead), F.lit("lead")),
    )
    return F.array_compact(F.array(*(F.when(broken, name) for broken, name in rules)))


def identity_pairs(rows: DataFrame, text: str, kind: str) -> DataFrame:
    """rows as pairs whose output is their source, with empty judgements."""
    null = lambda t: F.lit(None).cast(t)
    return rows.withColumns({"source_text": F.col(text), "output_text": F.col(text), "kind": F.lit(kind), "score": null("double"), "lead": null("double"), "tier": null("string")})


def teacher_sample(rows: DataFrame, is_planted: Column, row_id: str, most: int, seed: str) -> DataFrame:
    """All planted rows and others in a reproducible random order, up to `most` rows; planted ones are never dropped."""
    planted = rows.where(is_planted)
    room = max(0, most - planted.count())
    others = rows.where(~F.coalesce(is_planted, F.lit(False))).orderBy(hash_order(row_id, seed), row_id).limit(room)
    return planted.unionByName(others)


def report_grid(facts: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Each combination of the dimensions' values (null is a value) with its value or null; several facts of a cell all stay.

    Dimensions of a report are short lists: more than MOST_CELLS combinations raise an error before any is made.
    """
    sizes = facts.agg(*(F.count_distinct(F.struct(d)).alias(f"n{i}") for i, d in enumerate(dims))).first()
    if prod(max(1, n) for n in sizes) > MOST_CELLS:
        raise ValueError(f"a grid of {' x '.join(map(str, sizes))} cells is no report")
    grid = None
    for d in dims:
        values = facts.select(d).distinct()
        grid = values if grid is None else grid.crossJoin(F.broadcast(values))  # at most MOST_CELLS values
    return same(grid, facts.select(*dims, value), dims, "left")
