"""Quality of rewrites against references: SARI, BLEU, copy and edit rates, word and diacritic errors."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions.text import as_column, norm, sari_tokens, strip_marks, word_ngrams
from .diacritics import error_rates  # noqa: F401  a measure of rewriting like the others


def _grams(rows: DataFrame, n: int) -> DataFrame:
    """item, gram, source, output counts and references' count of each n-gram."""
    side = lambda col, name: rows.select("item", F.explode(word_ngrams(sari_tokens(col), n)).alias("gram")).groupBy("item", "gram").agg(F.count(F.lit(1)).alias(name))
    refs = rows.select("item", F.explode("references").alias("reference")).select("item", F.explode(word_ngrams(sari_tokens("reference"), n)).alias("gram")).groupBy("item", "gram").agg(F.count(F.lit(1)).alias("r"))
    return side("source", "s").join(side("output", "c"), ["item", "gram"], "full").join(refs, ["item", "gram"], "full").na.fill(0, ["s", "c", "r"])


def sari(rows: DataFrame, orders: int = 4) -> DataFrame:
    """item and sari (0 to 100) of (item, source, output, references): n-gram keep F1, delete precision and add F1, averaged.

    Multisets are counts of (item, n-gram), so the work is grouped sums. A part without anything to judge scores 1.
    """
    refs = rows.select("item", F.size("references").alias("k"))
    parts = None
    for n in range(1, orders + 1):
        g = _grams(rows, n).join(refs, "item")
        s, c, r = F.col("s") * F.col("k"), F.col("c") * F.col("k"), F.col("r")
        kept, kept_good, kept_all = F.least(s, c), F.least(s, c, r), F.least(s, r)
        gone, gone_good = F.greatest(s - c, F.lit(0)), F.greatest(F.greatest(s - c, F.lit(0)) - r, F.lit(0))
        new, new_good, new_all = (c > 0) & (s == 0), (c > 0) & (s == 0) & (r > 0), (r > 0) & (s == 0)
        ratio = lambda a, b: F.sum(F.when(b > 0, a / F.greatest(b, F.lit(1))))
        sums = g.groupBy("item").agg(
            ratio(kept_good, kept).alias("kp"), F.count_if(kept > 0).alias("kn"), F.sum(kept_good).alias("kr"), F.sum(kept_all).alias("km"),
            ratio(gone_good, gone).alias("dp"), F.count_if(gone > 0).alias("dn"), F.count_if(new_good).alias("ag"), F.count_if(new).alias("an"), F.count_if(new_all).alias("am"),
        )
        share = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.greatest(F.col(b), F.lit(1))).otherwise(1.0)
        f1 = lambda p, q: F.when(p + q > 0, 2 * p * q / F.when(p + q > 0, p + q).otherwise(1.0)).otherwise(0.0)
        score = (f1(share("kp", "kn"), share("kr", "km")) + share("dp", "dn") + f1(share("ag", "an"), share("ag", "am"))) / 3
        # A text too short for n-grams of this order has no rows and scores 1.
        part = refs.select("item").join(sums.select("item", score.alias(f"p{n}")), "item", "left").withColumn(f"p{n}", F.coalesce(f"p{n}", F.lit(1.0)))
        parts = part if parts is None else parts.join(part, "item")
    return parts.select("item", (100 * sum((F.col(f"p{n}") for n in range(1, orders + 1)), F.lit(0.0)) / orders).alias("sari"))


def bleu(rows: DataFrame, by: list[str], orders: int = 4) -> DataFrame:
    """Corpus BLEU (0 to 100) per group: clipped n-gram counts summed over items, closest reference lengths."""
    size = lambda c: F.size(sari_tokens(c))
    lengths = rows.select(*by, size("output").alias("length"), F.transform("references", lambda r: F.size(sari_tokens(r))).alias("lengths"))
    close = F.array_min(F.transform("lengths", lambda r: F.struct(F.abs(r - F.col("length")).alias("d"), r.alias("r"))))["r"]
    out = lengths.groupBy(*by).agg(F.sum("length").alias("c"), F.sum(close).alias("r"))
    for n in range(1, orders + 1):
        cand = rows.select("item", *by, F.explode(word_ngrams(sari_tokens("output"), n)).alias("gram")).groupBy("item", *by, "gram").agg(F.count(F.lit(1)).alias("n"))
        ref = rows.select("item", F.posexplode("references").alias("k", "reference")).select("item", "k", F.explode(word_ngrams(sari_tokens("reference"), n)).alias("gram")).groupBy("item", "k", "gram").agg(F.count(F.lit(1)).alias("m")).groupBy("item", "gram").agg(F.max("m").alias("m"))
        hits = cand.join(ref, ["item", "gram"], "left").groupBy(*by).agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias(f"h{n}"), F.sum("n").alias(f"t{n}"))
        out = out.join(hits, by, "left")
    logs = sum((F.ln(F.when(F.col(f"h{n}") > 0, F.col(f"h{n}")).otherwise(1e-9) / F.greatest(F.coalesce(f"t{n}", F.lit(1)), F.lit(1))) for n in range(1, orders + 1)), F.lit(0.0)) / orders
    penalty = F.when(F.col("c") >= F.col("r"), 0.0).otherwise(1 - F.col("r") / F.greatest("c", F.lit(1)))
    return out.select(*by, (100 * F.exp(logs + penalty)).alias("bleu"))


def copy_rate(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg((F.trim("output") == F.trim("source")).cast("double")).alias("copy_rate"), F.count(F.lit(1)).alias("n"))


def edit_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """copy_rate, over_edit_rate (rows that should stay as they are, yet are edited), one_word_share (edited rows that differ
    in one word), n; of (source, output, target), where a target equal to its source asks for no edit. Null without such rows."""
    t = lambda c: F.trim(c)
    edited, keep = t("output") != t("source"), t("target") == t("source")
    words = F.split(t("source"), r"(?U)\s+"), F.split(t("output"), r"(?U)\s+")
    one = (F.size(words[0]) == F.size(words[1])) & (F.size(F.filter(F.arrays_zip(words[0].alias("a"), words[1].alias("b")), lambda p: p["a"] != p["b"])) == 1)
    mean = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*by).agg(mean(~edited).alias("copy_rate"), mean(F.when(keep, edited)).alias("over_edit_rate"), mean(F.when(edited, one)).alias("one_word_share"), F.count(F.lit(1)).alias("n"))


def length_ratio(source: Column | str, output: Column | str) -> Column:
    words = lambda t: F.size(F.split(F.trim(as_column(t)), r"\s+"))
    return words(output) / F.greatest(words(source), F.lit(1))


@F.pandas_udf(DoubleType())
def word_edit_share(source: pd.Series, output: pd.Series) -> pd.Series:
    """Share of the source's words in blocks that the alignment changes (difflib's alignment, not edit distance)."""

    def one(a: str | None, b: str | None) -> float:
        a, b = (a or "").split(), (b or "").split()
        same = sum(m.size for m in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks())
        return 1 - same / len(a) if a else 0.0

    return pd.Series([one(a, b) for a, b in zip(source, output, strict=True)])


# A comma is a token of its own; how a clause starts that can stand alone; signs that end a clause.
COMMA_TOKEN, CLAUSE_START, CLAUSE_END = "،|[^\\s،]+", "^(و|ف)(?!ي$|ى$)\\S{2,}|^(ثم|لكن|ولكن|لذلك|لذا|بل)$", ".!?؟؛:"


def commas_to_stops(source: Column | str, output: Column | str, least: int = 3) -> Column:
    """The output with those Arabic commas as full stops that it added and that part two clauses.

    A comma is added if the alignment of the tokens (without diacritics) pairs it with none of the source's. The word
    after it must open a clause, and each side must have `least` words: up to the comma before, and up to the next comma
    or word that ends a clause. Null if either text is.
    """
    tokens = lambda c: F.regexp_extract_all(as_column(c), F.lit(COMMA_TOKEN), 0)
    opens = F.transform(tokens(output), lambda w: strip_marks(w).rlike(CLAUSE_START))
    return _stops_written(F.transform(tokens(source), norm), F.transform(tokens(output), norm), tokens(output), opens, F.lit(least))


@F.pandas_udf(StringType())
def _stops_written(source: pd.Series, plain: pd.Series, output: pd.Series, opens: pd.Series, least: pd.Series) -> pd.Series:
    def one(a, b, words, opening, least) -> str | None:
        if a is None or words is None:
            return None
        blocks = difflib.SequenceMatcher(None, list(a), list(b), autojunk=False).get_matching_blocks()
        kept = {m.b + i for m in blocks for i in range(m.size)}
        marks = [j for j, w in enumerate(words) if w == "،"]
        stops = set()
        for before, j, after in zip([-1, *marks], marks, [*marks[1:], len(words)], strict=False):
            ending = next((i for i in range(j + 1, after) if words[i][-1] in CLAUSE_END), after)
            if j not in kept and j + 1 < len(words) and opening[j + 1] and j - before > least and ending - j > least:
                stops.add(j)
        pieces = [("." if j in stops else w) if w == "،" else (" " if j else "") + w for j, w in enumerate(words)]
        return "".join(pieces)

    return pd.Series([one(*row) for row in zip(source, plain, output, opens, least, strict=True)], dtype=object)
