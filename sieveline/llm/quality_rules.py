"""Quality rules: base counts of a text, and the divergence of its histograms from references of its language.

Built-in DataFrame functions only. A document's histograms of character classes and of common words, with one bin for all
other words, are compared with its language's, summed over the whole corpus, by the Jensen-Shannon distance. Short texts
are not judged by histograms that they are too short to fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: White space that parts words, as a pattern and as characters.
SPACES = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Common words of each language, in natural order.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "are", "with", "as", "be", "this"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"),
}
#: Classes of characters by pattern; what is in none is a letter of lower case or a letter outside ASCII.
CHAR_CLASSES = {"space": f"[^{SPACES}]+", "upper": "[^A-Z]+", "digit": "[^0-9]+", "stop": "[^.,;:]+", "shout": "[^!?]+", "symbol": r"[^#*$%&|<>@^~=_+{}\[\]\\/]+"}
#: Texts with fewer characters, or fewer words, are not judged by that histogram.
MIN_CHARS, MIN_WORDS = 200, 50
#: Distance (0 to 1) from which a text is rejected, and the room for chance in short texts: this over the square root of
#: the histogram's total is added. (Chance alone sets a sample of n at sqrt((bins - 1) / (8 ln 2 n)), 1.7 / sqrt(n) for words.)
MAX_DISTANCE, CHANCE = 0.15, 1.8
#: References are broadcast up to this number of languages (some 200 bytes each).
BROADCAST_LANGUAGES = 10_000


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _left(text: Column, other: str) -> Column:
    """Number of characters outside the runs that the pattern `other` matches."""
    return F.length(F.regexp_replace(text, other, "")).cast("long")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACES}]+"))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of `width` words that the text holds twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        # Positions whose window has an equal: neighbours when sorted. Each covers up to `width` words until the next.
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        flagged = _let(
            ordered,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]
                )
            ),
        )
        return _let(flagged, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x))

    none = F.lit(0).cast("long")
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    any_equal = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(none)
    return F.when(F.size(words) < width + 1, none).otherwise(_let(hashes, any_equal))


def _word_counts(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, in their order, and of all other words; null for an unknown language."""
    out = F.lit(None).cast("array<long>")
    for name, listed in COMMON_WORDS.items():
        out = F.when(lang == name, _counts_of(words, listed)).otherwise(out)
    others = lambda c: F.array_append(c, F.size(words).cast("long") - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
    return _let(out, lambda c: F.when(c.isNotNull(), others(c)))


def _counts_of(words: Column, listed: tuple[str, ...]) -> Column:
    common = F.filter(words, lambda w: F.lower(w).isin(*listed))
    # Two blanks between words: each stands alone with one on either side.
    joined = F.concat(F.lit(" "), F.lower(F.array_join(common, "  ")), F.lit(" "))
    return _let(joined, lambda s: F.array(*(((F.length(s) - F.length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in listed)))


def measured(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a document: id, lang, base counts and the two histograms (arrays of counts)."""
    rows = docs.select("doc_id", text_hash(text).alias("text_hash"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    counts = {name: _left(F.col("text"), pattern) for name, pattern in CHAR_CLASSES.items()}
    # The words are bound once: an expression inside a lambda would be computed again for each element.
    of_words = _let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"), _word_counts(w, F.col("lang")).alias("common")),
    )
    kept = rows.select(
        "doc_id", "text_hash", "lang", of_words.alias("w"), _left(F.col("text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.length("text").cast("long").alias("chars"), F.struct(*(c.alias(n) for n, c in counts.items())).alias("classes"),
    )
    others = F.col("chars") - sum((F.col(f"classes.{n}") for n in CHAR_CLASSES), F.lit(0))
    solid = [F.col(f"classes.{n}") for n in CHAR_CLASSES]
    return kept.select(
        "doc_id", "text_hash", "lang", F.col("w.n").alias("n_words"), (F.col("chars") - F.col("classes.space")).alias("word_chars"), "n_symbols", "n_dup_lines", F.col("w.repeated").alias("n_repeat_words"), "chars", F.array(*solid, others).alias("char_counts"), F.col("w.common").alias("word_counts")
    )


def _sums(array: str, size: int) -> list[Column]:
    return [F.sum(F.get(array, i)).cast("double").alias(f"{array}{i}") for i in range(size)]


def references(measures: DataFrame) -> DataFrame:
    """lang, char_ref and word_ref: each language's histograms over all documents that pass the base rules, as shares."""
    n_chars, n_words = len(CHAR_CLASSES) + 1, 17
    fine = measures.where(~base_failed())
    summed = fine.groupBy("lang").agg(*_sums("char_counts", n_chars), *_sums("word_counts", n_words))
    share = lambda name, n: F.transform(F.array(*(F.coalesce(f"{name}{i}", F.lit(0.0)) for i in range(n))), lambda x: x / F.greatest(F.lit(1.0), sum((F.coalesce(F.col(f"{name}{i}"), F.lit(0.0)) for i in range(n)), F.lit(0.0))))
    return summed.select("lang", share("char_counts", n_chars).alias("char_ref"), share("word_counts", n_words).alias("word_ref"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence to base 2) of counts from a reference of shares; null without counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def term(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def divergence(n: Column) -> Column:
        parts = F.zip_with(counts, reference, lambda c, q: _let(c / n, lambda p: term(p, (p + q) / 2) + term(q, (p + q) / 2)))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2))

    return _let(total, lambda n: F.when(n > 0, divergence(n)))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, chars, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    Null texts are empty; texts without words fail the base rules. A document that passes them is rejected if its
    characters are too far from its language's reference (given MIN_CHARS characters) or its words are (given MIN_WORDS
    words). A null or unknown language is one like others for characters and is not judged by words. Repeated rows are
    judged alike, each in its own row; extra columns are ignored; an empty table gives no rows. References are a few
    numbers for each language.
    """
    measures = written(measured(docs), "measures")
    refs = written(references(measures), "references")
    joined = measures.join(F.broadcast(refs) if refs.count() <= BROADCAST_LANGUAGES else refs, "lang", "left")
    scored = joined.select(
        "doc_id", "text_hash", "chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        F.when(F.col("chars") >= MIN_CHARS, distance(F.col("char_counts"), F.col("char_ref"))).alias("char_distance"),
        F.when(F.col("n_words") >= MIN_WORDS, distance(F.col("word_counts"), F.col("word_ref"))).alias("word_distance"),
    )
    far = lambda measure, total: F.coalesce(measure, F.lit(0.0)) > MAX_DISTANCE + CHANCE / F.sqrt(F.greatest(total, F.lit(1)))
    return scored.withColumn("kept", ~F.col("base_failed") & ~far("char_distance", "chars") & ~far("word_distance", "n_words"))


def text_hash(text: str = "text") -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))
