"""Column expressions over text: normalisers, segmentation, counts. All stay inside the JVM.

`(?U)` makes \\s, \\d and \\w cover Unicode. The four separators from U+001C to U+001F, which some tools count as white
space, are replaced by blanks where a function collapses white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
MARKS_ALL = "[ؐ-ًؚ-ٰٟۖ-ۭـ]"
MARKS_ALL_KEEP_TATWEEL = "[ؐ-ًؚ-ٰٟۖ-ۭ]"
MARKS_EXTENDED = "[ؐ-ًؚ-ٟۖ-ۜ۟-۪ۨ-ۭࣔ-ࣣ࣡-ࣿ]"
MARKS_SIGNS = "[ؐ-ًؚ-ٰٟ]"
MARKS_LEXICAL = "[ً-ْٰـ]"
MARKS_VOWELS = "[ً-ْٰ]"
ARABIC = "ء-يٱ-ۓ"
CLAUSE_BREAKS = "[.!?؟؛;،,:\\n]+"
SENTENCE_BREAKS = "[.!?؟؛;\\n]+"
EASE_CLAUSE_BREAKS = "[.!?؟؛;\\n،,]+"
EASTERN_DIGITS, WESTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~،؛؟«»ـ—–"
CLITICS = ("وال", "بال", "كال", "فال", "لل", "ال", "و", "ف", "ب", "ل")
PERSIAN, ARABIC_FOR_PERSIAN = "یکۀھہ", "يكةهه"

_STRIP = {"all": MARKS_ALL, "keep_tatweel": MARKS_ALL_KEEP_TATWEEL, "extended": MARKS_EXTENDED, "signs": MARKS_SIGNS, "lexical": MARKS_LEXICAL, "vowels": MARKS_VOWELS}


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside a lambda, an expression would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_marks(text: Column | str, kind: str = "all") -> Column:
    """Without the diacritics of the named class; the classes differ and are not interchangeable."""
    return F.regexp_replace(as_column(text), _STRIP[kind], "")


def single_spaces(text: Column | str) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(as_column(text), r"(?U)[\s\x1c-\x1f]+", " "))


def norm(text: Column | str) -> Column:
    """Without diacritics, with single blanks."""
    return single_spaces(strip_marks(text))


def match_key(text: Column | str) -> Column:
    """Key for leakage search: no diacritics or punctuation, alef forms, taa marbuta and final yaa unified, single blanks."""
    letters = F.translate(strip_marks(text, "extended"), "أإآةى", "اااهي")
    return single_spaces(F.translate(letters, PUNCTUATION, ""))


def western_digits(text: Column | str) -> Column:
    return F.translate(as_column(text), EASTERN_DIGITS, WESTERN_DIGITS)


def arabic_letters(text: Column | str) -> Column:
    """Persian letter forms as Arabic ones."""
    return F.translate(as_column(text), PERSIAN, ARABIC_FOR_PERSIAN)


def non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda x: F.length(x) > 0)


def words(text: Column | str) -> Column:
    """Words of letters and digits (Arabic or ASCII); anything else parts them."""
    plain = F.regexp_replace(strip_marks(text), r"(?U)[^ء-ي٠-٩A-Za-z0-9\s]", " ")
    return non_empty(F.split(plain, r"(?U)[\s\x1c-\x1f]+"))


def unicode_words(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return non_empty(F.split(F.lower(as_column(text)), r"(?U)[^\p{L}\p{N}]+"))


def arabic_words(text: Column | str) -> Column:
    """Words of Arabic letters alone."""
    return F.regexp_extract_all(strip_marks(text, "signs"), F.lit("([ء-ي]+)"), 1)


def word_count(text: Column | str) -> Column:
    return F.regexp_count(strip_marks(text), F.lit(f"[{ARABIC}0-9٠-٩]+"))


def is_short(text: Column | str, most: int = 5) -> Column:
    return word_count(text) <= most


def char_ngrams(text: Column | str, n: int = 5) -> Column:
    """Distinct runs of n characters; a shorter text is one run."""

    # Characters are split once: substring() walks a text from its start on every call.
    def runs(c: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*(F.get(c, i + j) for j in range(n))))
        return F.when(F.size(c) < n, F.array(F.array_join(c, ""))).otherwise(F.array_distinct(found))

    return let(F.regexp_extract_all(as_column(text), F.lit("(?s)."), 0), runs)


def word_ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens joined by blanks, repeated ones included."""
    none = F.array().cast("array<string>")
    return let(tokens, lambda w: F.when(F.size(w) < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets in arrays; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def word_stem(word: Column | str) -> Column:
    """A word without marks and non-word characters, with unified letters and without the first clitic that leaves three letters or more."""
    bare = F.translate(F.regexp_replace(strip_marks(word), r"(?U)[^\w]", ""), "إأآةى", "اااهي")
    # The first clitic of the list that the word starts with and leaves three letters or more, in one pattern.
    return F.regexp_replace(bare, "^(?:" + "|".join(CLITICS) + ")(?=.{3})", "")


def sari_tokens(text: Column | str) -> Column:
    """Lower-cased tokens with punctuation set apart, stops and commas inside numbers kept."""
    t = F.lower(as_column(text))
    t = F.regexp_replace(t, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([\.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return non_empty(F.split(single_spaces(t), " "))


# Segmentation


def clauses(text: Column | str) -> Column:
    return F.split(as_column(text), CLAUSE_BREAKS)


# Clitics before and after a stem.
STEM_PREFIXES = ("و", "ف", "ب", "ل", "ك", "س", "ال", "وال", "فال", "بال", "لل", "كال", "ولل", "وب", "ول", "وس", "فس", "فب", "فل")
STEM_SUFFIXES = ("ه", "ها", "هم", "هن", "ك", "كم", "نا", "ني", "ي", "ة", "ات", "ون", "ين", "ان", "ا")


def lexical_key(word: Column | str) -> Column:
    """A word as rated tables have it: without vowel marks and stretching, and without the article if more than one letter is left."""
    return F.regexp_replace(strip_marks(word, "lexical"), "^ال(?=..)", "")


def stem_candidates(word: Column | str) -> Column:
    """The word and what is left of it, two letters or more, without a clitic at either end or both; longest first, then by letters."""
    w = as_column(word)
    fixed = lambda affixes: F.array(F.lit(""), *(F.lit(a) for a in affixes))
    cut = lambda w, p, s: F.substring(w, F.length(p) + 1, F.length(w) - F.length(p) - F.length(s))
    heads = lambda w: F.filter(fixed(STEM_PREFIXES), lambda p: F.startswith(w, p))
    tails = lambda w: F.filter(fixed(STEM_SUFFIXES), lambda s: F.endswith(w, s))
    cuts = let(w, lambda w: F.flatten(F.transform(heads(w), lambda p: F.transform(tails(w), lambda s: cut(w, p, s)))))
    kept = F.array_distinct(F.concat(F.array(w), F.filter(cuts, lambda x: F.length(x) >= 2)))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("stem")))), lambda x: x["stem"])


def longest_clause(text: Column | str) -> Column:
    """Words of the longest clause; 0 for an empty text."""
    return F.coalesce(F.array_max(F.transform(clauses(text), lambda c: F.size(words(c)))), F.lit(0))


def longest_clause_any(text: Column | str) -> Column:
    """The same, with words of any script."""
    return F.coalesce(F.array_max(F.transform(clauses(text), lambda c: F.size(unicode_words(c)))), F.lit(0))


def with_words(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.size(arabic_words(p)) > 0)


def ease_sentences(text: Column | str) -> Column:
    return with_words(F.split(as_column(text), SENTENCE_BREAKS))


def ease_clauses(text: Column | str) -> Column:
    return with_words(F.split(as_column(text), EASE_CLAUSE_BREAKS))


def sentence_count(text: Column | str) -> Column:
    """Sentences that hold a word; one at least."""
    return F.greatest(F.lit(1), F.size(with_words(F.split(strip_marks(text, "signs"), SENTENCE_BREAKS))))


_LABEL = "أبجده"
OPTION = rf"\(\s*([{_LABEL}])\s*\)|(?<!\S)([{_LABEL}])\s*[)\-](?=\s)"


def option_labels(text: Column | str) -> Column:
    """Labels of the options of a multiple-choice item, in order."""
    t = strip_marks(text)
    one, two = F.regexp_extract_all(t, F.lit("(?U)" + OPTION), 1), F.regexp_extract_all(t, F.lit("(?U)" + OPTION), 2)
    return F.zip_with(one, two, lambda a, b: F.when(F.length(a) > 0, a).otherwise(b))


def question_stem(text: Column | str) -> Column:
    """What stands before the first option, if there are two options or more."""
    t = as_column(text)
    plain = F.regexp_instr(t, F.lit("(?U)" + OPTION))
    stem = F.trim(F.substring(t, F.lit(1), plain - 1))
    return F.when((F.size(F.regexp_extract_all(t, F.lit("(?U)" + OPTION), 1)) >= 2) & (F.length(stem) > 0), stem).otherwise(t)


def readability_units(text: Column | str) -> Column:
    """The sentences that a rewrite is scored by; the whole text if there are none."""
    t = as_column(text)
    units = non_empty(F.transform(F.split(question_stem(t), r"(?U)(?<=[.!?؟])\s+|\n+"), lambda u: F.trim(u)))
    return F.when(F.size(units) > 0, units).otherwise(F.array(t))


def paragraphs(text: Column | str) -> Column:
    """Array of paragraphs, each an array of sentences."""
    lines = F.split(F.btrim(strip_marks(text), F.lit(" \t\r\n")), r"\n\s*\n|\n")
    sentences = F.transform(lines, lambda p: non_empty(F.transform(F.split(F.regexp_replace(F.trim(p), r"[ \t ]+", " "), r"(?U)(?<=[.!?؟])\s+(?=\S)"), lambda s: F.trim(s))))
    return F.filter(sentences, lambda s: F.size(s) > 0)


def pieces(text: Column | str, least: int = 6) -> Column:
    """Array of (paragraph, sentence, to_model): sentences of at least `least` words go to a model."""
    return F.flatten(
        F.transform(
            paragraphs(text),
            lambda ss, p: F.transform(ss, lambda s: F.struct(p.alias("paragraph"), s.alias("sentence"), (F.size(non_empty(F.split(F.replace(s, F.lit("\n"), F.lit(" ")), " "))) >= least).alias("to_model"))),
        )
    )
