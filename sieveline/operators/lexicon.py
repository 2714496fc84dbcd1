"""Lexicons from ratings and annotations, and text scores by look-up chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.text import MARKS_SIGNS, arabic_words, strip_marks


def rated_words(ratings: DataFrame) -> DataFrame:
    """word, mean and n of rows (ratings array<struct<word, rating>>)."""
    return ratings.select(F.explode("ratings").alias("r")).groupBy(F.col("r.word").alias("word")).agg(F.avg("r.rating").alias("mean"), F.count(F.lit(1)).alias("n"))


def annotated_levels(lines: DataFrame, text: str, order: str) -> DataFrame:
    """word and its most frequent level from #level#word marks; ties go to the level seen first."""
    t = F.col(text)
    marks = F.arrays_zip(F.regexp_extract_all(t, F.lit(r"#(\d+)#([^\s#]+)"), 1).alias("level"), F.regexp_extract_all(t, F.lit(r"#(\d+)#([^\s#]+)"), 2).alias("word"))
    rows = lines.select(F.col(order).alias("line"), F.posexplode(marks).alias("place", "m")).select("line", "place", F.col("m.level").cast("int").alias("level"), strip_marks(F.col("m.word")).alias("word"))
    counts = rows.groupBy("word", "level").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line", "place")).alias("seen"))
    best = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "seen"))
    return counts.withColumn("rank", best).where("rank = 1").select("word", "level")


def frequent(tokens: DataFrame, token: str, order: str, k: int) -> DataFrame:
    """The k most frequent tokens; ties to the one seen first."""
    return tokens.groupBy(token).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen")).orderBy(F.desc("n"), "seen").limit(k)


def hard_words(texts: DataFrame, item: str, text: str, lexicon: DataFrame, fallback: DataFrame, level: int = 4) -> DataFrame:
    """item and its number of words at `level` or above, looked up in the lexicon, else the fallback; 0 without any."""
    tokens = texts.select(item, F.explode(arabic_words(text)).alias("word"))
    found = tokens.join(lexicon.select("word", F.col("level").alias("a")), "word", "left").join(fallback.select("word", F.col("level").alias("b")), "word", "left")
    counts = found.groupBy(item).agg(F.count_if(F.coalesce("a", "b") >= level).alias("hard"))
    return texts.select(item).join(counts, item, "left").select(item, F.coalesce("hard", F.lit(0)).alias("hard"))


def mean_score(texts: DataFrame, item: str, tokens: str, chain: list[DataFrame], coefficients: tuple[float, float, float], zipf: DataFrame) -> DataFrame:
    """item, mean score of its tokens and share found: each token's value from the first table of the chain that has it,
    else a quadratic of its frequency (clipped to 1..7); NaN for an item without words."""
    rows = texts.select(item, F.explode(tokens).alias("word"))
    value = F.lit(None).cast("double")
    for i, table in enumerate(chain):
        rows = rows.join(table.select("word", F.col("value").alias(f"v{i}")), "word", "left")
    value = F.coalesce(*(F.col(f"v{i}") for i in range(len(chain))))
    rows = rows.join(zipf.select("word", "zipf"), "word", "left").withColumn("value", value)
    a, b, c = coefficients
    guess = F.least(F.lit(7.0), F.greatest(F.lit(1.0), a * F.col("zipf") ** 2 + b * F.col("zipf") + c))
    means = rows.groupBy(item).agg(F.avg(F.coalesce("value", guess)).alias("mean"), F.avg(F.col("value").isNotNull().cast("double")).alias("found"))
    return texts.select(item).join(means, item, "left").select(item, F.coalesce("mean", F.lit(float("nan"))).alias("mean"), F.coalesce("found", F.lit(0.0)).alias("found"))


def quadratic_fit(points: DataFrame, x: str, y: str) -> tuple[float, float, float]:
    """Least-squares quadratic from nine sums (normal equations); the sums are Spark's, the 3 x 3 system the driver's."""
    import numpy as np

    p = F.col(x)
    sums = points.agg(*(F.sum(p**i).alias(f"s{i}") for i in range(5)), *(F.sum(p**i * F.col(y)).alias(f"t{i}") for i in range(3))).first()
    m = np.array([[sums[f"s{4 - i - j}"] for j in range(3)] for i in range(3)], float)
    return tuple(float(v) for v in np.linalg.solve(m, np.array([sums["t2"], sums["t1"], sums["t0"]], float)))


def spellings(tokens: DataFrame, token: str) -> DataFrame:
    """Bare word with its spellings and counts, most frequent first."""
    counts = tokens.groupBy(strip_marks(token).alias("bare"), F.col(token).alias("spelling")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("bare").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "spelling"))).alias("listed")).select("bare", F.transform("listed", lambda s: F.struct(s["spelling"].alias("spelling"), (-s["minus_n"]).alias("n"))).alias("spellings"))


# Vowel marks (doubled ones included) and the mark of a doubled letter.
VOWELS, DOUBLED = "\u064b\u064c\u064d\u064e\u064f\u0650", "\u0651"
_READING = "array<struct<letters: array<struct<vowel: string, doubled: boolean>>, n: bigint>>"


def letters(spelling) -> Column:
    """A spelling's letters as (vowel, doubled), null where it does not say: unmarked letters say nothing, and the last
    letter's vowel is the case ending, which tells no words apart."""
    units = F.regexp_extract_all(T.as_column(spelling), F.lit(f"[\u0621-\u064a](?:{MARKS_SIGNS})*"), 0)
    vowel = lambda u: F.nullif(F.regexp_extract(u, f"([{VOWELS}])[^{VOWELS}]*$", 1), F.lit(""))
    one = lambda u, i: F.struct(F.when(i < F.size(units) - 1, vowel(u)).alias("vowel"), F.when(F.length(u) > 1, u.contains(DOUBLED)).alias("doubled"))
    return F.transform(units, one)


def reading_counts(spellings) -> Column:
    """Rows of each reading of a bare word. A reading is what its spellings say together, letter by letter; each spelling,
    most frequent first, adds to the first reading that says nothing else than it does, or starts one."""

    def agrees(a: Column, b: Column) -> Column:
        differs = F.zip_with(a, b, lambda x, y: F.coalesce(x["vowel"] != y["vowel"], F.lit(False)) | F.coalesce(x["doubled"] != y["doubled"], F.lit(False)))
        return ~F.exists(differs, lambda d: d)

    def together(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(F.coalesce(x["vowel"], y["vowel"]).alias("vowel"), F.coalesce(x["doubled"], y["doubled"]).alias("doubled")))

    def add(readings: Column, said: Column) -> Column:
        place = F.array_position(F.transform(readings, lambda r: agrees(r["letters"], said["letters"])), F.lit(True))
        grown = lambda r: F.struct(together(r["letters"], said["letters"]).alias("letters"), (r["n"] + said["n"]).alias("n"))
        return F.when(place == 0, F.concat(readings, F.array(said))).otherwise(F.transform(readings, lambda r, i: F.when(i + 1 == place, grown(r)).otherwise(r))).cast(_READING)

    said = F.transform(spellings, lambda s: F.struct(letters(s["spelling"]).alias("letters"), s["n"].cast("long").alias("n")))
    return F.aggregate(said, F.array().cast(_READING), add, lambda readings: F.transform(readings, lambda r: r["n"]))


def ambiguous(spelled: DataFrame, least: int = 3, share: float = 0.1) -> DataFrame:
    """Bare words with two readings or more that are frequent enough: at least `least` and a `share` of all. Spellings that
    lack marks count for the reading that they fit; of equally frequent spellings the first by letters joins first."""
    counted = spelled.select("bare", reading_counts("spellings").alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    readings = F.filter("counts", lambda n: (n >= least) & (n / total >= share))
    return counted.select("bare", F.size(readings).alias("readings")).where("readings >= 2")


def repeated(tokens: DataFrame, word: str, least: int = 2) -> DataFrame:
    """word and n of the words that stand `least` times or more."""
    return tokens.groupBy(word).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def hardest_lead(pairs: DataFrame, item: str, levels: DataFrame) -> DataFrame:
    """item and level(source's question part) - highest level of the output's sentences; levels: text, level. Each distinct text is looked up once."""
    from ..functions.text import question_stem, readability_units

    asked = pairs.select(item, question_stem("source").alias("text"), F.lit(True).alias("of_source"))
    units = pairs.select(item, F.explode(readability_units("output")).alias("text")).withColumn("of_source", F.lit(False))
    found = asked.unionByName(units).join(levels.select("text", "level"), "text", "left")
    return found.groupBy(item).agg((F.max(F.when(F.col("of_source"), F.col("level"))) - F.max(F.when(~F.col("of_source"), F.col("level")))).alias("lead"))
