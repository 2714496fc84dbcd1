"""Synthetic defects, preference pairs, label blends and mixes. Random choices are hashes of ids, so runs repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import hash_order
from ..functions.text import as_column, western_digits
from .ranking import first_k, keep_first


def _draw(key: Column, seed: str, n: Column) -> Column:
    """A number from 0 to n - 1, from the first 28 bits of the MD5 of seed and key, which other engines can tell too."""
    bits = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), F.lit(7)), 16, 10).cast("long")
    return F.pmod(bits, F.greatest(n, F.lit(1)).cast("long")).cast("int")


def negated(text: Column | str) -> Column:
    """With a negation dropped, or one put before the first word."""
    t = as_column(text)
    pattern = "(?U)(^|\\s)(لا|لم|لن|ليس|not|never)(?=\\s)"
    return F.when(F.regexp_like(t, F.lit(pattern)), F.trim(F.regexp_replace(t, pattern, "$1"))).otherwise(F.concat(F.lit("ليس "), t))


def changed_number(text: Column | str, key: Column | str, seed: str = "number") -> Column:
    """With its first number changed by one to nine; null without a number."""
    t = western_digits(text)
    first = F.regexp_extract(t, r"(\d{1,9})", 1)
    other = (first.cast("long") + 1 + _draw(as_column(key), seed, F.lit(9))).cast("string")
    at = F.instr(t, F.when(F.length(first) > 0, first))
    return F.when(F.length(first) > 0, F.concat(F.substring(t, F.lit(1), at - 1), other, F.substring(t, at + F.length(first), F.length(t))))


def dropped_span(text: Column | str, key: Column | str, length: int = 3, seed: str = "span") -> Column:
    """Without `length` words in a row; null for texts of fewer than twice as many."""
    w = F.split(F.trim(as_column(text)), r"\s+")
    start = _draw(as_column(key), seed, F.size(w) - length + 1)
    return F.when(F.size(w) >= 2 * length, F.array_join(F.filter(w, lambda x, i: (i < start) | (i >= start + length)), " "))


def added_detail(text: Column | str, key: Column | str, details: list[str], seed: str = "detail") -> Column:
    pick = F.get(F.array(*(F.lit(d) for d in details)), _draw(as_column(key), seed, F.lit(len(details))))
    return F.concat(F.rtrim(F.regexp_replace(as_column(text), r"[.!?؟]+\s*$", "")), F.lit(" "), pick, F.lit("."))


def noised(text: Column | str, key: Column | str, drop_percent: int = 15, seed: str = "noise") -> Column:
    """Words dropped by chance and one neighbouring pair swapped."""
    w = F.split(F.trim(as_column(text)), r"\s+")
    kept = F.filter(w, lambda x, i: F.pmod(F.xxhash64(as_column(key).cast("string"), F.lit(seed), i), F.lit(100)) >= drop_percent)
    kept = F.when(F.size(kept) > 0, kept).otherwise(w)
    at = _draw(as_column(key), seed + "-swap", F.size(kept) - 1)
    swapped = F.transform(kept, lambda x, i: F.when(i == at, F.coalesce(F.get(kept, i + 1), x)).when((i == at + 1), F.coalesce(F.get(kept, i - 1), x)).otherwise(x))
    return F.array_join(swapped, " ")


# Prepositions, and signs that end a clause.
PREPOSITIONS = ("في", "على", "من", "إلى", "عن", "مع", "بعد", "قبل", "عند", "منذ", "حتى", "بين", "خلال", "داخل", "خارج", "أمام", "تحت", "فوق")
CLAUSE_SIGNS = "،.؛:!؟,"
QUESTION_WORDS = ("هل", "لماذا", "كيف", "متى", "أين", "ما ", "من ")
SPLIT_AT = "،\\s*و(?=\\S)|\\s+ثم\\s+|،\\s+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 0)


def _ends_clause(word: Column) -> Column:
    return F.regexp_like(word, F.lit(f"[{CLAUSE_SIGNS}]$"))


def _without(words: Column, start: Column, n: Column) -> Column:
    """The words but n from start on; a sign that ends the last of them goes to the word before, unless that has one."""
    sign = F.regexp_extract(F.get(words, start + n - 1), f"[{CLAUSE_SIGNS}]$", 0)
    kept = F.transform(words, lambda w, i: F.when((i == start - 1) & ~_ends_clause(w), F.concat(w, sign)).otherwise(w))
    return F.array_join(F.filter(kept, lambda w, i: (i < start) | (i >= start + n)), " ")


def phrase_dropped(text: Column | str, key: Column | str, seed: str = "phrase") -> Column:
    """Without a phrase of two to five words inside a clause, one that starts with a preposition if there is any.

    Null for fewer than eight words, or where no such phrase ends before the text does.
    """

    def dropped(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(w) - 3)
        opens = lambda i: F.regexp_replace(F.get(w, i), "^و+", "").isin(*PREPOSITIONS) | F.regexp_like(F.get(w, i), F.lit("^[وف]?[بل](?!ا)\\S{3,}$"))
        starts = T.let(F.filter(places, opens), lambda p: F.when(F.size(p) > 0, p).otherwise(F.slice(places, 1, F.size(w) - 4)))
        spans = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.lit(5)), lambda n: F.struct(i.alias("start"), n.alias("n")))))
        fine = F.filter(spans, lambda s: (s["start"] + s["n"] < F.size(w)) & ~F.exists(F.slice(w, s["start"] + 1, s["n"] - 1), _ends_clause))
        return T.let(fine, lambda f: F.when(F.size(f) > 0, T.let(F.get(f, _draw(as_column(key), seed, F.size(f))), lambda s: _without(w, s["start"], s["n"]))))

    return T.let(_words(as_column(text)), lambda w: F.when(F.size(w) >= 8, dropped(w)))


def adjective_dropped(text: Column | str, key: Column | str, seed: str = "adjective") -> Column:
    """Without the adjective of a definite noun; null for fewer than six words or without such a pair."""

    def dropped(w: Column) -> Column:
        pair = lambda i: F.regexp_like(F.get(w, i), F.lit("^ال\\S{3,}")) & F.regexp_like(F.get(w, i - 1), F.lit("^[وفبل]?ال\\S{2,}")) & ~_ends_clause(F.get(w, i - 1))
        places = F.filter(F.sequence(F.lit(1), F.size(w) - 1), pair)
        return T.let(places, lambda p: F.when(F.size(p) > 0, _without(w, F.get(p, _draw(as_column(key), seed, F.size(p))), F.lit(1))))

    return T.let(_words(as_column(text)), lambda w: F.when(F.size(w) >= 6, dropped(w)))


def as_question(text: Column | str) -> Column:
    """With its last statement as a question; null for statements of fewer than four words, questions and options."""
    parts = F.filter(F.split(F.trim(as_column(text)), r"(?<=[.!؟])\s+"), lambda x: F.length(x) > 0)

    def asked(p: Column) -> Column:
        last = F.regexp_replace(F.element_at(p, -1), "[.!؟ ]+$", "")
        asks = F.regexp_like(last, F.lit(f"^({'|'.join(QUESTION_WORDS)})"))
        whole = F.array_join(F.concat(F.slice(p, 1, F.size(p) - 1), F.array(F.concat(F.lit("هل "), last, F.lit("؟")))), " ")
        return F.when((F.size(_words(last)) >= 4) & ~asks & ~as_column(text).contains("(أ)"), whole)

    return T.let(parts, lambda p: F.when(F.size(p) > 0, asked(p)))


def split_in_two(text: Column | str, key: Column | str, seed: str = "split") -> Column:
    """As two sentences, at a comma or a joining word with three words or more on each side; null without such a place."""
    t = as_column(text)
    parts = F.struct(F.split(t, SPLIT_AT, -1).alias("said"), F.regexp_extract_all(t, F.lit(f"({SPLIT_AT})"), 1).alias("joint"))

    def cut(p: Column) -> Column:
        before = lambda i: F.concat(F.array_join(F.transform(F.slice(p["said"], 1, i), lambda s, k: F.concat(s, F.get(p["joint"], k))), ""), F.get(p["said"], i))
        after = lambda i: F.concat(F.array_join(F.transform(F.slice(p["said"], i + 2, F.size(p["joint"]) - i - 1), lambda s, k: F.concat(s, F.get(p["joint"], i + 1 + k))), ""), F.element_at(p["said"], -1))
        places = F.filter(F.sequence(F.lit(0), F.size(p["joint"]) - 1), lambda i: (F.size(_words(before(i))) >= 3) & (F.size(_words(after(i))) >= 3))

        def at(i: Column) -> Column:
            rest = F.regexp_replace(after(i), "^[\u064b-\u0652]+", "")
            return F.concat(F.regexp_replace(before(i), "[، ]+$", ""), F.lit(". "), F.when(F.get(p["joint"], i).contains("ثم"), F.lit("ثم ")).otherwise(F.lit("")), rest)

        return T.let(places, lambda c: F.when(F.size(c) > 0, T.let(F.get(c, _draw(as_column(key), seed, F.size(c))), at)))

    return T.let(parts, lambda p: F.when(F.size(p["joint"]) > 0, cut(p)))


def targeted(rows: DataFrame, source: str, output: str, row_id: str, quotas: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, source, anchor, candidate, kind, label) of each kind up to its quota, and a report (kind, quota, made, short).

    quotas: kinds among phrase, adjective (something missing), question (contradicts) and split (the same meaning). Each
    kind takes anchors in a reproducible random order of its own, one row for each source and candidate; a candidate that
    an earlier kind of `quotas` has made is not made again. Quotas are numbers of a report's size: each is a heap.
    """
    key = F.col(row_id)
    made = {"phrase": (phrase_dropped(output, key), "missing"), "adjective": (adjective_dropped(output, key), "missing"), "question": (as_question(output), "contradict"), "split": (split_in_two(output, key), "same")}
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("_turn"), made[k][0].alias("candidate"), F.lit(made[k][1]).alias("label")) for i, k in enumerate(quotas)))
    rows_made = rows.select(row_id, F.col(source).alias("source"), F.col(output).alias("anchor"), F.explode(each).alias("m")).select(row_id, "source", "anchor", "m.*")
    fine = rows_made.where(F.col("candidate").isNotNull() & (F.trim("candidate") != F.trim("anchor")))
    once = keep_first(fine, ["source", "candidate"], ["_turn", hash_order(row_id, "targeted"), row_id])
    quota = F.element_at(F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair)), F.col("kind"))
    kept = first_k(once, ["kind"], [hash_order(F.concat_ws(":", key.cast("string"), "kind"), "quota"), F.col(row_id)], max(quotas.values()), "_rank").where(F.col("_rank") <= quota)
    kept = kept.select(row_id, "source", "anchor", "candidate", "kind", "label")
    asked = rows.sparkSession.createDataFrame(list(quotas.items()), "kind string, quota int")
    report = asked.join(kept.groupBy("kind").agg(F.count(F.lit(1)).alias("made")), "kind", "left").select("kind", "quota", F.coalesce("made", F.lit(0)).alias("made")).withColumn("short", F.greatest(F.lit(0), F.col("quota") - F.col("made")))
    return kept, report


def bench(adversarial: DataFrame, human: DataFrame, silver: DataFrame, planted_sources: int = 260, identity_sources: int = 100, least_words: int = 8) -> DataFrame:
    """id, slice, original, candidate, label, kind: five slices of a bench for judges of meaning.

    adversarial (id, original, candidate, label), human and silver (id, original, candidate, label: same, minor, changed).
    Silver pairs that people call the same, of least_words words or more, take turns in a reproducible random order: the
    first planted_sources get planted defects, the next identity_sources stand as copies, and no source is in both.
    """
    columns = ("id", "slice", "original", "candidate", "label", "kind")
    given = [
        adversarial.select(F.concat(F.lit("adv"), F.col("id").cast("string")).alias("id"), F.lit("adv").alias("slice"), "original", "candidate", F.when(F.col("label") == "faithful", "same").otherwise("changed").alias("label"), F.col("label").alias("kind")),
        human.where(F.col("label").isin("same", "minor", "changed")).select(F.concat(F.lit("hum"), F.col("id").cast("string")).alias("id"), F.lit("human").alias("slice"), "original", "candidate", "label", F.lit("rated").alias("kind")),
        silver.select(F.concat(F.lit("sil"), F.col("id").cast("string")).alias("id"), F.lit("silver").alias("slice"), "original", "candidate", "label", F.lit("audit").alias("kind")),
    ]
    good = silver.where((F.col("label") == "same") & (F.size(_words(F.col("candidate"))) >= least_words))
    placed = first_k(good.withColumn("_all", F.lit(0)), ["_all"], [hash_order("id", "bench"), F.col("id")], planted_sources + identity_sources, "_rank")
    defects = planted(placed.where(F.col("_rank") <= planted_sources).select("id", "original", F.col("candidate").alias("_text")), "_text", "id", keep=["original"])
    made = defects.select(F.concat(F.lit("pl"), F.col("id").cast("string"), F.lit("_"), F.col("kind")).alias("id"), F.lit("planted").alias("slice"), "original", "candidate", F.lit("changed").alias("label"), "kind")
    copies = placed.where(F.col("_rank") > planted_sources).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("id"), F.lit("identity").alias("slice"), "original", F.col("original").alias("candidate"), F.lit("same").alias("label"), F.lit("identity").alias("kind"))
    out = None
    for part in (*given, made, copies):
        out = part.select(*columns) if out is None else out.unionByName(part.select(*columns))
    return out


def planted(rows: DataFrame, text: str, row_id: str, most: int = 2, keep: list[str] | None = None) -> DataFrame:
    """row_id, kind, original, candidate: each applicable defect, `most` random ones and every number defect a row.

    original is the text itself, or `keep` names columns that come instead.
    """
    keep = keep or []
    own = [] if keep else [F.col(text).alias("original")]
    key = F.col(row_id)
    made = F.array(
        *(F.struct(F.lit(kind).alias("kind"), c.alias("candidate")) for kind, c in (
            ("negate", negated(text)), ("delete", dropped_span(text, key)), ("add", added_detail(text, key, ["في ذلك اليوم", "كما قال الجميع", "منذ زمن بعيد"])), ("number", changed_number(text, key)),
        ))
    )
    each = rows.select(row_id, *own, *keep, F.explode(made).alias("m"), F.col(text).alias("_of")).select(row_id, *(["original"] if own else keep), "m.*", "_of").where("candidate is not null and candidate <> _of").drop("_of")
    numbers = each.where("kind = 'number'")
    others = first_k(each.where("kind <> 'number'"), [row_id], [hash_order(F.concat(key.cast("string"), "kind"), "planted")], most)
    return others.unionByName(numbers)


def blended(rows: DataFrame, teacher: DataFrame, second: DataFrame, key: str, weight: float = 0.5) -> DataFrame:
    """label: certain for planted kinds, else the weighted mean of both teachers, or the one there is."""
    j = rows.join(teacher.select(key, F.col("score").alias("t")), key, "left").join(second.select(key, F.col("score").alias("s")), key, "left")
    mixed = F.coalesce(weight * F.col("t") + (1 - weight) * F.col("s"), "t", "s")
    label = F.when(F.col("kind") == "identity", 1.0).when(F.col("kind").isin("negate", "delete", "add", "number"), 0.0).otherwise(mixed)
    return j.withColumn("label", label).drop("t", "s").where("label is not null")


def preference_pairs(candidates: DataFrame, source: str, position: str, least_good: float = 0.8, most_bad: float = 0.5, most: int = 3) -> DataFrame:
    """source, chosen, rejected: each source's best qualified candidate against its worst others, worst first."""
    good = candidates.where((F.col("p_same") >= least_good) & (F.col("lead") > 0))
    best = good.groupBy(source).agg(F.max_by("text", F.struct("lead", "p_same", (-F.col(position)).alias("p"))).alias("chosen"))
    bad = candidates.where(F.col("p_same") < most_bad)
    severity = F.when(F.col("p_same") < 0.1, 3).when(F.col("p_same") < 0.3, 2).otherwise(1)
    worst = first_k(bad.withColumn("severity", severity), [source], [F.desc("severity"), F.col("p_same"), F.col(position)], most)
    return best.join(worst.select(source, F.col("text").alias("rejected"), "severity"), source).where("chosen <> rejected")
