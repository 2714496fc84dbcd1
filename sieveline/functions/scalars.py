"""Numeric, hashing and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, let, norm

# Readability levels of nineteen as five, and the ease formula's weights.
FIVE_LEVELS = [1] * 7 + [2] * 4 + [3] * 2 + [4] * 2 + [5] * 4
EASE_WEIGHTS = (0.1121, -0.5777, 1.7292)


def clamp(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Within [low, high]; null stays null."""
    x = as_column(x)
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def logit(p: Column | str, clip: float = 1e-6) -> Column:
    q = clamp(as_column(p), clip, 1 - clip)
    return F.ln(q / (1 - q))


def linear_ease(level_logit: Column | str, mean_aoa: Column | str) -> Column:
    a, b, c = EASE_WEIGHTS
    return a * as_column(level_logit) + b * as_column(mean_aoa) + c


def tier(equivalence: Column | str, meaning_ok: Column | str, ease_ok: Column | str, high: float = 0.85) -> Column:
    """C unless both gates hold; then A from `high` on, else B."""
    ok = F.coalesce(as_column(meaning_ok) & as_column(ease_ok), F.lit(False))
    return F.when(~ok, "C").when(as_column(equivalence) >= high, "A").otherwise("B")


def both_known(a: Column | str, b: Column | str) -> Column:
    """a and b; null if either is null."""
    a, b = as_column(a), as_column(b)
    return F.when(a.isNotNull() & b.isNotNull(), a & b)


def gate(equivalence, ease_gain, least_equivalence: float = 0.7, least_gain: float = 0.33) -> Column:
    return both_known(as_column(equivalence) >= least_equivalence, as_column(ease_gain) >= least_gain)


def hash_bucket(key: Column | str, salt: str, buckets: int = 10_000) -> Column:
    """The first 32 bits of sha256(salt:key), modulo buckets: stable across engines and runs."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), as_column(key).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets


def hash_shard(key: Column | str, shards: int) -> Column:
    """The whole 128-bit md5 of a key, modulo shards."""
    digest, out = F.md5(as_column(key).cast("string")), F.lit(0).cast("long")
    for i in range(4):
        out = (out * ((1 << 32) % shards) + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")) % shards
    return out


def hash_order(key: Column | str, seed: str) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(F.lit(seed + ":"), as_column(key).cast("string")))


def pair_key(source, output, length: int = 16) -> Column:
    """Digest of the normalised pair."""
    return F.substring(F.sha1(F.concat(norm(source), F.char(F.lit(0)), norm(output)).cast("binary")), 1, length)


def raw_pair_key(source, output) -> Column:
    return F.sha1(F.concat(as_column(source), F.char(F.lit(0)), as_column(output)).cast("binary"))


def level_bucket(level: Column | str) -> Column:
    x = as_column(level)
    return F.when(x < 13, "12-13").when(x < 14, "13-14").when(x < 15, "14-15").otherwise("15+")


def expected_level(probabilities: Column | str) -> Column:
    """Sum of k * p_k, levels from 1."""
    p = as_column(probabilities)
    return F.aggregate(F.transform(p, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def easy_probability(probabilities: Column | str, levels: int = 11) -> Column:
    return F.aggregate(F.slice(as_column(probabilities), 1, levels), F.lit(0.0), lambda a, x: a + x)


def most_likely(probabilities: Column | str) -> Column:
    """The first of the likeliest levels."""
    p = as_column(probabilities)
    return F.array_position(p, F.array_max(p)).cast("int")


def five_level(level: Column | str) -> Column:
    return F.get(F.array(*(F.lit(x) for x in FIVE_LEVELS)), as_column(level) - 1)


def yes_probability(logprobs: Column | str) -> Column:
    """P(yes) of an array of (token, logprob): yes / (yes + no), 0.5 without either."""
    mass = lambda word: F.aggregate(F.filter(as_column(logprobs), lambda t: F.lower(F.trim(t["token"])) == word), F.lit(0.0), lambda a, t: a + F.exp(t["logprob"]))
    y, n = mass("yes"), mass("no")
    return F.when(y + n > 0, y / (y + n)).otherwise(F.lit(0.5))


def combined_meaning(same, added, missing, contradict) -> Column:
    return F.least(as_column(same), 1 - as_column(added), 1 - as_column(missing), 1 - as_column(contradict))


def ordinal_encode(level: Column | str, levels: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(levels - 1)), lambda k: (as_column(level) > k).cast("int"))


def ordinal_decode(logits: Column | str) -> Column:
    return 1 + F.size(F.filter(as_column(logits), lambda x: x > 0))


def reference_status(source, references) -> Column:
    """no references, changed (some reference differs from the source) or unchanged."""
    refs = F.coalesce(as_column(references), F.array().cast("array<string>"))
    return F.when(F.size(refs) == 0, "no references").when(F.exists(refs, lambda r: F.trim(r) != F.trim(as_column(source))), "changed").otherwise("unchanged")


def item_set(given, domain) -> Column:
    given = as_column(given)
    return F.when(F.length(given) > 0, given).otherwise(F.when(as_column(domain).isin("news", "legal"), "held-out").otherwise("core"))


def without_style_tag(text) -> Column:
    return F.regexp_replace(as_column(text), r"^\[[A-Z0-9-]+\] ", "")


# Multisets in arrays


def multiset_intersection_size(a: Column, b: Column) -> Column:
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.aggregate(F.array_distinct(p["a"]), F.lit(0), lambda acc, v: acc + F.least(times(p["a"], v), times(p["b"], v))))


def multiset_equal(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def banned_tokens(tokens: Column, n: int) -> Column:
    """Tokens that would complete an n-gram that the sequence already holds."""
    size = F.size(tokens)
    tail = F.slice(tokens, size - n + 2, n - 1)
    at = F.filter(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: (i <= size - n + 1) & (F.slice(tokens, i, n - 1) == tail))
    return F.when(size < n, F.array_except(tokens, tokens)).otherwise(F.array_distinct(F.transform(at, lambda i: F.element_at(tokens, i + n - 1))))


# Values from free text


def score_from_text(text: Column | str, name: str = "SCORE") -> Column:
    """The last `NAME: number` of a reply; null without one."""
    found = F.regexp_extract_all(as_column(text), F.lit(f"(?i){name}\\s*[:=]\\s*(-?[0-9]+(?:\\.[0-9]+)?)"), 1)
    return F.try_element_at(found, F.lit(-1)).cast("double")


def json_from_text(text: Column | str, schema: str, field: str) -> Column:
    """The last object of a reply (braces nested once at most) that parses and holds `field`; null without one."""
    objects = F.regexp_extract_all(as_column(text), F.lit("\\{(?:[^{}]|\\{[^{}]*\\})*\\}"), 0)
    parsed = F.filter(F.transform(objects, lambda o: F.from_json(o, schema)), lambda x: x[field].isNotNull())
    return F.try_element_at(parsed, F.lit(-1))


def numbered_ratings(text: Column | str, expected: int, least: float = 0.9) -> Column:
    """`n: rating` lines of a reply as a map; null unless `least` of the expected numbers are there (of repeated ones, the last)."""
    t = as_column(text)
    pattern = F.lit("(?m)^\\s*([0-9]+)\\s*[:.)-]\\s*([0-9]+)")
    keys = F.transform(F.regexp_extract_all(t, pattern, 1), lambda x: x.cast("int"))
    values = F.transform(F.regexp_extract_all(t, pattern, 2), lambda x: x.cast("int"))
    found = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    unique = let(found, lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"])))
    return let(unique, lambda e: F.when(F.size(e) >= least * expected, F.map_from_entries(e)))


def nan_mean(x: Column | str) -> Column:
    """Mean over values that are neither null nor NaN (an aggregate)."""
    v = as_column(x)
    return F.avg(F.when(~F.isnan(v), v))
