"""Queries over texts: normalisation, segmentation, measures and rewriting metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions import reading as R
from ..functions import scalars as S
from ..functions import text as T
from ..operators import diacritics, prefix, rewriting, scorecard
from ..operators import statistics as ST
from .base import PAIRS_SQL, r6, table, turn_pairs


def _items(spark, sf_dir):
    """Turn pairs as benchmark items, with a track, a set and a meaning score (missing for a quarter) by rule."""
    p = turn_pairs(spark, sf_dir)
    n = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    track = F.when(n == 0, "B").when(n == 1, "C").when(n == 2, "E1").when(n == 3, "A1").otherwise("F")
    return p.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("item"), F.col("conv_id").alias("doc"), F.when(F.col("conv_id") % 2 == 0, "core").otherwise("held-out").alias("set"), track.alias("track"), "source", "output",
        F.when(F.col("conv_id") % 4 != 0, F.pmod("conv_id", F.lit(10)) / 10).alias("same"),
    )


def conversation_measures(spark, sf_dir):
    """Rates and means of the measures of all turn pairs, with the numbers of pending ones."""
    out = scorecard.summary(scorecard.item_measures(_items(spark, sf_dir)))
    return out.select("set", "block", "measure", r6(F.col("mean"), "mean"), "n", "pending", "complete")


_MARKS = "[ؐ-ًؚ-ٰٟۖ-ۭـ]"
_NORM = f"trim(regexp_replace(regexp_replace({{0}}, '{_MARKS}', '', 'g'), '\\s+', ' ', 'g'))"
_NUMBERS = "list_sort(regexp_extract_all(translate({0}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '[0-9]+(?:[.,][0-9]+)?'))"
_LONGEST = f"coalesce(list_max(list_transform(regexp_split_to_array({{0}}, '[.!?؟؛;،,:\\n]+'), lambda c: len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(c, '{_MARKS}', '', 'g'), '[^ء-ي٠-٩A-Za-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')))), 0)"
_STEMS = f"list_transform(string_split({{0}}, ' '), lambda w: translate(regexp_replace(regexp_replace(w, '{_MARKS}', '', 'g'), '[^\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{Nd}}}}\\p{{{{Nl}}}}\\p{{{{Pc}}}}]', '', 'g'), 'إأآةى', 'اااهي'))"
_END = "regexp_extract(trim({0}, ' '), '([.!?؟])[»\"'')\\]]*\\s*$', 1)"
_INNER = "left(trim({0}, ' '), length(trim({0}, ' ')) - 1)"

#: The tables hold no Arabic: no negation, limit, condition or clitic is met, and no house rule but that of full stops is broken.
MEASURES_SQL = f"""with i as (select *, case when conv_id % 2 = 0 then 'core' else 'held-out' end as set, ['B', 'C', 'E1', 'A1', 'F'][(conv_id + turn) % 5 + 1] as track, case when conv_id % 4 <> 0 then conv_id % 10 / 10.0 end as same from {PAIRS_SQL}),
a as (select set, track, same::double as same, source, output, {_NORM.format('source')} = {_NORM.format('output')} as unchanged, {_NUMBERS.format('source')} as ns, {_NUMBERS.format('output')} as no, {_LONGEST.format('source')} as ls, {_LONGEST.format('output')} as lo,
list_filter({_STEMS.format('source')}, lambda w: length(w) >= 3) as ss, {_STEMS.format('output')} as so, {_END.format('source')} as es, {_END.format('output')} as eo,
regexp_matches({_INNER.format('source')}, '[.!?؟]\\s+\\S') as several, regexp_matches({_INNER.format('output')}, '(^|[^.0-9\\s])\\.\\s+\\S') as stops, regexp_split_to_array({_INNER.format('output')}, '\\s+') as ws from i),
b as (select *, not several and stops and len(list_filter(range(1, len(ws)), lambda k: ends_with(ws[k], '.') and ws[k + 1] <> '' and length(ws[k]) > 2 and not regexp_matches(ws[k], '[0-9]\\.$'))) > 0 as stop, case when len(ss) = 0 then 1.0 else len(list_filter(ss, lambda w: list_contains(so, w))) / len(ss)::double end as kept from a),
m as (select set, unnest([
{{'block': 'behaviour', 'measure': 'F: letters unchanged', 'value': unchanged::double, 'applies': track = 'F'}}, {{'block': 'behaviour', 'measure': 'F: exactly unchanged', 'value': (trim(output, ' ') = trim(source, ' '))::double, 'applies': track = 'F'}},
{{'block': 'checks', 'measure': 'numbers kept', 'value': case when len(ns) > 0 then (ns = no)::double end, 'applies': track <> 'F'}}, {{'block': 'checks', 'measure': 'no house-rule break', 'value': 1.0::double, 'applies': track <> 'F'}},
{{'block': 'behaviour', 'measure': 'C: easy text left unchanged', 'value': unchanged::double, 'applies': track = 'C'}}, {{'block': 'behaviour', 'measure': 'E1: end mark kept', 'value': (es = eo)::double, 'applies': track = 'E1'}},
{{'block': 'meaning', 'measure': 'P(same meaning)', 'value': same, 'applies': track <> 'F'}}, {{'block': 'meaning', 'measure': 'meaning kept', 'value': (same >= 0.5 and ns = no)::double, 'applies': track <> 'F' and same is not null}}, {{'block': 'meaning', 'measure': 'meaning kept', 'value': null::double, 'applies': track <> 'F' and same is null}},
{{'block': 'simpler', 'measure': 'longest clause: words shorter', 'value': case when ls > 15 then (ls - lo)::double end, 'applies': track not in ('F', 'C')}}, {{'block': 'diagnostics', 'measure': 'kept 60%+ of words', 'value': (kept >= 0.6)::double, 'applies': track not in ('F', 'C')}},
{{'block': 'diagnostics', 'measure': 'no clause over 15 words', 'value': (lo <= 15)::double, 'applies': track = 'B'}}, {{'block': 'diagnostics', 'measure': 'mid-sentence full stop added', 'value': stop::double, 'applies': track <> 'F'}},
{{'block': 'diagnostics', 'measure': 'B: not left as copy', 'value': (not unchanged)::double, 'applies': track = 'B'}}]) as e from b),
v as (select set, e.block, e.measure, e.value from m where e.applies and (e.value is not null or e.block = 'meaning'))
select set, block, measure, round(avg(value), 6) as mean, count(value) as n, count(*) filter (value is null) as pending, count(value) >= 0.9 * count(*) as complete from v group by 1, 2, 3"""


def conversation_scorecard(spark, sf_dir):
    """The same with intervals by a bootstrap over conversations, and the difference from copying the source."""
    items = _items(spark, sf_dir)
    return scorecard.scorecard(scorecard.item_measures(items), scorecard.item_measures(scorecard.copy_baseline(items)))


def clause_lengths(spark, sf_dir):
    """Longest clause, sentences and words of each document (any script)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.longest_clause_any("text").cast("long").alias("longest"), F.size(F.filter(F.split("text", T.SENTENCE_BREAKS), lambda x: F.length(F.trim(x)) > 0)).cast("long").alias("sentences"))


CLAUSE_SQL = r"""
select doc_id, cast(coalesce(list_max(list_transform(regexp_split_to_array(text, '[.!?؟؛;،,:\n]+'), lambda c: len(list_filter(regexp_split_to_array(lower(c), '[^\p{L}\p{N}]+'), lambda w: length(w) > 0)))), 0) as bigint) as longest,
       cast(len(list_filter(regexp_split_to_array(text, '[.!?؟؛;\n]+'), lambda x: length(trim(x, ' ')) > 0)) as bigint) as sentences
from documents"""


def numbers_kept(spark, sf_dir):
    """Numbers of each turn pair and whether they are equal or contained."""
    p = turn_pairs(spark, sf_dir)
    return p.select("conv_id", "turn", F.size(G.numbers("source")).cast("long").alias("n_numbers"), G.numbers_equal("source", "output").alias("equal"), (F.trim("source") == F.trim("output")).alias("copied"))


NUMBERS_SQL = rf"""
select conv_id, turn, cast(len(regexp_extract_all(source, '[0-9]+(?:[.,][0-9]+)?')) as bigint) as n_numbers,
       list_sort(regexp_extract_all(source, '[0-9]+(?:[.,][0-9]+)?')) = list_sort(regexp_extract_all(output, '[0-9]+(?:[.,][0-9]+)?')) as equal, trim(source, ' ') = trim(output, ' ') as copied
from {PAIRS_SQL}"""


def word_retention(spark, sf_dir):
    """Share of the source's distinct words that the answer holds, and Jaccard similarity of character 5-grams."""
    p = turn_pairs(spark, sf_dir)
    return p.select("conv_id", "turn", r6(G.kept_words("source", "output"), "kept"), r6(T.jaccard(T.char_ngrams("source"), T.char_ngrams("output")), "alike"))


RETENTION_SQL = rf"""
with p as (select conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(source), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 0)) as a,
                  list_distinct(list_filter(regexp_split_to_array(lower(output), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 0)) as b,
                  case when length(source) < 5 then [source] else list_distinct(list_transform(range(1, length(source) - 3), lambda i: substr(source, i, 5))) end as ga,
                  case when length(output) < 5 then [output] else list_distinct(list_transform(range(1, length(output) - 3), lambda i: substr(output, i, 5))) end as gb
           from {PAIRS_SQL})
select conv_id, turn, round(case when len(a) = 0 then 1.0 else len(list_intersect(a, b)) / cast(len(a) as double) end, 6) as kept,
       round(len(list_intersect(ga, gb)) / cast(len(list_distinct(list_concat(ga, gb))) as double), 6) as alike from p"""


def match_keys(spark, sf_dir):
    """Keys of documents for leakage search, as digests, and their groups."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.md5(T.match_key("text")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


MATCH_SQL = r"""
select md5(trim(regexp_replace(translate(translate(text, 'أإآةى', 'اااهي'), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~،؛؟«»ـ—–', ''), '\s+', ' ', 'g'))) as key, count(*) as n from documents group by 1"""


def segments(spark, sf_dir):
    """Paragraphs and pieces of documents, and the share that goes to a model."""
    d = table(spark, sf_dir, "documents")
    e = d.select("lang", F.explode(T.pieces("text")).alias("p"))
    return e.groupBy("lang").agg(F.count(F.lit(1)).alias("pieces"), F.count_if("p.to_model").alias("to_model"))


_STOP_MARK = "regexp_replace({0}, '([.!?؟])\\s+(\\S)', '\\1' || chr(1) || '\\2', 'g')"
_ONE_BLANK = r"regexp_replace(trim(line, ' '), '[ \t\x{A0}]+', ' ', 'g')"
SEGMENTS_SQL = rf"""with l as (select lang, unnest(regexp_split_to_array(trim(regexp_replace(text, '[ؐ-ًؚ-ٰٟۖ-ۭـ]', '', 'g'), ' ' || chr(9) || chr(13) || chr(10)), '\n\s*\n|\n')) as line from documents where text is not null),
s as (select lang, unnest(string_split({_STOP_MARK.format(_STOP_MARK.format(_ONE_BLANK))}, chr(1))) as s from l)
select lang, count(*) as pieces, count(*) filter (len(list_filter(string_split(s, ' '), lambda w: w <> '')) >= 6) as to_model from s where trim(s, ' ') <> '' group by 1"""


def sari_scores(spark, sf_dir):
    """SARI of each turn pair against the source itself as reference, and copies."""
    p = turn_pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), "source", "output", F.array("source").alias("references"))
    return rewriting.sari(p).select("item", r6(F.col("sari"), "sari"))


def bleu_scores(spark, sf_dir):
    """Corpus BLEU of the answers against the questions, by parity of the conversation."""
    p = turn_pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), (F.col("conv_id") % 2).alias("part"), "output", F.array("source").alias("references"))
    return rewriting.bleu(p, ["part"]).select("part", r6(F.col("bleu"), "bleu"))


_BREAK_UP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '([\{{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g')"
_TOKENS = f"list_filter(regexp_split_to_array({_BREAK_UP}, '\\s+'), lambda w: w <> '')"
_GRAMS = f"""p as (select conv_id * 1000 + turn as item, conv_id % 2 as part, {_TOKENS.format('source')} as s, {_TOKENS.format('output')} as c from {PAIRS_SQL}),
o as (select unnest([1, 2, 3, 4]) as n), l as (select item, part, n, unnest([array_to_string(s[i : i + n - 1], ' ') for i in range(1, len(s) - n + 2)]) as gram, 1 as s, 0 as c from p, o
union all select item, part, n, unnest([array_to_string(c[i : i + n - 1], ' ') for i in range(1, len(c) - n + 2)]), 0, 1 from p, o), g as (select item, part, n, gram, sum(s)::double as s, sum(c)::double as c, sum(s)::double as r from l group by 1, 2, 3, 4)"""

#: The source is the only reference, so its counts are the references' too.
SARI_SQL = f"""with {_GRAMS},
m as (select item, n, sum(case when least(s, c) > 0 then least(s, c, r) / least(s, c) end) as kp, count(*) filter (least(s, c) > 0) as kn, sum(least(s, c, r)) as kr, sum(least(s, r)) as km,
sum(case when s > c then greatest(s - c - r, 0) / (s - c) end) as dp, count(*) filter (s > c) as dn, count(*) filter (c > 0 and s = 0 and r > 0) as ag, count(*) filter (c > 0 and s = 0) as an, count(*) filter (r > 0 and s = 0) as am from g group by 1, 2),
h as (select item, n, case when kn > 0 then coalesce(kp, 0) / kn else 1 end as a, case when km > 0 then kr / km else 1 end as b, case when dn > 0 then coalesce(dp, 0) / dn else 1 end as d, case when an > 0 then ag / an else 1 end as e, case when am > 0 then ag / am else 1 end as f from m),
k as (select item, n, (case when a + b > 0 then 2 * a * b / (a + b) else 0 end + d + case when e + f > 0 then 2 * e * f / (e + f) else 0 end) / 3 as score from h)
select p.item, round(100 * sum(coalesce(score, 1.0)) / 4, 6) as sari from p cross join o left join k on k.item = p.item and k.n = o.n group by 1"""

BLEU_SQL = f"""with {_GRAMS}, z as (select part, sum(len(c))::double as c, sum(len(s))::double as r from p group by 1),
h as (select part, n, sum(case when c > 0 then least(c, r) end) as h, sum(c) as t from g group by 1, 2),
q as (select part, sum(ln((case when h > 0 then h else 1e-9 end) / greatest(coalesce(t, 1), 1))) / 4 as logs from (select z.part, o.n, h.h, h.t from z cross join o left join h on h.part = z.part and h.n = o.n) group by 1)
select part, round(100 * exp(logs + case when c >= r then 0 else 1 - r / greatest(c, 1) end), 6) as bleu from q join z using (part)"""


def copy_rates(spark, sf_dir):
    """Copy rate and length statistics by turn."""
    p = turn_pairs(spark, sf_dir)
    p = p.withColumn("ratio", rewriting.length_ratio("source", "output"))
    rates = p.groupBy("turn").agg(r6(F.avg((F.trim("source") == F.trim("output")).cast("double")), "copy_rate"), r6(F.avg((F.col("ratio") < 0.5).cast("double")), "lost_half"), F.count(F.lit(1)).alias("n"))
    return rates.join(prefix.quantiles(p, ["turn"], "ratio", {"median_ratio": 0.5}), "turn").select("turn", "copy_rate", r6(F.col("median_ratio"), "median_ratio"), "lost_half", "n")


COPY_SQL = rf"""
with p as (select turn, source, output, len(regexp_split_to_array(trim(output, ' '), '\s+')) / cast(greatest(1, len(regexp_split_to_array(trim(source, ' '), '\s+'))) as double) as ratio from {PAIRS_SQL})
select turn, round(avg(case when trim(source, ' ') = trim(output, ' ') then 1.0 else 0.0 end), 6) as copy_rate, round(quantile_cont(ratio, 0.5), 6) as median_ratio,
       round(avg(case when ratio < 0.5 then 1.0 else 0.0 end), 6) as lost_half, count(*) as n from p group by 1"""


def sentence_ranges(spark, sf_dir):
    """Number of sentences read aloud of each document, and the sums of the places where they start and stop."""
    d = table(spark, sf_dir, "documents").select("doc_id", R.sentence_ranges("text").alias("s"))
    total = lambda c: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x[c])
    return d.select("doc_id", F.size("s").alias("n"), total("start").alias("starts"), total("stop").alias("stops"))


RANGES_SQL = r"""with p as (select doc_id, regexp_extract_all(text, '[^.!?؟\n]+[.!?؟]*|[.!?؟\n]+') as ps from documents where text is not null),
u as (select doc_id, unnest(ps) as piece, unnest(range(len(ps))) as i from p), o as (select doc_id, piece, coalesce(sum(length(piece)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from u),
s as (select doc_id, pos + length(piece) - length(regexp_replace(piece, '^[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '')) as a, length(trim(regexp_replace(regexp_replace(piece, '^[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ''), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', ''), '')) as n from o where not regexp_matches(piece, '^[.!?؟\n]'))
select d.doc_id, case when any_value(d.text) is null then null else cast(count(s.doc_id) as int) end as n, case when any_value(d.text) is null then null else cast(coalesce(sum(a), 0) as bigint) end as starts, case when any_value(d.text) is null then null else cast(coalesce(sum(a + s.n), 0) as bigint) end as stops from documents d left join s on s.doc_id = d.doc_id and s.n > 0 group by d.doc_id"""

_LATIN, _ARABIC = "bcdfghjklmnpqrstvwxyz" + "aiueo", "بتثجحخدذرزسشصضطظعغفقكلم"[:21] + "\u064e\u0650\u064f\u0652\u0651"


def mark_errors(spark, sf_dir):
    """Errors of marks by role, in what people and models write, put into Arabic letters and vowels, where one vowel is lost."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    spelled = c.select("role", F.translate(F.lower("text"), _LATIN, _ARABIC).alias("reference")).withColumn("output", F.translate("reference", "\u0650", ""))
    rates = diacritics.error_rates(spelled, ["role"], "reference", "output")
    return rates.select("role", *(r6(F.col(c), c) for c in ("der", "der_no_case", "wer", "corrupt_rate")), "letters", "words", "n")


#: No letter changes, so letters and words meet in their order.
MARKS_SQL = rf"""with t as (select role, translate(lower(text), '{_LATIN}', '{_ARABIC}') as x from conversations where text is not null),
w as (select role, regexp_extract_all(x, '[\x{{64B}}-\x{{652}}\x{{670}}ء-غف-يٱ]+') as ws from t), u as (select role, list_filter([regexp_extract_all(w, '[\x{{64B}}-\x{{652}}\x{{670}}]*[ء-غف-يٱ]') for w in ws], lambda w: len(w) > 0) as ws from w),
c as (select role, len(ws) as words, len(flatten(ws)) as letters, len(list_filter(flatten(ws), lambda u: contains(u, chr(1616)))) as wrong, len(list_filter(ws, lambda w: contains(array_to_string(w, ''), chr(1616)))) as wrong_words,
len(list_filter(flatten([w[:-2] for w in ws]), lambda u: contains(u, chr(1616)))) as wrong_inside from u)
select role, round(sum(wrong) / greatest(1, sum(letters)), 6) as der, round(sum(wrong_inside) / greatest(1, sum(letters)), 6) as der_no_case, round(sum(wrong_words) / greatest(1, sum(words)), 6) as wer, 0.0::double as corrupt_rate, cast(sum(letters) as bigint) as letters, cast(sum(words) as bigint) as words, count(*) as n from c group by 1"""


def marks_restored(spark, sf_dir):
    """Conversations with predicted marks put back, looked up by what a model that knows Latin letters is given."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    known = "abcdefghijklmnopqrstuvwxyz "
    asked = c.where("text is not null").select(diacritics.prediction_input("text", known).alias("input")).distinct()
    predictions = asked.withColumn("marks", F.transform(F.split("input", ""), lambda x: F.when(x.isin(*"aeiou"), "\u064e").otherwise("")))
    return diacritics.with_predictions(c, "text", predictions, known).select("conv_id", "turn", F.md5("restored").alias("digest"))


RESTORED_SQL = r"select conv_id, turn, md5(regexp_replace(text, '([aeiou])', '\1' || chr(1614), 'g')) as digest from conversations"


def pair_keys(spark, sf_dir):
    """Content keys of turn pairs."""
    p = turn_pairs(spark, sf_dir)
    return p.select("conv_id", "turn", S.raw_pair_key("source", "output").alias("key"), S.hash_bucket("conv_id", "salt").alias("bucket"), S.hash_shard("conv_id", 7).alias("shard"))


PAIR_KEYS_SQL = rf"""
select conv_id, turn, sha1(source || chr(0) || output) as key, cast(('0x' || substr(sha256('salt:' || cast(conv_id as varchar)), 1, 8)) as bigint) % 10000 as bucket,
       cast(('0x' || md5(cast(conv_id as varchar)))::uhugeint % 7 as bigint) as shard from {PAIRS_SQL}"""


def token_sets(spark, sf_dir):
    """Set and multiset comparisons of the words of turn pairs."""
    a, b = T.unicode_words("source"), T.unicode_words("output")
    p = turn_pairs(spark, sf_dir)
    return p.select(
        "conv_id", "turn", F.size(F.array_union(a, b)).cast("long").alias("either"), F.size(F.array_intersect(a, b)).cast("long").alias("both"), F.size(F.array_except(a, b)).cast("long").alias("lost"), S.multiset_equal(a, b).alias("same")
    )


TOKENS_SQL = rf"""
with p as (select conv_id, turn, list_filter(regexp_split_to_array(lower(source), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 0) as a, list_filter(regexp_split_to_array(lower(output), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 0) as b from {PAIRS_SQL})
select conv_id, turn, cast(len(list_distinct(list_concat(a, b))) as bigint) as either, cast(len(list_intersect(list_distinct(a), list_distinct(b))) as bigint) as both,
       cast(len(list_filter(list_distinct(a), lambda w: not list_contains(b, w))) as bigint) as lost, list_sort(a) = list_sort(b) as same from p"""


def copy_intervals(spark, sf_dir):
    """Share of answers shorter than their question, with a bootstrap interval over conversations."""
    p = turn_pairs(spark, sf_dir).withColumn("shorter", (F.length("output") < F.length("source")).cast("double")).withColumn("set", F.lit("all"))
    return ST.spread_bootstrap(p, ["set"], "conv_id", "shorter", scale=100.0)


QUERIES = {f.__name__: f for f in (conversation_measures, conversation_scorecard, clause_lengths, numbers_kept, word_retention, match_keys, segments, sari_scores, bleu_scores, copy_rates, sentence_ranges, mark_errors, marks_restored, pair_keys, token_sets, copy_intervals)}
ORACLE_SQL = {"conversation_measures": MEASURES_SQL, "clause_lengths": CLAUSE_SQL, "numbers_kept": NUMBERS_SQL, "word_retention": RETENTION_SQL, "match_keys": MATCH_SQL, "copy_rates": COPY_SQL, "sari_scores": SARI_SQL, "bleu_scores": BLEU_SQL, "segments": SEGMENTS_SQL, "sentence_ranges": RANGES_SQL, "mark_errors": MARKS_SQL, "marks_restored": RESTORED_SQL, "pair_keys": PAIR_KEYS_SQL, "token_sets": TOKENS_SQL}
