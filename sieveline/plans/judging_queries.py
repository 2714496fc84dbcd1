"""Queries over judges of rewrites, selection among candidates, and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judging, lexicon, selection
from .base import JUDGED_SQL, PAIRS_SQL, judged, r6, table, turn_pairs


def score_separation(spark, sf_dir):
    """Bars and rates of text length as a score of quality, per language."""
    s = judging.separation(judged(spark, sf_dir), ["lang"], "score", "quality")
    return s.select("lang", *(r6(F.col(c), c) for c in ("t95", "frr", "catch")), "n_changed", "n_same")


SEPARATION_SQL = f"""with j as {JUDGED_SQL}, b as (select lang, quantile_cont(score, 0.95) filter (quality = 0) as t95, quantile_cont(score, 0.05) filter (quality = 1) as t5, count(*) filter (quality = 0) as n_changed, count(*) filter (quality = 1) as n_same from j group by 1)
select lang, round(any_value(t95)::double, 6) as t95, round(avg((score <= t95)::int) filter (quality = 1), 6) as frr, round(avg((score <= t5)::int) filter (quality = 0), 6) as catch, any_value(n_changed) as n_changed, any_value(n_same) as n_same
from j join b using (lang) where n_changed >= 10 and n_same >= 10 group by 1"""


def score_closeness(spark, sf_dir):
    """Closeness of discounts (times ten; none where the tax is zero) to returns."""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("t"), F.when(F.col("l_tax") > 0, F.col("l_discount") * 10).alias("p"))  # noqa: E741
    c = judging.closeness(l, "t", "p")
    return c.select(r6(F.col("closeness"), "closeness"), r6(F.col("accuracy"), "accuracy"), "scored", "failed")


CLOSENESS_SQL = """with l as (select (l_returnflag = 'R')::int::double as t, case when l_tax > 0 then least(1.0, greatest(0.0, l_discount * 10)) end as p from lineitem)
select round(avg(1 - abs(t - p)), 6) as closeness, round(avg(((t >= 0.7) = (p >= 0.7))::int), 6) as accuracy, count(p) as scored, count(*) filter (p is null) as failed from l"""


def second_judge(spark, sf_dir):
    """Tax as a second judge beside discount, with open lines as what people kept."""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_linestatus") == "O").alias("kept"), (F.col("l_discount") * 10).alias("first"), F.when(F.col("l_quantity") > 2, F.col("l_tax") * 10).alias("second"))  # noqa: E741
    s = judging.second_judge(l, "kept", "first", "second")
    return s.select("n", "disagreements", "sides_with_people", r6(F.col("first_auc"), "first_auc"), r6(F.col("second_auc"), "second_auc"), "passes")


SECOND_SQL = """with l as (select l_linestatus = 'O' as kept, l_discount * 10 as first, l_tax * 10 as second from lineitem where l_quantity > 2),
a as (select count(*) as n, count(*) filter ((first >= 0.5) <> kept) as disagreements, count(*) filter ((first >= 0.5) <> kept and (second >= 0.5) = kept) as sides_with_people from l),
u as (select kept, rank() over (order by first) + (count(*) over (partition by first) - 1) / 2.0 as rf, rank() over (order by second) + (count(*) over (partition by second) - 1) / 2.0 as rs from l),
s as (select count(*) filter (kept)::double as p, count(*) filter (not kept)::double as m, sum(rf) filter (kept) as wf, sum(rs) filter (kept) as ws from u)
select n, disagreements, sides_with_people, round((wf - p * (p + 1) / 2) / (p * m), 6) as first_auc, round((ws - p * (p + 1) / 2) / (p * m), 6) as second_auc, (ws - p * (p + 1) / 2) / (p * m) >= 0.79 and sides_with_people > disagreements / 2.0 as passes from a, s"""


def _candidates(spark, sf_dir):
    """Lines as candidates of orders: scored by discount where open, by tax in a later run; quantity is the lead."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("text")).agg(  # noqa: E741
        F.min("l_linenumber").alias("position"), F.max("l_linestatus").alias("status"), F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"), F.max("l_quantity").alias("quantity")
    )
    rows = l.select("l_orderkey", "text", "position", F.when(F.col("status") == "O", F.col("discount") * 10).alias("score"), (F.col("quantity") / 10).alias("lead"))
    whole = l.where("position <= 3").select("l_orderkey", "text", (F.col("quantity") / 20).alias("lead_whole"))
    later = l.where("position % 2 = 1").select("l_orderkey", "text", (F.col("tax") * 10).alias("score"))
    return selection.merged_candidates(rows, whole, later, "l_orderkey")


_CANDIDATES_SQL = """l as (select l_orderkey, cast(l_linenumber as varchar) as text, l_linenumber as position, max(l_linestatus) as status, max(l_discount) as discount, max(l_tax) as tax, max(l_quantity) as quantity from lineitem group by 1, 2, 3),
c as (select l_orderkey, text, position, coalesce(case when status = 'O' then discount * 10 end, case when position % 2 = 1 then tax * 10 end) as score, quantity / 10 as lead, case when position <= 3 then quantity / 20 end as lead_whole from l)"""


def reselected(spark, sf_dir):
    """The best eligible candidate of each order, from three sources of candidates."""
    best = selection.reselected(_candidates(spark, sf_dir), "l_orderkey", "position", 0.3)
    return best.select("l_orderkey", "text", r6(F.col("score"), "score"), r6(F.col("lead"), "lead"), r6(F.col("lead_whole"), "lead_whole"), "tier")


RESELECTED_SQL = f"""with {_CANDIDATES_SQL}, r as (select *, row_number() over (partition by l_orderkey order by score >= 0.85 desc, lead desc, score desc, position) as k from c where score >= 0.3 and lead >= 2)
select l_orderkey, text, round(score, 6) as score, round(lead, 6) as lead, round(lead_whole, 6) as lead_whole, case when score >= 0.85 then 'A' else 'B' end as tier from r where k = 1"""


def below_lead(spark, sf_dir):
    """Orders without a candidate of enough lead, and the nearest one."""
    return selection.fallbacks(_candidates(spark, sf_dir), "l_orderkey", "position").select("l_orderkey", "text", r6(F.col("lead"), "lead"))


BELOW_SQL = f"""with {_CANDIDATES_SQL}, r as (select *, row_number() over (partition by l_orderkey order by lead desc, position) as k, max(lead) over (partition by l_orderkey) as most from c)
select l_orderkey, text, round(lead, 6) as lead from r where k = 1 and most < 2"""


def overridden_flags(spark, sf_dir):
    """Quality labels with people's verdicts, made from ids, over them."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("boolean").alias("flag"))
    verdict = F.element_at(F.array(*(F.lit(x) for x in ("ok", "should_be_equivalent", "should_not_be_equivalent", "unclear"))), (F.col("doc_id") % 4 + 1).cast("int"))
    notes = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", verdict.alias("verdict"))
    return judging.overridden(labels, notes, "doc_id", "flag")


OVERRIDDEN_SQL = """select doc_id, case doc_id % 4 when 0 then quality::double when 1 then 1.0 else 0.0 end as target from labels join documents using (doc_id) where doc_id % 3 = 0 and doc_id % 4 <> 3 and (doc_id % 4 <> 0 or quality is not null)"""


def pair_kinds(spark, sf_dir):
    """Kinds of pairs of turns, each pair also with its source as output."""
    p = turn_pairs(spark, sf_dir).select("source", "output")
    both = p.unionByName(p.withColumn("output", F.col("source")))
    return both.groupBy(selection.pair_kind("source", "output").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


PAIR_KINDS_SQL = rf"""with p as {PAIRS_SQL}, b as (select source, output from p union all select source, source from p)
select case when source <> output then 'generated' when len(list_filter(regexp_split_to_array(source, '\s+'), lambda w: length(w) > 0)) < 4 then 'short' else 'identity' end as kind, count(*) as n from b where source is not null and output is not null group by 1"""


_GRADED = ("l_linenumber = 1", "l_linestatus = 'O'", "1 - l_discount * 5", "l_tax * 7", "l_discount * 4", "l_returnflag = 'R'", "l_quantity / 10 - 1")


def candidate_grades(spark, sf_dir):
    """Severity, fitness and reward of lines as candidates."""
    names = ("copied", "fine", "same", "missing", "contra", "flagged", "lead")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", *(F.expr(e).alias(n) for e, n in zip(_GRADED, names, strict=True)))  # noqa: E741
    kind = F.when(F.col("l_orderkey") % 5 == 0, "short").otherwise("generated")
    graded = l.select(
        selection.severity(*names).alias("severity"), selection.qualifies(*names).alias("qualified"), selection.reward(kind, "copied", "fine", "same", "lead").alias("reward"), selection.reward(kind, "copied", "fine", "same", "lead", meaning_gate=0.75).alias("gated")
    )
    return graded.groupBy("severity", "qualified").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("reward"), "reward"), r6(F.sum("gated"), "gated"))


GRADES_SQL = """with l as (select l_orderkey % 5 = 0 as keep, l_linenumber = 1 as copied, l_linestatus = 'O' as fine, 1 - l_discount * 5 as same, l_tax * 7 as missing, l_discount * 4 as contra, l_returnflag = 'R' as flagged, l_quantity / 10 - 1 as lead from lineitem),
g as (select *, least(1.0, greatest(0.0, lead / 2)) as share from l)
select case when copied then 2 when not fine then 4 when contra >= 0.5 or flagged and contra >= 0.3 then 5 when missing >= 0.5 or same < 0.5 then 3 when lead <= 0 then 1 else 0 end as severity,
not copied and fine and same >= 0.75 and missing < 0.5 and contra < 0.3 and not (flagged and contra >= 0.15) and lead >= 1 as qualified, count(*) as n,
round(sum(case when keep then copied::int when fine and lead > 0 then same * share else 0 end), 6) as reward, round(sum(case when keep then copied::int when fine and lead > 0 and same >= 0.75 then share else 0 end), 6) as gated from g group by 1, 2"""


def _verdicts(spark, sf_dir):
    """Events of each user as errors that a judge names; the official flags come from the users' ids."""
    e = table(spark, sf_dir, "events")
    kind = F.expr("case event_type when 'error' then 'deletion' when 'purchase' then 'grammar' else 'style' end")
    found = e.groupBy("user_id").agg(F.collect_list(F.struct(kind.alias("type"), F.when(F.col("value") >= 40, "major").otherwise("minor").alias("severity"))).alias("errors"))
    planted = F.expr("case user_id % 6 when 0 then 'number changed' when 1 then 'typo' end")
    return found.select("user_id", judging.major_flags("errors").alias("f"), (F.col("user_id") % 2 == 0).alias("official_meaning"), F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 5 > 2).alias("official_language"), planted.alias("planted")).select("*", "f.*")


_VERDICTS_SQL = """v as (select user_id, coalesce(bool_or(event_type = 'error' and value >= 40), false) as meaning, coalesce(bool_or(event_type = 'purchase' and value >= 40), false) as language, user_id % 2 = 0 as om, case when user_id % 5 > 0 then user_id % 5 > 2 end as ol,
case user_id % 6 when 0 then 'number changed' when 1 then 'typo' end as planted from events group by user_id)"""


def judge_acceptance(spark, sf_dir):
    """Whether the judge made of events would be accepted."""
    rule = {"meaning_recall": 0.1, "meaning_clean_pass": 0.1, "meaning_kappa": -1.0, "planted_meaning": 0.1, "language_recall": 0.99}
    return judging.acceptance(_verdicts(spark, sf_dir), rule)


def _agreement_sql(o: str, c: str) -> str:
    return f"select count(*) filter ({o} and {c})::double as tp, count(*) filter ({o} and not {c})::double as fn, count(*) filter (not {o} and {c})::double as fp, count(*) filter (not {o} and not {c})::double as tn from v"


def _rates_sql(of: str, name: str) -> str:
    n = f"greatest(1, {of}.tp + {of}.fn + {of}.fp + {of}.tn)"
    pe = f"((({of}.tp + {of}.fn) * ({of}.tp + {of}.fp) + ({of}.tn + {of}.fp) * ({of}.tn + {of}.fn)) / ({n} * {n}))"
    return f"round_even({of}.tp / greatest(1, {of}.tp + {of}.fn), 3) as {name}_recall, round_even({of}.tn / greatest(1, {of}.tn + {of}.fp), 3) as {name}_clean_pass, round_even((({of}.tp + {of}.tn) / {n} - {pe}) / greatest(1e-9, 1 - {pe}), 3) as {name}_kappa"


ACCEPTANCE_SQL = f"""with {_VERDICTS_SQL}, m as ({_agreement_sql('om', 'meaning')}), g as ({_agreement_sql('ol', 'language')}),
p as (select round_even(count(*) filter (meaning)::double / greatest(1, count(*)), 3) as planted_meaning from v where planted = 'number changed'), r as (select {_rates_sql('m', 'meaning')}, {_rates_sql('g', 'language')}, planted_meaning from m, g, p)
select *, meaning_recall >= 0.1 and meaning_clean_pass >= 0.1 and meaning_kappa >= -1 and planted_meaning >= 0.1 and language_recall >= 0.99 as accept from r"""


def planted_caught(spark, sf_dir):
    """Planted errors that the judge made of events catches."""
    return judging.planted_caught(_verdicts(spark, sf_dir))


CAUGHT_SQL = f"with {_VERDICTS_SQL} select planted, count(*) filter (case when planted = 'number changed' then meaning else language end) as caught, count(*) as n from v where planted is not null group by 1"


def teacher_sample(spark, sf_dir):
    """Toxic documents and others up to two hundred."""
    j = judged(spark, sf_dir).select("doc_id", "toxic")
    return selection.teacher_sample(j, F.col("toxic") == 1, "doc_id", 200, "teacher")


TEACHER_SQL = f"""with j as (select doc_id, toxic from {JUDGED_SQL}), o as (select *, row_number() over (order by md5('teacher:' || cast(doc_id as varchar)), doc_id) as k from j where coalesce(toxic, 0) <> 1)
select doc_id, toxic from j where toxic = 1 union all select doc_id, toxic from o where k <= greatest(0, 200 - (select count(*) from j where toxic = 1))"""


def report_grid(spark, sf_dir):
    """Each language and source with its number of long documents, empty combinations too."""
    d = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.nullif(F.count_if(F.col("n_chars") > 5000), F.lit(0)).cast("double").alias("n"))
    return selection.report_grid(d, ["lang", "source"], "n")


GRID_SQL = """with f as (select lang, source, nullif(count(*) filter (n_chars > 5000), 0)::double as n from documents group by 1, 2) select l.lang, s.source, f.n from (select distinct lang from f) l cross join (select distinct source from f) s left join f on f.lang = l.lang and f.source = s.source"""


def repeated_words(spark, sf_dir):
    """Words that stand twice or more in what users write."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    words = c.select(F.explode(F.filter(F.split(F.lower("text"), r"(?U)[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)).alias("word"))
    return lexicon.repeated(words, "word")


REPEATED_SQL = r"select word, count(*) as n from (select unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 0)) as word from conversations where role = 'user') group by 1 having count(*) >= 2"

_ALL = (score_separation, score_closeness, second_judge, reselected, below_lead, overridden_flags, pair_kinds, candidate_grades, judge_acceptance, planted_caught, teacher_sample, report_grid, repeated_words)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "score_separation": SEPARATION_SQL, "score_closeness": CLOSENESS_SQL, "second_judge": SECOND_SQL, "reselected": RESELECTED_SQL, "below_lead": BELOW_SQL, "overridden_flags": OVERRIDDEN_SQL, "pair_kinds": PAIR_KINDS_SQL,
    "candidate_grades": GRADES_SQL, "judge_acceptance": ACCEPTANCE_SQL, "planted_caught": CAUGHT_SQL, "teacher_sample": TEACHER_SQL, "report_grid": GRID_SQL, "repeated_words": REPEATED_SQL,
}
