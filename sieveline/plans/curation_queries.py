"""Queries over leakage, provenance, splits, ranking and incremental loads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import leakage, prefix, ranking, splits, synthesis
from ..sources import io
from .base import r6, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def near_leakage(spark, sf_dir):
    """Exact and near matches of documents of odd ids among those of even ids."""
    d = _docs(spark, sf_dir).select("doc_id", "text")
    return leakage.matches(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), "doc_id", "doc_id").select("left_id", "right_id", r6(F.col("similarity"), "similarity"), "kind")


def exact_leakage(spark, sf_dir):
    """Exact matches alone."""
    d = _docs(spark, sf_dir).select("doc_id", "text")
    return leakage.exact_matches(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), "doc_id", "doc_id").select("left_id", "right_id")


_KEY = r"""trim(regexp_replace(translate(translate(text, 'أإآةى', 'اااهي'), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~،؛؟«»ـ—–', ''), '\s+', ' ', 'g'))"""
NEAR_SQL = f"""
with k as (select doc_id, {_KEY} as key from documents), f as (select doc_id, key from k where key <> ''),
o as (select key, min(doc_id) as right_id from f where doc_id % 2 = 0 group by key),
e as (select f.doc_id as left_id, o.right_id from f join o using (key) where f.doc_id % 2 = 1),
g as (select distinct doc_id, substr(key, unnest(range(1, greatest(1, length(key) - 4) + 1)), 5) as gram from f where doc_id not in (select left_id from e)),
s as (select doc_id, count(*) as n from g group by 1),
p as (select l.doc_id as left_id, r.doc_id as right_id, count(*) as both_ from g l join g r on l.gram = r.gram and l.doc_id % 2 = 1 and r.doc_id % 2 = 0 group by 1, 2)
select left_id, right_id, 1.0::double as similarity, 'exact' as kind from e
union all select left_id, right_id, round(both_ / (a.n + b.n - both_), 6), 'near' from p join s a on a.doc_id = left_id join s b on b.doc_id = right_id where both_ / (a.n + b.n - both_) >= 0.8"""
EXACT_SQL = f"""
with k as (select doc_id, {_KEY} as key from documents)
select l.doc_id as left_id, r.doc_id as right_id from k l join (select key, min(doc_id) as doc_id from k where doc_id % 2 = 0 and key <> '' group by key) r using (key) where l.doc_id % 2 = 1"""


def benchmark_containment(spark, sf_dir):
    """Documents that hold a whole benchmark item of eight words or more."""
    return leakage.contained(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "item_id").select("long_id", "short_id")


CONTAINED_SQL = rf"""
with d as (select doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array({_KEY.replace('text,', 'lower(text),')}, ' '), lambda w: length(w) > 0), ' ') || ' ' as hay from documents),
     b as (select item_id, list_filter(regexp_split_to_array({_KEY.replace('text,', 'lower(text),')}, ' '), lambda w: length(w) > 0) as w from benchmark)
select doc_id as long_id, item_id as short_id from d join b on len(w) >= 8 and contains(hay, ' ' || array_to_string(w, ' ') || ' ')"""


def provenance(spark, sf_dir):
    """Split of each document by id among three quarters of the documents, else by text."""
    d = _docs(spark, sf_dir)
    split = F.when(F.col("doc_id") % 10 < 6, "train").when(F.col("doc_id") % 10 < 8, "dev").otherwise("test")
    corpus = d.where("doc_id % 4 <> 0").select("doc_id", "text", split.alias("split"))
    return leakage.provenance(d.select("doc_id", "text"), corpus, "doc_id", "text").select("doc_id", "found_split", "match_method", "in_several_splits")


PROVENANCE_SQL = f"""
with k as (select doc_id, {_KEY} as key, case when doc_id % 10 < 6 then 'train' when doc_id % 10 < 8 then 'dev' else 'test' end as split from documents),
     c as (select * from k where doc_id % 4 <> 0), t as (select key, min(split) as text_split, count(distinct split) as splits from c group by key)
select k.doc_id, coalesce(c.split, t.text_split) as found_split, case when c.split is not null then 'id' when t.text_split is not null then 'text' else 'none' end as match_method, coalesce(t.splits, 0) > 1 as in_several_splits
from k left join c using (doc_id) left join t on t.key = k.key"""


def _split(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("key"), "lang", "n_chars")
    return splits.split_rows(d, "key", "doc_id", "lang", "split-1")


def split_assignment(spark, sf_dir):
    """Hash-based stratified split; copies share theirs."""
    return _split(spark, sf_dir).select("doc_id", "group_stratum", "split")


_SPLIT_CTE = """
g as (select md5(text) as key, min(doc_id) as id, arg_min(lang, doc_id) as stratum from documents group by 1),
b as (select *, cast(('0x' || substr(sha256('split-1:' || cast(id as varchar)), 1, 8)) as bigint) % 10000 as bucket from g),
n as (select stratum, count(*) as n from g group by 1), w as (select sum(n) as total, count(*) as strata from n),
t as (select stratum, least(round_even(0.1 / strata / (n / total) * 10000, 0), 10000) as cut from n, w),
s as (select key, stratum, case when bucket < cut then 'test' when bucket < 2 * cut then 'dev' else 'train' end as split from b join t using (stratum))"""
SPLIT_SQL = f"with {_SPLIT_CTE} select d.doc_id, s.stratum as group_stratum, s.split from documents d join s on s.key = md5(d.text)"


def split_balance(spark, sf_dir):
    """Standardised differences of text length between splits."""
    return splits.standardised_difference(_split(spark, sf_dir), "n_chars").select("split", r6(F.col("smd"), "smd"), "flagged")


BALANCE_SQL = f"""with {_SPLIT_CTE}, r as (select s.split, avg(n_chars) as m, var_pop(n_chars) as v from documents d join s on s.key = md5(d.text) group by 1), z as (select m as bm, v as bv from r where split = 'train')
select split, round(case when (v + bv) / 2 = 0 then 0.0 else abs(m - bm) / sqrt((v + bv) / 2) end, 6) as smd, (case when (v + bv) / 2 = 0 then 0.0 else abs(m - bm) / sqrt((v + bv) / 2) end) >= 0.1 as flagged from r, z where split <> 'train'"""


def winners(spark, sf_dir):
    """Best line item of each order by (returned, discount, price); the first line wins ties."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_extendedprice", "l_returnflag")  # noqa: E741
    return ranking.winner(l, ["l_orderkey"], [F.col("l_returnflag") == "R", F.col("l_discount"), F.col("l_extendedprice")], "l_linenumber")


WINNERS_SQL = """select l_orderkey, l_linenumber, l_discount, l_extendedprice, l_returnflag from (select *, row_number() over (partition by l_orderkey order by l_returnflag = 'R' desc, l_discount desc, l_extendedprice desc, l_linenumber) as k
from lineitem) where k = 1"""


def capped_sample(spark, sf_dir):
    """At most twenty documents a source in a reproducible order."""
    return ranking.capped_sample(_docs(spark, sf_dir).select("doc_id", "source"), ["source"], "doc_id", 20, "cap")


CAPPED_SQL = "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by md5('cap:' || cast(doc_id as varchar)), doc_id) as k from documents) where k <= 20"


def stratified_sample(spark, sf_dir):
    """A tenth of each language."""
    return ranking.stratified_sample(_docs(spark, sf_dir).select("doc_id", "lang"), ["lang"], "doc_id", 0.1, "strata")


STRATIFIED_SQL = """select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5('strata:' || cast(doc_id as varchar)), doc_id) as k, count(*) over (partition by lang) as n from documents) where k <= floor(n * 0.1)"""


def bottom_share(spark, sf_dir):
    """Shortest documents of each language, with quotas from the languages' shares of labels."""
    d = _docs(spark, sf_dir).select("doc_id", "lang", "n_chars")
    shares = d.groupBy("lang").agg((F.count(F.lit(1)) / 1000.0).alias("fraction"))
    return ranking.bottom_share(d, ["lang"], "n_chars", "doc_id", shares, 15)


BOTTOM_SQL = """select doc_id, lang, n_chars from (select doc_id, lang, n_chars, row_number() over (partition by lang order by n_chars, doc_id) as k, count(*) over (partition by lang) as n from documents) where k <= round_even(15 * (n / 1000.0), 0)"""


def seeded_limit(spark, sf_dir):
    """A hundred orders in a reproducible random order."""
    return ranking.seeded_limit(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, "seed")


SEEDED_SQL = "select o_orderkey, o_totalprice from orders order by md5('seed:' || cast(o_orderkey as varchar)), o_orderkey limit 100"


def top_orders(spark, sf_dir):
    """The fifty dearest orders; ties to the smaller key."""
    return ranking.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 50, "o_totalprice", "o_orderkey")


TOP_SQL = "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50"


def last_records(spark, sf_dir):
    """Last event of each user and type; and the first one's id."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    last = ranking.keep_last(e, ["user_id", "event_type"], ["ts", "event_id"])
    first = ranking.keep_first(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", F.col("event_id").alias("first_id"))
    return last.join(first, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value", "first_id")


LAST_SQL = """select user_id, event_type, max_by(event_id, (ts, event_id)) as event_id, max_by(value, (ts, event_id)) as value, min_by(event_id, (ts, event_id)) as first_id from events group by 1, 2"""


def event_history(spark, sf_dir):
    """Each user's newest three event types."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return ranking.upsert_history(e, "user_id", "event_type", "ts", "event_id", 3).select("user_id", "event_type", "event_id")


HISTORY_SQL = """with u as (select user_id, event_type, max(ts) as ts, max_by(event_id, (ts, event_id)) as event_id from events group by 1, 2)
select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from u) where k <= 3"""


def resume(spark, sf_dir):
    """What a second run appends to a log of results: documents that the first run, over two thirds of the ids, lacks or failed at."""
    path = f"{prefix.shared_folder(spark)}/resume-{uuid.uuid4().hex}"
    d = _docs(spark, sf_dir).select("doc_id", "source")
    first = d.where("doc_id % 3 <> 0").select("*", F.when(F.col("doc_id") % 11 == 5, "no answer").alias("error"), F.lit(1).alias("run"))
    second = d.select("*", F.lit(None).cast("string").alias("error"), F.lit(2).alias("run"))
    for run in (first, second):
        io.append_new(run, path, "doc_id", failed=F.col("error").isNotNull())
    return spark.read.schema(second.schema).json(path).where("run = 2").select("doc_id", "source")


RESUME_SQL = "select doc_id, source from documents where not (doc_id % 3 <> 0 and doc_id % 11 <> 5)"


def batches(spark, sf_dir):
    """Jobs of forty documents a source after a reproducible shuffle."""
    return ranking.batches(_docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 40, "jobs")


BATCHES_SQL = "select doc_id, source, cast(floor((row_number() over (partition by source order by md5('jobs:' || cast(doc_id as varchar)), doc_id) - 1) / 40) as bigint) as batch from documents"


def union_and_difference(spark, sf_dir):
    """Sources of quality documents, of toxic ones, and of either but not both."""
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    good, bad = d.where("quality = 1").select("source", "lang"), d.where("toxic = 1").select("source", "lang")
    return good.union(bad).distinct().subtract(good.intersect(bad))


UNION_SQL = """with j as (select d.source, d.lang, l.quality, l.toxic from documents d join labels l using (doc_id)), g as (select source, lang from j where quality = 1), b as (select source, lang from j where toxic = 1)
select source, lang from (select * from g union select * from b) except (select * from g intersect select * from b)"""


def planted_defects(spark, sf_dir):
    """Synthetic defects of benchmark items."""
    return synthesis.planted(table(spark, sf_dir, "benchmark"), "text", "item_id").select("item_id", "kind", F.md5("candidate").alias("digest"))


def _draw_sql(key: str, seed: str, n: str) -> str:
    return f"('0x' || left(md5('{seed}:' || cast({key} as varchar)), 7))::bigint % greatest({n}, 1)"


_DETAILS = "['في ذلك اليوم', 'كما قال الجميع', 'منذ زمن بعيد']"


def _planted_sql(of: str) -> str:
    """Table expressions that end in `planted` (id, kind, candidate) of a table `of` (id, text)."""
    number = "regexp_extract(text, '([0-9]{1,9})', 1)"
    return rf"""w as (select id, text, regexp_split_to_array(trim(text), '\s+') as ws, {number} as first from {of}),
m as (select id, text, 'negate' as kind, case when regexp_matches(text, '(^|\s)(لا|لم|لن|ليس|not|never)(\s)') then trim(regexp_replace(text, '(^|\s)(لا|لم|لن|ليس|not|never)(\s)', '\1\3', 'g')) else 'ليس ' || text end as candidate from w
union all select id, text, 'delete', case when len(ws) >= 6 then array_to_string(list_concat(ws[1 : {_draw_sql('id', 'span', 'len(ws) - 2')}], ws[{_draw_sql('id', 'span', 'len(ws) - 2')} + 4 :]), ' ') end from w
union all select id, text, 'add', rtrim(regexp_replace(text, '[.!?؟]+\s*$', '')) || ' ' || ({_DETAILS})[{_draw_sql('id', 'detail', '3')} + 1] || '.' from w
union all select id, text, 'number', case when first <> '' then left(text, instr(text, first) - 1) || cast(first::bigint + 1 + {_draw_sql('id', 'number', '9')} as varchar) || substr(text, instr(text, first) + length(first)) end from w),
e as (select *, row_number() over (partition by id, kind = 'number' order by md5('planted:' || cast(id as varchar) || kind)) as k from m where candidate is not null and candidate <> text),
planted as (select id, kind, candidate from e where kind = 'number' or k <= 2)"""


PLANTED_SQL = f"with s as (select item_id as id, text from benchmark where text is not null), {_planted_sql('s')} select id as item_id, kind, md5(candidate) as digest from planted"


def planted_bench(spark, sf_dir):
    """A bench for judges of meaning from benchmark items: labels follow from ids, silver rows carry planted defects and copies."""
    b = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("id"), F.col("text").alias("original"), F.col("text").alias("candidate"), (F.col("item_id") % 5).alias("r"))
    of = lambda names: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("r") + 1).cast("int"))
    adversarial = b.where("r < 2").withColumn("label", of(("faithful", "number", "", "", "")))
    human, silver = b.where("r > 1").withColumn("label", of(("", "", "same", "minor", "unsure"))), b.withColumn("label", of(("same", "same", "minor", "changed", "same")))
    return synthesis.bench(adversarial, human, silver).select("id", "slice", "label", "kind", F.md5("candidate").alias("digest"))


BENCH_SQL = rf"""with b as (select item_id as id, text, item_id % 5 as r from benchmark where text is not null),
p as (select *, row_number() over (order by md5('bench:' || cast(id as varchar)), id) as k from b where r in (0, 1, 4) and len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 8),
s as (select id, text from p where k <= 260), {_planted_sql('s')}
select 'adv' || id as id, 'adv' as slice, case when r = 0 then 'same' else 'changed' end as label, case when r = 0 then 'faithful' else 'number' end as kind, md5(text) as digest from b where r < 2
union all select 'hum' || id, 'human', case when r = 2 then 'same' else 'minor' end, 'rated', md5(text) from b where r in (2, 3)
union all select 'sil' || id, 'silver', ['same', 'same', 'minor', 'changed', 'same'][r + 1], 'audit', md5(text) from b
union all select 'pl' || id || '_' || kind, 'planted', 'changed', kind, md5(candidate) from planted
union all select 'id' || id, 'identity', 'same', 'identity', md5(text) from p where k > 260 and k <= 360"""


def acceptance_tiers(spark, sf_dir):
    """Tiers and gates over line items, with discount as equivalence and tax as gain."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    eq, gain = F.col("l_discount") * 10, F.col("l_tax") * 10
    return l.groupBy(S.tier(eq, eq >= 0.7, gain >= 0.33).alias("tier"), S.gate(eq, gain).alias("passed")).agg(F.count(F.lit(1)).alias("n"))


TIERS_SQL = """select case when not (l_discount * 10 >= 0.7 and l_tax * 10 >= 0.33) then 'C' when l_discount * 10 >= 0.85 then 'A' else 'B' end as tier, l_discount * 10 >= 0.7 and l_tax * 10 >= 0.33 as passed, count(*) as n from lineitem group by 1, 2"""

_ALL = (near_leakage, exact_leakage, benchmark_containment, provenance, split_assignment, split_balance, winners, capped_sample, stratified_sample, bottom_share, seeded_limit, top_orders, last_records, event_history, resume, batches, union_and_difference, planted_defects, planted_bench, acceptance_tiers)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "near_leakage": NEAR_SQL, "exact_leakage": EXACT_SQL, "benchmark_containment": CONTAINED_SQL, "provenance": PROVENANCE_SQL, "split_assignment": SPLIT_SQL, "split_balance": BALANCE_SQL, "winners": WINNERS_SQL, "capped_sample": CAPPED_SQL,
    "stratified_sample": STRATIFIED_SQL, "bottom_share": BOTTOM_SQL, "seeded_limit": SEEDED_SQL, "top_orders": TOP_SQL, "last_records": LAST_SQL, "event_history": HISTORY_SQL, "resume": RESUME_SQL, "batches": BATCHES_SQL,
    "union_and_difference": UNION_SQL, "planted_defects": PLANTED_SQL, "planted_bench": BENCH_SQL, "acceptance_tiers": TIERS_SQL,
}
