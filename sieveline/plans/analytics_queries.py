"""Queries over aggregates, agreement, calibration, timelines and lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexicon, scorecard, timeline
from ..operators import resampling as RS
from ..operators import statistics as ST
from ..streaming import incremental
from .base import JUDGED_SQL, judged, r6, table


def auc_by_lang(spark, sf_dir):
    """AUC of text length for quality, per language."""
    return ST.auc(judged(spark, sf_dir), "score", "quality", ["lang"]).select("lang", r6(F.col("auc"), "auc"), "positives", "negatives")


AUC_SQL = f"""with j as {JUDGED_SQL}, c as (select lang, score, count(*) filter (quality = 1) as pos, count(*) filter (quality <> 1) as neg from j group by 1, 2),
t as (select *, coalesce(sum(neg) over (partition by lang order by score rows between unbounded preceding and 1 preceding), 0) as below from c)
select lang, round(case when sum(pos) * sum(neg) > 0 then cast(sum(pos * (below + neg / 2.0)) as double) / cast(sum(pos) * sum(neg) as double) end, 6) as auc, cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives from t group by 1"""


def auc_interval(spark, sf_dir):
    """AUC of text length for quality, per language, with its interval over resampled sources."""
    return RS.bootstrap_auc(judged(spark, sf_dir), "source", "score", "quality", ["lang"]).select("lang", *(r6(F.col(c), c) for c in ("value", "low", "high")), "draws")


def kappa_interval(spark, sf_dir):
    """Kappa, recall and precision of toxicity as a prediction of bad quality, per language, with intervals over sources."""
    bad, toxic = F.col("quality") != 1, F.col("toxic") == 1
    counts = {c: F.when(of, 1) for c, of in (("tp", bad & toxic), ("fn", bad & ~toxic), ("fp", ~bad & toxic), ("tn", ~bad & ~toxic))}
    of = {"kappa": RS.kappa_of, "recall": lambda tp, fn, fp, tn: RS.ratio(tp, tp + fn), "precision": lambda tp, fn, fp, tn: RS.ratio(tp, tp + fp)}
    drawn = RS.resampled_sums(judged(spark, sf_dir), ["lang"], "source", counts)
    every = drawn.select("lang", "_draw", F.explode(F.create_map(*(x for name, f in of.items() for x in (F.lit(name), f(*(F.col(c) for c in counts)))))).alias("measure", "_of"))
    return RS.interval(every, ["lang", "measure"], F.col("_of")).select("lang", "measure", *(r6(F.col(c), c) for c in ("value", "low", "high")), "draws")


def roc_points(spark, sf_dir):
    """ROC of text length for toxicity."""
    return ST.roc(judged(spark, sf_dir), "score", "toxic").select("threshold", r6(F.col("fpr"), "fpr"), r6(F.col("tpr"), "tpr"))


ROC_SQL = f"""with j as {JUDGED_SQL}, c as (select score, count(*) filter (toxic = 1) as pos, count(*) filter (toxic <> 1) as neg from j group by 1)
select score as threshold, round(cast(sum(neg) over w as double) / sum(neg) over (), 6) as fpr, round(cast(sum(pos) over w as double) / sum(pos) over (), 6) as tpr from c window w as (order by score desc rows unbounded preceding) union all select null, 0.0, 0.0"""


def sweep(spark, sf_dir):
    """Accuracy, rates and balance over thresholds of text length."""
    s = ST.threshold_sweep(judged(spark, sf_dir), "score", "quality", [50, 200, 1000, 5000])
    return s.select("threshold", *(r6(F.col(c), c) for c in ("accuracy", "tpr", "tnr", "balanced", "accept_rate")))


SWEEP_SQL = f"""with g as (select *, score >= t as yes, quality = 1 as pos from {JUDGED_SQL} j, (select unnest([50.0, 200.0, 1000.0, 5000.0])::double as t))
select t as threshold, round(avg(case when yes = pos then 1.0 else 0.0 end), 6) as accuracy, round(avg(case when yes then 1.0 else 0.0 end) filter (pos), 6) as tpr, round(avg(case when yes then 0.0 else 1.0 end) filter (not pos), 6) as tnr,
round((avg(case when yes then 1.0 else 0.0 end) filter (pos) + avg(case when yes then 0.0 else 1.0 end) filter (not pos)) / 2, 6) as balanced, round(avg(case when yes then 1.0 else 0.0 end), 6) as accept_rate from g group by 1"""


def label_confusion(spark, sf_dir):
    """Confusion counts of both labels."""
    return ST.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


CONFUSION_SQL = "select quality as label, toxic as predicted, count(*) as n from labels where quality is not null and toxic is not null group by 1, 2"


def label_kappa(spark, sf_dir):
    """Cohen's kappa of both labels."""
    return ST.cohen_kappa(table(spark, sf_dir, "labels"), "quality", "toxic").select(r6(F.col("kappa"), "kappa"), r6(F.col("agreement"), "agreement"))


KAPPA_SQL = """with c as (select quality as a, toxic as b, count(*) as n from labels group by 1, 2), t as (select cast(sum(n) as double) as total, cast(sum(case when a = b then n else 0 end) as double) as same from c),
e as (select sum(l.n * r.n) as chance from (select a, cast(sum(n) as double) as n from c group by 1) l join (select b as a, cast(sum(n) as double) as n from c group by 1) r using (a))
select round((same / total - chance / (total * total)) / (1 - chance / (total * total)), 6) as kappa, round(same / total, 6) as agreement from t, e"""


def binary_agreement(spark, sf_dir):
    """Kappa, recall and clean pass of toxicity as a prediction of bad quality."""
    return ST.binary_agreement(table(spark, sf_dir, "labels").withColumn("bad", 1 - F.col("quality")), "bad", "toxic")


BINARY_SQL = """with c as (select count(*) filter (quality <> 1 and toxic = 1)::double as tp, count(*) filter (quality <> 1 and toxic <> 1)::double as fn, count(*) filter (quality = 1 and toxic = 1)::double as fp, count(*) filter (quality = 1 and toxic <> 1)::double as tn from labels),
m as (select *, (tp + tn) / (tp + fn + fp + tn) as po, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / pow(tp + fn + fp + tn, 2) as pe from c)
select round_even((po - pe) / greatest(1 - pe, 1e-9), 3) as kappa, round_even(tp / greatest(1, tp + fn), 3) as recall, round_even(tn / greatest(1, tn + fp), 3) as clean_pass from m"""


def _alpha(metric):
    def query(spark, sf_dir):
        l = table(spark, sf_dir, "lineitem")  # noqa: E741
        ratings = l.select(F.col("l_orderkey").alias("unit"), F.ceil(F.col("l_quantity") / 10).cast("int").alias("value"))
        return ST.krippendorff_alpha(ratings, "unit", "value", metric).select(r6(F.col("alpha"), "alpha"))

    query.__name__, query.__doc__ = f"alpha_{metric}", f"Krippendorff's alpha ({metric}) of line items' quantity classes within orders."
    return query


def _alpha_sql(distance: str) -> str:
    return f"""with r as (select l_orderkey as unit, cast(ceil(l_quantity / 10) as int) as v from lineitem), c as (select unit, v, count(*)::double as n from r group by 1, 2), m as (select unit, sum(n) as m from c group by 1 having sum(n) > 1),
o as (select x.v as a, y.v as b, sum(case when x.v = y.v then x.n * (x.n - 1) else x.n * y.n end / (m - 1)) as o from c x join c y using (unit) join m using (unit) group by 1, 2),
g as (select a as v, sum(o) as n from o group by 1), u as (select v, n, sum(n) over (order by v) as upto from g),
z as (select {distance} as d, coalesce(o.o, 0) as o, x.n as na, y.n as nb from u x cross join u y left join o on o.a = x.v and o.b = y.v)
select round(1 - (sum(o) - 1) * sum(o * d) / sum(na * nb * d), 6) as alpha from z"""


def rater_agreement(spark, sf_dir):
    """Exact agreement over pairs of lines of an order."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.ceil(F.col("l_quantity") / 10).cast("int").alias("value"))  # noqa: E741
    lines = l.groupBy("l_orderkey", "l_linenumber").agg(F.min("value").alias("value"))
    return ST.rater_pairs(lines, "l_orderkey", "l_linenumber", "value").select(r6(F.col("agreement"), "agreement"), "pairs")


RATER_SQL = """with l as (select l_orderkey, l_linenumber, min(cast(ceil(l_quantity / 10) as int)) as v from lineitem group by 1, 2)
select round(avg(case when a.v = b.v then 1.0 else 0.0 end), 6) as agreement, count(*) as pairs from l a join l b using (l_orderkey) where a.l_linenumber < b.l_linenumber"""


def majority_status(spark, sf_dir):
    """Most frequent order status of each customer, or tie."""
    return ST.majority(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


MAJORITY_SQL = """with c as (select o_custkey, o_orderstatus as v, count(*) as n from orders group by 1, 2), m as (select o_custkey, max(n) as most from c group by 1)
select o_custkey, case when count(*) > 1 then 'tie' else min(v) end as majority from c join m using (o_custkey) where n = most group by 1"""


def calibration(spark, sf_dir):
    """Calibration of discount (times nine) as a probability of a return."""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 9).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("hit"))  # noqa: E741
    return ST.calibration(l, "p", "hit").select("bin", r6(F.col("mean_p"), "mean_p"), r6(F.col("positive"), "positive"), "n")


CALIBRATION_SQL = """select cast(least(floor(l_discount * 9 * 10), 9) as bigint) as bin, round(avg(l_discount * 9), 6) as mean_p, round(avg(case when l_returnflag = 'R' then 1.0 else 0.0 end), 6) as positive, count(*) as n from lineitem group by 1"""


def price_histogram(spark, sf_dir):
    """Quartile edges of order prices and the share of each status in each quarter."""
    found = ST.quantile_histogram(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderstatus"], [0.25, 0.5, 0.75])
    return found.select("o_orderstatus", F.col("bin").alias("quarter"), "n", r6(F.col("share"), "share"))


HISTOGRAM_SQL = """with e as (select quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.5) as b, quantile_cont(o_totalprice, 0.75) as c from orders),
q as (select o_orderstatus, cast(o_totalprice > a as int) + cast(o_totalprice > b as int) + cast(o_totalprice > c as int) as quarter, count(*) as n from orders, e group by 1, 2)
select o_orderstatus, quarter, n, round(n / cast(sum(n) over (partition by o_orderstatus) as double), 6) as share from q"""


def grouping_sets(spark, sf_dir):
    """Documents and mean length of each source, overall and by language."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("system"), F.col("lang").alias("status"), "n_chars")
    return scorecard.by_status(d, [F.count(F.lit(1)).alias("n"), r6(F.avg("n_chars"), "mean_chars")])


GROUPING_SQL = "select source as system, lang as status, count(*) as n, round(avg(n_chars), 6) as mean_chars from documents group by grouping sets ((source), (source, lang))"


def funnel(spark, sf_dir):
    """Counts of documents that remain after each condition."""
    j = judged(spark, sf_dir)
    long, good, clean = F.col("score") >= 200, F.col("quality") == 1, F.col("toxic") == 0
    wide = j.agg(F.count(F.lit(1)).alias("all"), F.count_if(long).alias("long"), F.count_if(long & good).alias("good"), F.count_if(long & good & clean).alias("clean"))
    return wide.unpivot([], ["all", "long", "good", "clean"], "step", "n")


FUNNEL_SQL = f"""with j as {JUDGED_SQL} select step, n from (select 'all' as step, count(*) as n from j union all select 'long', count(*) from j where score >= 200 union all select 'good', count(*) from j where score >= 200 and quality = 1
union all select 'clean', count(*) from j where score >= 200 and quality = 1 and toxic = 0)"""


def duplicate_groups(spark, sf_dir):
    """Groups of equal texts, their redundant rows, and texts in several sources."""
    g = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("s")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"), F.count_if(F.col("s") > 1).alias("crossing"))


DUPLICATE_SQL = "with g as (select md5(text), count(*) as n, count(distinct source) as s from documents group by 1 having count(*) > 1) select count(*) as groups, cast(coalesce(sum(n - 1), 0) as bigint) as redundant, count(*) filter (s > 1) as crossing from g"


def class_weights(spark, sf_dir):
    """Weights that balance the languages."""
    return ST.class_weights(table(spark, sf_dir, "documents"), "lang", 4).select("lang", r6(F.col("weight"), "weight"))


WEIGHTS_SQL = "with c as (select lang, count(*) as n from documents group by 1) select lang, round((select sum(n) from c)::double / (4 * n), 6) as weight from c"


def event_as_of(spark, sf_dir):
    """The last view's value before each purchase of a user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    kinds = e.select(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    tagged = e.crossJoin(F.broadcast(kinds))  # one row
    right = tagged.where("event_type = lo").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    return timeline.as_of(tagged.where("event_type = hi").select("user_id", "ts", "event_id"), right, "user_id", "ts", "start", ["seen_id", "seen_value"]).select("event_id", "seen_id", "seen_value")


AS_OF_SQL = """with k as (select min(event_type) as lo, max(event_type) as hi from events), r as (select user_id, ts, max_by(event_id, (event_id, value)) as seen_id, max_by(value, (event_id, value)) as seen_value from events, k where event_type = lo group by 1, 2),
l as (select user_id, ts, event_id from events, k where event_type = hi)
select l.event_id, r.seen_id, r.seen_value from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts"""


def weight_bands(spark, sf_dir):
    """The line of each order at which half of its price is reached."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("w"))  # noqa: E741
    look = l.select("l_orderkey").distinct().withColumn("fraction", F.lit(0.5))
    return timeline.band(l, "l_orderkey", "l_linenumber", "w", look, "fraction").select("l_orderkey", "item")


BANDS_SQL = """with l as (select l_orderkey, l_linenumber, sum(l_quantity) as w from lineitem group by 1, 2), r as (select *, sum(w) over (partition by l_orderkey order by l_linenumber) as upto, sum(w) over (partition by l_orderkey) as total from l)
select l_orderkey, min(l_linenumber) as item from r where upto >= 0.5 * total group by 1"""


def failure_stop(spark, sf_dir):
    """Events of each user until three in a row have a value below ten."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") < 10).alias("failed"))
    return timeline.stop_after_failures(e, "user_id", "event_id", "failed", 3).groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


FAILURE_SQL = """with e as (select user_id, event_id, value < 10 as failed from events), s as (select *, failed and lag(failed, 1, false) over w and lag(failed, 2, false) over w as hit from e window w as (partition by user_id order by event_id)),
h as (select *, coalesce(sum(hit::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as hits from s) select user_id, count(*) as kept from h where hits = 0 group by 1"""


SESSION_GAP, SESSION_LATE = 4 * 3600, 600


def event_sessions(spark, sf_dir):
    """Each user's ended runs of events without a pause of more than four hours, by a stream over the whole table."""
    schema = table(spark, sf_dir, "events").select("user_id", "ts").schema
    found = incremental.table_sessions(spark, f"{sf_dir}/events.parque[t]", schema, "user_id", "ts", SESSION_GAP, SESSION_LATE)
    return found.select("user_id", *(F.unix_millis(c).alias(f"{c}_ms") for c in ("start", "stop")), "n")


#: Runs by gaps and islands; the last run of a user has ended if the stream's watermark has passed it.
SESSIONS_SQL = f"""with e as (select user_id, ts, epoch_us(ts) // 1000 as ms from events where user_id is not null and ts is not null), g as (select *, case when ms - lag(ms) over w <= {SESSION_GAP} * 1000 then 0 else 1 end as starts from e window w as (partition by user_id order by ts)),
s as (select *, sum(starts) over (partition by user_id order by ts rows unbounded preceding) as run from g), r as (select user_id, run, min(ms) as a, max(ms) as b, count(*) as n from s group by 1, 2)
select user_id, a as start_ms, b as stop_ms, n from r where b + {SESSION_GAP} * 1000 + 1 <= (select max(ms) from e) - {SESSION_LATE} * 1000 or run < (select max(run) from r x where x.user_id = r.user_id)"""


def latency(spark, sf_dir):
    """Median, 95th percentile and throughput of event values as seconds."""
    return timeline.latency(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", r6(F.col("median"), "median"), r6(F.col("p95"), "p95"), r6(F.col("per_second"), "per_second"))


LATENCY_SQL = "select event_type, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95, round(count(*) / sum(value), 6) as per_second from events group by 1"


def frequent_words(spark, sf_dir):
    """The five hundred most frequent words of the answers; ties to the alphabet."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    words = c.select(F.explode(F.filter(F.split(F.lower("text"), r"(?U)[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)).alias("word"))
    return lexicon.frequent(words.withColumn("place", F.col("word")), "word", "place", 500).select("word", "n")


FREQUENT_SQL = r"select word, count(*) as n from (select unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 0)) as word from conversations where role = 'assistant') group by 1 order by 2 desc, 1 limit 500"


def quadratic_fit(spark, sf_dir):
    """Least-squares quadratic of line prices over quantities."""
    a, b, c = lexicon.quadratic_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return spark.createDataFrame([(round(a, 4), round(b, 4), round(c, 2))], "a double, b double, c double")


#: The normal equations by Cramer's rule, about the mean quantity, which keeps the sums small; then moved back.
FIT_SQL = """with m as (select avg(l_quantity) as c from lineitem), p as (select l_quantity - c as x, l_extendedprice as y, c from lineitem, m),
s as (select any_value(c) as c, count(*)::double as n, sum(x) as a, sum(x * x) as b, sum(x * x * x) as d, sum(x * x * x * x) as e, sum(y) as t, sum(x * y) as u, sum(x * x * y) as v from p),
q as (select *, e * (b * n - a * a) - d * (d * n - a * b) + b * (d * a - b * b) as det from s),
k as (select c, (v * (b * n - a * a) - d * (u * n - a * t) + b * (u * a - b * t)) / det as a2, (e * (u * n - a * t) - v * (d * n - a * b) + b * (d * t - b * u)) / det as a1, (e * (b * t - a * u) - d * (d * t - b * u) + v * (d * a - b * b)) / det as a0 from q)
select round(a2, 4) as a, round(a1 - 2 * a2 * c, 4) as b, round(a0 - a1 * c + a2 * c * c, 2) as c from k"""


def best_marks(spark, sf_dir):
    """Which status has the highest number of orders, and which the lowest mean price, in each priority."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.avg("o_totalprice").alias("price"))
    long = o.unpivot(["o_orderpriority", "o_orderstatus"], ["orders", "price"], "of", "value").withColumn("measure", F.concat_ws(" ", "of", "o_orderpriority")).withColumn("up", F.col("of") == "orders")
    return scorecard.best_marks(long, "measure", "value", "up").select("measure", "o_orderstatus", r6(F.col("value"), "value"), "best")


BEST_SQL = """with o as (select o_orderpriority as p, o_orderstatus, count(*)::double as n, avg(o_totalprice) as v from orders group by 1, 2)
select 'orders ' || p as measure, o_orderstatus, n as value, n = max(n) over (partition by p) as best from o union all select 'price ' || p, o_orderstatus, round(v, 6), v = min(v) over (partition by p) from o"""


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def event_type_pivot(spark, sf_dir):
    """Events of each user by type, with an explicit list of types, and all types' numbers and range of values."""
    e = table(spark, sf_dir, "events")
    by_type = e.groupBy("user_id").pivot("event_type", list(EVENT_TYPES)).agg(F.count(F.lit(1))).na.fill(0, list(EVENT_TYPES))
    whole = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("types"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    return whole.join(by_type, "user_id")


PIVOT_SQL = f"select user_id, count(*) as n, count(distinct event_type) as types, max(value) as hi, min(value) as lo, {', '.join(f"count(*) filter (event_type = '{x}') as {x}" for x in EVENT_TYPES)} from events group by 1"

alpha_nominal, alpha_ordinal, alpha_interval = _alpha("nominal"), _alpha("ordinal"), _alpha("interval")
_ALL = (auc_by_lang, auc_interval, kappa_interval, roc_points, sweep, label_confusion, label_kappa, binary_agreement, alpha_nominal, alpha_ordinal, alpha_interval, rater_agreement, majority_status, calibration, price_histogram, grouping_sets, funnel, duplicate_groups, class_weights, event_as_of, weight_bands, failure_stop, event_sessions, latency, frequent_words, quadratic_fit, best_marks, event_type_pivot)
QUERIES = {f.__name__: f for f in _ALL}
_BETWEEN = "pow(case when x.v = y.v then 0 else greatest(x.upto, y.upto) - least(x.upto - x.n, y.upto - y.n) - (x.n + y.n) / 2 end, 2)"
ORACLE_SQL = {
    "auc_by_lang": AUC_SQL, "roc_points": ROC_SQL, "sweep": SWEEP_SQL, "label_confusion": CONFUSION_SQL, "label_kappa": KAPPA_SQL, "binary_agreement": BINARY_SQL,
    "alpha_nominal": _alpha_sql("cast(x.v <> y.v as int)"), "alpha_ordinal": _alpha_sql(_BETWEEN), "alpha_interval": _alpha_sql("pow(x.v - y.v, 2)"), "rater_agreement": RATER_SQL, "majority_status": MAJORITY_SQL,
    "calibration": CALIBRATION_SQL, "price_histogram": HISTOGRAM_SQL, "grouping_sets": GROUPING_SQL, "funnel": FUNNEL_SQL, "duplicate_groups": DUPLICATE_SQL, "class_weights": WEIGHTS_SQL, "event_as_of": AS_OF_SQL, "weight_bands": BANDS_SQL,
    "failure_stop": FAILURE_SQL, "event_sessions": SESSIONS_SQL, "latency": LATENCY_SQL, "frequent_words": FREQUENT_SQL, "quadratic_fit": FIT_SQL, "best_marks": BEST_SQL, "event_type_pivot": PIVOT_SQL,
}
