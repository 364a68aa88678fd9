"""Span and statement queries. The window of the spans is 1995, its baseline 1994."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import series
from sondage.operators import traces as op
from sondage.plans.base import Plans, rounded
from sondage.sources import durable
from sondage.sources import telemetry as t

PLANS = Plans()
BASE, MIDDLE, END = "1994-01-01", "1995-01-01", "1996-01-01"
KEYS = ["service", "kind", "route"]
AGG = """count(*) as n, count(distinct (trace_id, span_id)) as unique_n, count(*) filter (parent_span_id is null) as roots,
  quantile_cont(duration_ms, 0.5) as p50, quantile_cont(duration_ms, 0.95) as p95, max(duration_ms) as max_ms, sum(duration_ms) as total_ms,
  count(*) filter (status = 'ERROR') as failed, count(code) as coded, count(*) filter (code >= 400 and code < 500) as rejected, arg_max(trace_id, {'d': duration_ms, 't': trace_id}) as slowest_trace"""
WINDOWS = f"""with {t.SPANS}, c as (select service, kind, route, {AGG} from spans where ts >= timestamp '{MIDDLE}' and ts < timestamp '{END}' group by 1, 2, 3),
b as (select service, kind, route, {AGG} from spans where ts >= timestamp '{BASE}' and ts < timestamp '{MIDDLE}' group by 1, 2, 3)"""
SHOWN = "service, kind, route, n, unique_n, roots, round(p50, 6) as p50, round(p95, 6) as p95, round(max_ms, 6) as max_ms, round(total_ms, 4) as total_ms, failed, slowest_trace"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The current window and the one before it, out of one pass over the spans."""
    s = series.within(t.spans(spark, sf_dir), BASE, END).withColumn("is_current", F.col("ts") >= F.lit(MIDDLE).cast("timestamp_ntz"))
    both = durable(op.breakdown(s, [*KEYS, "is_current"]), "endpoints")
    return both.filter("is_current").drop("is_current"), both.filter("not is_current").drop("is_current")


@PLANS.add(f"{WINDOWS} select {SHOWN} from c")
def endpoint_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.breakdown(series.within(t.spans(spark, sf_dir), MIDDLE, END), KEYS)
    return rounded(rows.drop("coded", "rejected").withColumn("total_ms", F.round("total_ms", 4)))


ARMS = """j as (select c.*, coalesce(b.unique_n, 0) >= 30 as known, b.p50 as b_p50, b.p95 as b_p95, c.failed / c.unique_n as rate, b.failed / b.unique_n as b_rate,
  case when c.coded > 0 then c.rejected / c.coded else 0 end as refused, case when b.coded > 0 then b.rejected / b.coded else 0 end as b_refused
  from c left join b on c.service = b.service and c.kind = b.kind and c.route = b.route),
v as (select *, list_filter([
  case when known and kind in ('SERVER', 'CONSUMER') and b_p50 > 0 and p50 >= 3 * b_p50 then 'latency_ratio' end,
  case when known and b_p95 > 0 and p95 >= 3 * b_p95 and p95 >= 300 then 'latency_shift' end,
  case when p95 >= 3000 then 'latency_magnitude' end,
  case when kind in ('SERVER', 'CLIENT') and failed >= 5 and rate >= 0.05 then 'failure_magnitude' end,
  case when known and failed >= 5 and rate >= 2 * b_rate and rate - b_rate >= 0.1 then 'failure_shift' end,
  case when known and kind in ('SERVER', 'CLIENT') and rejected >= 20 and refused - b_refused >= 0.1 and (refused >= 2 * b_refused or 1 - refused <= (1 - b_refused) / 2) then 'rejection_shift' end
  ], lambda x: x is not null) as fired from j),
a as (select service, kind, route, n, case when unique_n >= 30 then fired else [] end as arms, case when known then 'ok' else 'insufficient_samples' end as base_state,
  case when unique_n < 30 then 'insufficient_sample' when len(fired) > 0 then 'anomalous' else 'normal' end as verdict from v)"""


@PLANS.add(f"{WINDOWS}, {ARMS} select service, kind, route, n, array_to_string(arms, ',') as arms, base_state, verdict from a")
def endpoint_verdict_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.verdict_arms(*_two(spark, sf_dir), KEYS)
    return rows.select(*KEYS, "n", F.array_join("arms", ",").alias("arms"), "base_state", "verdict")


@PLANS.add(f"""{WINDOWS}, {ARMS}, r as (select *, row_number() over (partition by kind order by case verdict when 'anomalous' then 0 when 'normal' then 1 else 2 end, n desc, route, service) as rank from a)
select service, kind, route, n, verdict, rank from r where rank <= 5 or len(arms) > 0""")
def endpoint_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.verdict_arms(*_two(spark, sf_dir), KEYS)
    order = op.W.partitionBy("kind").orderBy(F.when(F.col("verdict") == "anomalous", 0).when(F.col("verdict") == "normal", 1).otherwise(2), F.desc("n"), "route", "service")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter((F.col("rank") <= 5) | (F.size("arms") > 0))
    return rows.select(*KEYS, "n", "verdict", "rank")


@PLANS.add(f"""with {t.SPANS}, k as (select trace_id, parent_span_id as span_id, sum(duration_ms) as child_ms from spans where parent_span_id is not null group by 1, 2),
j as (select service, duration_ms, coalesce(child_ms, 0) as child_ms from spans s left join k on s.trace_id = k.trace_id and s.span_id = k.span_id)
select service, round(sum(duration_ms - least(child_ms, duration_ms)), 4) as self_ms, round(sum(least(child_ms, duration_ms)) / sum(duration_ms), 6) as child_share from j group by 1""")
def endpoint_self_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.self_time(t.spans(spark, sf_dir))
    return rows.select("service", F.round("self_ms", 4).alias("self_ms"), F.round("child_share", 6).alias("child_share"))


@PLANS.add(f"""with {t.SPANS} select p.service as caller, c.service as callee, count(*) as calls, count(*) filter (p.status = 'ERROR') as caller_errors,
  count(*) filter (c.status = 'ERROR') as callee_errors, round(quantile_cont(c.duration_ms, 0.5), 6) as p50,
  count(*) filter (p.status = 'ERROR') > 0 and count(*) filter (c.status = 'ERROR') = 0 as observation_mismatch
  from spans c join spans p on c.trace_id = p.trace_id and c.parent_span_id = p.span_id where p.service <> c.service group by 1, 2""")
def topology_paired_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.paired_edges(t.spans(spark, sf_dir)))


@PLANS.add(f"""with {t.SPANS} select service, count(*) as spans, count(*) filter (status = 'ERROR') as errors, round(max(duration_ms), 4) as max_ms from spans s
  where kind = 'CLIENT' and not exists (select 1 from spans c where c.trace_id = s.trace_id and c.parent_span_id = s.span_id) group by 1""")
def topology_orphan_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.orphans(t.spans(spark, sf_dir)), 4)


@PLANS.add(f"""with {t.SPANS}, x as (select service, ts >= timestamp '1995-01-01' as cur, trace_id, span_id,
    floor((epoch(ts) - epoch(case when ts >= timestamp '1995-01-01' then timestamp '1995-01-01' else timestamp '1994-01-01' end)) / 3153600)::bigint as bucket
  from spans where ts >= timestamp '1994-01-01' and ts < timestamp '1996-01-01'),
n as (select service, cur, bucket, count(distinct (trace_id, span_id)) as n from x group by all),
g as (select service, cur, bucket from (select distinct service from x), (values (true), (false)) c(cur), range(10) r(bucket)),
f as (select g.service, g.cur, g.bucket, coalesce(n.n, 0) as n from g left join n on g.service = n.service and g.cur = n.cur and g.bucket = n.bucket)
select service, sum(n) filter (cur)::bigint as current, sum(n) filter (not cur)::bigint as baseline, string_agg(n::varchar, ',' order by bucket) filter (cur) as counts,
  case when sum(n) filter (not cur) = 0 then 'not_seen_in_baseline' when sum(n) filter (cur) = 0 then 'not_seen_in_current' else 'both' end as state from f group by 1""")
def trace_activity_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.activity(t.spans(spark, sf_dir), BASE, MIDDLE, END, 3153600, 10)


@PLANS.add(f"with {t.SPANS} select ts, trace_id, span_id, service, cast(round(duration_ms * 1000) as bigint)::varchar as duration_us from spans order by ts, trace_id, span_id limit 51")
def trace_span_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.spans(spark, sf_dir).orderBy("ts", "trace_id", "span_id").limit(51)  # one page and one row more
    return rows.select("ts", "trace_id", "span_id", "service", F.round(F.col("duration_ms") * 1000).cast("long").cast("string").alias("duration_us"))


@PLANS.add(f"""with {t.SPANS}, s as (select trace_id, min(ts) as window_start, max(ts) as window_end, count(*) as n from spans group by 1)
select * from s where window_start < timestamp '1995-02-01' and window_end > timestamp '1995-01-15'""")
def trace_summary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t.spans(spark, sf_dir).groupBy("trace_id").agg(F.min("ts").alias("window_start"), F.max("ts").alias("window_end"), F.count(F.lit(1)).alias("n"))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return s.filter((F.col("window_start") < at("1995-02-01")) & (F.col("window_end") > at("1995-01-15")))


FOLD = f"""with {t.STATEMENTS}, p as (select sql_key, mode, ts, case when sum(execs) > 0 then sum(latency_ms * execs) / sum(execs) else avg(latency_ms) end as latency_ms, sum(execs) as execs from statements group by all),
w as (select sql_key, mode, ts >= timestamp '{MIDDLE}' as cur, list_sort(list(latency_ms))[floor(count(*) / 2)::int + 1] as p50, max(latency_ms) as max_ms, arg_max(latency_ms, ts) as last_ms,
  sum(execs) as execs, count(*) as polls from p where ts >= timestamp '{BASE}' and ts < timestamp '{END}' group by 1, 2, 3)"""


def _statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = op.statement_polls(t.statements(spark, sf_dir))
    return op.statement_windows(series.within(p, MIDDLE, END)), op.statement_windows(series.within(p, BASE, MIDDLE))


@PLANS.add(f"{FOLD} select sql_key, mode, round(p50, 4) as p50, round(max_ms, 4) as max_ms, round(last_ms, 4) as last_ms, round(execs, 2) as execs, polls from w where cur")
def slow_query_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_statements(spark, sf_dir)[0], 4)


@PLANS.add(f"""{FOLD}, r as (select c.sql_key, case c.mode when 'F' then 'legacy' else c.mode end as mode, c.polls, b.polls as b_polls, case when b.p50 > 0 then c.p50 / b.p50 end as r50, case when b.max_ms > 0 then c.max_ms / b.max_ms end as rmax,
    coalesce(b.polls, 0) / 365 as presence from (select * from w where cur) c left join (select * from w where not cur) b on c.sql_key = b.sql_key and c.mode = b.mode),
v as (select *, case when mode = 'legacy' then 'not_assessable_legacy' when polls < 3 or coalesce(b_polls, 0) < 3 then 'insufficient_baseline' when r50 >= 3 or rmax >= 3 then 'slower'
    when r50 <= 1 / 3.0::double then 'faster' when presence >= 0.9 and r50 is not null then 'chronic' else 'stable' end as verdict from r)
select sql_key, mode, polls, b_polls, round(r50, 4) as ratio_p50, round(rmax, 4) as ratio_max, verdict,
  case when verdict = 'slower' then case when r50 >= 3 and rmax >= 3 then 'both' when r50 >= 3 then 'median' else 'max' end end as basis from v""")
def slow_query_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    legacy = F.when(F.col("mode") == "F", "legacy").otherwise(F.col("mode"))
    current, base = (df.withColumn("mode", legacy) for df in _statements(spark, sf_dir))
    return rounded(op.statement_verdict(current, base, 365).select("sql_key", "mode", "polls", "b_polls", "ratio_p50", "ratio_max", "verdict", "basis"), 4)


@PLANS.add("""with x as (select 'q' || (l_partkey % 300)::varchar as sql_key, l_suppkey % 7 as plan from lineitem)
select sql_key, count(*) as captures, count(distinct plan) as plans, case when count(*) < 5 then 'unknown' when count(distinct plan) / count(*) >= 0.9 then 'unstable'
  when count(distinct plan) / count(*) <= 0.2 then 'stable' else 'mixed' end as stability from x group by 1""")
def plan_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = t.read_table(spark, sf_dir, "lineitem")
    return op.plan_stability(line.select(F.concat(F.lit("q"), t.text(F.col("l_partkey") % 300)).alias("sql_key"), (F.col("l_suppkey") % 7).alias("plan")))


@PLANS.add("""with x as (select page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) as scheme, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from pages)
select page_id, case when scheme = '' then 'unknown' else scheme end as scheme, regexp_extract(rest, '^([^/?#]*)', 1) as authority, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from x""")
def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = op.split_url(F.col("url"))
    return t.read_table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in parts.items()])
