"""Log, event and change queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import episodes as ev
from sondage.operators import logs as op
from sondage.plans.base import Plans
from sondage.sources import telemetry as t

PLANS = Plans()
TEMPLATES = f"""with {t.LOGS}, x as (select *, stream % 2 = 0 as cur,
  regexp_replace(regexp_replace(body, '[0-9a-fA-F]{{8,}}', '#', 'g'), '[0-9]+', 'N', 'g') as template from logs),
c as (select template, count(*) filter (cur) as n, count(*) filter (not cur) as base_n, min(seq) filter (cur) as first_seq from x group by 1),
k as (select *, case when base_n = 0 then 'new' when n >= 10 and n / 10.0 >= 5 * base_n / 60.0 then 'surged' when n = 0 and base_n / 60.0 * 10.0 >= 5 then 'disappeared'
  when n = 0 then 'skipped_rare' else 'frequent' end as class from c)"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.logs(spark, sf_dir)
    return op.compare_templates(rows.filter("stream % 2 = 0"), rows.filter("stream % 2 <> 0"), 10.0, 60.0)


@PLANS.add(f"{TEMPLATES} select template, n, base_n, first_seq, class from k")
def log_template_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)


@PLANS.add(f"""{TEMPLATES}, r as (select *, row_number() over (partition by class order by greatest(n, base_n) desc, template) as rank, count(*) over (partition by class) as total from k)
select template, n, base_n, first_seq, class, rank, total from r where rank <= case class when 'new' then 8 when 'skipped_rare' then 0 else 5 end""")
def log_template_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.within_quota(_compared(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@PLANS.add(f"with {t.LOGS} select severity, count(*) as n from logs group by 1")
def log_level_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.levels(t.logs(spark, sf_dir))


@PLANS.add(f"with {t.LOGS} select * from logs where contains(lower(body), 'th') and severity >= 13")
def log_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.grep(t.logs(spark, sf_dir), "TH", 13)


@PLANS.add(f"""with {t.LOGS}, n as (select *, row_number() over (partition by stream order by seq, body) as rn from logs),
h as (select stream, rn as at from n where contains(lower(body), 'and') and severity >= 17)
select n.stream, h.at::int as at, n.rn - h.at as "offset", n.seq, n.body from h join n on h.stream = n.stream and abs(n.rn - h.at) <= 2""")
def log_grep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.logs(spark, sf_dir)
    return op.context(rows, op.grep(rows, "and", 17), 2)


@PLANS.add(f"""with {t.TRANSITIONS}, x as (select * from transitions where transition <> 'other' and "at" >= timestamp '2024-01-08' and "at" < timestamp '2024-01-22')
select episode_id, count(*) filter (transition = 'open') as n_open, count(*) filter (transition = 'close') as n_close,
  min("at") filter (transition = 'open') as open_at, max("at") filter (transition = 'close') as close_at,
  arg_max(severity, {{'a': "at", 'e': event_id}}) filter (transition = 'close') as peak, arg_max(severity, {{'a': "at", 'e': event_id}}) filter (transition = 'open') as open_severity,
  arg_max(detector, {{'a': "at", 'e': event_id}}) as detector,
  case when count(*) filter (transition = 'open') = 0 then 'opened_before_window' when count(*) filter (transition = 'close') = 0 then 'closed_after_window' else 'complete' end as boundary
from x group by 1""")
def episode_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.fold_episodes(t.transitions(spark, sf_dir), "2024-01-08", "2024-01-22")


@PLANS.add(f"""with {t.TRANSITIONS} select * from transitions where transition = 'other' order by "at" desc, event_id desc limit 15""")
def events_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.unpaired(t.transitions(spark, sf_dir), 15)


@PLANS.add(f"""with {t.TRANSITIONS} select episode_id, transition, detector, max(severity) as max_count, min("at") as first_at, max("at") as last_at from transitions group by 1, 2, 3""")
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.deduplicate(t.transitions(spark, sf_dir), ["episode_id", "transition", "detector"])


INTERVAL = f"""with {t.POLLS}, g as (select engine, (epoch(ts) - epoch(lag(ts) over (partition by engine order by ts)))::bigint as gap from polls),
c as (select engine, gap, count(*) as n from g where gap > 0 group by all), interval_of as (select engine, arg_max(gap, {{'n': n, 'g': -gap}}) as step from c group by 1)"""


@PLANS.add(f"{INTERVAL} select engine, step as interval from interval_of")
def poll_interval_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.poll_interval(t.polls(spark, sf_dir))


@PLANS.add(f"""{INTERVAL}, m as (select *, sum((blocked = 0)::int) over (partition by engine order by ts) as brk from polls),
o as (select m.*, step, (epoch(ts) - epoch(lag(ts) over (partition by m.engine, brk order by ts)))::bigint as gap from m join interval_of i on m.engine = i.engine where blocked > 0)
select engine, min(ts) as start, max(ts) as "end", count(*) as polls, max(blocked) as blocked_peak, arg_max(ts, {{'b': blocked, 't': ts}}) as representative,
  arg_max(blocked, ts) as blocked_last, sum(greatest(coalesce(floor(gap / step) - 1, 0), 0))::bigint as gap_polls, max(blocked) >= 3 as anomalous from o group by engine, brk""")
def blocking_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.blocking_events(t.polls(spark, sf_dir))


@PLANS.add(f"""with {t.CHANGES}, v as (select category, target_id, date_trunc('second', "at") as second, detail, action, count(*) as n from changes group by all)
select category, target_id, second::timestamp as second, sum(n)::bigint as n, count(*) as variants from v group by 1, 2, 3""")
def changes_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.fold_changes(t.changes(spark, sf_dir))
    return rows.withColumn("second", F.col("second").cast("timestamp_ntz"))


PAIRS = f"""with recursive {t.CHANGES}, r as (select * from changes where action = 'O'),
l as (select id, category, row_number() over (partition by category order by "at", id) as i,
  (select coalesce(list(r.id), []) from r where r.category = c.category and abs(epoch(c."at") - epoch(r."at")) <= 90000) as wants from changes c where action = 'F'),
walk as (select category, 0::bigint as i, []::bigint[] as used, null::bigint as id, []::bigint[] as open from (select distinct category from l)
  union all select l.category, l.i, case when len(list_filter(wants, lambda x: not list_contains(used, x))) = 1 then list_concat(used, list_filter(wants, lambda x: not list_contains(used, x))) else used end,
    l.id, list_filter(wants, lambda x: not list_contains(used, x)) from walk w join l on l.category = w.category and l.i = w.i + 1)
select id, case len(open) when 0 then 'unmatched' when 1 then 'unique_inferred' else 'ambiguous' end as pairing, case when len(open) = 1 then open[1] end as partner from walk where i > 0"""


@PLANS.add(PAIRS)
def changes_pair_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole days apart by one at most, so that neighbouring days compete."""
    rows = t.changes(spark, sf_dir).select("id", "at", F.col("category").alias("key"), "action")
    return ev.pair_consumed(rows.filter("action = 'F'"), rows.filter("action = 'O'"), 90_000)


@PLANS.add(f"""with {t.CHANGES}, {t.TRANSITIONS} select 'audit' as source, id as ref, "at" from changes
union all select 'transition', event_id, "at" from transitions""")
def changes_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.changes(spark, sf_dir).select(F.lit("audit").alias("source"), F.col("id").alias("ref"), "at")
    b = t.transitions(spark, sf_dir).select(F.lit("transition").alias("source"), F.col("event_id").alias("ref"), "at")
    return a.unionByName(b)
