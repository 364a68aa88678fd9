"""Findings of several tools, derived from the events, to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import mapping as op
from sondage.plans.base import Plans, rounded
from sondage.sources import telemetry as t

PLANS = Plans()


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a finding of the tool that its type stands for, with that tool's keys."""
    e = t.read_table(spark, sf_dir, "events")
    i, u, v, kind = F.col("event_id"), F.col("user_id"), F.col("value"), F.col("event_type")
    s = lambda p, c: F.concat(F.lit(p), t.text(c))
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")
    scan = F.struct(F.lit("shifted").alias("class"), s("m", u % 10).alias("metric"), v.alias("current_median"), (u % 7).alias("baseline_median"))
    end = F.struct(
        F.lit("entry").alias("section"), F.lit("SERVER").alias("kind"), F.lit("by_name").alias("axis"), s("l", u % 20).alias("label"), v.alias("p50_ms"),
        F.when(i % 2 == 0, v / 1000).alias("failed_rate"), (i % 30).alias("count"), F.struct((u % 50).alias("p50_ms"), F.lit("ok").alias("state")).alias("baseline"),
    )
    sql = F.struct(
        F.lit("sql").alias("class"), s("q", u % 50).alias("sql_key"), v.alias("latency_ms_p50"), (u % 5).alias("baseline_latency_ms_p50"),
        (i % 25).alias("polls_in_window"), (u % 3).alias("baseline_polls"),
    )
    change = F.struct(s("k", u % 3).alias("kind"), at)
    log = F.struct(F.element_at(F.array(F.lit("match"), F.lit("before"), F.lit("odd")), (i % 3 + 1).cast("int")).alias("relation"), at, F.array(s("ch:logs:t:", i)).alias("refs"))
    source = F.when(kind == "view", "scan_metrics").when(kind == "click", "breakdown_endpoints").when(kind == "purchase", "db_slow_queries").when(kind == "signup", "change").otherwise("sample_logs")
    finding = F.when(kind == "view", F.to_json(scan)).when(kind == "click", F.to_json(end)).when(kind == "purchase", F.to_json(sql)).when(kind == "signup", F.to_json(change)).otherwise(F.to_json(log))
    return e.select(
        i.alias("id"), source.alias("source"), s("t", u).alias("target_id"), finding.alias("finding"), F.when(i % 11 == 0, "no_data").otherwise("normal").alias("status"),
        F.when(i % 11 == 0, "zero_observations").alias("no_data_reason"), F.when(i % 13 == 0, 2).otherwise(0).cast("long").alias("omitted"),
        F.lit(False).alias("truncated"), (u % 17 == 0).alias("degraded"),
    )


RECORDS = """e as (select *, event_id as id, 't' || user_id::varchar as target_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as stamp from events),
r as (select id, 'scan_metrics' as source, target_id, 'shifted' as class, 'metric' as aspect, 'ratio' as kind, '' as entity_key, 'm' || (user_id % 10)::varchar as metric, value as observed,
    (user_id % 7)::double as baseline, null::bigint as sample_n, null as moment, false as doubtful, user_id from e where event_type = 'view'
  union all select id, 'breakdown_endpoints', target_id, 'endpoint_latency', 'endpoint', 'duration', 'entry|SERVER|by_name|l' || (user_id % 20)::varchar, 'p50_ms', value, user_id % 50, event_id % 30, null, false, user_id from e where event_type = 'click'
  union all select id, 'breakdown_endpoints', target_id, 'endpoint_failure', 'endpoint', 'share', 'entry|SERVER|by_name|l' || (user_id % 20)::varchar, 'failed_rate', value / 1000, null, event_id % 30, null, false, user_id from e where event_type = 'click' and event_id % 2 = 0
  union all select id, 'db_slow_queries', target_id, 'sql', 'db', 'ratio', 'q' || (user_id % 50)::varchar, 'latency_ms_p50', value, user_id % 5, event_id % 25, null, user_id % 3 = 0, user_id from e where event_type = 'purchase'
  union all select id, 'change', target_id, 'change', 'change', 'count', 'k' || (user_id % 3)::varchar || '|' || target_id || '|' || stamp, 'change', 1, null, null, stamp, false, user_id from e where event_type = 'signup'
  union all select id, 'sample_logs', target_id, 'grep', 'log', 'count', stamp || '|' || id::varchar, '', 1, null, null, stamp, false, user_id from e where event_type = 'error' and event_id % 3 = 0),
m as (select *, case when kind = 'ratio' then case when baseline <> 0 then observed / baseline end else observed end as magnitude from r),
records as (select id, source, target_id, 'finding' as record_kind, class, false as unknown, aspect, kind, entity_key, metric, observed, baseline, magnitude,
    case when baseline is null then 'n/a' when observed > baseline then 'up' when observed < baseline then 'down' else 'flat' end as direction, moment as change_from, moment as change_to, sample_n,
    case when id % 11 > 0 then 'observed' when id % 13 = 0 then 'missing' else 'observed_zero' end as availability,
    case when user_id % 17 = 0 or id % 11 > 0 and id % 13 = 0 or coalesce(sample_n, 10) < 10 or doubtful or magnitude is null then 'low' else 'normal' end as confidence from m
  union all select id, 'sample_logs', target_id, 'meta', case when event_id % 3 = 1 then 'before' else 'odd' end, event_id % 3 = 2, null, null, null, null, null, null, null, null, null, null, null,
    case when id % 11 > 0 then 'observed' when id % 13 = 0 then 'missing' else 'observed_zero' end, null from e where event_type = 'error' and event_id % 3 > 0)"""


@PLANS.add(f"with {RECORDS} select * replace (round(observed, 6) as observed, round(baseline, 6) as baseline, round(magnitude, 6) as magnitude) from records")
def evidence_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.project(findings(spark, sf_dir)))


@PLANS.add(f"""with {RECORDS} select source, class, record_kind, unknown, count(*) as n, count(*) filter (confidence = 'low') as low, count(distinct entity_key) as entities,
  count(*) filter (change_from is not null) as dated from records group by 1, 2, 3, 4""")
def evidence_projection_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each class there is, unknown ones among them, so that a tool's new class is seen."""
    return op.project(findings(spark, sf_dir)).groupBy("source", "class", "record_kind", "unknown").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "low").alias("low"), F.count_distinct("entity_key").alias("entities"),
        F.count("change_from").alias("dated"),
    )
