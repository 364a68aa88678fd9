"""The log of evidence over the events: ids by arrival, violations of records and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import appending as op
from sondage.plans.base import Plans
from sondage.sources import telemetry as t

PLANS = Plans()


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each event, with links to records some places before and after it, and fields that are now and then wrong."""
    e = t.read_table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    text = lambda v: F.lit(v).cast("string")
    return e.select(
        i.alias("event_id"), F.lit("scan_metrics").alias("source"), F.concat(F.lit("t"), t.text(u % 3)).alias("target_id"), F.lit("metric").alias("aspect"),
        F.col("event_type").alias("metric"), F.lit("").alias("entity_key"), F.when(u % 29 == 0, text(None)).otherwise("full").alias("window"),
        F.when(u % 10 == 0, "meta").when(u % 10 == 1, "query_scope").otherwise("finding").alias("record_kind"), F.repeat(F.col("event_type"), (u % 24).cast("int")).alias("headline"),
        F.lit("").alias("excerpt"), (u % 10 == 1).alias("scoped"), F.lit("ratio").alias("kind"), F.lit("up").alias("direction"), F.when(u % 31 == 0, "").otherwise("shifted").alias("class"),
        F.lit("observed").alias("availability"), F.lit("low").alias("confidence"), F.col("value").alias("observed"), F.col("value").alias("baseline"), F.lit(1.0).alias("magnitude"),
        F.lit(20).cast("long").alias("sample_n"), (u % 37 % 2).alias("omitted"), (u % 4 > 0).alias("truncated"),
        F.when(i % 7 < 2, op.eid(i - i % 5 + 1)).alias("supersedes"), F.when(i % 11 == 0, op.eid(i - 2)).alias("refines"),
    )


LOG = """a as (select *, row_number() over (order by event_id) as n from events),
log as (select n, printf('EIX-%04d', n) as eid, event_id, user_id as u, 't' || (user_id % 3)::varchar || '|' || event_type || '|' || case when user_id % 29 = 0 then '' else 'full' end as key,
  case user_id % 10 when 0 then 'meta' when 1 then 'query_scope' else 'finding' end as record_kind, length(event_type) * (user_id % 24) as headline,
  case when event_id % 7 < 2 then event_id - event_id % 5 + 1 end as over, case when event_id % 11 = 0 then event_id - 2 end as refined from a)"""


@PLANS.add(f"with {LOG} select n, eid, event_id from log")
def evidence_log_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.numbered(arrivals(spark, sf_dir), ["event_id"]).select("n", "eid", "event_id")


@PLANS.add(f"""with {LOG}, o as (select l.*, x.n as xn, x.key as xkey, x.record_kind as xkind, min(case when x.n < l.n then l.n end) over (partition by l.over) as first from log l left join log x on printf('EIX-%04d', l.over) = x.eid where l.over is not null),
r as (select l.*, x.n as xn, x.key as xkey from log l left join log x on printf('EIX-%04d', l.refined) = x.eid where l.refined is not null)
select n, eid, 'headline_long' as rule from log where headline > 120 union all select n, eid, 'window' from log where u % 29 = 0 and record_kind <> 'meta'
union all select n, eid, 'finding_class' from log where u % 31 = 0 and record_kind = 'finding' union all select n, eid, 'cut_untold' from log where u % 37 % 2 = 1 and u % 4 = 0
union all select n, eid, 'supersedes_and_refines' from log where over is not null and refined is not null
union all select n, eid, 'missing' from o where xn is null union all select n, eid, 'self' from o where xn = n union all select n, eid, 'later' from o where xn > n
union all select n, eid, 'fork' from o where xn < n and n > first union all select n, eid, 'cross_kind' from o where xn < n and record_kind <> xkind union all select n, eid, 'selector' from o where xn < n and key <> xkey
union all select n, eid, 'refines_missing' from r where xn is null union all select n, eid, 'refines_self' from r where xn = n union all select n, eid, 'refines_later' from r where xn > n
union all select n, eid, 'refines_same' from r where xn < n and key = xkey""")
def evidence_append_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = op.durable(op.numbered(arrivals(spark, sf_dir), ["event_id"]), "log")
    return op.invalid(log).unionByName(op.broken_links(log))
