"""Queries over sessions that block each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import blocking as op
from sondage.plans.base import Plans
from sondage.sources import sessions as v

PLANS = Plans()

FIELDS = f"""{v.SESSIONS}, j as (select *, case when json_valid(body) then body else '{{}}' end as b from sessions),
fields as (select database, engine, poll,
  coalesce(try_cast(json_extract_string(b, case engine when 'postgresql' then '$.pid' when 'oracle' then '$.sid' when 'mysql' then '$.tid' else '$.none' end) as bigint), 0) as session,
  coalesce(try_cast(json_extract_string(b, case engine when 'postgresql' then '$.blockingPid' when 'oracle' then '$.blockingSession' when 'mysql' then '$.blockingTid' else '$.none' end) as bigint), 0) as blocker,
  coalesce(case engine when 'postgresql' then json_extract_string(b, '$.waitEvent') when 'oracle' then json_extract_string(b, '$.event') end, '') as wait,
  coalesce(case when engine in ('postgresql', 'mysql') then json_extract_string(b, '$.sqlHash') when engine = 'oracle' then json_extract_string(b, '$.sqlId') end, '') as sql_key,
  case when engine in ('postgresql', 'oracle') then 'verified' else 'unverified' end as pairing from j)"""
ROLES = f"""{FIELDS}, own as (select database, poll, session, max(blocker) as blocker from fields where session > 0 group by all),
waited as (select distinct database, poll, blocker as session from fields where blocker > 0),
roles as (select o.database, o.poll, o.session, o.blocker, case when w.session is null then 'blocked_only' when o.blocker <= 0 then 'root' else 'both' end as role
  from own o left join waited w using (database, poll, session) where w.session is not null or o.blocker > 0)"""


@PLANS.add(f"with {FIELDS} select * from fields")
def db_session_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.session_fields(v.sessions(spark, sf_dir))


@PLANS.add(f"with {ROLES} select * from roles")
def db_session_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.roles(op.session_fields(v.sessions(spark, sf_dir)))


@PLANS.add(f"""with recursive {ROLES}, e as (select database, poll, session, blocker from roles where blocker > 0),
walk as (select database, poll, [session] as path, session as cur from e
  union all select w.database, w.poll, list_append(w.path, e.blocker), e.blocker from walk w join e on w.database = e.database and w.poll = e.poll and w.cur = e.session where not list_contains(w.path, e.blocker))
select database, poll, greatest(max(len(path)), 2)::bigint as depth from walk group by 1, 2""")
def db_blocking_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.chain_depth(op.roles(op.session_fields(v.sessions(spark, sf_dir))).filter("blocker > 0"))


@PLANS.add(f"""with {ROLES}, s as (select database, poll, string_agg(session::varchar, ',' order by session::varchar) as roots from roles where role = 'root' group by 1, 2),
l as (select *, coalesce(roots <> lag(roots) over (partition by database order by poll), false) as changed from s)
select database, count(*) as polls, count(distinct roots) as root_sets, count(*) filter (changed) as n_changes, bool_or(changed) as migrated from l group by 1""")
def db_root_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.root_changes(op.roles(op.session_fields(v.sessions(spark, sf_dir))))


@PLANS.add(f"""with {ROLES}, p as (select database, poll, count(*) filter (blocker > 0) as blocked_n from roles group by 1, 2),
n as (select *, count(*) over (partition by database) as n, row_number() over (partition by database order by poll) as a, row_number() over (partition by database order by poll desc) as z from p)
select database, poll, blocked_n, n > 60 as truncated from n where n <= 60 or a <= 30 or z <= 30""")
def db_poll_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = op.roles(op.session_fields(v.sessions(spark, sf_dir))).groupBy("database", "poll").agg(F.count_if(F.col("blocker") > 0).alias("blocked_n"))
    return op.timeline(polls)
