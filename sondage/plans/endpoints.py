"""Queries over the endpoints of services."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from sondage.operators import endpoints as op
from sondage.plans.base import Plans, rounded
from sondage.sources import sessions as v

PLANS = Plans()

DESCRIBED = f"""{v.CALLS}, d0 as (select *, case when kind in ('SERVER', 'CONSUMER') then 'entry' when kind = 'INTERNAL' and parent_span_id is null then 'entry' when kind = 'INTERNAL' then 'step' else 'egress' end as section,
  case when kind <> 'CLIENT' then name when db_system is not null then 'db ' || db_system || ' ' || coalesce(db_operation, '-') || ' -'
    when url is not null then 'http GET ' || address || coalesce(':' || port, '') else 'peer ' || address end as label from calls),
d as (select *, case when kind = 'SERVER' then 'http.route' when kind in ('CONSUMER', 'PRODUCER') then 'messaging.destination' when kind = 'INTERNAL' then 'framework_segment'
  when label like 'db %' then 'db_call' when label like 'http %' then 'http_call' else 'peer' end as axis from d0)"""


@PLANS.add(f"""with {DESCRIBED}, a as (select section, kind, label, axis, count(*) as n, count(distinct (trace_id, span_id)) as unique_n, count(*) filter (parent_span_id is null) as root_n, count(*) filter (code >= 500) as http_5xx, count(*) filter (code between 400 and 499) as http_4xx,
  count(code) as http_n, count(*) filter (code is null and status = 'ERROR') as err_nohttp, count(*) filter (status = 'ERROR') as status_err, count(error) as labelled, min(target_id) as target_id from d group by all),
f as (select *, case when kind = 'SERVER' or axis = 'http_call' then http_5xx + err_nohttp else status_err end as failed_n, case when kind = 'SERVER' or axis = 'http_call' then http_4xx else -1 end as rejected_n from a)
select section, kind, label, axis, n, unique_n, root_n, http_5xx, http_4xx, http_n, err_nohttp, status_err, target_id, failed_n, rejected_n,
  case when failed_n = 0 and rejected_n <= 0 and labelled = 0 then 'none' when kind = 'SERVER' then 'http_server' when axis = 'db_call' then 'db' when kind = 'CLIENT' then 'http_client' else 'framework' end as semantics,
  round(failed_n / unique_n, 6) as failed_rate, round(case when rejected_n >= 0 and http_n > 0 then rejected_n / http_n else 0 end, 6) as rejected_rate from f""")
def endpoint_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.totals(v.calls(spark, sf_dir)))


@PLANS.add(f"""with {DESCRIBED}, c as (select section, kind, label, error, count(*) as n from d where error is not null group by all),
r as (select *, row_number() over (partition by section, kind, label order by n desc, error) as place from c) select * from r where place <= 2""")
def endpoint_frequent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.frequent_errors(v.calls(spark, sf_dir))


@PLANS.add(f"""with {DESCRIBED}, c as (select section, kind, label, count(*) filter (ts >= '2000-06-01' and ts < '2000-07-01') as n, count(*) filter (ts >= '2000-05-02' and ts < '2000-06-01') as near_n,
  count(*) filter (ts >= '2000-03-03' and ts < '2000-06-01') as far_n from d group by all), w as (select coalesce(bool_or(n >= 30 and near_n < 30), false) as thin from c)
select section, kind, label, n, case when thin then far_n else near_n end as base_n, case when thin then 'widened' else 'ok' end as base_state from c, w where n > 0""")
def endpoint_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.against_baseline(v.calls(spark, sf_dir), datetime(2000, 6, 1), datetime(2000, 7, 1))
