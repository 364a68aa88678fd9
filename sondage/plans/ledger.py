"""Queries that judge hypotheses: orders stand in for evidence, customers for hypotheses and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.operators import ledger as op
from sondage.plans.base import Plans, rounded
from sondage.sources import telemetry as t

PLANS = Plans()

HYPOTHESES = """h as (select c_custkey as id, case c_custkey % 3 when 0 then 'confirmed' when 1 then 'probable' else 'insufficient' end as status, c_nationkey % 5 as lineages, c_acctbal > 3000 as temporal,
  c_custkey % 4 as weak, c_custkey % 5 as qualified, c_custkey % 7 as unexamined, c_nationkey % 4 * 3 as required from customer)"""


@PLANS.add(f"""with {HYPOTHESES}, b as (select *, case status when 'confirmed' then 80 when 'probable' then 50 else 0 end as b from h),
a as (select *, b > 0 and lineages >= 3 as i1, b > 0 and temporal as i2, b > 0 and weak > qualified as i3, b > 0 and required > 0 and 3 * unexamined > required as i4 from b)
select id, status, b / 100 as band, concat_ws(',', case when i1 then 'lineage_ge3' end, case when i2 then 'temporal_confirmed' end, case when i3 then 'weak_majority' end, case when i4 then 'unexamined_over_third' end) as items,
  round((b + greatest(-10, least(10, 5 * (i1::int + i2::int - i3::int - i4::int)))) / 100, 6) as value from a""")
def ledger_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = t.read_table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "case c_custkey % 3 when 0 then 'confirmed' when 1 then 'probable' else 'insufficient' end as status", "c_nationkey % 5 as lineages", "c_acctbal > 3000 as temporal",
        "c_custkey % 4 as weak", "c_custkey % 5 as qualified", "c_custkey % 7 as unexamined", "c_nationkey % 4 * 3 as required",
    )
    return rounded(op.confidence(h).select("id", "status", "band", "items", "value"))


EVIDENCE = {
    "id": "o_orderkey", "heir": "case when o_orderkey % 13 = 0 then o_orderkey + 1 when o_orderkey % 17 <> 0 then o_orderkey end", "counter": "o_orderkey % 4 = 0",
    "predicate": "case o_orderkey % 5 when 0 then 'present' when 1 then 'absent' when 2 then 'magnitude_ge' when 3 then 'magnitude_lt' else 'direction_up' end", "must_hold": "o_custkey % 3 > 0",
    "availability": "case o_custkey % 6 when 0 then 'missing' when 1 then 'observed_zero' when 2 then 'not_applicable' else 'observed' end",
    "confidence": "case when o_custkey % 7 = 0 then 'low' else 'normal' end", "scope_omitted": "case when o_custkey % 2 = 0 then o_custkey % 5 end", "omitted": "case when o_custkey % 11 = 0 then 3 end",
    "from_at": "case when o_orderkey % 19 > 0 then o_orderdate end", "to_at": "o_orderdate + interval '400' day", "change_from": "case when o_orderkey % 2 = 0 then o_orderdate + interval '200' day end",
    "change_to": "case when o_orderkey % 6 = 0 then o_orderdate + interval '300' day end", "need_from": "case when o_custkey % 23 > 0 then timestamp '1998-01-01' end", "need_to": "timestamp '1998-06-01'",
    "lag_status": "case when o_custkey % 9 > 0 then 'observed' else 'unknown' end", "lag_s": "o_custkey % 900", "now": "timestamp '2000-01-01'", "sample_n": "case when o_orderkey % 3 > 0 then o_orderkey % 40 end", "min_sample": "10",
}
EVIDENCE_SQL = "e as (select " + ", ".join(f"{x} as {n}" for n, x in EVIDENCE.items()) + " from orders)"


@PLANS.add(f"""with {EVIDENCE_SQL}, x as (select *, case when must_hold then predicate not in ('absent', 'magnitude_lt') else predicate in ('absent', 'magnitude_lt') end as one_sight from e),
g as (select id, coalesce(heir = id, false) as c1, case when counter then availability not in ('missing', 'not_applicable') else availability in ('observed', 'observed_zero') end as c2,
  confidence = 'normal' as c3, coalesce(scope_omitted, 0) = 0 and coalesce(omitted, 0) = 0 as c4,
  case when need_from is null or from_at is null then 'unknown' when from_at <= need_from and to_at >= need_to then 'pass' when counter or not one_sight then 'fail'
    when coalesce(change_to, change_from, to_at) >= need_from and coalesce(change_from, from_at) <= need_to then 'pass' else 'fail' end as "window",
  case when lag_status <> 'observed' then 'unknown' when now >= to_at + to_seconds(lag_s) then 'pass' else 'fail' end as arrived,
  case when sample_n is null then 'no_source' when sample_n >= min_sample then 'pass' else 'fail' end as sample from x),
n as (select *, concat_ws(',', case when not c1 then 'active' end, case when not c2 then 'available' end, case when not c3 then 'trusted' end, case when not c4 then 'untruncated' end,
  case when "window" in ('fail', 'unknown') then 'window' end, case when arrived in ('fail', 'unknown') then 'arrived' end, case when sample = 'fail' then 'sample' end) as failed from g)
select id, "window", arrived, sample, failed, failed = '' as qualified from n""")
def ledger_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read_table(spark, sf_dir, "orders").selectExpr(*[f"{x} as {n}" for n, x in EVIDENCE.items()])
    return op.qualify(rows).select("id", "window", "arrived", "sample", "failed", "qualified")


@PLANS.add("""with k as (select distinct o_custkey as target_id, o_orderpriority as tool from orders), na as (select c_custkey as target_id, '5-LOW' as tool from customer where c_acctbal < 0)
select * from k where not exists (select 1 from na where na.target_id = k.target_id and na.tool = k.tool)
  and not exists (select 1 from orders o where o_orderstatus = 'F' and o.o_custkey = k.target_id and o.o_orderpriority = k.tool)""")
def ledger_unseen_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target_id"), F.col("o_orderpriority").alias("tool"), "o_orderstatus")
    na = t.read_table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("target_id"), F.lit("5-LOW").alias("tool"))
    return op.unseen_views(o, na, o.filter("o_orderstatus = 'F'"), ["target_id", "tool"])


@PLANS.add("""with b as (select o_custkey as key, list(o_orderkey order by o_orderkey) as l from orders where o_orderdate < '2000-01-01' group by 1), n as (select o_custkey as key, list(o_orderkey order by o_orderkey) as l from orders where o_orderdate < '2001-01-01' group by 1)
select n.key from n left join b on n.key = b.key where b.l is distinct from n.l""")
def ledger_changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.read_table(spark, sf_dir, "orders")

    def snapshot(until: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
        return o.filter(F.col("o_orderdate") < until).select(F.col("o_custkey").alias("key"), place.alias("place"), F.col("o_orderkey").alias("eid"))

    return op.changed_keys(snapshot("2000-01-01"), snapshot("2001-01-01"))


CANDIDATES = """c as (select c_custkey as id, c_custkey % 50 as grp, c_mktsegment as source, c_nationkey as target, (c_custkey * 7) % 5 as depth, round(c_acctbal / 1000, 1) as prior from customer),
p as (select o_custkey as id, o_orderpriority || o_orderstatus as key from orders), s as (select o_custkey as id, case when o_orderkey % 10 > 0 then o_orderdate::varchar else '' end as eid from orders)"""
MERGED = f"""{CANDIDATES}, b as (select grp, count(*) as merged_count, min(id) as lead, arg_min(source, id) as source, count(distinct source) as sources, arg_max(target, {{'d': depth, 'i': -id}}) as target, max(depth) as depth, max(prior) as prior,
  max(depth) > arg_min(depth, id) as chain_replaced from c group by 1), m as (select b.*, coalesce(pn, 0) as predictions, coalesce(pr, 0) as repeated, coalesce(sn, 0) as support from b
  left join (select grp, count(distinct key) as pn, count(*) - count(distinct key) as pr from p join c on p.id = c.id group by 1) x on b.grp = x.grp left join (select grp, count(distinct eid) as sn from s join c on s.id = c.id where eid <> '' group by 1) y on b.grp = y.grp)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.read_table(spark, sf_dir, "orders")
    c = t.read_table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "c_custkey % 50 as grp", "c_mktsegment as source", "c_nationkey as target", "(c_custkey * 7) % 5 as depth", "round(c_acctbal / 1000, 1) as prior"
    )
    p = o.select(F.col("o_custkey").alias("id"), F.concat("o_orderpriority", "o_orderstatus").alias("key"))
    s = o.select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 10 > 0, t.text("o_orderdate")).otherwise("").alias("eid"))
    return op.merged(c, p, s)


@PLANS.add(f"with {MERGED} select * from m")
def ledger_merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@PLANS.add(f"with {MERGED} select grp, lead, prior from m order by prior desc, lead limit 5")
def ledger_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.front(_merged(spark, sf_dir)).select("grp", "lead", "prior")


@PLANS.add("""with n as (select o_custkey as id, count(*) as n from orders group by 1)
select coalesce(c_custkey, id) as id, case when c_custkey is null then 'unknown' when n is null then 'missing' else 'repeated' end as state
from (select c_custkey from customer where c_nationkey < 20) c full join n on c_custkey = id where c_custkey is null or n is null or n > 1""")
def ledger_partition_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.read_table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("id"))
    return op.misgrouped(t.read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), c)


AUDIT = """a as (select o_orderkey as id, o_custkey as hypothesis, case when o_orderkey % 3 = 0 then 'necessary' else 'corroborating' end as role, o_orderkey % 7 > 0 and o_orderkey % 8 > 0 and o_orderkey % 10 > 0 as valid,
  o_orderkey % 9 = 0 as bad from orders), au as (select id, hypothesis, case when valid and role = 'necessary' and bad then 'corroborating' else role end as role, not valid as audited_out, valid and role = 'necessary' and bad as demoted from a)"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = t.read_table(spark, sf_dir, "orders"), F.col("o_orderkey")
    p = o.select(i.alias("id"), F.col("o_custkey").alias("hypothesis"), F.when(i % 3 == 0, "necessary").otherwise("corroborating").alias("role"))
    v = o.filter(i % 10 > 0).select(i.alias("id"), (i % 7 > 0).alias("pertinent"), (i % 8 > 0).alias("substantive"), F.when(i % 2 == 0, i % 9 > 0).when(i % 9 == 0, False).alias("role_valid"))
    return op.audited(p, v)


@PLANS.add(f"with {AUDIT} select * from au")
def ledger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir)


@PLANS.add(f"with {AUDIT}, n as (select hypothesis, count(*) filter (not audited_out) as live, count(*) filter (not audited_out and role = 'necessary') as necessary from au group by 1) select *, live >= 2 and necessary >= 1 as admitted from n")
def ledger_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.recheck(_audited(spark, sf_dir))


@PLANS.add("""with p as (select distinct o_custkey as id, o_orderdate as key, o_orderstatus as x from orders)
select id, bool_or(exists (select 1 from p q where q.key = p.key and q.x <> p.x and q.id <> p.id)) as discriminating from p group by 1""")
def ledger_discriminating(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.read_table(spark, sf_dir, "orders")
    return op.discriminating(o.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("key"), F.col("o_orderstatus").alias("expectation")))


@PLANS.add("""with c as (select case when c_nationkey < 3 then '' when c_nationkey < 9 then 'unknown:' || c_mktsegment else c_mktsegment end as cause from customer)
select count(*) as candidates, count(distinct case when cause <> '' and cause not like 'unknown:%' then cause end) as causes,
  count(distinct case when cause <> '' and cause not like 'unknown:%' then cause end) < 2 as diversity_unmet, count(*) < 3 as count_below_min from c""")
def ledger_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    cause = F.when(F.col("c_nationkey") < 3, "").when(F.col("c_nationkey") < 9, F.concat(F.lit("unknown:"), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return op.cohort(t.read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), cause.alias("cause")))


@PLANS.add("""with odd as (select c_custkey as id from customer where c_acctbal < 0 union select o_custkey from orders where o_orderpriority <> '5-LOW' and o_totalprice > 300000)
select id::varchar as target_id from odd where id not in (select user_id from events where event_type = 'error' and value > 50)""")
def ledger_unexplained(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda n: t.read_table(spark, sf_dir, n)
    groups = r("customer").select(t.text("c_custkey").alias("target_id"), (F.col("c_acctbal") < 0).alias("anomalous"))
    source, status = F.when(F.col("o_orderpriority") == "5-LOW", "change").otherwise("scan"), F.when(F.col("o_totalprice") > 300000, "anomalous").otherwise("normal")
    findings = r("orders").select(t.text("o_custkey").alias("target_id"), source.alias("source"), status.alias("status"))
    return op.unexplained(groups, findings, r("events").filter("event_type = 'error' and value > 50").select(t.text("user_id").alias("target_id")))


@PLANS.add("""with r as (select event_id as id, 't' || (user_id % 9)::varchar as target, event_type as metric, case event_id % 3 when 0 then '' when 1 then 'vm:' || event_type || ':' || event_id::varchar || '/9' else 'ch' end as ref,
  case when event_id % 4 > 0 then event_type end as entity, case when event_id % 5 > 0 then 'load' end as aspect, round(value) as m from events)
select id, 'LIN-' || sha256(case ref when '' then 'scan' when 'ch' then 'ch' else 'vm:' || metric end || '|' || target || '|' || metric)[:12] as lineage,
  case when entity is null then '' else entity || '(' || target || coalesce('/' || aspect, '') || '): seen [' || metric || '=' || m::decimal(20,2)::varchar || ']' end as statement from r""")
def evidence_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = t.read_table(spark, sf_dir, "events"), F.col("event_id")
    target, metric = F.concat(F.lit("t"), t.text(F.col("user_id") % 9)), F.col("event_type")
    ref = F.when(i % 3 == 0, "").when(i % 3 == 1, F.concat(F.lit("vm:"), metric, F.lit(":"), t.text("event_id"), F.lit("/9"))).otherwise("ch")
    said = op.statement(F.when(i % 4 > 0, metric), target, F.when(i % 5 > 0, "load"), F.lit("seen"), metric, F.round("value"))
    return e.select(i.alias("id"), op.lineage(F.lit("scan"), target, metric, ref).alias("lineage"), said.alias("statement"))


@PLANS.add("""with r as (select event_id as id, case when event_id % 6 = 0 then 'no_data' else 'normal' end as status, case when event_id % 12 = 0 then 'backend_error' else 'zero_observations' end as reason,
  date_trunc('hour', ts) + interval 1 hour as wanted, case when event_id % 7 > 0 then ts + to_minutes(user_id % 90) end as got from events)
select id, case when status = 'no_data' and reason = 'backend_error' then 'backend_error' when status = 'no_data' or got is null then 'unknown' else 'observed' end as lag_status,
  case when status <> 'no_data' and got is not null then greatest(epoch(wanted)::bigint - floor(epoch(got))::bigint, 0) end as lag_s from r""")
def evidence_collect_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read_table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "case when event_id % 6 = 0 then 'no_data' else 'normal' end as status", "case when event_id % 12 = 0 then 'backend_error' else 'zero_observations' end as reason",
        "date_trunc('hour', ts) + interval '1' hour as requested_to", "case when event_id % 7 > 0 then ts + make_dt_interval(0, 0, cast(user_id % 90 as int)) end as observed_to",
    )
    return op.collect_lag(rows).select("id", "lag_status", "lag_s")


@PLANS.add("""select o_custkey as target_id, o_orderpriority as class, case o_orderstatus when 'F' then '*' else o_orderstatus end as metric, sum(o_orderkey % 3)::bigint as total, sum(o_orderkey % 2)::bigint as returned,
  sum((o_orderkey % 5 = 0)::bigint)::bigint as omitted, sum((o_orderkey % 5 = 0)::bigint) = 0 as complete, case when sum(o_orderkey % 3) > 0 then 'normal' else 'no_data' end as status from orders group by 1, 2, 3""")
def evidence_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    return op.scopes(t.read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("target_id"), F.col("o_orderpriority").alias("class"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).otherwise("").alias("metric"),
        (i % 3).alias("total"), (i % 2).alias("returned"), (i % 5 == 0).cast("long").alias("omitted"),
    ))


@PLANS.add("""with r as (select o_custkey as target_id, o_orderpriority as metric, o_orderstatus as w, bool_or(o_orderkey % 4 = 0) as measured, bool_or(o_orderkey % 8 = 0) as truth, case o_orderstatus when 'O' then 1 when 'F' then 2 else 3 end as place from orders group by 1, 2, 3)
select target_id, metric, arg_max(measured, {'m': measured, 'p': case when measured then -place else place end}) as measured, arg_max(w, {'m': measured, 'p': case when measured then -place else place end}) as "window",
  arg_max(truth, {'m': measured, 'p': case when measured then -place else place end}) as truth from r group by 1, 2""")
def evidence_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = t.read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("target_id"), F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("window"))
    rows = by.agg(F.when(F.bool_or(F.col("o_orderkey") % 4 == 0), "ok").otherwise("missing").alias("status"), F.bool_or(F.col("o_orderkey") % 8 == 0).alias("truth"))
    return op.measured_any_window(rows, ["O", "F", "P"])


@PLANS.add("""with n as (select distinct user_id as id from events where user_id not in (select o_custkey from orders)) select id, (7 + (select (count(*) > 0)::bigint from n))::bigint as version from (select distinct o_custkey as id from orders union all select id from n)""")
def ledger_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = t.read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    ids, version = op.extended(known, t.read_table(spark, sf_dir, "events").select(F.col("user_id").alias("id")), 7)
    return ids.withColumn("version", F.lit(version).cast("long"))


@PLANS.add("""with r as (select o_orderkey as id, o_custkey as target_id, substring(o_orderpriority, 1, 1)::bigint as tier, 50 + o_orderkey % 300 as size from orders),
s as (select *, sum(size) over (partition by target_id order by tier, id rows unbounded preceding)::bigint as spent from r) select *, case when spent <= 1000 then 'full' else 'short' end as form from s""")
def ledger_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.read_table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_custkey as target_id", "cast(substring(o_orderpriority, 1, 1) as bigint) as tier", "50 + o_orderkey % 300 as size")
    return op.within_budget(o, 1000)
