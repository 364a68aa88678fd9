"""Queries over targets, processes, coverage and topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import inventory as op
from sondage.plans.base import Plans, rounded
from sondage.sources import telemetry as t

PLANS = Plans()


@PLANS.add(f"with {t.TARGETS} select id, name, type from targets where lower(id) like '%n1%' or lower(name) like '%n1%' or lower(type) like '%n1%' order by id limit 6 offset 3")
def target_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.search(t.targets(spark, sf_dir), "N1", ["id", "name", "type"], 5, 3).select("id", "name", "type")


@PLANS.add(f"""with recursive {t.TARGETS}, chain as (select id, 1 as depth, parent_id as ancestor from targets where parent_id is not null
  union all select c.id, depth + 1, p.parent_id from chain c join targets p on c.ancestor = p.id where p.parent_id is not null and depth < 6)
select id, depth::bigint as depth, ancestor from chain""")
def target_membership_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.parent_chain(t.targets(spark, sf_dir))


@PLANS.add(f"with {t.TARGETS} select parent_id, type, count(*) as n, case when count(*) <= 10 then string_agg(id, ',' order by id) end as ids from targets where parent_id is not null group by 1, 2")
def children_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.children_counts(t.targets(spark, sf_dir))


@PLANS.add(f"""with {t.TARGETS}, d as (select 's' || s_suppkey::varchar as id, s_acctbal < 0 as dev from supplier),
p as (select a.id, b.id as peer from targets a join targets b on a.group_id = b.group_id and a.type = b.type and a.id <> b.id),
n as (select p.id, count(*) as compared, count(*) filter (dev) as n_dev from p join d on p.peer = d.id group by 1)
select d.id, coalesce(compared, 0) as compared, coalesce(n_dev, 0) as n_deviating, case when coalesce(compared, 0) = 0 then 'undecidable' when not dev then 'self_not_deviating'
  when n_dev > 0 then 'shared' else 'alone' end as verdict from d left join n on d.id = n.id""")
def peers_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t.read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), t.text("s_suppkey")).alias("id"), (F.col("s_acctbal") < 0).alias("deviating"))
    return op.peer_verdict(s, t.targets(spark, sf_dir))


@PLANS.add("""with m as (select user_id, ts as seen_at, event_type from events where event_type in ('signup', 'click')),
o as (select event_id, user_id, ts from events where event_type = 'purchase')
select o.event_id, o.user_id, o.ts, arg_max(m.event_type, {'t': m.seen_at, 'e': m.event_type}) as event_type, max(m.seen_at) as seen_at
from o left join m on o.user_id = m.user_id and m.seen_at <= o.ts group by 1, 2, 3""")
def process_snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read_table(spark, sf_dir, "events")
    meta = e.filter(F.col("event_type").isin("signup", "click")).select("user_id", F.col("ts").alias("seen_at"), "event_type")
    return op.latest_before(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), meta, "user_id", "ts", "seen_at", "event_type")


@PLANS.add(f"""with {t.METRICS} select target_id, name, round(arg_max(value, {{'t': ts, 'v': value}}), 6) as latest, round(max(value), 6) as peak, arg_max(ts, {{'v': value, 't': ts}}) as peak_at, max(ts) as observed_at
from metrics group by 1, 2""")
def process_snapshot_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.latest_and_peaks(t.metrics(spark, sf_dir), ["target_id", "name"], "value"))


@PLANS.add(f"""with {t.METRICS}, a as (select name, target_id, avg(v) as avg from (select name, target_id, dim, avg(value) as v from metrics group by 1, 2, 3) group by 1, 2)
select name, target_id, round(avg, 6) as avg, round(avg / sum(avg) over (), 6) as share, avg / sum(avg) over () >= 0.5 as anomalous from a order by a.avg desc, name, target_id limit 5""")
def process_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.top_share(t.metrics(spark, sf_dir), ["name", "target_id"], 5))


@PLANS.add("""select event_type, user_id % 3 as oid, count(*) as n, min(ts) as first_at, max(ts) as last_at from events group by 1, 2 order by n desc, 1, 2 limit 21""")
def trap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read_table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("oid"))
    rows = e.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return rows.orderBy(F.desc("n"), "event_type", "oid").limit(21)  # 20 shown, one more tells that there are others


@PLANS.add("""with w as (select c_custkey as target_id from customer), o as (select o_custkey as target_id, count(*) as n from orders where o_orderstatus = 'F' group by 1),
e as (select user_id as target_id, count(*) as n from events group by 1)
select w.target_id, coalesce(o.n, 0) as changes, coalesce(e.n, 0) as events, (coalesce(o.n, 0) > 0)::bigint + (coalesce(e.n, 0) > 0)::bigint as sources_seen
from w left join o on w.target_id = o.target_id left join e on w.target_id = e.target_id""")
def data_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda n: t.read_table(spark, sf_dir, n)
    orders = r("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("target_id"))
    return op.coverage(r("customer").select(F.col("c_custkey").alias("target_id")), {"changes": orders, "events": r("events").select(F.col("user_id").alias("target_id"))})


@PLANS.add("""select event_id, user_id, event_type, sha256(event_id::varchar || '|' || event_type) as ref from events
where contains(lower(event_type), 'err')""")
def host_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read_table(spark, sf_dir, "events").filter(F.contains(F.lower("event_type"), F.lit("err")))
    return e.select("event_id", "user_id", "event_type", F.sha2(F.concat_ws("|", t.text("event_id"), "event_type").cast("binary"), 256).alias("ref"))


@PLANS.add("select event_id, user_id % 5 as cluster_id, ts as assigned_at from events where user_id % 5 = 2 order by ts desc, event_id limit 51")
def cluster_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read_table(spark, sf_dir, "events").filter("user_id % 5 = 2")
    rows = e.orderBy(F.desc("ts"), "event_id").limit(51)  # one page and one row more
    return rows.select("event_id", (F.col("user_id") % 5).alias("cluster_id"), F.col("ts").alias("assigned_at"))


@PLANS.add("""with recursive e as (select distinct l_suppkey as s, l_partkey as p from lineitem),
ways as (select 's' || s::varchar as a, 'p' || p::varchar as b from e union select 'p' || p::varchar, 's' || s::varchar from e),
walk as (select 's1' as node, 0 as hop union select b, hop + 1 from walk join ways on a = node where hop < 3)
select node, min(hop)::bigint as hop from walk group by 1""")
def topology_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = t.read_table(spark, sf_dir, "lineitem")
    edges = line.select(F.concat(F.lit("s"), t.text("l_suppkey")).alias("src"), F.concat(F.lit("p"), t.text("l_partkey")).alias("dst")).distinct()
    return op.expand(edges, spark.createDataFrame([("s1",)], "node string"), 3)


@PLANS.add("""with x as (select n_name as service, case when s_suppkey % 3 = 0 then 't' || (s_suppkey % 2)::varchar end as target_id from supplier join nation on s_nationkey = n_nationkey)
select service, count(distinct target_id) as targets, case when count(distinct target_id) = 1 then 'resolved' when count(distinct target_id) = 0 then 'unresolved' else 'ambiguous' end as identity,
  case when count(distinct target_id) = 1 then max(target_id) end as target_id from x group by 1""")
def service_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t.read_table(spark, sf_dir, "supplier").join(t.read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return op.service_identity(s.select(F.col("n_name").alias("service"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("t"), t.text(F.col("s_suppkey") % 2))).alias("target_id")))


@PLANS.add("""with x as (select user_id as target_id, event_type as metric, bool_or(value > 95) as anomalous, max(floor(value))::bigint as severity, min(ts) as first_at, count(*) as n from events group by 1, 2)
select *, row_number() over (order by anomalous desc, severity desc, first_at, target_id, metric) as rank from x""")
def triage_member_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read_table(spark, sf_dir, "events")
    return op.triage(e.select(F.col("user_id").alias("target_id"), F.col("event_type").alias("metric"), (F.col("value") > 95).alias("anomalous"), F.floor("value").cast("long").alias("severity"), F.col("ts").alias("at")))


@PLANS.add("""with c as (select distinct user_id as target_id, case event_type when 'view' then 'metrics' when 'click' then 'logs' when 'error' then 'events' end as domain from events where value > 90),
g as (select distinct user_id as target_id, d.domain from events, (values ('metrics'), ('logs'), ('events')) d(domain))
select g.target_id, g.domain, c.target_id is not null as covered from g left join c on g.target_id = c.target_id and g.domain = c.domain""")
def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read_table(spark, sf_dir, "events").withColumn("target_id", F.col("user_id"))
    domain = F.when(F.col("event_type") == "view", "metrics").when(F.col("event_type") == "click", "logs").when(F.col("event_type") == "error", "events")
    return op.coverage_grid(e.select("target_id").distinct(), ["metrics", "logs", "events"], e.filter("value > 90").select("target_id", domain.alias("domain")))


@PLANS.add("""with recursive sym as (select 's' || s_suppkey::varchar as id from supplier where s_acctbal < -900 union select 's0'), nodes as (select 'p' || p_partkey::varchar as id from part where p_partkey % 10 > 0 union all select 's' || s_suppkey::varchar from supplier),
e as (select 's' || l_suppkey::varchar as a, 'p' || l_partkey::varchar as b from lineitem where l_returnflag = 'R'), ways as (select a, b from e union select b, a from e),
h1 as (select distinct b as id from ways join sym on a = id where b not in (select id from sym)), h2 as (select distinct b as id from ways join h1 on a = id where b not in (select id from sym union select id from h1)),
near as (select id, 'topology_1hop' as via from h1 union all select id, 'topology_2hop' from h2),
kin as (select id, 'host_kin' as via from (select distinct 'c' || c_custkey::varchar as id from customer where c_nationkey = 3 union select 's2') where id not in (select id from near) and id not in (select id from sym))
select id as target_id, via, case when via <> 'host_kin' and id not in (select id from nodes) then 'unprobeable' else 'candidate' end as state from (select * from near union all select * from kin)
union all select id, null, 'missing_from_topology' from sym where id not in (select id from nodes)""")
def triage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda n: t.read_table(spark, sf_dir, n)
    i = lambda p, c: F.concat(F.lit(p), t.text(c)).alias("target_id")
    one = lambda x: spark.createDataFrame([(x,)], "target_id string")
    symptom = r("supplier").filter("s_acctbal < -900").select(i("s", "s_suppkey")).union(one("s0"))
    nodes = r("part").filter("p_partkey % 10 > 0").select(i("p", "p_partkey")).union(r("supplier").select(i("s", "s_suppkey")))
    edges = r("lineitem").filter("l_returnflag = 'R'").select(i("s", "l_suppkey").alias("src"), i("p", "l_partkey").alias("dst"))
    return op.candidates(symptom, nodes, edges, r("customer").filter("c_nationkey = 3").select(i("c", "c_custkey")).union(one("s2")))
