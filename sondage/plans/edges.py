"""Queries over edges between services and the targets that they end at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import edges as op
from sondage.plans.base import Plans, rounded
from sondage.sources import sessions as v
from sondage.sources import telemetry as t

PLANS = Plans()

PAIRED = f"""{v.CALLS}, s as (select trace_id, span_id, min({{'a': service, 'b': kind, 'c': coalesce(parent_span_id, -1), 'd': status}}) as s from calls group by 1, 2),
spans as (select trace_id, span_id, s.a as service, s.b as kind, nullif(s.c, -1) as parent_span_id, s.d as status from s),
paired as (select u.service as source, c.service as target, case when u.kind = 'CLIENT' and c.kind = 'SERVER' then 'sync_call' when u.kind = 'PRODUCER' and c.kind = 'CONSUMER' then 'async_candidate' else 'unknown' end as kind,
  'paired' as observation, u.kind || '>' || c.kind as span_kinds, count(*) as n, count(*) filter (c.status = 'ERROR') as errors
  from spans c join spans u on c.trace_id = u.trace_id and c.parent_span_id = u.span_id where u.service <> c.service group by 1, 2, 3, 4, 5)"""

OBSERVED = f"""{PAIRED}, observed as (select *, length(target)::bigint % 2 + 1 as hop, 0 as seq from paired union all select source, target, kind, observation, span_kinds, n + 5, errors, 2, 1 from paired)"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge as both its ends report it."""
    p = op.paired(v.calls(spark, sf_dir))
    one = p.withColumns({"hop": F.length("target").cast("long") % 2 + 1, "seq": F.lit(0)})
    return one.unionByName(p.withColumns({"n": F.col("n") + 5, "hop": F.lit(2).cast("long"), "seq": F.lit(1)}))


@PLANS.add(f"with {PAIRED} select * from paired")
def topology_edge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.paired(v.calls(spark, sf_dir))


@PLANS.add(f"""with {OBSERVED} select source, target, kind, observation, span_kinds, arg_min(n, {{'h': hop, 's': seq}}) as n, arg_min(errors, {{'h': hop, 's': seq}}) as errors, min(hop) as hop from observed group by 1, 2, 3, 4, 5""")
def topology_edge_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.once(observed(spark, sf_dir))


@PLANS.add(f"""with {OBSERVED}, o as (select source, target, kind, observation, span_kinds, arg_min(n, {{'h': hop, 's': seq}}) as n, arg_min(errors, {{'h': hop, 's': seq}}) as errors, min(hop) as hop from observed group by 1, 2, 3, 4, 5)
select * from o order by hop, errors / n desc, n desc, source, target, kind, observation, span_kinds limit 40""")
def topology_edge_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page(op.once(observed(spark, sf_dir)), 40)


@PLANS.add("""with p as (select l_suppkey as service, l_partkey % 10 as peer, l_linenumber as path, count(*) as n, max(l_extendedprice) as worst, avg(l_quantity) as middle from lineitem group by 1, 2, 3)
select service, peer, sum(n)::bigint as n, round(max(worst), 6) as worst, round(max(middle), 6) as middle from p group by 1, 2""")
def topology_upper_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = t.read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("service"), (F.col("l_partkey") % 10).alias("peer"), F.col("l_linenumber").alias("path"))
    paths = i.agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("worst"), F.avg("l_quantity").alias("middle"))
    return rounded(op.upper_bounds(paths, ["service", "peer"], ["worst", "middle"]))


@PLANS.add("""with a as (select 'a' || (s_suppkey % 70)::varchar as address, min(s_suppkey) as target_id from supplier group by 1)
select o_orderkey as id, 'a' || (o_custkey % 90)::varchar as peer, target_id from orders left join a on address = 'a' || (o_custkey % 90)::varchar""")
def topology_peer_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t.read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("a"), t.text(F.col("s_suppkey") % 70)).alias("address"), F.col("s_suppkey").alias("id"))
    o = t.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("a"), t.text(F.col("o_custkey") % 90)).alias("peer"))
    return op.by_address(o, s, "peer")


@PLANS.add("""with nodes as (select s_suppkey as node, min(case when s_suppkey % 5 > 0 then 'host' || (s_nationkey % 20)::varchar end) as host from supplier group by 1),
t as (select 'host' || n_nationkey::varchar as host, min(n_nationkey) as target_id from nation where n_nationkey % 4 > 0 group by 1)
select c_custkey as pod, c_custkey % 150 as node, n.host, target_id, case when n.host is null then 'no_node' when target_id is null then 'no_target' else 'resolved' end as state
from customer left join nodes n on node = c_custkey % 150 left join t on t.host = n.host""")
def topology_hosted_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda n: t.read_table(spark, sf_dir, n)
    host = lambda c: F.concat(F.lit("host"), t.text(c))
    pods = r("customer").select(F.col("c_custkey").alias("pod"), (F.col("c_custkey") % 150).alias("node"))
    nodes = r("supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 5 > 0, host(F.col("s_nationkey") % 20)).alias("host"))
    return op.hosted_on(pods, nodes, r("nation").filter("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("id"), host("n_nationkey").alias("name")))


@PLANS.add("""with i as (select distinct lower(l_returnflag) || '|' || (l_partkey % 400)::varchar as key, l_suppkey as id from lineitem),
r as (select *, row_number() over (partition by key order by id) as place from i)
select key, count(*) as candidates, string_agg(id::varchar, ',' order by id) filter (place <= 10) as ids, case when count(*) = 1 then min(id) end as target_id, case when count(*) = 1 then 'unique' else 'ambiguous' end as state from r group by 1""")
def topology_name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = t.read_table(spark, sf_dir, "lineitem")
    return op.unambiguous(i.select(F.concat(F.lower("l_returnflag"), F.lit("|"), t.text(F.col("l_partkey") % 400)).alias("key"), F.col("l_suppkey").alias("id")), "key")
