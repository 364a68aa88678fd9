"""Queries over the topology around a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import topology as op
from sondage.plans.base import Plans
from sondage.sources import durable
from sondage.sources import telemetry as t

PLANS = Plans()


def inventory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Applications (suppliers and parts) that call each other, their hosts, and the switches of those; edges and nodes."""
    r = lambda n: t.read_table(spark, sf_dir, n)
    i = lambda p, c: F.concat(F.lit(p), t.text(c))
    e = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind")).distinct()
    line, part, orders = r("lineitem"), r("part"), r("orders")
    size, switch = F.col("p_size"), F.col("p_size") % 7
    edges = e(line.filter("l_partkey % 4 > 0"), i("s", "l_suppkey"), i("p", "l_partkey"), "sync_call")
    edges = edges.union(e(line.filter("l_partkey % 4 = 0"), i("p", "l_partkey"), i("s", "l_suppkey"), "async_candidate"))
    edges = edges.union(e(line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("o_custkey % 5 = 0"), i("s", "l_suppkey"), i("d", "o_custkey"), "apm_db"))
    edges = edges.union(e(part.filter("p_partkey % 3 = 0"), i("p", "p_partkey"), i("h", size), "hosted_on"))
    edges = edges.union(e(part, i("h", size), i("w", switch), "network_fdb")).union(e(part, i("w", switch), i("w", switch + 1), "network_lldp"))
    node = lambda df, c, kind: df.select(c.alias("node"), F.lit(kind).alias("type")).distinct()
    nodes = node(r("supplier"), i("s", "s_suppkey"), "application").union(node(part, i("p", "p_partkey"), "application"))
    edges = durable(edges, "topology")  # five shuffles that each step of each hop would repeat
    return edges, nodes.union(node(part, i("h", size), "server")).union(node(part, i("w", switch), "network"))


def _sql(seeds: str, hops: int, most_nodes: int, most_edges: int) -> str:
    ctes = [f"""edges as (select distinct 's' || l_suppkey::varchar as src, 'p' || l_partkey::varchar as dst, 'sync_call' as kind from lineitem where l_partkey % 4 > 0
  union all select distinct 'p' || l_partkey::varchar, 's' || l_suppkey::varchar, 'async_candidate' from lineitem where l_partkey % 4 = 0
  union all select distinct 's' || l_suppkey::varchar, 'd' || o_custkey::varchar, 'apm_db' from lineitem join orders on l_orderkey = o_orderkey where o_custkey % 5 = 0
  union all select distinct 'p' || p_partkey::varchar, 'h' || p_size::varchar, 'hosted_on' from part where p_partkey % 3 = 0
  union all select distinct 'h' || p_size::varchar, 'w' || (p_size % 7)::varchar, 'network_fdb' from part
  union all select distinct 'w' || (p_size % 7)::varchar, 'w' || (p_size % 7 + 1)::varchar, 'network_lldp' from part),
nodes as (select 's' || s_suppkey::varchar as node, 'application' as type from supplier union select 'p' || p_partkey::varchar, 'application' from part
  union select 'h' || p_size::varchar, 'server' from part union select 'w' || (p_size % 7)::varchar, 'network' from part),
n0 as (select node, type, 0 as hop from nodes where node in ({seeds})), e0 as (select *, 0 as hop from edges where false)"""]
    # one hop after the other as plain sets; a is the calls, b the hosts, c the network
    for h in range(1, hops + 1):
        before = f"(select node from n{h - 1})"
        new = lambda e, *had: f"""select x.node, coalesce(type, 'peer') as type, {h} as hop from (select src as node from {e} union select dst from {e}) x left join nodes using (node)
  where x.node not in {before}""" + "".join(f" and x.node not in (select node from {n})" for n in had)  # noqa: B023, E731
        last = f"(select node, type from n{h - 1} where hop = {h - 1}"
        one = f"where (src, dst, kind) not in (select (src, dst, kind) from e{h - 1})"
        ctes.append(f"""f{h}a as (select node from {last}) where type = 'application'), e{h}a as (select *, {h} as hop from edges {one} and (kind in ('sync_call', 'async_candidate', 'apm_db') and src in (select node from f{h}a)
    or kind in ('sync_call', 'async_candidate') and dst in (select node from f{h}a))), n{h}a as ({new(f"e{h}a")}),
f{h}b as (select node from {last} union select node, type from n{h}a) where type = 'application'), e{h}b as (select *, {h} as hop from edges {one} and kind = 'hosted_on' and src in (select node from f{h}b)), n{h}b as ({new(f"e{h}b", f"n{h}a")}),
f{h}c as (select node from {last} union select node, type from n{h}a union select node, type from n{h}b) where type in ('server', 'network')),
e{h}c as (select *, {h} as hop from edges {one} and kind in ('network_fdb', 'network_lldp') and src in (select node from f{h}c)), n{h}c as ({new(f"e{h}c", f"n{h}a", f"n{h}b")}),
n{h} as (select * from n{h - 1} union all select * from n{h}a union all select * from n{h}b union all select * from n{h}c), e{h} as (select * from e{h - 1} union all select * from e{h}a union all select * from e{h}b union all select * from e{h}c)""")
    counts = " union all ".join(f"select {h} as hop, (select count(*) from n{h}) as n, (select count(*) from e{h}) as e" for h in range(1, hops + 1))
    return f"""with {", ".join(ctes)}, cut as (select min(hop) as cut from ({counts}) where n >= {most_nodes} or e >= {most_edges})
select 'node' as row, node as a, null as b, type as kind, hop::bigint as hop, coalesce(hop = cut, false) as boundary from n{hops}, cut where hop <= coalesce(cut, {hops})
union all select 'edge', src, dst, kind, hop, false from e{hops}, cut where hop <= coalesce(cut, {hops})
union all select 'unknown_seed', s, null, null, null, false from (select unnest([{seeds}]) as s) where s not in (select node from nodes)
union all select 'coverage', null, null, case when cut is null then 'complete' else 'truncated' end, cut, false from cut"""


def _seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node string")


@PLANS.add(_sql("'p3', 'x9'", 2, 1 << 40, 1 << 40))
def topology_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = inventory(spark, sf_dir)
    return op.report(op.expand(edges, nodes, _seeds(spark, "p3", "x9"), 2, most_nodes=1 << 40, most_edges=1 << 40))


@PLANS.add(_sql("'h1'", 3, op.MAX_NODES, op.MAX_EDGES))
def topology_expansion_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = inventory(spark, sf_dir)
    return op.report(op.expand(edges, nodes, _seeds(spark, "h1"), 3))


@PLANS.add(_sql("'s1'", 3, op.MAX_NODES, op.MAX_EDGES))
def topology_expansion_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = inventory(spark, sf_dir)
    return op.report(op.expand(edges, nodes, _seeds(spark, "s1"), 3))
