"""Canonical telemetry views over the driver's tables. Operators know these schemas only.

Each view has a DataFrame form and the SQL of the same relation, which the checks put before their own query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.sources.tables import read_table


def text(c: str | object) -> object:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, name, target_id, grade, dim, value"""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        "ts", F.col("event_type").alias("name"), text(F.col("user_id") % 10).alias("target_id"),
        text(F.col("event_id") % 3).alias("grade"), text(F.col("user_id") % 7).alias("dim"), "value",
    )


METRICS = """metrics as (select ts, event_type as name, (user_id % 10)::varchar as target_id, (event_id % 3)::varchar as grade,
  (user_id % 7)::varchar as dim, value from events)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, trace_id, span_id, parent_span_id, service, kind, status, duration_ms, label, route, code"""
    line, orders, supplier, nation = (read_table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "nation"))
    at = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    at = at.join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return at.select(
        F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").cast("long").alias("span_id"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("long") - 1).alias("parent_span_id"),
        F.col("n_name").alias("service"),
        F.when(F.col("l_linestatus") == "O", "SERVER").otherwise("CLIENT").alias("kind"),
        F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("OK").alias("status"),
        (F.col("l_extendedprice") / 100).alias("duration_ms"), F.col("o_orderpriority").alias("label"),
        F.concat(F.lit("/"), F.lower("l_returnflag"), F.lit("/"), text(F.col("l_partkey") % 5)).alias("route"),
        F.when(F.col("l_returnflag") == "R", 500).when(F.col("l_tax") >= 0.06, 404).otherwise(200).alias("code"),
    )


SPANS = """spans as (select l_shipdate as ts, l_orderkey as trace_id, l_linenumber::bigint as span_id,
  case when l_linenumber > 1 then l_linenumber::bigint - 1 end as parent_span_id, n_name as service,
  case when l_linestatus = 'O' then 'SERVER' else 'CLIENT' end as kind, case when l_returnflag = 'R' then 'ERROR' else 'OK' end as status,
  l_extendedprice / 100 as duration_ms, o_orderpriority as label, '/' || lower(l_returnflag) || '/' || (l_partkey % 5)::varchar as route,
  case when l_returnflag = 'R' then 500 when l_tax >= 0.06 then 404 else 200 end as code
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join orders on l_orderkey = o_orderkey)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of database statements: ts, sql_key, mode, latency_ms, execs"""
    return read_table(spark, sf_dir, "lineitem").select(
        F.date_trunc("day", "l_shipdate").alias("ts"), F.concat(F.lit("q"), text(F.col("l_partkey") % 50)).alias("sql_key"),
        F.col("l_linestatus").alias("mode"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("latency_ms"), F.col("l_quantity").alias("execs"),
    )


STATEMENTS = """statements as (select date_trunc('day', l_shipdate) as ts, 'q' || (l_partkey % 50)::varchar as sql_key, l_linestatus as mode,
  l_extendedprice / l_quantity as latency_ms, l_quantity as execs from lineitem)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert transitions: event_id, at, episode_id, transition, severity, detector"""
    e = read_table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "purchase", "close").otherwise("other")
    return e.select(
        "event_id", F.col("ts").alias("at"), F.col("user_id").alias("episode_id"), kind.alias("transition"),
        F.floor("value").cast("long").alias("severity"), F.concat(F.lit("d"), text(F.col("user_id") % 6)).alias("detector"),
    )


TRANSITIONS = """transitions as (select event_id, ts as "at", user_id as episode_id,
  case event_type when 'signup' then 'open' when 'purchase' then 'close' else 'other' end as transition,
  floor(value)::bigint as severity, 'd' || (user_id % 6)::varchar as detector from events)"""


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session polls of databases: engine, ts, blocked, rows"""
    e = read_table(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("e"), text(F.col("user_id") % 3)).alias("engine"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.count_if(F.col("event_type") == "error").alias("blocked"), F.count(F.lit(1)).alias("rows")
    )


POLLS = """polls as (select 'e' || (user_id % 3)::varchar as engine, date_trunc('hour', ts) as ts,
  count(*) filter (event_type = 'error') as blocked, count(*) as rows from events group by all)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory: id, name, type, parent_id, group_id"""
    s, n, r = (read_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    i = lambda p, c: F.concat(F.lit(p), text(c))
    one = s.select(i("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("host").alias("type"), i("n", "s_nationkey").alias("parent_id"), i("g", F.col("s_suppkey") % 4).alias("group_id"))
    two = n.select(i("n", "n_nationkey"), "n_name", F.lit("cluster"), i("r", "n_regionkey"), i("g", F.col("n_nationkey") % 4))
    three = r.select(i("r", "r_regionkey"), "r_name", F.lit("site"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return one.union(two).union(three)


TARGETS = """targets as (
  select 's' || s_suppkey::varchar as id, s_name as name, 'host' as type, 'n' || s_nationkey::varchar as parent_id, 'g' || (s_suppkey % 4)::varchar as group_id from supplier
  union all select 'n' || n_nationkey::varchar, n_name, 'cluster', 'r' || n_regionkey::varchar, 'g' || (n_nationkey % 4)::varchar from nation
  union all select 'r' || r_regionkey::varchar, r_name, 'site', null, null from region)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit trail: id, at, category, target_id, action, detail"""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("category"),
        F.col("o_custkey").alias("target_id"), F.col("o_orderstatus").alias("action"), F.floor(F.col("o_totalprice") / 50000).cast("long").alias("detail"),
    )


CHANGES = """changes as (select o_orderkey as id, o_orderdate as "at", o_orderpriority as category, o_custkey as target_id, o_orderstatus as action,
  floor(o_totalprice / 50000)::bigint as detail from orders)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines: stream, seq, at_day, severity, body"""
    k = read_table(spark, sf_dir, "conversations")
    severity = F.when(F.col("role") == "user", 9).when(F.col("role") == "assistant", 13).otherwise(17)
    return k.select(
        F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), severity.cast("long").alias("severity"),
        F.concat(F.lit("conn "), text("conv_id"), F.lit(" id "), F.substring(F.md5(text("turn").cast("binary")), 1, 10), F.lit(" "), F.col("text")).alias("body"),
    )


LOGS = """logs as (select conv_id as stream, turn as seq, (case role when 'user' then 9 when 'assistant' then 13 else 17 end)::bigint as severity,
  'conn ' || conv_id::varchar || ' id ' || substring(md5(turn::varchar), 1, 10) || ' ' || text as body from conversations)"""
