"""Session polls and service calls as views over the driver's tables, each with the SQL of the same relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.sources.tables import read_table
from sondage.sources.telemetry import text


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """database, engine, poll, body (JSON with the keys of the engine; some bodies are no JSON, some numbers no numbers)"""
    i = read_table(spark, sf_dir, "lineitem")
    kind = F.col("l_orderkey") % 4
    engine = F.when(kind == 0, "postgresql").when(kind == 1, "oracle").when(kind == 2, "mysql").otherwise("other")
    own = F.when(kind == 0, "pid").when(kind == 1, "sid").otherwise("tid")
    other = F.when(kind == 0, "blockingPid").when(kind == 1, "blockingSession").otherwise("blockingTid")
    blocker = F.when(F.col("l_partkey") % 11 == 0, '"none"').otherwise(text(F.col("l_partkey") % 8))
    body = F.concat(
        F.lit('{"'), own, F.lit('":'), text("l_linenumber"), F.lit(',"'), other, F.lit('":'), blocker, F.lit(',"waitEvent":"w'), text(F.col("l_suppkey") % 3),
        F.lit('","event":"e'), text(F.col("l_suppkey") % 4), F.lit('","sqlHash":'), text(F.col("l_partkey") % 50), F.lit(',"sqlId":"s'), text(F.col("l_partkey") % 50), F.lit('"}'),
    )
    return i.select(
        F.concat(F.lit("d"), text(F.col("l_orderkey") % 40)).alias("database"), engine.alias("engine"), F.col("l_orderkey").alias("poll"),
        F.when(F.col("l_quantity") == 50, "no json").otherwise(body).alias("body"),
    )


SESSIONS = """sessions as (select 'd' || (l_orderkey % 40)::varchar as database, case l_orderkey % 4 when 0 then 'postgresql' when 1 then 'oracle' when 2 then 'mysql' else 'other' end as engine,
  l_orderkey as poll, case when l_quantity = 50 then 'no json' else '{"' || case l_orderkey % 4 when 0 then 'pid' when 1 then 'sid' else 'tid' end || '":' || l_linenumber::varchar
  || ',"' || case l_orderkey % 4 when 0 then 'blockingPid' when 1 then 'blockingSession' else 'blockingTid' end || '":' || case when l_partkey % 11 = 0 then '"none"' else (l_partkey % 8)::varchar end
  || ',"waitEvent":"w' || (l_suppkey % 3)::varchar || '","event":"e' || (l_suppkey % 4)::varchar || '","sqlHash":' || (l_partkey % 50)::varchar || ',"sqlId":"s' || (l_partkey % 50)::varchar || '"}' end as body
  from lineitem)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, trace_id, span_id, parent_span_id, service, kind, name, attributes (a map without empty values), status, error, target_id"""
    i = read_table(spark, sf_dir, "lineitem")
    turn, supp = F.col("l_partkey") % 5, F.col("l_suppkey")
    kind = F.when(turn == 0, "SERVER").when(turn == 1, "CONSUMER").when(turn == 2, "INTERNAL").when(turn == 3, "CLIENT").otherwise("PRODUCER")
    code = F.when(F.col("l_quantity") < 10, "").when(F.col("l_quantity") < 20, "500").when(F.col("l_quantity") < 30, "404").otherwise("200")
    pairs = {
        "db.system": F.when(supp % 3 == 0, "pg").otherwise(""), "db.operation": F.when(supp % 2 == 0, "SELECT").otherwise(""),
        "url.full": F.when(supp % 3 == 1, "u").otherwise(""), "http.request.method": F.lit("GET"), "server.address": F.concat(F.lit("h"), text(supp % 4)),
        "server.port": F.when(supp % 4 == 1, "8080").otherwise(""), "http.response.status_code": code,
    }
    attributes = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v != "")
    return i.select(
        F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") - 1).alias("parent_span_id"), F.concat(F.lit("v"), text(supp % 6)).alias("service"), kind.alias("kind"),
        F.concat(F.lit("op"), text(F.col("l_partkey") % 7)).alias("name"), attributes.alias("attributes"), F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("OK").alias("status"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("x"), text(F.col("l_partkey") % 6))).alias("error"), text(supp % 5).alias("target_id"),
    )


CALLS = """calls as (select l_shipdate as ts, l_orderkey as trace_id, l_linenumber as span_id, case when l_linenumber > 1 then l_linenumber - 1 end as parent_span_id, 'v' || (l_suppkey % 6)::varchar as service,
  case l_partkey % 5 when 0 then 'SERVER' when 1 then 'CONSUMER' when 2 then 'INTERNAL' when 3 then 'CLIENT' else 'PRODUCER' end as kind, 'op' || (l_partkey % 7)::varchar as name,
  case when l_suppkey % 3 = 0 then 'pg' end as db_system, case when l_suppkey % 2 = 0 then 'SELECT' end as db_operation, case when l_suppkey % 3 = 1 then 'u' end as url, 'h' || (l_suppkey % 4)::varchar as address,
  case when l_suppkey % 4 = 1 then '8080' end as port, case when l_quantity < 10 then null when l_quantity < 20 then 500 when l_quantity < 30 then 404 else 200 end as code,
  case when l_returnflag = 'R' then 'ERROR' else 'OK' end as status, case when l_returnflag = 'R' then 'x' || (l_partkey % 6)::varchar end as error, (l_suppkey % 5)::varchar as target_id from lineitem)"""
