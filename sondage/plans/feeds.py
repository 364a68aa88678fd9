"""Queries over feeds of changes and events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import feeds as op
from sondage.plans.base import Plans, rounded
from sondage.sources import telemetry as t

PLANS = Plans()

FEED = f"""{t.CHANGES}, ro as (select '5-LOW' as category, 'O' as action union all select '4-NOT SPECIFIED', 'F'),
feed as (select 'audit' as source, id::varchar as ref, "at", 't' || (target_id % 50)::varchar as target_id, case when id % 3 = 0 then 'global' else 'target' end as scope from changes
    where not exists (select 1 from ro where ro.category = changes.category and ro.action = changes.action)
  union all select 'policy', event_id::varchar, ts, 't' || (user_id % 50)::varchar, 'target' from events where event_type = 'signup'
  union all select 'collector', event_id::varchar, ts, null, 'control' from events where event_type = 'click')"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read_table(spark, sf_dir, "events")
    read_only = spark.createDataFrame([("5-LOW", "O"), ("4-NOT SPECIFIED", "F")], "category string, action string")
    audit = op.exposed(t.changes(spark, sf_dir), read_only)
    own = lambda c: F.concat(F.lit("t"), t.text(F.col(c) % 50)).alias("target_id")
    ref = t.text("event_id").alias("ref")
    return op.union({
        "audit": audit.select(t.text("id").alias("ref"), "at", own("target_id"), F.when(F.col("id") % 3 == 0, "global").otherwise("target").alias("scope")),
        "policy": e.filter("event_type = 'signup'").select(ref, F.col("ts").alias("at"), own("user_id"), F.lit("target").alias("scope")),
        "collector": e.filter("event_type = 'click'").select(ref, F.col("ts").alias("at"), F.lit("control").alias("scope")),
    })


@PLANS.add(f"with {FEED} select * from feed")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir)


@PLANS.add(f"""with {FEED}, b as (select *, case when target_id = 't7' then 0 when scope = 'target' then 1 when scope = 'global' then 2 else 3 end as bucket from feed) select * from b order by bucket, "at" desc, source, ref limit 60""")
def change_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.change_page(feed(spark, sf_dir), "t7", 60)


@PLANS.add(f"""with {FEED} select source, ref, feed.target_id, n_name as name from feed left join nation on 't' || n_nationkey::varchar = feed.target_id""")
def change_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t.read_table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), t.text("n_nationkey")).alias("target_id"), F.col("n_name").alias("name"))
    return op.with_names(feed(spark, sf_dir), names, "target_id").select("source", "ref", "target_id", "name")


@PLANS.add("""with n as (select distinct unnest(['Supplier#' || s_suppkey::varchar, 'c' || (s_suppkey * 3)::varchar]) as name from supplier) select o_orderkey as id, 'c' || o_custkey::varchar as name from orders where 'c' || o_custkey::varchar in (select name from n)""")
def change_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = t.read_table(spark, sf_dir, "supplier").select(F.array(F.concat(F.lit("Supplier#"), t.text("s_suppkey")), F.concat(F.lit("c"), t.text(F.col("s_suppkey") * 3))).alias("names"))
    rows = t.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), t.text("o_custkey")).alias("name"))
    return op.of_names(rows, owners, "name")


@PLANS.add("""select l_orderkey::varchar as id, (l_suppkey % 10)::varchar as target_id, (l_partkey % 10)::varchar as host_target_id, l_returnflag as flag, l_linestatus as line from lineitem
where (l_suppkey % 10 = 3 or l_partkey % 10 = 3) and l_orderkey in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144) and l_returnflag = 'R'""")
def attributed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read_table(spark, sf_dir, "lineitem").select(
        t.text("l_orderkey").alias("id"), t.text(F.col("l_suppkey") % 10).alias("target_id"), t.text(F.col("l_partkey") % 10).alias("host_target_id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line")
    )
    return op.asked_for(rows, "3", [str(i) for i in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)], flag="R", line="")


@PLANS.add("""with h as (select target_id, min(h) as horizon from (select user_id as target_id, max(ts) as h from events where event_type = 'view' group by 1 union all select user_id, max(ts) from events where event_type = 'error' group by 1) group by 1)
select *, case when horizon > '2024-01-10' then timestamp '2024-01-10' end as observed_from, case when horizon > '2024-01-10' then least(timestamp '2024-01-25', horizon) end as observed_to from h""")
def arrival_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read_table(spark, sf_dir, "events").withColumn("target_id", F.col("user_id"))
    return op.observed_range(op.horizons([e.filter("event_type = 'view'"), e.filter("event_type = 'error'")]), datetime(2024, 1, 10), datetime(2024, 1, 25))


@PLANS.add("""select event_id as id, case event_id % 5 when 0 then ts when 1 then ts - to_hours(event_id % 9) - to_minutes(30) when 2 then ts - to_seconds(event_id % 99) when 3 then timestamp '2024-01-05 06:00:00' end as "at" from events""")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = t.read_table(spark, sf_dir, "events"), F.col("event_id")
    said = F.when(i % 5 == 0, "now").when(i % 5 == 1, F.concat(F.lit("now-"), t.text(i % 9), F.lit("h30m"))).when(i % 5 == 2, F.concat(F.lit("now-"), t.text(i % 99), F.lit("s")))
    said = said.when(i % 5 == 3, "2024-01-05 06:00:00").otherwise("then-5x")
    return e.select(i.alias("id"), op.flexible_time(said, F.col("ts")).alias("at"))


@PLANS.add(f"""with {t.METRICS}, s as (select distinct name, target_id from metrics) select *, case when name in ('view', 'click') then 'counter' else 'gauge' end as kind, false as degraded from s""")
def metric_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = spark.createDataFrame([("view", "counter_total"), ("click", "counter"), ("error", "gauge")], "name string, value_type string")
    return op.value_kinds(t.metrics(spark, sf_dir).select("name", "target_id").distinct(), catalogue)


@PLANS.add("""with c as (select distinct user_id, ts from events where event_type = 'signup'), a as (select event_id as id, user_id, ts from events where event_type = 'error')
select id, user_id, a.ts, (select c.ts from c where c.user_id = a.user_id order by abs(epoch_us(c.ts) - epoch_us(a.ts)), c.ts limit 1) as captured from a""")
def nearest_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.read_table(spark, sf_dir, "events")
    asked = e.filter("event_type = 'error'").select(F.col("event_id").alias("id"), "user_id", "ts")
    return op.nearest(asked, e.filter("event_type = 'signup'"), "user_id")


@PLANS.add("""with p as (select l_suppkey as query, l_partkey % 20 as plan_hash, max(l_shipdate) as captured from lineitem group by 1, 2), r as (select *, row_number() over (partition by query order by captured desc, plan_hash) as place from p) select * from r where place <= 3""")
def plan_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = t.read_table(spark, sf_dir, "lineitem")
    return op.latest_plans(i.select(F.col("l_suppkey").alias("query"), (F.col("l_partkey") % 20).alias("plan_hash"), F.col("l_shipdate").alias("captured")))


@PLANS.add("""select l_partkey as key, l_partkey % 4 = 0 as monitoring, sum(l_quantity)::bigint as execs from lineitem group by 1, 2 order by monitoring, execs desc, key limit 25""")
def statement_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = t.read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key"), (F.col("l_partkey") % 4 == 0).alias("monitoring"))
    return op.statement_page(i.agg(F.sum("l_quantity").cast("long").alias("execs")), "execs", 25)


@PLANS.add(f"""with {t.METRICS} select name, target_id, floor((epoch_us(ts) - epoch_us(timestamp '2024-01-03')) / 21600000000)::bigint + 1 as step, round(arg_max(value, {{'t': ts, 'v': value}}), 6) as value
from metrics where ts >= '2024-01-03' and ts < '2024-01-20' group by 1, 2, 3""")
def metric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.at_steps(t.metrics(spark, sf_dir), datetime(2024, 1, 3), datetime(2024, 1, 20), 21_600))


@PLANS.add(f"with {t.METRICS} select distinct dim as value from metrics where ts >= '2024-01-03' and ts < '2024-01-20'")
def metric_label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.label_values(t.metrics(spark, sf_dir), "dim", datetime(2024, 1, 3), datetime(2024, 1, 20))


@PLANS.add(f"""with {t.CHANGES} select id, "at", target_id, "at" > '1999-06-01' as late from changes where "at" < '1999-09-01' and target_id in (select c_custkey from customer where c_acctbal < 0)""")
def change_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = t.read_table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("target_id"))
    return op.scanned_changes(t.changes(spark, sf_dir), members, datetime(1999, 6, 1), datetime(1999, 9, 1)).select("id", "at", "target_id", "late")
