"""Candidates from the orders: their lines are the predictions, older lines what is measured, suppliers the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import admission as op
from sondage.plans.base import Plans
from sondage.sources import telemetry as t

PLANS = Plans()


def _admission(spark: SparkSession, sf_dir: str) -> op.Admission:
    s = lambda p, c: F.concat(F.lit(p), t.text(c))
    flag, part, number = F.col("l_returnflag"), F.col("l_partkey"), F.col("l_linenumber")
    predicate = F.element_at(F.array(F.lit("direction_up"), F.lit("present"), F.lit("magnitude_ge")), (number % 3 + 1).cast("int"))
    line = t.read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("candidate"), number.cast("long").alias("seq"),
        F.when(flag == "R", "scan_metrics").when(flag == "A", "db_slow_queries").otherwise("list_events").alias("source"), s("t", "l_suppkey").alias("target_id"),
        F.when(part % 61 == 0, "log").when(flag == "R", "metric").when(flag == "A", "db").otherwise("event").alias("aspect"), s("m", part % 5).alias("metric"),
        F.lit("").alias("entity_key"), F.lit("full").alias("window"), predicate.alias("predicate"),
        F.when((number % 3 == 2) & (part % 59 > 0), (F.col("l_quantity") % 3)).alias("threshold"), F.when(F.col("l_linestatus") == "O", "must_hold").otherwise("must_not_hold").alias("expectation"),
        F.when(number % 2 == 1, "necessary").otherwise("corroborating").alias("role"), F.when(number == 1, s("E", "l_orderkey")).alias("eid_hint"), part.alias("part"), (F.col("l_tax") > 0.03).alias("high"),
    )
    orders = t.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate"), F.concat(F.lit("E"), t.text("o_orderkey")).alias("eid"))
    key = [F.col(c) for c in op.SELECTOR]
    truths = line.filter("part % 3 = 0").groupBy(*key, F.lit("onset_narrow").alias("window"), "predicate", "threshold").agg(F.bool_or("high").alias("truth"))
    first = line.filter("seq = 1").select(
        F.col("eid_hint").alias("eid"), "source", F.when(F.col("candidate") % 7 == 0, "elsewhere").otherwise(F.col("target_id")).alias("target_id"), "aspect", "metric", "entity_key", "window", (F.col("candidate") % 9 > 0).alias("active")
    )
    vocabulary = t.read_table(spark, sf_dir, "supplier").filter("s_suppkey % 17 > 0").select(s("t", "s_suppkey").alias("target_id"))
    return op.admit(orders.select("candidate"), line.drop("part", "high"), orders.filter("candidate % 5 > 0"), vocabulary, truths, first)


PARTS = """l as (select l_orderkey as candidate, l_linenumber::bigint as seq, l_returnflag as flag, l_suppkey as target, case when l_partkey % 61 = 0 then 'log' else l_returnflag end as aspect, l_partkey % 5 as metric, l_partkey as part,
    l_linenumber % 3 as predicate, case when l_linenumber % 3 = 2 and l_partkey % 59 > 0 then l_quantity % 3 end as threshold, l_linestatus = 'O' as expected, l_linenumber % 2 = 1 as necessary, l_tax > 0.03 as high from lineitem),
form as (select candidate, seq, '1c' as rule, 'threshold_missing' as reason from l where predicate = 2 and threshold is null
  union all select candidate, seq, '1a', 'target' from l where target % 17 = 0 union all select candidate, seq, '1b', 'aspect' from l where aspect = 'log'),
sound as (select o_orderkey as candidate from orders where o_orderkey not in (select candidate from form)),
truths as (select flag, target, aspect, metric, predicate, coalesce(threshold, -1) as threshold, bool_or(high) as truth from l where part % 3 = 0 group by all),
seen as (select l.candidate, seq, truth, necessary, coalesce(truth = expected, false) as pre from l join sound using (candidate)
  left join truths x on l.flag = x.flag and l.target = x.target and l.aspect = x.aspect and l.metric = x.metric and l.predicate = x.predicate and coalesce(l.threshold, -1) = x.threshold),
firsts as (select candidate from l where seq = 1),
tied as (select candidate, case when candidate not in (select candidate from firsts) then 'unknown' when candidate % 9 = 0 then 'superseded' when candidate % 7 = 0 then 'selector' end as reason from sound where candidate % 5 > 0),
per as (select s.candidate, count(seq) as predictions, count(*) filter (pre) as pre_satisfied, count(*) filter (seq is not null and truth is null) as open, count(*) filter (necessary and not pre) as live,
  (select count(*) from tied x where x.candidate = s.candidate and reason is null) as bound from sound s left join seen on s.candidate = seen.candidate group by s.candidate)"""


@PLANS.add(f"""with {PARTS} select candidate, predictions, pre_satisfied, bound, bound > 0 and open > 0 and live > 0 as admitted from per
union all select candidate, count(*), 0, 0, false from l where candidate in (select candidate from form) group by candidate""")
def admission_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admission(spark, sf_dir).decisions


@PLANS.add(f"""with {PARTS} select * from form union all select candidate, null, 'support', 'unbound' from per where bound = 0
union all select candidate, null, '3a', 'all_measured' from per where open = 0 union all select candidate, null, '3b', 'none_necessary_open' from per where live = 0""")
def admission_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admission(spark, sf_dir).violations


@PLANS.add(f"""with {PARTS} select candidate, 'E' || candidate::varchar as eid, reason from tied where reason is not null""")
def admission_unbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admission(spark, sf_dir).unbound


@PLANS.add(f"""with {PARTS} select distinct candidate, seq, 'undecidable' as tag from form union all select candidate, seq, 'pre_satisfied' from seen where pre""")
def admission_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admission(spark, sf_dir).tags
