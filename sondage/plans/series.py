"""Metric queries. Two windows of 15 days, buckets of 6 hours; thresholds scaled to the tables' small movements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import series as op
from sondage.plans.base import Plans, rounded
from sondage.sources import telemetry as t

PLANS = Plans()
BASE, MIDDLE, END, STEP = "2024-01-01", "2024-01-16", "2024-01-31", 21600
SHIFTED = 0.2
BOTH = f"""with {t.METRICS},
raw as (select *, (floor(epoch(ts) / {STEP}) * {STEP})::bigint as bucket, ts >= timestamp '{MIDDLE}' as cur from metrics
  where ts >= timestamp '{BASE}' and ts < timestamp '{END}'),
b as (select name, dim, target_id, grade, bucket, cur, avg(value) as value from raw group by all),
f as (select name, dim, target_id, bucket, cur, max(value) as value, max(value) - min(value) > 1e-9 * greatest(abs(max(value)), abs(min(value))) as mismatch from b group by all),
m as (select name || '.' || target_id as name, bucket, cur, avg(value) as value from f group by all),
s as (select name, cur, count(*) as n, median(value) as med, max(abs(value)) as scale from m group by all),
d as (select m.name, m.cur, median(abs(value - med)) as mad from m join s on m.name = s.name and m.cur = s.cur group by all),
bs as (select s.name, n, med, scale, mad from s join d on s.name = d.name and not s.cur and not d.cur),
cs as (select name, n, med, scale from s where cur)"""


def windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Current and baseline: means by (metric, target) and bucket, grades folded."""

    def one(start: str, end: str) -> DataFrame:
        rows = op.within(t.metrics(spark, sf_dir), start, end)
        folded = op.fold_grade(op.bucket_mean(rows, ["name", "dim", "target_id", "grade"], STEP), ["name", "dim", "target_id"])
        return op.mean_over(folded.withColumn("name", F.concat_ws(".", "name", "target_id")))

    return one(MIDDLE, END), one(BASE, MIDDLE)


CLASSES = """select coalesce(cs.name, bs.name) as name,
  case when cs.n is null then 'disappeared' when bs.n is null then 'appeared' when {z} >= {shifted} then 'shifted' else 'steady' end as class,
  round(case when cs.n is not null and bs.n is not null then {z} end, 6) as z, round(cs.med, 6) as current_median, round(bs.med, 6) as baseline_median,
  coalesce(bs.n, 0) / 60 < 0.3 as intermittent, coalesce(bs.n, 0) < 10 as thin
  from cs full join bs on cs.name = bs.name""".format(
    shifted=SHIFTED,
    z="abs(cs.med - bs.med) / greatest(1.4826 * mad, 0.05 * abs(bs.med), 0.01 * case when greatest(cs.scale, bs.scale) = 0 then 1 else greatest(cs.scale, bs.scale) end, 1e-9)",
)


@PLANS.add(f"{BOTH} {CLASSES}")
def scan_metrics_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.classify(*windows(spark, sf_dir), 60, SHIFTED))


@PLANS.add(f"{BOTH} select class, count(*) as n from ({CLASSES}) group by class")
def scan_metrics_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.classify(*windows(spark, sf_dir), 60, SHIFTED).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@PLANS.add(f"{BOTH} select name, z, least(z, 0.5) as shown_z, row_number() over (order by z desc, name) as rank from ({CLASSES}) where z is not null order by rank limit 20")
def robust_z_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rounded(op.classify(*windows(spark, sf_dir), 60, SHIFTED)).filter("z is not null")
    top = rows.orderBy(F.desc("z"), "name").limit(20)  # a report of the 20 largest; ordered by the uncapped value
    rank = F.row_number().over(op.W.orderBy(F.desc("z"), "name")).cast("long")
    return top.select("name", "z", F.least("z", F.lit(0.5)).alias("shown_z"), rank.alias("rank"))


@PLANS.add(f"{BOTH} select name, count(*) filter (mismatch) as mismatches, count(*) as buckets from f group by name")
def grade_fold_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.within(t.metrics(spark, sf_dir), BASE, END)
    folded = op.fold_grade(op.bucket_mean(rows, ["name", "dim", "target_id", "grade"], STEP), ["name", "dim", "target_id"])
    return folded.groupBy("name").agg(F.count_if("mismatch").alias("mismatches"), F.count(F.lit(1)).alias("buckets"))


@PLANS.add(f"{BOTH} select name, bucket, round(value, 6) as value from m")
def timeseries_bucket_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, b = windows(spark, sf_dir)
    return rounded(c.unionByName(b))


TOP = """g as (select dim, bucket, sum(value) as value from b group by all),
r as (select dim, row_number() over (order by sum(value) desc, dim) as rank from g group by dim)"""


@PLANS.add(f"{BOTH}, {TOP} select case when rank <= 3 then g.dim else '(other)' end as \"group\", bucket, round(sum(value), 4) as value from g join r using (dim) group by all")
def timeseries_group_topn_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.bucket_mean(op.within(t.metrics(spark, sf_dir), BASE, END), ["name", "dim", "target_id", "grade"], STEP)
    return rounded(op.top_groups(rows.groupBy("dim", "bucket").agg(F.sum("value").alias("value")), "dim", 3), 4)


@PLANS.add(f"{BOTH}, i as (select name, bucket, value - lag(value) over (partition by name order by bucket) as step from m) select name, bucket, round(case when step < 0 then 0 else step end, 6) as value from i where step is not null")
def counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, b = windows(spark, sf_dir)
    return rounded(op.increases(c.unionByName(b)))


ONSET = """o as (select m.name, bucket, value, row_number() over w as i, lag(bucket) over w as before,
    (abs(value - bs.med) / greatest(1.4826 * mad, 0.05 * abs(bs.med), 0.01 * case when greatest(cs.scale, bs.scale) = 0 then 1 else greatest(cs.scale, bs.scale) end, 1e-9) >= 1.5)::int as over
  from m join bs on m.name = bs.name join cs on m.name = cs.name where m.cur window w as (partition by m.name order by bucket)),
p as (select *, sum(over) over (partition by name order by bucket rows between current row and 2 following) as near from o),
q as (select name, min(i) as i from p where over = 1 and near >= 2 and name in (select name from cs where n / 60 >= 0.3) group by name),
onset as (select p.name, before as onset_from, bucket as onset_to, case when p.i = 1 then 'outside_window' else 'found' end as state from p join q on p.name = q.name and p.i = q.i)"""


@PLANS.add(f"{BOTH}, {ONSET} select * from onset")
def onset_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.onset(*windows(spark, sf_dir), 1.5, expected=60)


@PLANS.add(f"""{BOTH}, {ONSET}, l as (select name, onset_from, onset_to, lag(onset_to) over (order by onset_from, onset_to, name) as before from onset where state = 'found')
select name, onset_from, onset_to, case when before is null then 'first' when onset_from < before then 'indeterminate' else 'after' end as versus_previous,
  case when onset_from >= before then onset_from - before end as gap_seconds from l""")
def onset_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.timeline(op.onset(*windows(spark, sf_dir), 1.5, expected=60))


@PLANS.add(f"""{BOTH}, r as (select *, row_number() over (partition by name order by bucket) - 1 as i, ceil(count(*) over (partition by name) / 20) as size from m)
select name, floor(i / size)::bigint as part, min(bucket) as bucket, round(avg(value), 6) as value from r group by 1, 2""")
def downsample_even_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, b = windows(spark, sf_dir)
    return rounded(op.downsample(c.unionByName(b), 20))


@PLANS.add(f"""with {t.METRICS}, x as (select target_id, sum(value) filter (name = 'view') as used, sum(value) filter (name = 'click') as lim from metrics group by 1)
select target_id, round(used, 4) as used, round(case when lim > 0 then lim end, 4) as "limit", round(case when lim > 0 then 100 * used / lim end, 4) as percent from x where used is not null""")
def capacity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t.metrics(spark, sf_dir)
    return rounded(op.capacity(m.filter("name = 'view'"), m.filter("name = 'click'"), "target_id"), 4)


@PLANS.add(f"""{BOTH.replace('with ', 'with recursive ', 1)}, w as (select name, bucket, round(value) as v, row_number() over (partition by name order by bucket) as i from m),
walk as (select name, bucket, i, v as kept, null::double as was from w where i = 1
  union all select w.name, w.bucket, w.i, case when abs(v - kept) > 1e-9 * greatest(abs(v), abs(kept)) then v else kept end,
    case when abs(v - kept) > 1e-9 * greatest(abs(v), abs(kept)) then kept end from walk join w on walk.name = w.name and w.i = walk.i + 1)
select name, bucket, was, kept as "is" from walk where was is not null""")
def limit_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, b = windows(spark, sf_dir)
    return op.change_points(c.unionByName(b).withColumn("value", F.round("value")))


WALK = f"""{BOTH.replace('with ', 'with recursive ', 1)}, w as (select name, bucket, round(value / 20) as v, row_number() over (partition by name order by bucket) as i from m),
walk as (select name, bucket, i, v as kept, false as moved from w where i = 1
  union all select w.name, w.bucket, w.i, case when abs(v - kept) > 1e-9 * greatest(abs(v), abs(kept)) then v else kept end, abs(v - kept) > 1e-9 * greatest(abs(v), abs(kept))
  from walk join w on walk.name = w.name and w.i = walk.i + 1)"""


@PLANS.add(f"""{WALK}, moves as (select name, count(*) filter (moved) as changes from walk group by name), seen as (select name, count(*) as n, min(bucket) as first_at, max(bucket) as last_at, arg_max(v, bucket) as last_value from w group by name)
select name, n, first_at, last_at, last_value, changes, case when changes > 0 then 'changed' when n * 10 < 360 then 'unknown_sparse' else 'observed_constant' end as stability from seen join moves using (name)""")
def limit_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, b = windows(spark, sf_dir)
    return op.stability(c.unionByName(b).withColumn("value", op.whole(F.col("value") / 20)), 120)


STATS = """x as (select name, cur, avg(value) as a, max(value) as mx, min(value) as mn, count(*) as n, arg_max(value, {'ts': ts, 'v': value}) as last from raw group by all)"""


@PLANS.add(f"""{BOTH}, {STATS} select c.name, round(c.a, 6) as avg, round(c.mx, 6) as max, round(c.mn, 6) as min, round(c.last, 6) as last, c.n as n, round(p.a, 6) as baseline,
  case when p.a is null then 'no_data' when p.a = 0 then case when c.a = 0 then 'normal' else 'anomalous' end when abs(c.a - p.a) / abs(p.a) > 0.02 then 'anomalous' else 'normal' end as verdict
  from (select * from x where cur) c left join (select * from x where not cur) p on c.name = p.name""")
def metric_series_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t.metrics(spark, sf_dir)
    c, b = op.window_stats(op.within(m, MIDDLE, END), ["name"]), op.window_stats(op.within(m, BASE, MIDDLE), ["name"])
    rows = c.join(b.select("name", F.col("avg").alias("baseline")), "name", "left")
    return rounded(rows.withColumn("verdict", op.change_verdict(F.col("avg"), F.col("baseline"), 0.02)))


@PLANS.add(f"""{BOTH}, x as (select name || '.' || target_id as name, avg(value) filter (cur) as c, avg(value) filter (not cur) as b from raw group by 1)
select name, round(c, 6) as c, round(b, 6) as b, round(abs(c - b) / greatest(abs(b), 1e-9), 6) as score, b is null as is_new,
  row_number() over (order by b is null desc, abs(c - b) / greatest(abs(b), 1e-9) desc nulls last, name) as rank from x where c is not null""")
def discover_signals_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t.metrics(spark, sf_dir).withColumn("name", F.concat_ws(".", "name", "target_id"))
    return rounded(op.relative_change(op.within(m, MIDDLE, END), op.within(m, BASE, MIDDLE)))


@PLANS.add(f"""with {t.METRICS}, x as (select dim, sum(value) as total from metrics where name = 'view' group by 1)
select dim, round(total, 4) as total, round(total / sum(total) over (), 6) as share, total / sum(total) over () >= 0.5 as dominant from x""")
def metric_dimension_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.share_of_total(t.metrics(spark, sf_dir).filter("name = 'view'"), "dim")
    return rows.select("dim", F.round("total", 4).alias("total"), F.round("share", 6).alias("share"), "dominant")


@PLANS.add("""with u as (select user_id::varchar as target_id, ts from events), g as (select distinct target_id from u where ts < timestamp '2024-01-29' except select target_id from u where ts >= timestamp '2024-01-29')
select target_id, case when count(*) over () <= 1 then 'isolated' else 'widespread' end as scope from g""")
def silent_targets_setdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read_table(spark, sf_dir, "events").select(t.text("user_id").alias("target_id"), "ts")
    return op.silent_targets(op.within(rows, "2024-01-29", "2030-01-01"), op.within(rows, "2000-01-01", "2024-01-29"))


@PLANS.add(f"with {t.METRICS} select name, dim, target_id, round(max(value) - min(value), 6) as increase from metrics group by all having max(value) > min(value) order by max(value) - min(value) desc, name, dim, target_id limit 10")
def k8s_restart_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.restart_increase(t.metrics(spark, sf_dir), ["name", "dim", "target_id"], 10))


@PLANS.add("""with s as (select 'n' || (l_suppkey % 4)::varchar as namespace, 'p' || (l_orderkey % 97)::varchar as pod, l_linenumber as container,
  case l_partkey % 4 when 0 then 'restarts' when 1 then 'crash_loop' when 2 then 'oom_killed' else 'waiting' end as probe, case when l_quantity < 5 then null when l_quantity < 30 then 0 else l_quantity end as value from lineitem),
c as (select namespace, pod, probe, container, case when probe = 'restarts' then max(value) - min(value) else max(value) end as v from s where value is not null group by namespace, pod, probe, container)
select namespace, pod, probe, round(sum(v), 6) as value, count(*) as containers, sum(v) > 0 as finding from c group by namespace, pod, probe""")
def cluster_pod_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = t.read_table(spark, sf_dir, "lineitem").selectExpr(
        "concat('n', l_suppkey % 4) as namespace", "concat('p', l_orderkey % 97) as pod", "l_linenumber as container",
        "case l_partkey % 4 when 0 then 'restarts' when 1 then 'crash_loop' when 2 then 'oom_killed' else 'waiting' end as probe",
        "case when l_quantity < 5 then null when l_quantity < 30 then 0 else l_quantity end as value",
    )
    return rounded(op.pod_probes(i, ["restarts"]))
