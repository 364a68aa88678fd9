"""Spans: endpoint verdicts, self time, call edges, activity; statements: two-stage folds and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.functions import quantiles

#: Thresholds of the endpoint and statement verdicts.
SAMPLE, RATIO, SHIFT_MS, SLOW_MS = 30, 3.0, 300.0, 3000.0
FAIL_COUNT, FAIL_RATE, FAIL_SHIFT, FAIL_POINTS = 5, 0.05, 2.0, 0.10
REJECT_COUNT, REJECT_SHIFT, REJECT_POINTS = 20, 2.0, 0.10
SLOWER, FASTER, CHRONIC, POLLS = 3.0, 1 / 3, 0.9, 3


def breakdown(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Latency and errors by endpoint, exact percentiles."""
    rows = spans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("trace_id", "span_id")).alias("unique_n"),
        F.count_if(F.col("parent_span_id").isNull()).alias("roots"), F.max("duration_ms").alias("max_ms"), F.sum("duration_ms").alias("total_ms"),
        F.count_if(F.col("status") == "ERROR").alias("failed"), F.count("code").alias("coded"),
        F.count_if((F.col("code") >= 400) & (F.col("code") < 500)).alias("rejected"),
        F.max_by("trace_id", F.struct("duration_ms", "trace_id")).alias("slowest_trace"),
    )
    return rows.join(quantiles(spans, keys, "duration_ms", {"p50": 0.5, "p95": 0.95}), keys, "left")


def verdict_arms(current: DataFrame, baseline: DataFrame, keys: list[str], compared: bool = True) -> DataFrame:
    """The arms that fire for each endpoint of enough calls; the others have none. ``keys`` hold ``kind``.

    Failures are told by unique spans, rejections by calls with a code. Only what is called from outside (SERVER, CONSUMER) can be slower
    by ratio, as batches of an inner part differ in size; errors of frameworks count by their change only. An endpoint that was mostly
    rejected before can't double, so its remaining share may also halve. ``base_state``: ok, insufficient_samples, or unavailable where
    there is no window to compare with (``compared`` false).
    """
    c = current.select(*keys, "n", "unique_n", "p50", "p95", "failed", "coded", "rejected")
    b = baseline.select(*keys, *[F.col(x).alias(f"b_{x}") for x in ("unique_n", "p50", "p95", "failed", "coded", "rejected")])
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    rate, before = share("failed", "unique_n"), share("b_failed", "b_unique_n")
    refused, refused_before = share("rejected", "coded"), share("b_rejected", "b_coded")
    known = (F.col("b_unique_n") >= SAMPLE) & F.lit(compared)
    outer, by_code = F.col("kind").isin("SERVER", "CONSUMER"), F.col("kind").isin("SERVER", "CLIENT")
    shut = (refused >= REJECT_SHIFT * refused_before) | (1 - refused <= (1 - refused_before) / REJECT_SHIFT)
    arms = F.array_compact(F.array(
        F.when(known & outer & (F.col("b_p50") > 0) & (F.col("p50") >= RATIO * F.col("b_p50")), "latency_ratio"),
        F.when(known & (F.col("b_p95") > 0) & (F.col("p95") >= RATIO * F.col("b_p95")) & (F.col("p95") >= SHIFT_MS), "latency_shift"),
        F.when(F.col("p95") >= SLOW_MS, "latency_magnitude"),
        F.when(by_code & (F.col("failed") >= FAIL_COUNT) & (rate >= FAIL_RATE), "failure_magnitude"),
        F.when(known & (F.col("failed") >= FAIL_COUNT) & (rate >= FAIL_SHIFT * before) & (rate - before >= FAIL_POINTS), "failure_shift"),
        F.when(known & by_code & (F.col("rejected") >= REJECT_COUNT) & (refused - refused_before >= REJECT_POINTS) & shut, "rejection_shift"),
    ))
    rows = c.join(b, keys, "left")
    state = F.when(F.col("unique_n") < SAMPLE, "insufficient_sample").when(F.size("arms") > 0, "anomalous").otherwise("normal")
    rows = rows.withColumn("base_state", F.when(F.lit(not compared), "unavailable").when(F.col("b_unique_n") >= SAMPLE, "ok").otherwise("insufficient_samples"))
    return rows.withColumn("arms", F.when(F.col("unique_n") >= SAMPLE, arms).otherwise(F.array().cast("array<string>"))).withColumn("verdict", state)


def ranked(rows: DataFrame, section: str, most: int) -> DataFrame:
    """The first ``most`` of each section by rank class and time, and beyond them every row with a verdict."""
    order = W.partitionBy(section).orderBy(
        F.when(F.col("verdict") == "anomalous", 0).when(F.col("verdict") == "normal", 1).otherwise(2), F.desc("n"), "route"
    )
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter((F.col("rank") <= most) | (F.size("arms") > 0))


def self_time(spans: DataFrame, key: str = "service") -> DataFrame:
    """Time of a span less that of its children, which are summed by parent first; never below 0."""
    kids = spans.filter("parent_span_id is not null").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.sum("duration_ms").alias("child_ms"))
    rows = spans.join(kids, ["trace_id", "span_id"], "left").withColumn("child_ms", F.coalesce("child_ms", F.lit(0.0)))
    return rows.groupBy(key).agg(
        F.sum(F.col("duration_ms") - F.least("child_ms", "duration_ms")).alias("self_ms"),
        (F.sum(F.least("child_ms", "duration_ms")) / F.sum("duration_ms")).alias("child_share"),
    )


def paired_edges(spans: DataFrame) -> DataFrame:
    """Calls between services: child spans joined to their parents."""
    p = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("caller"), F.col("status").alias("caller_status"))
    met = spans.join(p, ["trace_id", "parent_span_id"]).filter("caller <> service")
    met = met.select("caller", F.col("service").alias("callee"), "caller_status", "status", "duration_ms")
    edges = met.groupBy("caller", "callee").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("caller_status") == "ERROR").alias("caller_errors"), F.count_if(F.col("status") == "ERROR").alias("callee_errors")
    )
    edges = edges.withColumn("observation_mismatch", (F.col("caller_errors") > 0) & (F.col("callee_errors") == 0))
    return edges.join(quantiles(met, ["caller", "callee"], "duration_ms", {"p50": 0.5}), ["caller", "callee"], "left")


def orphans(spans: DataFrame) -> DataFrame:
    """Client spans that no span names as its parent, by service."""
    kids = spans.filter("parent_span_id is not null").select("trace_id", F.col("parent_span_id").alias("span_id")).distinct()
    alone = spans.filter("kind = 'CLIENT'").join(kids, ["trace_id", "span_id"], "left_anti")
    return alone.groupBy("service").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("status") == "ERROR").alias("errors"), F.max("duration_ms").alias("max_ms"))


def activity(spans: DataFrame, start: str, middle: str, end: str, seconds: int, n_buckets: int) -> DataFrame:
    """Distinct spans by service and bucket of two equal windows, with zeros where there are none."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    edge = lambda t: F.unix_seconds(F.lit(t).cast("timestamp_ntz").cast("timestamp"))
    now = at >= edge(middle)
    rows = spans.filter((at >= edge(start)) & (at < edge(end))).select(
        "service", now.alias("is_current"), F.floor((at - F.when(now, edge(middle)).otherwise(edge(start))) / seconds).cast("long").alias("bucket"),
        F.struct("trace_id", "span_id").alias("id"),
    )
    n = rows.groupBy("service", "is_current", "bucket").agg(F.count_distinct("id").alias("n"))
    grid = rows.select("service").distinct().select("service", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_current"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_buckets - 1).cast("long"))).alias("bucket"))
    full = grid.join(n, ["service", "is_current", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = full.groupBy("service").agg(
        F.sum(F.when(F.col("is_current"), F.col("n")).otherwise(0)).alias("current"), F.sum(F.when(~F.col("is_current"), F.col("n")).otherwise(0)).alias("baseline"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_current"), F.struct("bucket", "n")))), lambda x: x["n"]), ",").alias("counts"),
    )
    state = F.when(F.col("baseline") == 0, "not_seen_in_baseline").when(F.col("current") == 0, "not_seen_in_current").otherwise("both")
    return sums.withColumn("state", state)


def statement_polls(rows: DataFrame) -> DataFrame:
    """First fold: execution-weighted latency of each statement within a poll, plain mean where nothing was executed."""
    execs = F.sum("execs")
    latency = F.when(execs > 0, F.sum(F.col("latency_ms") * F.col("execs")) / execs).otherwise(F.avg("latency_ms"))
    return rows.groupBy("sql_key", "mode", "ts").agg(latency.alias("latency_ms"), execs.alias("execs"))


def upper_median(c: str) -> Column:
    """The element at n / 2 of the sorted values (not the mean of the middle two)."""
    values = F.array_sort(F.collect_list(c))
    return F.element_at(values, F.floor(F.size(values) / 2).cast("int") + 1)


def statement_windows(polls: DataFrame) -> DataFrame:
    """Second fold: over the polls of a window."""
    return polls.groupBy("sql_key", "mode").agg(
        upper_median("latency_ms").alias("p50"), F.max("latency_ms").alias("max_ms"), F.max_by("latency_ms", "ts").alias("last_ms"),
        F.sum("execs").alias("execs"), F.count(F.lit(1)).alias("polls"),
    )


def statement_verdict(current: DataFrame, baseline: DataFrame, base_polls: int) -> DataFrame:
    """current with what the baseline says of each (sql_key, mode): ratios, presence, verdict, and what a ``slower`` one rests on.

    There is no ratio to a baseline that is absent or not above 0, and without a ratio nothing is slower, faster or chronic. Statements of
    the mode ``legacy`` carry totals since the start of their server and are not assessed. A baseline without polls has presence 0.
    """
    b = baseline.select("sql_key", "mode", F.col("p50").alias("b_p50"), F.col("max_ms").alias("b_max"), F.col("polls").alias("b_polls"))
    over = lambda c, base: F.when(F.col(base) > 0, F.col(c) / F.col(base))
    rows = current.join(b, ["sql_key", "mode"], "left")
    rows = rows.withColumns({"ratio_p50": over("p50", "b_p50"), "ratio_max": over("max_ms", "b_max"), "presence": F.coalesce("b_polls", F.lit(0)) / float(base_polls) if base_polls else F.lit(0.0)})
    slow = lambda c: F.coalesce(F.col(c) >= SLOWER, F.lit(False))
    basis = F.when(slow("ratio_p50") & slow("ratio_max"), "both").when(slow("ratio_p50"), "median").when(slow("ratio_max"), "max")
    verdict = (
        F.when(F.col("mode") == "legacy", "not_assessable_legacy").when((F.col("polls") < POLLS) | (F.coalesce("b_polls", F.lit(0)) < POLLS), "insufficient_baseline")
        .when(basis.isNotNull(), "slower").when(F.col("ratio_p50") <= FASTER, "faster").when((F.col("presence") >= CHRONIC) & F.col("ratio_p50").isNotNull(), "chronic").otherwise("stable")
    )
    return rows.withColumns({"verdict": verdict, "basis": F.when(verdict == "slower", basis)})


def plan_stability(captures: DataFrame) -> DataFrame:
    n, kinds = F.count(F.lit(1)), F.count_distinct("plan")
    state = F.when(n < 5, "unknown").when(kinds / n >= 0.9, "unstable").when(kinds / n <= 0.2, "stable").otherwise("mixed")
    return captures.groupBy("sql_key").agg(n.alias("captures"), kinds.alias("plans"), state.alias("stability"))


def split_url(url: Column) -> dict[str, Column]:
    """Scheme, authority and path; a missing scheme is unknown."""
    scheme = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return {
        "scheme": F.when(scheme == "", "unknown").otherwise(scheme), "authority": F.regexp_extract(rest, "^([^/?#]*)", 1),
        "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    }
