"""Calls of a service by endpoint: sections, labels, failures and rejections, frequent errors, the window to compare with."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["section", "kind", "label"]

# Fixed values.
MIN_CALLS = 30
MIN_WINDOW = timedelta(minutes=15)
WIDEN = 4


def attribute(name: str, default: str = "") -> Column:
    return F.coalesce(F.element_at("attributes", F.lit(name)), F.lit(default))


def described(calls: DataFrame) -> DataFrame:
    """calls with the section (entry, step, egress), the label and the axis that the label is made of."""
    kind = F.col("kind")
    inner = F.when(F.col("parent_span_id").isNull(), "entry").otherwise("step")
    section = F.when(kind.isin("SERVER", "CONSUMER"), "entry").when(kind == "INTERNAL", inner).otherwise("egress")
    port = F.when(attribute("server.port") != "", F.concat(F.lit(":"), attribute("server.port"))).otherwise("")
    db = F.concat_ws(" ", F.lit("db"), attribute("db.system"), attribute("db.operation", "-"), attribute("db.sql.table", "-"))
    http = F.concat(F.lit("http "), attribute("http.request.method"), F.lit(" "), attribute("server.address"), port)
    client = F.when(attribute("db.system") != "", db).when(attribute("url.full") != "", http).otherwise(F.concat(F.lit("peer "), attribute("server.address")))
    label = F.when(kind == "CLIENT", client).otherwise(F.col("name"))
    out = F.when(F.startswith(label, F.lit("db ")), "db_call").when(F.startswith(label, F.lit("http ")), "http_call").otherwise("peer")
    axis = F.when(kind == "SERVER", "http.route").when(kind.isin("CONSUMER", "PRODUCER"), "messaging.destination").when(kind == "INTERNAL", "framework_segment").otherwise(out)
    return calls.withColumns({"section": section, "label": label, "axis": axis})


def totals(calls: DataFrame) -> DataFrame:
    """One row for each endpoint: calls, roots, codes, slowest target and the failures and rejections that its kind tells apart.

    Failures of HTTP endpoints are codes of 500 and more, and errors without a code; rejections are codes of 400 to 499. Elsewhere failures
    are errors, and rejections are unknown (-1). Spans that came twice count once in the rate of failures.
    """
    code = attribute("http.response.status_code").try_cast("int")
    failed, coded = F.col("status") == "ERROR", attribute("http.response.status_code") != ""
    rows = described(calls).groupBy(*KEYS, "axis").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("trace_id", "span_id")).alias("unique_n"),
        F.count_if(F.col("parent_span_id").isNull()).alias("root_n"), F.count_if(code >= 500).alias("http_5xx"),
        F.count_if((code >= 400) & (code < 500)).alias("http_4xx"), F.count_if(coded).alias("http_n"), F.count_if(~coded & failed).alias("err_nohttp"),
        F.count_if(failed).alias("status_err"), F.count("error").alias("labelled"), F.min("target_id").alias("target_id"),
    )
    by_code = (F.col("kind") == "SERVER") | (F.col("axis") == "http_call")
    kind = F.when(F.col("kind") == "SERVER", "http_server").when(F.col("axis") == "db_call", "db").when(F.col("kind") == "CLIENT", "http_client").otherwise("framework")
    failures = F.when(by_code, F.col("http_5xx") + F.col("err_nohttp")).otherwise(F.col("status_err"))
    rows = rows.withColumns({"failed_n": failures, "rejected_n": F.when(by_code, F.col("http_4xx")).otherwise(F.lit(-1).cast("long"))})
    clean = (F.col("failed_n") == 0) & (F.col("rejected_n") <= 0) & (F.col("labelled") == 0)
    return rows.withColumns({
        "semantics": F.when(clean, "none").otherwise(kind), "failed_rate": F.col("failed_n") / F.col("unique_n"),
        "rejected_rate": F.when((F.col("rejected_n") >= 0) & (F.col("http_n") > 0), F.col("rejected_n") / F.col("http_n")).otherwise(0.0),
    }).drop("labelled")


def frequent_errors(calls: DataFrame, most: int = 2) -> DataFrame:
    """The errors that each endpoint had most often, by number, then name; they are counted before they are ranked."""
    counted = described(calls).filter("error is not null").groupBy(*KEYS, "error").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("n"), "error"))
    return counted.withColumn("place", place.cast("long")).filter(F.col("place") <= most)


def against_baseline(calls: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Calls of each endpoint in a window and in the one before it, as long and of 15 minutes at least.

    If an endpoint with enough calls had too few before, the baseline is once widened to the three window lengths before. One pass counts
    all three windows by endpoint; the choice is one row.
    """
    near, far = start - max(end - start, MIN_WINDOW), end - WIDEN * (end - start)
    within = lambda a, b: (F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))
    rows = described(calls.filter(within(min(near, far), end))).groupBy(*KEYS).agg(
        F.count_if(within(start, end)).alias("n"), F.count_if(within(near, start)).alias("near_n"), F.count_if(within(far, start)).alias("far_n")
    )
    thin = rows.agg(F.coalesce(F.bool_or((F.col("n") >= MIN_CALLS) & (F.col("near_n") < MIN_CALLS)), F.lit(False)).alias("thin")).first()["thin"]
    widened = thin and far < near
    base = F.col("far_n") if widened else F.col("near_n")
    return rows.filter("n > 0").select(*KEYS, "n", base.alias("base_n"), F.lit("widened" if widened else "ok").alias("base_state"))
