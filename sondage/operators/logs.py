"""Log lines: templates, comparison of windows by template, search with context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SURGE_COUNT, SURGE_RATIO, EXPECTED_RARE = 10, 5, 5.0
#: Lines shown of each class.
QUOTAS = {"new": 8, "surged": 5, "disappeared": 5, "frequent": 5}


def template(body: Column) -> Column:
    """Long hexadecimal runs and digits become placeholders."""
    return F.regexp_replace(F.regexp_replace(body, "[0-9a-fA-F]{8,}", "#"), "[0-9]+", "N")


def by_template(lines: DataFrame) -> DataFrame:
    t = template(F.col("body"))
    return lines.groupBy(t.alias("template")).agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("severity"), F.min("seq").alias("first_seq"))


def compare_templates(current: DataFrame, baseline: DataFrame, minutes: float, base_minutes: float) -> DataFrame:
    """new, surged, disappeared or frequent, by rates; rare templates of the baseline may be absent without notice."""
    c = by_template(current)
    b = by_template(baseline).select("template", F.col("n").alias("base_n"))
    both = c.join(b, "template", "full").select("template", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("base_n", F.lit(0)).alias("base_n"), "first_seq")
    surged = (F.col("n") >= SURGE_COUNT) & (F.col("n") / minutes >= SURGE_RATIO * F.col("base_n") / base_minutes)
    kind = (
        F.when(F.col("base_n") == 0, "new").when(surged, "surged")
        .when((F.col("n") == 0) & (F.col("base_n") / base_minutes * minutes >= EXPECTED_RARE), "disappeared")
        .when(F.col("n") == 0, "skipped_rare").otherwise("frequent")
    )
    return both.withColumn("class", kind)


def within_quota(rows: DataFrame) -> DataFrame:
    """The first rows of each class, and how many there are."""
    w = W.partitionBy("class")
    order = w.orderBy(F.desc(F.greatest("n", "base_n")), "template")
    quota = F.coalesce(*[F.when(F.col("class") == k, q) for k, q in QUOTAS.items()], F.lit(0))
    ranked = rows.withColumn("rank", F.row_number().over(order)).withColumn("total", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("rank") <= quota)


def levels(lines: DataFrame) -> DataFrame:
    return lines.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def grep(lines: DataFrame, query: str, least_severity: int = 0) -> DataFrame:
    """Lines that hold a literal, in any case, from a severity on."""
    found = F.contains(F.lower("body"), F.lit(query.lower()))
    return lines.filter(found & (F.col("severity") >= least_severity))


def context(lines: DataFrame, matches: DataFrame, n: int) -> DataFrame:
    """The ``n`` lines before and after each match in the match's own stream."""
    numbered = lines.withColumn("rn", F.row_number().over(W.partitionBy("stream").orderBy("seq", "body")))
    hit = numbered.join(matches.select("stream", "seq").distinct(), ["stream", "seq"], "left_semi").select("stream", F.col("rn").alias("at"))
    # each match names the rows around it, so the join is on equal keys
    around = hit.select("stream", "at", F.explode(F.sequence(F.col("at") - n, F.col("at") + n)).alias("rn"))
    return numbered.join(around, ["stream", "rn"]).select("stream", "at", (F.col("rn") - F.col("at")).cast("long").alias("offset"), "seq", "body")
