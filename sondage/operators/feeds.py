"""Changes and events of several sources as one feed, what of a source has arrived, and which rows a question is about."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of a report on changes, after those of the target asked for.
SCOPES = ("target", "global")


def exposed(audit: DataFrame, read_only: DataFrame) -> DataFrame:
    """Rows of an audit trail but those whose (category, action) only reads; an unknown pair is kept."""
    return audit.join(read_only, ["category", "action"], "left_anti")


def union(sources: dict[str, DataFrame]) -> DataFrame:
    """One feed of all sources, each under its name; columns that a source lacks are null."""
    out = None
    for name, rows in sources.items():
        named = rows.withColumn("source", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def change_page(feed: DataFrame, asked: str, most: int) -> DataFrame:
    """The first changes: of the target asked for, of targets, of all, of the control plane; newest first, then by reference."""
    scope = F.when(F.col("scope") == SCOPES[0], 1).when(F.col("scope") == SCOPES[1], 2).otherwise(3)
    bucket = F.when((F.col("target_id") == asked) & (F.lit(asked) != ""), 0).otherwise(scope)
    return feed.withColumn("bucket", bucket).orderBy("bucket", F.desc("at"), "source", "ref").limit(most)


def with_names(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """rows with the name that a dictionary(key, name) has for them, null where it has none; a key's least name counts."""
    return rows.join(names.groupBy(key).agg(F.min("name").alias("name")), key, "left")


def of_names(rows: DataFrame, owners: DataFrame, column: str) -> DataFrame:
    """Rows that bear one of the names in the arrays of ``owners``."""
    return rows.join(owners.select(F.explode("names").alias(column)).distinct(), column, "left_semi")


def asked_for(rows: DataFrame, target: str, ids: list[str] | None = None, **optional: str) -> DataFrame:
    """Rows that belong to a target or to its host, of a list of ids if there is one, with the values of those columns that are not empty."""
    rows = rows.filter((F.col("target_id") == target) | (F.col("host_target_id") == target))
    if ids is not None:
        rows = rows.filter(F.col("id").isin(ids))
    for name, value in optional.items():
        if value:
            rows = rows.filter(F.col(name) == value)
    return rows


def horizons(sources: list[DataFrame]) -> DataFrame:
    """sources(target_id, ts): until when all sources of a target have arrived, the earliest of their latest rows."""
    latest = [s.groupBy("target_id").agg(F.max("ts").alias("__h")) for s in sources]
    all_ = latest[0]
    for one in latest[1:]:
        all_ = all_.unionByName(one)
    return all_.groupBy("target_id").agg(F.min("__h").alias("horizon"))


def observed_range(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """rows(horizon) with the part of a window that has arrived; null where nothing of it has."""
    some = F.col("horizon") > F.lit(start)
    return rows.withColumns({"observed_from": F.when(some, F.lit(start)), "observed_to": F.when(some, F.least(F.lit(end), F.col("horizon")))})


def flexible_time(said: Column, now: Column) -> Column:
    """``now``, ``now-<duration>`` like ``now-1h30m``, or a time; null for anything else."""
    part = lambda unit: F.coalesce(F.regexp_extract(said, rf"(\d+){unit}", 1).try_cast("int"), F.lit(0))
    back = F.make_dt_interval(hours=part("h"), mins=part("m"), secs=part("s"))
    return F.when(said == "now", now).when(said.rlike(r"^now-(?=\d)(\d+h)?(\d+m)?(\d+s)?$"), now - back).otherwise(said.try_cast("timestamp_ntz"))


def value_kinds(series: DataFrame, catalogue: DataFrame | None) -> DataFrame:
    """Series as counters where the catalogue(name, value_type) says so, else as gauges; without a catalogue all are gauges, and degraded."""
    if catalogue is None:
        return series.withColumns({"kind": F.lit("gauge"), "degraded": F.lit(True)})
    types = catalogue.groupBy("name").agg(F.min("value_type").alias("__type"))
    kind = F.when(F.startswith("__type", F.lit("counter")), "counter").otherwise("gauge")
    return series.join(types, "name", "left").withColumns({"kind": kind, "degraded": F.lit(False)}).drop("__type")


def nearest(asked: DataFrame, captures: DataFrame, key: str) -> DataFrame:
    """asked(id, key, ts) with the capture nearest in time, the earlier of two; both sides pass two windows, so no pairs are made."""
    both = asked.select(key, "ts", "id", F.lit(None).cast("timestamp_ntz").alias("__c")).unionByName(
        captures.select(key, "ts").distinct().select(key, "ts", F.lit(None).cast(asked.schema["id"].dataType).alias("id"), F.col("ts").alias("__c"))
    )
    # both frames grow from one end, so each is a running value; one that shrinks is read anew for every row
    up, down = W.partitionBy(key).orderBy("ts"), W.partitionBy(key).orderBy(F.desc("ts"))
    before = F.last("__c", ignorenulls=True).over(up.rangeBetween(W.unboundedPreceding, 0))
    after = F.last("__c", ignorenulls=True).over(down.rangeBetween(W.unboundedPreceding, 0))
    both = both.withColumns({"__b": before, "__a": after}).filter("id is not null")
    closer = F.col("__a") - F.col("ts") < F.col("ts") - F.col("__b")
    return both.select("id", key, "ts", F.when(F.col("__b").isNull() | closer, F.col("__a")).otherwise(F.col("__b")).alias("captured"))


def latest_plans(plans: DataFrame, most: int = 3) -> DataFrame:
    """plans(query, plan_hash, captured): the last capture of each plan, and of a query's plans the last ones."""
    last = plans.groupBy("query", "plan_hash").agg(F.max("captured").alias("captured"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("captured"), "plan_hash"))
    return last.withColumn("place", place.cast("long")).filter(F.col("place") <= most)


def statement_page(rows: DataFrame, axis: str, most: int) -> DataFrame:
    """The first statements by an axis; those of the monitoring itself come last."""
    return rows.orderBy("monitoring", F.desc(axis), "key").limit(most)


def at_steps(metrics: DataFrame, start: datetime, end: datetime, step_s: int) -> DataFrame:
    """The last value of each series in each step of a window; a step is named by its end."""
    passed = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))
    step = (F.floor(passed / (step_s * 1_000_000)) + 1).cast("long")
    own = metrics.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))).groupBy("name", "target_id", step.alias("step"))
    return own.agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def label_values(metrics: DataFrame, label: str, start: datetime, end: datetime) -> DataFrame:
    return metrics.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))).select(F.col(label).alias("value")).distinct()


def scanned_changes(changes: DataFrame, targets: DataFrame, start: datetime, end: datetime, look_back: timedelta | None = None) -> DataFrame:
    """Changes of the targets of an incident from before its start, or from ``look_back`` before it, to its end; those after the start are late."""
    own = changes.filter(F.col("at") < F.lit(end))
    if look_back is not None:
        own = own.filter(F.col("at") >= F.lit(start - look_back))
    return own.join(targets.select("target_id").distinct(), "target_id", "left_semi").withColumn("late", F.col("at") > F.lit(start))
