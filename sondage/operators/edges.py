"""Edges of a service topology: kinds, identity, order, and the look-ups that end them at a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What tells one edge from another.
EDGE = ["source", "target", "kind", "observation", "span_kinds"]


def edge_kind(caller: Column, callee: Column) -> Column:
    """A producer and its consumer are a candidate only, since a parent doesn't prove the message's way."""
    return F.when((caller == "CLIENT") & (callee == "SERVER"), "sync_call").when((caller == "PRODUCER") & (callee == "CONSUMER"), "async_candidate").otherwise("unknown")


def paired(calls: DataFrame) -> DataFrame:
    """Calls between services, one row for each pair of services and kinds; both sides are cut to one row a span first."""
    span = ["trace_id", "span_id"]
    spans = calls.groupBy(*span).agg(F.min(F.struct("service", "kind", "parent_span_id", F.col("status"))).alias("s")).select(*span, "s.*")
    up = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("source"), F.col("kind").alias("__caller"))
    both = spans.join(up, ["trace_id", "parent_span_id"]).filter(F.col("source") != F.col("service"))
    return both.groupBy(
        "source", F.col("service").alias("target"), edge_kind(F.col("__caller"), F.col("kind")).alias("kind"), F.lit("paired").alias("observation"),
        F.concat("__caller", F.lit(">"), "kind").alias("span_kinds"),
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ERROR").alias("errors"))


def once(observed: DataFrame) -> DataFrame:
    """Each edge once: the counts of its first observation (least hop, then ``seq``), never their sum, as both ends report the same calls."""
    first = observed.groupBy(*EDGE).agg(F.min_by(F.struct("n", "errors"), F.struct("hop", "seq")).alias("__first"), F.min("hop").alias("hop"))
    return first.select(*EDGE, "__first.n", "__first.errors", "hop")


def page(edges: DataFrame, most: int) -> DataFrame:
    """The first edges of a report: near ones, then by rate of errors, volume and key."""
    return edges.orderBy("hop", F.desc(F.col("errors") / F.col("n")), F.desc("n"), *EDGE).limit(most)


def upper_bounds(paths: DataFrame, by: list[str], levels: list[str]) -> DataFrame:
    """Percentiles of single paths to one bound for each pair: their maximum is no percentile, but no percentile is above it."""
    return paths.groupBy(*by).agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in levels])


def by_address(rows: DataFrame, addresses: DataFrame, column: str) -> DataFrame:
    """rows with the target that has their address; the least id where several have it, null where none has."""
    known = addresses.filter("address is not null").groupBy(F.col("address").alias(column)).agg(F.min("id").alias("target_id"))
    return rows.join(known, column, "left")


def hosted_on(pods: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """pods(pod, node) by nodes(node, host) to targets(id, name): the state says where the chain ends."""
    named = targets.groupBy(F.col("name").alias("host")).agg(F.min("id").alias("target_id"))
    chain = pods.join(nodes.groupBy("node").agg(F.min("host").alias("host")), "node", "left").join(named, "host", "left")
    state = F.when(F.col("host").isNull(), "no_node").when(F.col("target_id").isNull(), "no_target").otherwise("resolved")
    return chain.select("pod", "node", "host", "target_id", state.alias("state"))


def unambiguous(index: DataFrame, key: str, shown: int = 10) -> DataFrame:
    """index(key, id): the one target of a key, or how many there are and the least of them.

    Ids are cut to one row each before they are collected, and a key's list holds ``shown`` of them; the count is of all.
    """
    ids = index.groupBy(key, "id").agg(F.count(F.lit(1)).alias("__n"))
    counts = ids.groupBy(key).agg(F.count(F.lit(1)).alias("candidates"), F.min("id").alias("__least"))
    least = ids.withColumn("__place", F.row_number().over(W.partitionBy(key).orderBy("id"))).filter(F.col("__place") <= shown)
    lists = least.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    one = F.col("candidates") == 1
    return counts.join(lists, key).select(key, "candidates", "ids", F.when(one, F.col("__least")).alias("target_id"), F.when(one, "unique").otherwise("ambiguous").alias("state"))
