"""Targets: search, parent chains, peers, processes, coverage, topology."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.functions import ranked
from sondage.sources import durable


def search(targets: DataFrame, query: str, columns: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Literal substring in any case; one row beyond the page tells that there is more."""
    hit = reduce(lambda a, b: a | b, [F.instr(F.lower(c), F.lit(query.lower())) > 0 for c in columns])
    return targets.filter(hit).orderBy("id").offset(offset).limit(limit + 1)


def parent_chain(targets: DataFrame, depth: int = 6) -> DataFrame:
    """Ancestors of every target, at most ``depth`` steps; a chain that comes back to a target it holds ends there."""
    up = targets.select(F.col("id").alias("__id"), F.col("parent_id").alias("__up"))
    level = targets.filter("parent_id is not null").select("id", F.lit(1).cast("long").alias("depth"), F.col("parent_id").alias("ancestor"), F.array("id").alias("path"))
    levels = [level]
    for _ in range(depth - 1):
        level = level.join(up, F.col("ancestor") == F.col("__id")).filter(F.col("__up").isNotNull() & ~F.array_contains("path", F.col("__up")))
        level = level.select("id", (F.col("depth") + 1).alias("depth"), F.col("__up").alias("ancestor"), F.array_append("path", F.col("ancestor")).alias("path"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).select("id", "depth", "ancestor")


def children_counts(targets: DataFrame, listed: int = 10) -> DataFrame:
    """How many children each target has by type, and which, if there are few."""
    kids = targets.filter("parent_id is not null").select("parent_id", "type", "id")
    counts = kids.groupBy("parent_id", "type").agg(F.count(F.lit(1)).alias("n"))
    few = kids.join(counts.filter(F.col("n") <= listed).drop("n"), ["parent_id", "type"], "left_semi")  # only short lists are gathered
    ids = few.groupBy("parent_id", "type").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return counts.join(ids, ["parent_id", "type"], "left")


def peers(targets: DataFrame, asked: DataFrame) -> DataFrame:
    """For the asked targets (id) those of the same group and type, without the target itself."""
    p = targets.select(F.col("id").alias("peer"), F.col("group_id").alias("g"), F.col("type").alias("t"))
    own = targets.join(asked.select("id").distinct(), "id", "left_semi")
    return own.join(p, (F.col("group_id") == F.col("g")) & (F.col("type") == F.col("t"))).filter("id <> peer").select("id", "peer")


def peer_verdict(states: DataFrame, targets: DataFrame) -> DataFrame:
    """states(id, deviating) against the states of the other targets of its group and type: alone, shared, self_not_deviating or undecidable.

    Counts of the group less the row itself, so no pairs are made.
    """
    own = targets.filter("group_id is not null and type is not null").select("id", "group_id", "type").join(states, "id")
    group = own.groupBy("group_id", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if("deviating").alias("d"))
    less = own.join(group, ["group_id", "type"]).select("id", (F.col("n") - 1).alias("compared"), (F.col("d") - F.col("deviating").cast("long")).alias("n_deviating"))
    rows = states.join(less, "id", "left").fillna({"compared": 0, "n_deviating": 0})
    verdict = F.when(F.col("compared") == 0, "undecidable").when(~F.col("deviating"), "self_not_deviating").when(F.col("n_deviating") > 0, "shared").otherwise("alone")
    return rows.select("id", "compared", "n_deviating", verdict.alias("verdict"))


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, seen: str, value: str) -> DataFrame:
    """As-of join: each left row with the latest right value of its key that was seen at its time or before.

    Both sides are sorted together by time within the key, so nothing is multiplied. At equal times the right row comes first.
    """
    r = right.select(F.col(key), F.col(seen).alias("__t"), F.struct(F.col(seen).alias("s"), F.col(value).alias("v")).alias("__r"), F.lit(0).alias("__side"))
    own = [c for c in left.columns if c != key]
    both = left.select(F.col(key), F.col(at).alias("__t"), F.struct(*own).alias("__l"), F.lit(1).alias("__side")).unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("__t", "__side", F.col("__r.v")).rowsBetween(W.unboundedPreceding, 0)
    got = both.withColumn("__last", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    return got.select(key, "__l.*", F.col("__last.v").alias(value), F.col("__last.s").alias(seen))


def latest_and_peaks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Latest state of each process, its maximum in the window and when that was, independently of each other."""
    return rows.groupBy(*keys).agg(
        F.max_by(value, F.struct("ts", value)).alias("latest"), F.max(value).alias("peak"),
        F.max_by("ts", F.struct(value, "ts")).alias("peak_at"), F.max("ts").alias("observed_at"),
    )


def top_share(rows: DataFrame, keys: list[str], most: int, dominant: float = 0.5) -> DataFrame:
    """Mean of the series' means by key, its share of all, the largest first."""
    avg = rows.groupBy(*keys, "dim").agg(F.avg("value").alias("v")).groupBy(*keys).agg(F.avg("v").alias("avg"))
    share = F.col("avg") / F.lit(avg.agg(F.sum("avg")).first()[0])
    return avg.select(*keys, "avg", share.alias("share"), (share >= dominant).alias("anomalous")).orderBy(F.desc("avg"), *keys).limit(most)


def coverage(wanted: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of each source by target; 0 and absent are both told."""
    rows = wanted
    for name, df in sources.items():
        rows = rows.join(df.groupBy("target_id").agg(F.count(F.lit(1)).alias(name)), "target_id", "left").fillna(0, [name])
    seen = reduce(lambda a, b: a + b, [(F.col(n) > 0).cast("long") for n in sources])
    return rows.withColumn("sources_seen", seen)


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` steps of a seed, with the least number of steps. edges(src, dst) are walked both ways."""
    ways = durable(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "ways")
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0).cast("long"))
    frontier = seen
    for hop in range(1, hops + 1):
        reached = ways.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop).cast("long"))
        frontier = durable(frontier, "frontier")  # no hop repeats the ones before
        seen = seen.unionByName(frontier)
    return seen


def service_identity(rows: DataFrame) -> DataFrame:
    """rows(service, target_id): one distinct target resolves a service, several make it ambiguous."""
    n = F.count_distinct("target_id")
    state = F.when(n == 1, "resolved").when(n == 0, "unresolved").otherwise("ambiguous")
    return rows.groupBy("service").agg(n.alias("targets"), state.alias("identity"), F.when(n == 1, F.max("target_id")).alias("target_id"))


def triage(members: DataFrame) -> DataFrame:
    """Members folded by (target, metric): anomalies first, then severity, first time, id."""
    folded = members.groupBy("target_id", "metric").agg(F.bool_or("anomalous").alias("anomalous"), F.max("severity").alias("severity"), F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    return ranked(folded, [F.desc("anomalous"), F.desc("severity"), F.asc("first_at"), F.asc("target_id"), F.asc("metric")])


def candidates(symptom: DataFrame, nodes: DataFrame, edges: DataFrame, kin: DataFrame) -> DataFrame:
    """Where to look beyond the targets of a symptom(target_id): neighbours in one and two steps, then kin on the same host.

    A symptom's target that is no node(target_id) is missing_from_topology; a neighbour that is none can't be probed. edges(src, dst) are
    walked both ways.
    """
    own = symptom.select("target_id").distinct()
    walk = expand(edges, own.withColumnRenamed("target_id", "node"), 2).filter("hop > 0")
    near = walk.select(F.col("node").alias("target_id"), F.when(F.col("hop") == 1, "topology_1hop").otherwise("topology_2hop").alias("via"))
    kin = kin.select("target_id").distinct().join(own, "target_id", "left_anti").join(near, "target_id", "left_anti").withColumn("via", F.lit("host_kin"))
    known = nodes.select("target_id").distinct().withColumn("__known", F.lit(True))
    absent = own.join(known, "target_id", "left_anti").select("target_id", F.lit(None).cast("string").alias("via"), F.lit("missing_from_topology").alias("state"))
    probed = F.when(F.col("__known").isNull() & (F.col("via") != "host_kin"), "unprobeable").otherwise("candidate")
    return near.unionByName(kin).join(known, "target_id", "left").select("target_id", "via", probed.alias("state")).unionByName(absent)


def coverage_grid(wanted: DataFrame, domains: list[str], calls: DataFrame) -> DataFrame:
    """Every wanted target x domain, and whether a call has looked there."""
    cells = wanted.select("target_id", F.explode(F.array(*map(F.lit, domains))).alias("domain"))
    done = calls.select("target_id", "domain").distinct().withColumn("done", F.lit(True))
    return cells.join(done, ["target_id", "domain"], "left").select("target_id", "domain", F.coalesce("done", F.lit(False)).alias("covered"))
