"""A topology around a target, hop by hop: calls, then hosts at no cost, then the network of what is there by then."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.sources import durable

EDGE = ["src", "dst", "kind"]


class Step(NamedTuple):
    """Edges followed within a hop: ``out`` from source to target, ``both`` either way, from nodes of these types.

    ``grown``: also from nodes that the same hop has reached, so that what the step adds costs no hop of its own.
    """

    out: tuple[str, ...]
    both: tuple[str, ...]
    types: tuple[str, ...]
    grown: bool


#: The steps of a hop, and how far a report goes.
STEPS = (
    Step(("apm_db", "apm_client_peer"), ("sync_call", "async_candidate", "unknown_parent_child"), ("application",), False),
    Step(("hosted_on",), (), ("application",), True),
    Step(("network_fdb", "network_lldp"), (), ("server", "network"), True),
)
MAX_NODES = 200
MAX_EDGES = 400


class Expansion(NamedTuple):
    nodes: DataFrame  # node, type, hop, boundary
    edges: DataFrame  # src, dst, kind, hop
    unknown: DataFrame  # node: seeds that are no nodes
    truncated_at: int | None


def expand(
    edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hops: int = 2, steps: tuple[Step, ...] = STEPS, most_nodes: int = MAX_NODES, most_edges: int = MAX_EDGES
) -> Expansion:
    """Nodes and edges within ``hops`` of the seeds(node), each with the first hop that reached it.

    edges(src, dst, kind), nodes(node, type). A node that the inventory lacks is a ``peer``, where no step starts; a seed that it lacks is
    told as unknown. Once there are ``most_nodes`` nodes or ``most_edges`` edges after a hop, that hop is kept whole, its nodes are the
    boundary, and no further one is taken. Repeated edges count once, null ends none.

    Each step semi-joins the edges with where it starts, and its edges are stored, so no hop repeats the ones before.
    """
    known = nodes.filter("node is not null").groupBy("node").agg(F.min("type").alias("type"))
    ends = edges.filter("src is not null and dst is not null").select(*EDGE)
    asked = seeds.select("node").distinct()
    seen = asked.join(known, "node").withColumn("hop", F.lit(0).cast("long"))
    frontier = seen = durable(seen, "seeds")
    found, cut = None, None
    n_nodes, n_edges = seen.count(), 0
    for hop in range(1, hops + 1 if n_nodes else 1):
        at = F.lit(hop).cast("long")
        grown = None
        for step in steps:
            start = frontier if grown is None or not step.grown else frontier.unionByName(grown)
            start = start.filter(F.col("type").isin(*step.types)).select("node")
            hit = ends.filter(F.col("kind").isin(*step.out, *step.both)).join(start.withColumnRenamed("node", "src"), "src", "left_semi")
            if step.both:
                back = ends.filter(F.col("kind").isin(*step.both)).join(start.withColumnRenamed("node", "dst"), "dst", "left_semi")
                hit = hit.unionByName(back)
            hit = hit.distinct() if found is None else hit.distinct().join(found.select(*EDGE), EDGE, "left_anti")
            hit = durable(hit.withColumn("hop", at), "hits")
            found = hit if found is None else found.unionByName(hit)
            had = seen.select("node") if grown is None else seen.select("node").unionByName(grown.select("node"))
            new = hit.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(had, "node", "left_anti")
            new = new.join(known, "node", "left").select("node", F.coalesce("type", F.lit("peer")).alias("type"), at.alias("hop"))
            grown = new if grown is None else grown.unionByName(new)
        frontier = durable(grown, "frontier")
        seen = seen.unionByName(frontier)
        n_new, n_edges = frontier.count(), found.count()
        n_nodes += n_new
        if n_nodes >= most_nodes or n_edges >= most_edges:
            cut = hop
        if cut or not n_new:
            break
    if found is None:
        found = ends.limit(0).withColumn("hop", F.lit(0).cast("long"))
    boundary = F.lit(False) if cut is None else F.col("hop") == cut
    return Expansion(seen.withColumn("boundary", boundary), found, asked.join(known, "node", "left_anti"), cut)


def report(e: Expansion) -> DataFrame:
    """One table: nodes, edges, unknown seeds, and a coverage row whose hop is where the expansion was cut (null: nowhere)."""
    text = lambda c=None: F.lit(c).cast("string")
    rows = e.nodes.select(F.lit("node").alias("row"), F.col("node").alias("a"), text().alias("b"), F.col("type").alias("kind"), "hop", "boundary")
    rows = rows.unionByName(e.edges.select(F.lit("edge").alias("row"), F.col("src").alias("a"), F.col("dst").alias("b"), "kind", "hop", F.lit(False).alias("boundary")))
    rows = rows.unionByName(
        e.unknown.select(F.lit("unknown_seed").alias("row"), F.col("node").alias("a"), text().alias("b"), text().alias("kind"), F.lit(None).cast("long").alias("hop"), F.lit(False).alias("boundary"))
    )
    spark = e.nodes.sparkSession
    state = "complete" if e.truncated_at is None else "truncated"
    last = spark.createDataFrame([("coverage", None, None, state, e.truncated_at, False)], "row string, a string, b string, kind string, hop long, boundary boolean")
    return rows.unionByName(last)
