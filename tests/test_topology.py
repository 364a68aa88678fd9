"""Expansion around seeds on literal rows."""

from sondage.operators import topology as op

EDGES = [
    ("web", "api", "sync_call"), ("web", "api", "sync_call"), ("api", "db", "apm_db"), ("api", "vm1", "hosted_on"), ("web", "vm2", "hosted_on"),
    ("vm1", "sw1", "network_fdb"), ("sw1", "sw2", "network_lldp"), ("jobs", "api", "async_candidate"), ("db", "far", "sync_call"), ("api", None, "sync_call"), (None, "api", "sync_call"),
]
NODES = [(n, "application") for n in ("web", "api", "jobs")] + [("vm1", "server"), ("vm2", "server"), ("sw1", "network"), ("sw2", "network"), ("web", "application")]


def _expand(spark, *seeds, **more):
    edges, nodes = spark.createDataFrame(EDGES, "src string, dst string, kind string"), spark.createDataFrame(NODES, "node string, type string")
    return op.expand(edges, nodes, spark.createDataFrame([(s,) for s in seeds], "node string"), **more)


def _nodes(e):
    return {r.node: (r.type, r.hop) for r in e.nodes.collect()}


def test_hosts_cost_no_hop_and_peers_are_ends(spark):
    e = _expand(spark, "web", "web", "gone", hops=3)
    # in the first hop: the caller's other end, the hosts of both, and the network of those hosts
    assert _nodes(e) == {
        "web": ("application", 0), "api": ("application", 1), "vm1": ("server", 1), "vm2": ("server", 1), "sw1": ("network", 1), "sw2": ("network", 2),
        "db": ("peer", 2), "jobs": ("application", 2),
    }
    edges = [(r.src, r.dst, r.hop) for r in e.edges.collect()]
    assert sorted(edges) == [
        ("api", "db", 2), ("api", "vm1", 1), ("jobs", "api", 2), ("sw1", "sw2", 2), ("vm1", "sw1", 1), ("web", "api", 1), ("web", "vm2", 1),
    ]
    assert [r.node for r in e.unknown.collect()] == ["gone"] and e.truncated_at is None


def test_a_host_leads_to_its_network_only(spark):
    assert set(_nodes(_expand(spark, "vm1", hops=2))) == {"vm1", "sw1", "sw2"}


def test_caps_end_after_a_whole_hop(spark):
    for caps in ({"most_nodes": 5}, {"most_edges": 4}):
        e = _expand(spark, "web", hops=2, **caps)
        assert e.truncated_at == 1 and {r.node for r in e.nodes.filter("boundary").collect()} == {"api", "vm1", "vm2", "sw1"}


def test_nothing_to_expand(spark):
    e = _expand(spark, "gone")
    assert e.nodes.count() == e.edges.count() == 0 and e.truncated_at is None
    assert _nodes(_expand(spark, "web", hops=0)) == {"web": ("application", 0)}
    rows = op.report(e).collect()
    assert [(r.row, r.a, r.kind) for r in rows] == [("unknown_seed", "gone", None), ("coverage", None, "complete")]
