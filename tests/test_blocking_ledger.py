"""Blocking, endpoints, edges, ledger and feeds on literal rows."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sondage.operators import blocking, edges, endpoints, feeds, ledger


def _got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_fields_of_engines(spark):
    body = '{"pid": 7, "blockingPid": 9, "waitEvent": "lock", "sqlHash": 5, "sid": 3, "blockingSession": "x", "event": "row"}'
    rows = spark.createDataFrame([("a", "postgresql", 1, body), ("a", "oracle", 1, body), ("a", "db9", 1, body), ("a", "mssql", 1, "{"), ("a", "mysql", 1, None)], "database string, engine string, poll long, body string")
    got = _got(blocking.session_fields(rows), "engine", "session", "blocker", "wait", "sql_key", "pairing")
    assert got == [
        ("db9", 0, 0, "", "", "unverified"), ("mssql", 0, 0, "", "", "unverified"), ("mysql", 0, 0, "", "", "unverified"),
        ("oracle", 3, 0, "row", "", "verified"), ("postgresql", 7, 9, "lock", "5", "verified"),
    ]


def test_depth_and_roles(spark):
    rows = [("a", 1, 1, 2), ("a", 1, 2, 3), ("a", 1, 3, 0), ("a", 2, 1, 2), ("a", 2, 2, 1), ("a", 3, 5, 5), ("a", 4, 8, 0)]
    s = spark.createDataFrame(rows, "database string, poll long, session long, blocker long")
    assert _got(blocking.chain_depth(s.filter("blocker > 0")), "poll", "depth") == [(1, 3), (2, 2), (3, 2)]
    assert _got(blocking.roles(s).filter("poll = 1"), "session", "role") == [(1, "blocked_only"), (2, "both"), (3, "root")]
    assert blocking.chain_depth(s.filter("blocker > 9")).count() == 0


def test_root_changes_skip_polls_without_roots(spark):
    rows = [("a", 1, 1, "root"), ("a", 2, 4, "both"), ("a", 3, 1, "root"), ("b", 1, 1, "root"), ("b", 2, 2, "root"), ("b", 3, 1, "root")]
    got = blocking.root_changes(spark.createDataFrame(rows, "database string, poll long, session long, role string"))
    assert _got(got, "database", "polls", "root_sets", "n_changes", "migrated") == [("a", 2, 1, 0, False), ("b", 3, 2, 2, True)]


def test_timeline_keeps_both_ends(spark):
    polls = spark.range(1, 8).select(F.lit("a").alias("database"), F.col("id").alias("poll"))
    assert [p for p, _ in _got(blocking.timeline(polls, 4), "poll", "truncated")] == [1, 2, 6, 7]
    assert blocking.timeline(polls, 7).filter("truncated").count() == 0


def test_failures_and_rejections(spark):
    t = datetime(2024, 1, 1)
    row = lambda kind, attributes, status, parent=1: (t, 1, 1, parent, "s", kind, "n", attributes, status, None, "x")
    code = lambda c, **more: {"http.response.status_code": c} | more
    calls = spark.createDataFrame(
        [row("SERVER", code("500"), "ERROR"), row("SERVER", code("404"), "OK"), row("SERVER", {}, "ERROR"), row("CLIENT", {"db.system": "pg"}, "ERROR"), row("INTERNAL", {}, "OK", None), row("INTERNAL", {}, "OK")],
        "ts timestamp_ntz, trace_id long, span_id int, parent_span_id int, service string, kind string, name string, attributes map<string,string>, status string, error string, target_id string",
    )
    assert _got(endpoints.totals(calls), "section", "label", "n", "failed_n", "rejected_n", "semantics") == [
        ("egress", "db pg - -", 1, 1, -1, "db"), ("entry", "n", 1, 0, -1, "none"), ("entry", "n", 3, 2, 1, "http_server"), ("step", "n", 1, 0, -1, "none"),
    ]


def test_edges_count_once(spark):
    rows = [("a", "b", "sync_call", "paired", "x", 5, 1, 2, 0), ("a", "b", "sync_call", "paired", "x", 9, 2, 1, 1), ("a", "b", "unknown", "paired", "x", 1, 0, 3, 2)]
    got = edges.once(spark.createDataFrame(rows, "source string, target string, kind string, observation string, span_kinds string, n long, errors long, hop long, seq long"))
    assert _got(got, "kind", "n", "errors", "hop") == [("sync_call", 9, 2, 1), ("unknown", 1, 0, 3)]


def test_names_that_are_ambiguous(spark):
    got = edges.unambiguous(spark.createDataFrame([("k", 1), ("k", 1), ("l", 3), ("l", 2)], "key string, id long"), "key", 1)
    assert _got(got, "key", "candidates", "ids", "state") == [("k", 1, "1", "unique"), ("l", 2, "2", "ambiguous")]


@pytest.mark.parametrize(
    ("row", "value"),
    [
        (("confirmed", 3, True, 0, 2, 0, 6), 0.90), (("confirmed", 1, True, 0, 2, 3, 6), 0.80), (("probable", 0, False, 2, 1, 3, 6), 0.40),
        (("probable", 3, True, 0, 1, 0, 0), 0.60), (("insufficient", 9, True, 0, 9, 0, 0), 0.0), (("probable", 0, False, 0, 0, 2, 6), 0.50),
    ],
)
def test_confidence(spark, row, value):
    h = spark.createDataFrame([row], "status string, lineages int, temporal boolean, weak int, qualified int, unexamined int, required int")
    assert ledger.confidence(h).first()["value"] == pytest.approx(value)


def test_gate_windows_depend_on_the_claim(spark):
    day = lambda d: datetime(2024, 1, d)
    row = lambda i, heir, counter, predicate, change: (i, heir, counter, predicate, True, "observed", "normal", 0, 0, day(5), day(9), change, None, day(1), day(10), "observed", 60, day(20), None, 10)
    rows = [row(1, 1, False, "present", None), row(2, 2, True, "present", None), row(3, 3, False, "absent", None), row(4, None, False, "present", None), row(5, 5, False, "present", day(12))]
    got = ledger.qualify(spark.createDataFrame(rows, """id long, heir long, counter boolean, predicate string, must_hold boolean, availability string, confidence string, scope_omitted int, omitted int,
        from_at timestamp_ntz, to_at timestamp_ntz, change_from timestamp_ntz, change_to timestamp_ntz, need_from timestamp_ntz, need_to timestamp_ntz, lag_status string, lag_s int, now timestamp_ntz, sample_n int, min_sample int"""))
    assert _got(got, "id", "failed", "qualified") == [(1, "", True), (2, "window", False), (3, "window", False), (4, "active", False), (5, "window", False)]


def test_changed_keys(spark):
    of = lambda *rows: spark.createDataFrame(rows, "key string, place int, eid string")
    before, now = of(("a", 1, "x"), ("b", 1, "x"), ("d", 1, "x")), of(("a", 1, "x"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "z"))
    assert _got(ledger.changed_keys(before, now), "key") == [("b",), ("c",)]


def test_merge_takes_the_longest_chain(spark):
    c = spark.createDataFrame([(1, 0, "s", "t1", 2, 0.5), (2, 0, "r", "t2", 3, 0.4), (3, 0, "r", "t3", 3, 0.9)], "id long, grp long, source string, target string, depth int, prior double")
    p = spark.createDataFrame([(1, "k"), (2, "k"), (3, "l")], "id long, key string")
    s = spark.createDataFrame([(1, "e"), (2, ""), (3, "e")], "id long, eid string")
    got = ledger.merged(c, p, s)
    assert _got(got, "merged_count", "source", "sources", "target", "depth", "prior", "predictions", "repeated", "support", "chain_replaced") == [(3, "s", 2, "t2", 3, 0.9, 2, 1, 1, True)]


def test_discriminating_needs_another_candidate(spark):
    p = spark.createDataFrame([(1, "k", "up"), (1, "k", "down"), (2, "l", "up"), (3, "l", "down"), (4, "l", "up")], "id long, key string, expectation string")
    assert _got(ledger.discriminating(p), "id", "discriminating") == [(1, False), (2, True), (3, True), (4, True)]


def test_audit_leaves_two_live_ones(spark):
    p = spark.createDataFrame([(1, "h", "necessary"), (2, "h", "other"), (3, "g", "necessary"), (4, "g", "other")], "id long, hypothesis string, role string")
    v = spark.createDataFrame([(1, True, True, None), (2, True, True, None), (3, True, True, False), (4, True, False, None)], "id long, pertinent boolean, substantive boolean, role_valid boolean")
    assert _got(ledger.recheck(ledger.audited(p, v)), "hypothesis", "live", "necessary", "admitted") == [("g", 1, 0, False), ("h", 2, 1, True)]
    assert ledger.audited(p, v.limit(0)).filter("audited_out").count() == 4


def test_relative_times(spark):
    now = datetime(2024, 1, 2)
    rows = spark.createDataFrame([(s, now) for s in ("now", "now-1h30m", "now-", "now-5", "2024-01-01 00:00:00", "later")], "s string, now timestamp_ntz")
    got = [r[0] for r in rows.select(feeds.flexible_time(F.col("s"), F.col("now"))).collect()]
    assert got == [now, datetime(2024, 1, 1, 22, 30), None, None, datetime(2024, 1, 1), None]


def test_nearest_prefers_the_earlier(spark):
    day = lambda d: datetime(2024, 1, d)
    asked = spark.createDataFrame([(1, "a", day(3)), (2, "a", day(9)), (3, "b", day(1))], "id long, k string, ts timestamp_ntz")
    captures = spark.createDataFrame([("a", day(2)), ("a", day(4)), ("a", day(8)), ("a", day(11))], "k string, ts timestamp_ntz")
    assert _got(feeds.nearest(asked, captures, "k"), "id", "captured") == [(1, day(2)), (2, day(8)), (3, None)]


def test_kinds_without_a_catalogue_are_degraded(spark):
    series = spark.createDataFrame([("m",)], "name string")
    assert _got(feeds.value_kinds(series, None), "kind", "degraded") == [("gauge", True)]
    types = spark.createDataFrame([("m", "counter_total")], "name string, value_type string")
    assert _got(feeds.value_kinds(series, types), "kind", "degraded") == [("counter", False)]


def _plain_depth(edges):
    best = 2
    for at in edges:
        path = [at]
        while path[-1] in edges and edges[path[-1]] not in path:
            path.append(edges[path[-1]])
        best = max(best, len(path))
    return best


@pytest.mark.parametrize("most", [1_000, 8, 0])
def test_chains_and_circles_of_many_polls(spark, monkeypatch, most):
    monkeypatch.setattr(blocking, "MOST_EDGES", most)
    rng, polls = random.Random(5), {}
    for poll in range(60):
        n = rng.choice([1, 2, 3, 7, 20])
        polls["a" if poll % 2 else "b", poll] = {s: rng.randint(1, n + 2) * 10**12 for s in [i * 10**12 for i in rng.sample(range(1, n + 1), rng.randint(1, n))]}
    polls["c", 1], polls["c", 2] = {i: i + 1 for i in range(1, 13)}, {i: i % 12 + 1 for i in range(1, 13)}
    rows = [(*p, s, b) for p, edges in polls.items() for s, b in edges.items()]
    got = blocking.chain_depth(spark.createDataFrame(rows, "database string, poll long, session long, blocker long"))
    assert {(r.database, r.poll): r.depth for r in got.collect()} == {p: _plain_depth(e) for p, e in polls.items()}


def test_a_round_reads_its_sessions_once(spark, tmp_path):
    spark.createDataFrame([("a", 1, 1, 2), ("a", 1, 2, 0)], "database string, poll long, session long, blocker long").write.parquet(f"{tmp_path}/s")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    s = spark.read.parquet(f"{tmp_path}/s")
    assert (plan(blocking.roles(s)), plan(blocking.chain_depth(s))) == (1, 1)
