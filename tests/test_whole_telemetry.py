"""Telemetry queries against brute force over whole tables, where their SQL takes only a part."""

import hashlib
from collections import Counter

from sondage.operators import evidence
from sondage.operators.logs import template
from sondage.plans import registry
from sondage.sources import telemetry

SF = "/root/testdata/sf0.001"


def _lines(spark):
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        code = hashlib.md5(str(r.turn).encode()).hexdigest()[:10]
        yield r.conv_id, r.turn, {"user": 9, "assistant": 13}.get(r.role, 17), None if r.text is None else f"conn {r.conv_id} id {code} {r.text}"


def test_logs_hold_whole_texts(spark):
    want = list(_lines(spark))
    assert Counter(map(tuple, telemetry.logs(spark, SF).select("stream", "seq", "severity", "body").collect())) == Counter(want)
    hits = Counter(w for w in want if w[2] >= 13 and w[3] and "th" in w[3].lower())
    assert Counter((r.stream, r.seq, r.severity, r.body) for r in registry.QUERIES["log_grep"](spark, SF).collect()) == hits


def test_words_beyond_a_prefix_are_found_with_context(spark):
    by = {}
    for w in sorted((w for w in _lines(spark) if w[3] is not None), key=lambda w: (w[0], w[1], w[3])):
        by.setdefault(w[0], []).append(w)
    want = Counter(
        (s, i + 1, j - i, x[1], x[3])
        for s, rows in by.items() for i, h in enumerate(rows) if h[2] >= 17 and "and" in h[3].lower()
        for j, x in enumerate(rows) if abs(i - j) <= 2
    )
    got = registry.QUERIES["log_grep_context"](spark, SF).collect()
    assert Counter((r.stream, r["at"], r.offset, r.seq, r.body) for r in got) == want


def test_templates_of_whole_texts(spark):
    bodies = spark.createDataFrame([(w[3],) for w in _lines(spark)], "body string")
    want = Counter(r.t for r in bodies.select(template(bodies.body).alias("t")).collect())
    got = registry.QUERIES["log_template_map"](spark, SF).collect()
    assert {r.template: r.n + r.base_n for r in got} == dict(want)


def _walk(next_, i):
    """The reference's ActiveHeir: to the end of the chain, nothing where it comes back to a record."""
    seen = set()
    while i in next_:
        if i in seen:
            return None
        seen.add(i)
        i = next_[i]
    return i


def test_heirs_of_long_chains_and_cycles(spark):
    rows = [(i, i + 1 if i < 37 else None) for i in range(1, 38)] + [(101, 102), (102, 103), (103, 101), (104, 999), (105, None), (201, 105), (202, 105)]
    got = evidence.heirs(spark.createDataFrame(rows, "id long, supersedes long")).collect()
    next_ = {}
    for i, s in sorted(rows, reverse=True):
        next_[s] = i
    next_.pop(None)
    assert {r.id: r.heir for r in got} == {i: _walk(next_, i) for i, _ in rows} and len(got) == len(rows)
    assert {r.heir for r in got if r.id < 38} == {1} and {r.heir for r in got if 101 <= r.id <= 103} == {None}


def test_heirs_are_active_records(spark):
    ids = [r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()]
    next_ = {i - 18: i for i in ids if i % 9 == 0 and i >= 18}
    assert {r.id: r.heir for r in registry.QUERIES["evidence_heirs"](spark, SF).collect()} == {i: _walk(next_, i) for i in ids}


def _table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_topology_walks_all_edges(spark):
    ways = {}
    for r in _table(spark, "lineitem"):
        ways.setdefault(f"s{r.l_suppkey}", set()).add(f"p{r.l_partkey}")
        ways.setdefault(f"p{r.l_partkey}", set()).add(f"s{r.l_suppkey}")
    want, now = {"s1": 0}, {"s1"}
    for hop in (1, 2, 3):
        now = {b for a in now for b in ways.get(a, ())} - set(want)
        want |= dict.fromkeys(now, hop)
    assert {r.node: r.hop for r in registry.QUERIES["topology_bfs"](spark, SF).collect()} == want


def test_plan_stability_counts_all_captures(spark):
    n, plans = Counter(), {}
    for r in _table(spark, "lineitem"):
        n[k := f"q{r.l_partkey % 300}"] += 1
        plans.setdefault(k, set()).add(r.l_suppkey % 7)
    share = {k: len(plans[k]) / n[k] for k in n}
    want = {k: (n[k], len(plans[k]), "unknown" if n[k] < 5 else "unstable" if share[k] >= 0.9 else "stable" if share[k] <= 0.2 else "mixed") for k in n}
    got = registry.QUERIES["plan_stability"](spark, SF).collect()
    assert {r.sql_key: (r.captures, r.plans, r.stability) for r in got} == want


def test_scopes_resolve_against_all_records(spark):
    n, complete, metrics = Counter(), {}, set()
    for r in _table(spark, "events"):
        target, metric = r.user_id % 40, f"{r.event_type.lower()} rate"
        n[target, metric] += 1
        metrics.add(metric)
        complete[target] = complete.get(target, True) and (r.event_id % 3 != 0 or target % 2 == 0)
    scope = {True: "scope", False: "scope_incomplete", None: "unmeasured"}
    want = {(t, m): "ambiguous" if n[t, m] > 1 else "entity" if n[t, m] else scope[complete.get(t)] for t in range(50) for m in metrics}
    got = registry.QUERIES["scope_resolution"](spark, SF).collect()
    assert {(r.target_id, r.metric): r.resolution for r in got} == want


def test_span_page_is_of_all_spans(spark):
    want = sorted((r.l_shipdate, r.l_orderkey, r.l_linenumber) for r in _table(spark, "lineitem"))[:51]
    got = registry.QUERIES["trace_span_page"](spark, SF).collect()
    assert sorted((r.ts, r.trace_id, r.span_id) for r in got) == want
