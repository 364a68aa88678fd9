"""Findings with keys of their own to records, on literal envelopes."""

import json

import pytest

from sondage.operators import mapping


@pytest.fixture(scope="module")
def got(spark):
    at = "2024-01-01T00:00:00Z"
    span = {"interval": f"{at}/2024-01-01T00:05:00Z", "confidence": "high"}
    end = {"section": "entry", "kind": "SERVER", "axis": "by_name", "label": "GET /", "p50_ms": 30, "count": 50, "baseline": {"p50_ms": 20, "state": "ok", "failed_rate": 0.1}}
    findings = [
        ("scan_metrics", {"class": "shifted", "metric": "cpu", "current_median": 6, "baseline_median": 4}),
        ("scan_metrics", {"class": "shifted", "metric": "cpu", "current_median": 6, "baseline_median": 0}),
        ("scan_metrics", {"class": "appeared", "metric": "cpu", "representative": 7, "episodic": True}),
        ("read_timeseries", {"metric": "cpu", "stats": {"median": 5}, "baseline_median": 10, "onset": span}),
        ("read_timeseries", {"metric": "cpu", "baseline_median": 10}),
        ("list_events", {"section": "episode", "episode_id": "e1", "duration_ms": "12", "boundary": "open", "derived_open_at": at}),
        ("sample_logs", {"relation": "match", "at": at, "refs": ["ch:logs:t:1:abc", "ch:logs:t:1:abd"]}),
        ("sample_logs", {"relation": "before", "at": at}),
        ("db_slow_queries", {"class": "sql", "sql_key": "q", "latency_ms_p50": 8, "baseline_latency_ms_p50": 2, "ratio_p50": 3.5, "polls_in_window": 20, "baseline_polls": 9}),
        ("db_blocking", {"blocked_peak": 3, "first_seen": at, "last_seen": at, "polls": 4}),
        ("breakdown_endpoints", end | {"failed_rate": 0.5}),
        ("breakdown_endpoints", end),
        ("compare_peers", {"class": "self", "target_id": "t", "deviating": True, "direction": "up", "observed": True}),
        ("compare_peers", {"class": "self", "target_id": "t", "deviating": True, "observed": False}),
        ("change", {"kind": "policy_deploy", "at": at}),
        ("change", {"kind": "policy_deploy", "target_id": "u", "at": "soon"}),
        ("get_k8s_state", {"signal": "evicted", "value": 1}),
    ]
    rows = [(i, s, "t", json.dumps(f), "normal", None, 0, False, False) for i, (s, f) in enumerate(findings)]
    rows += [(90, "list_events", "t", "no json", "no_data", "zero_observations", 0, False, False), (91, None, None, None, "no_data", "zero_observations", 2, False, False)]
    rows += [(92, "get_processes", "t", '{"process": "p", "pid": 5, "share": 0.5}', "no_data", "not_collected", 0, False, False), (93, "get_processes", "t", '{"share": 0.5}', "normal", None, 3, None, None)]
    df = spark.createDataFrame(rows, "id long, source string, target_id string, finding string, status string, no_data_reason string, omitted long, truncated boolean, degraded boolean")
    out = {}
    for r in mapping.project(df).collect():
        out.setdefault(r.id, []).append(r)
    return out


def _effect(r):
    return r["class"], r.kind, r.observed, r.baseline, r.magnitude, r.direction, r.confidence


def test_effects(got):
    one = lambda i: _effect(got[i][0])
    assert one(0) == ("shifted", "ratio", 6, 4, 1.5, "up", "normal")
    assert one(1) == ("shifted", "ratio", 6, 0, None, "up", "low")  # no ratio to zero
    assert one(2) == ("appeared", "categorical", 7, None, None, "n/a", "low")
    assert one(3) == ("series", "ratio", 5, 10, 0.5, "down", "normal") and 4 not in got
    assert one(5) == ("episode", "duration", None, None, None, "n/a", "low")  # a text is no number
    assert one(8) == ("sql", "ratio", 8, 2, 3.5, "up", "normal")  # the tool's own ratio
    assert one(9) == ("event", "count", 3, None, 3, "n/a", "low") and got[9][0].sample_n == 4
    assert one(12) == ("self", "categorical", 1, None, None, "up", "normal") and 13 not in got


def test_classes_entities_and_times(got):
    key = lambda i: (got[i][0].entity_key, got[i][0].metric, got[i][0].change_from, got[i][0].change_to)
    at = "2024-01-01T00:00:00Z"
    assert key(0) == ("", "cpu", None, None) and key(3) == ("", "cpu", at, "2024-01-01T00:05:00Z")
    assert key(5) == ("e1", "", at, None) and key(6) == (at + "|abc", "", at, at)
    assert key(9) == ("t|" + at, "blocked_peak", at, at)
    assert key(14) == ("policy_deploy|t|" + at, "change", at, at) and key(15) == ("policy_deploy|u|soon", "change", None, None)
    assert sorted(r["class"] for r in got[10]) == ["endpoint_failure", "endpoint_latency"] and {r.entity_key for r in got[10]} == {"entry|SERVER|by_name|GET /"}
    assert [_effect(r) for r in got[11]] == [("endpoint_latency", "duration", 30, 20, 30, "up", "normal")]
    assert got[6][0]["class"] == "grep"


def test_meta_unknown_and_gaps(got):
    kind = lambda i: (got[i][0].record_kind, got[i][0]["class"], got[i][0].unknown, got[i][0].availability)
    assert kind(7) == ("meta", "before", False, "observed") and kind(16) == ("meta", "evicted", True, "observed")
    assert kind(90) == ("meta", "", True, "observed_zero") and kind(91) == ("meta", "", True, "missing")
    assert kind(92) == ("finding", "process", False, "not_applicable") and got[92][0].entity_key == "p|5"
    assert got[93][0].confidence == "low" and got[93][0].entity_key == "|"


def test_table_is_whole():
    rows = mapping.rows()
    assert len({(r[0], r[2]) for r in rows}) == 25 and len(rows) == len({(r[0], r[1], r[2]) for r in rows})
