"""Each arm of an endpoint's verdict alone, on literal totals."""

import pytest

from sondage.operators import traces

KIND = "kind string, n long, unique_n long, p50 double, p95 double, failed long, coded long, rejected long"
CALM = {"n": 100, "unique_n": 100, "p50": 10.0, "p95": 20.0, "failed": 0, "coded": 100, "rejected": 0}


def _row(kind, more):
    return (kind, *(CALM | more).values())


CASES = [
    ("SERVER", {"p50": 30.0}, {}, "latency_ratio"), ("CONSUMER", {"p50": 30.0}, {}, "latency_ratio"), ("INTERNAL", {"p50": 30.0}, {}, ""), ("CLIENT", {"p50": 99.0}, {}, ""),
    ("SERVER", {"p50": 30.0}, {"unique_n": 29}, ""), ("SERVER", {"p50": 30.0}, {"p50": 0.0}, ""),
    ("INTERNAL", {"p95": 300.0}, {"p95": 100.0}, "latency_shift"), ("INTERNAL", {"p95": 299.0}, {"p95": 10.0}, ""), ("INTERNAL", {"p95": 600.0}, {"p95": 0.0}, ""),
    ("INTERNAL", {"p95": 3000.0}, {"p95": 1001.0}, "latency_magnitude"), ("INTERNAL", {"p95": 3000.0}, None, "latency_magnitude"),
    ("SERVER", {"failed": 5}, {"failed": 4}, "failure_magnitude"), ("SERVER", {"failed": 4}, None, ""), ("INTERNAL", {"failed": 90}, {"failed": 85}, ""),
    ("CLIENT", {"n": 300, "unique_n": 90, "failed": 5}, None, "failure_magnitude"),
    ("INTERNAL", {"failed": 20}, {"failed": 10}, "failure_shift"), ("INTERNAL", {"failed": 19}, {"failed": 10}, ""), ("CONSUMER", {"failed": 12}, {"failed": 3}, ""),
    ("SERVER", {"rejected": 20}, {"rejected": 10}, "rejection_shift"), ("SERVER", {"rejected": 19}, {}, ""), ("INTERNAL", {"rejected": 90}, {}, ""),
    ("SERVER", {"rejected": 92}, {"rejected": 51}, "rejection_shift"), ("SERVER", {"rejected": 70}, {"rejected": 51}, ""), ("SERVER", {"rejected": 20, "coded": 0}, {}, ""),
    ("SERVER", {"unique_n": 29, "p95": 9000.0, "failed": 20}, {}, ""),
]


def test_each_arm_alone(spark):
    now = spark.createDataFrame([(i, *_row(k, m)) for i, (k, m, _, _) in enumerate(CASES)], "route long, " + KIND)
    base = spark.createDataFrame([(i, *_row(k, m)) for i, (k, _, m, _) in enumerate(CASES) if m is not None], "route long, " + KIND)
    rows = traces.verdict_arms(now, base, ["route", "kind"]).collect()
    assert {r.route: ",".join(r.arms) for r in rows} == {i: arms for i, (*_, arms) in enumerate(CASES)}
    assert {r.base_state for r in rows if CASES[r.route][2] is None} == {"insufficient_samples"}
    assert {r.verdict for r in rows if CASES[r.route][1].get("unique_n") == 29} == {"insufficient_sample"}


@pytest.mark.parametrize("arm", ["latency_magnitude", "failure_magnitude"])
def test_without_a_window_to_compare_only_sizes_count(spark, arm):
    loud = {"p50": 5000.0, "p95": 9000.0, "failed": 50, "rejected": 50}
    now, base = (spark.createDataFrame([("r", *_row("SERVER", m))], "route string, " + KIND) for m in (loud, {}))
    got = traces.verdict_arms(now, base, ["route", "kind"], compared=False).first()
    assert arm in got.arms and len(got.arms) == 2 and got.base_state == "unavailable"
