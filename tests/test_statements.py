"""Verdicts over statements on literal rows."""

from sondage.operators import traces


def test_statement_verdicts(spark):
    schema = "sql_key string, mode string, p50 double, max_ms double, polls long"
    # key: current (p50, max, polls), baseline, mode
    cases = {
        "both": ((30, 60, 5), (10, 20, 5)), "median": ((30, 50, 5), (10, 20, 5)), "max": ((20, 60, 5), (10, 20, 5)), "faster": ((3, 20, 5), (10, 20, 5)), "chronic": ((10, 20, 5), (10, 20, 9)),
        "stable": ((10, 20, 5), (10, 20, 8)), "zero": ((10, 20, 5), (0, 0, 10)), "zero-median": ((10, 60, 5), (0, 20, 10)), "few": ((90, 90, 2), (10, 20, 9)), "few-before": ((90, 90, 5), (10, 20, 2)), "new": ((90, 90, 5), None),
    }
    now = [(k, "delta", *map(float, c[:2]), c[2]) for k, (c, _) in cases.items()] + [("old", "legacy", 90.0, 90.0, 9)]
    before = [(k, "delta", *map(float, b[:2]), b[2]) for k, (_, b) in cases.items() if b] + [("old", "legacy", 10.0, 10.0, 9)]
    now, before = spark.createDataFrame(now, schema), spark.createDataFrame(before, schema)
    got = {r.sql_key: (r.verdict, r.basis) for r in traces.statement_verdict(now, before, 10).collect()}
    assert got == {
        "both": ("slower", "both"), "median": ("slower", "median"), "max": ("slower", "max"), "faster": ("faster", None), "chronic": ("chronic", None), "stable": ("stable", None), "zero": ("stable", None),
        "zero-median": ("slower", "max"), "few": ("insufficient_baseline", None), "few-before": ("insufficient_baseline", None), "new": ("insufficient_baseline", None), "old": ("not_assessable_legacy", None),
    }
    assert {r.verdict for r in traces.statement_verdict(now, before, 0).collect()} >= {"slower", "stable"}
