"""Appending to the log: each rule broken by one literal record alone."""

import pytest

from sondage.operators import appending

GOOD = {
    "at": 0, "source": "scan_metrics", "target_id": "t", "aspect": "metric", "metric": "m", "entity_key": "", "window": "full", "record_kind": "finding", "headline": "h", "excerpt": "",
    "scoped": False, "kind": "ratio", "direction": "up", "class": "shifted", "availability": "observed", "confidence": "normal", "observed": 1.0, "baseline": 1.0, "magnitude": 1.0,
    "sample_n": 20, "omitted": 0, "truncated": False, "supersedes": None, "refines": None,
}
TYPES = {"at": "long", "sample_n": "long", "omitted": "long", "scoped": "boolean", "truncated": "boolean", "observed": "double", "baseline": "double", "magnitude": "double"}
SCHEMA = ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in GOOD)


def _df(spark, changes, more=""):
    rows = [GOOD | {"at": i} | c for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA + more)


def _rules(df):
    return sorted((r.n, r.rule) for r in df.collect())


def test_each_rule_alone(spark):
    scope = {"record_kind": "query_scope", "scoped": True}
    bad = [
        ("record_kind", {"record_kind": "note"}), ("aspect", {"aspect": "smell"}), ("source", {"source": "x"}), ("source", {"source": None}), ("headline_long", {"headline": "h" * 121}),
        ("excerpt_long", {"excerpt": "e" * 201}), ("scope_missing", scope | {"scoped": False}), ("scope_misplaced", {"scoped": True}), ("window", {"window": "half"}),
        ("effect_kind", {"kind": "sum"}), ("direction", {"direction": "away"}), ("categorical_magnitude", {"kind": "categorical"}), ("finding_class", {"class": ""}),
        ("availability", {"availability": "perhaps"}), ("confidence", {"confidence": "high"}), ("sample_negative", {"sample_n": -1}), ("not_finite", {"baseline": float("inf")}),
        ("not_finite", {"observed": float("nan")}), ("omitted_negative", {"omitted": -1}), ("cut_untold", {"omitted": 3}),
    ]
    fine = [{}, scope, {"record_kind": "meta", "window": None, "kind": None, "direction": None, "class": None}, {"omitted": 3, "truncated": True}, {"kind": "categorical", "magnitude": None}]
    log = appending.numbered(_df(spark, [c for _, c in bad] + fine), ["at"])
    assert _rules(appending.invalid(log)) == [(i, rule) for i, (rule, _) in enumerate(bad, 1)]


def test_links(spark):
    e = "EIX-{:04d}".format
    links = [
        {}, {"supersedes": e(1)}, {"supersedes": e(1)}, {"supersedes": e(4)}, {"supersedes": e(7)}, {"supersedes": e(99)}, {"supersedes": e(2), "target_id": "u"}, {"metric": "other", "refines": e(1)},
        {"refines": e(1)}, {"refines": e(99), "metric": "x"}, {"supersedes": e(3), "record_kind": "meta"}, {"supersedes": e(8), "metric": " OTHER "},
    ]
    log = appending.numbered(_df(spark, links), ["at"])
    assert [r.eid for r in log.orderBy("n").collect()] == [e(i) for i in range(1, 13)]
    assert _rules(appending.broken_links(log)) == [(3, "fork"), (4, "self"), (5, "later"), (6, "missing"), (7, "selector"), (9, "refines_same"), (10, "refines_missing"), (11, "cross_kind")]


def test_append_stops_at_the_first_offender(spark):
    log = appending.numbered(_df(spark, [{}, {}]), ["at"])
    batch = _df(spark, [{"at": 5, "supersedes": "EIX-0001"}, {"at": 6, "supersedes": "EIX-0003"}, {"at": 7, "supersedes": "EIX-0001"}, {"at": 8}])
    whole, broken = appending.append(log, batch, ["at"])
    assert _rules(broken) == [(5, "fork")]
    assert [(r.n, r.at) for r in whole.orderBy("n").collect()] == [(1, 0), (2, 1), (3, 5), (4, 6)] and whole.columns == log.columns
    whole, broken = appending.append(log.limit(0), batch.limit(0), ["at"])
    assert whole.count() == broken.count() == 0


@pytest.mark.parametrize(("n", "text"), [(7, "EIX-0007"), (9999, "EIX-9999"), (123456, "EIX-123456")])
def test_ids(spark, n, text):
    from pyspark.sql import functions as F

    assert spark.range(1).select(appending.eid(F.lit(n)).alias("e")).first().e == text
