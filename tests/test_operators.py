"""Branches that the shared tables don't reach, on literal rows."""

from sondage.operators import episodes, evidence, inventory, series, traces


def _series(spark, **values):
    return spark.createDataFrame([(n, i, float(v)) for n, vs in values.items() for i, v in enumerate(vs)], "name string, bucket long, value double")


def test_four_classes(spark):
    base = _series(spark, a=[1] * 20, b=[1] * 20, c=[1] * 3)
    now = _series(spark, a=[1] * 20, b=[9] * 20, d=[2] * 5)
    got = {r["name"]: r for r in series.classify(now, base, 20).collect()}
    assert {n: r["class"] for n, r in got.items()} == {"a": "steady", "b": "shifted", "c": "disappeared", "d": "appeared"}
    assert got["c"].intermittent and got["c"].thin and not got["b"].thin


def test_onset_needs_two_of_three(spark):
    base = _series(spark, a=[1, 2] * 10, b=[1, 2] * 10, c=[1, 2] * 10)
    now = _series(spark, a=[1, 1, 50, 1, 50, 50], b=[1, 1, 1, 1, 1, 50], c=[50, 50, 1, 1, 1, 1])
    got = {r["name"]: (r.onset_from, r.onset_to, r.state) for r in series.onset(now, base).collect()}
    assert got == {"a": (1, 2, "found"), "c": (None, 0, "outside_window")}


def test_counter_reset(spark):
    got = [r["value"] for r in series.increases(_series(spark, a=[1, 4, 2, 5])).orderBy("bucket").collect()]
    assert got == [3.0, 0.0, 3.0]


def test_upper_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert df.agg(traces.upper_median("x")).first()[0] == 3.0


def test_pairing(spark):
    left = spark.sql("select * from values (1, timestamp_ntz'2024-01-01 00:00:10', 'k'), (2, timestamp_ntz'2024-01-01 01:00:00', 'k'), (3, timestamp_ntz'2024-01-02', 'k') t(id, at, key)")
    right = spark.sql("select * from values (7, timestamp_ntz'2024-01-01 00:00:12', 'k'), (8, timestamp_ntz'2024-01-01 01:00:01', 'k'), (9, timestamp_ntz'2024-01-01 00:59:58', 'k') t(id, at, key)")
    got = {r.id: (r.pairing, r.partner) for r in episodes.pair_consumed(left, right, 2).collect()}
    assert got == {1: ("unique_inferred", 7), 2: ("ambiguous", None), 3: ("unmatched", None)}


def test_parent_chain_stops_at_a_cycle(spark):
    t = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "id string, parent_id string")
    got = sorted((r.depth, r.ancestor) for r in inventory.parent_chain(t).filter("id = 'a'").collect())
    assert got == [(1, "b"), (2, "c")]


def test_direction_and_magnitude(spark):
    f = spark.createDataFrame([(1, "ratio", 4.0, 2.0), (2, "ratio", 4.0, 0.0), (3, "count", 0.0, None)], "id int, kind string, observed double, baseline double")
    f = f.selectExpr("id", "1 as target_id", "' A  b ' as metric", "kind", "observed", "baseline", "20 as sample_n")
    got = {r.id: r for r in evidence.project(f).collect()}
    assert (got[1].magnitude, got[1].direction, got[1].confidence, got[1].metric) == (2.0, "up", "normal", "a b")
    assert (got[2].magnitude, got[2].confidence) == (None, "low")
    assert (got[3].availability, got[3].direction) == ("observed_zero", "n/a")
