"""Keys resolved by records and by the scopes that cover them, on literal rows."""

from datetime import datetime, timedelta

from sondage.operators import evidence, feeds

KEY = "source string, target_id string, aspect string, metric string, entity_key string, window string"


def _got(spark, asked, records, scopes):
    rows = evidence.resolve_keys(
        spark.createDataFrame([(i, *k) for i, k in enumerate(asked)], "id long, " + KEY), spark.createDataFrame(records, "eid long, " + KEY + ", availability string"),
        spark.createDataFrame(scopes, "eid long, " + KEY + ", availability string, complete boolean"),
    )
    return [(r.resolution, r.availability) for r in rows.orderBy("id").collect()]


def test_any_in_each_place_and_spellings(spark):
    key = lambda metric, entity, target="t": ("s", target, "a", metric, entity, "w")
    asked = [key("m", "e"), key(" M ", "E"), key("other", "e"), key("m", "x"), key("other", "x"), key("m", "e", "u"), key("m", ""), key("none", ""), key("m", "x", "v")]
    records = [(1, *key("m", "e"), "observed"), (2, *key("two", "e"), "observed"), (3, *key("two", "e"), "missing")]
    scopes = [(10, *key("*", "e"), "observed_zero", True), (11, *key("m", "*"), "observed", True), (12, *key("*", "*", "u"), "observed_zero", False), (13, *key("m", "x", "v"), "observed_zero", True)]
    assert _got(spark, asked, records, scopes) == [
        ("entity", "observed"), ("entity", "observed"), ("scope", "observed_zero"), ("scope", "observed"), ("unmeasured", None), ("scope_incomplete", None),
        ("entity", "observed"), ("unmeasured", None), ("scope", "observed_zero"),
    ]
    assert _got(spark, [key("two", "e"), key("two", None)], records, scopes) == [("ambiguous", None), ("ambiguous", None)]


def test_all_covering_scopes_count(spark):
    k = ("s", "t", "a", "m", "e", "w")
    cover = lambda i, metric, entity, availability, complete=True: (i, "s", "t", "a", metric, entity, "w", availability, complete)
    one = lambda *scopes: _got(spark, [k], [], list(scopes))
    assert one(cover(1, "*", "*", "observed_zero"), cover(2, "m", "*", "observed")) == [("scope", "observed")]
    assert one(cover(1, "*", "*", "observed_zero"), cover(2, "m", "e", "observed_zero")) == [("scope", "observed_zero")]
    assert one(cover(1, "*", "*", "observed"), cover(3, "m", "*", "not_applicable"), cover(2, "*", "e", "missing")) == [("scope", "missing")]
    assert one(cover(1, "*", "*", "observed"), cover(2, "m", "*", "observed", False)) == [("scope_incomplete", None)]


def test_changes_further_back_than_asked_are_left_out(spark):
    at = lambda d: datetime(2024, 1, d)
    changes = spark.createDataFrame([(d, at(d), "t") for d in (1, 2, 5, 6, 9)] + [(7, at(5), "u")], "id long, at timestamp_ntz, target_id string")
    got = feeds.scanned_changes(changes, spark.createDataFrame([("t",), ("t",)], "target_id string"), at(5), at(9), timedelta(days=3))
    assert sorted((r.id, r.late) for r in got.collect()) == [(2, False), (5, False), (6, True)]


def test_changes_of_any_age_without_a_look_back(spark):
    at = lambda y: datetime(y, 1, 1)
    changes = spark.createDataFrame([(y, at(y), "t") for y in (1970, 1990, 2024, 2025)], "id long, at timestamp_ntz, target_id string")
    got = feeds.scanned_changes(changes, spark.createDataFrame([("t",)], "target_id string"), at(2024), at(2025))
    assert sorted((r.id, r.late) for r in got.collect()) == [(1970, False), (1990, False), (2024, False)]
