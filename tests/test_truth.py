"""Truth of predicates on literal rows, one for each status and predicate."""

from pyspark.sql import functions as F

from sondage.operators import evidence, mapping

OK = ("present", None, "entity", "shifted", "observed", 2.0, "up")


def test_statuses_and_truths(spark):
    cases = [
        (OK, "ok", True), (("absent", *OK[1:]), "ok", False), (("present", None, "scope", None, "observed_zero", None, None), "ok", False), (("absent", None, "scope", None, "observed", None, None), "ok", True),
        (("present", None, "entity", "shifted", "observed_zero", 0.0, "flat"), "ok", True),  # a record of zero is still a record
        (("magnitude_ge", 2.0, *OK[2:]), "ok", True), (("magnitude_lt", 2.0, *OK[2:]), "ok", False), (("direction_up", *OK[1:]), "ok", True), (("direction_down", *OK[1:]), "ok", False),
        (("direction_down", None, "entity", "shifted", "observed", 2.0, "flat"), "ok", False),
        (("present", None, "ambiguous", *OK[3:]), "unresolved", None), (("present", None, None, *OK[3:]), "unresolved", None), (("perhaps", *OK[1:]), "unknown_predicate", None), ((None, *OK[1:]), "unknown_predicate", None),
        (("present", None, "entity", "shifted", "missing", 2.0, "up"), "unusable_availability", None), (("absent", None, "scope", None, "not_applicable", None, None), "unusable_availability", None),
        (("magnitude_ge", 1.0, "entity", "appeared", "observed", 2.0, "up"), "class_not_allowed", None), (("present", None, "entity", "counts", "observed", 2.0, "up"), "class_not_allowed", None),
        (("magnitude_ge", 1.0, "scope", None, "observed", 2.0, "up"), "no_magnitude", None), (("magnitude_ge", 1.0, "entity", "shifted", "observed", None, "up"), "no_magnitude", None),
        (("magnitude_lt", None, *OK[2:]), "no_threshold", None), (("direction_up", None, "scope", None, "observed", None, "up"), "no_direction", None),
        (("direction_up", None, "entity", "shifted", "observed", 2.0, "n/a"), "no_direction", None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, (c, _, _) in enumerate(cases)], "id long, predicate string, threshold double, resolution string, class string, availability string, magnitude double, direction string")
    got = evidence.truth(rows.withColumn("allowed", mapping.allows(F.lit("scan_metrics"), F.col("class"), F.col("predicate")))).orderBy("id").collect()
    assert [(r.status, r.truth) for r in got] == [(s, t) for _, s, t in cases]
