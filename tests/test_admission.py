"""Admission of candidates: each rule broken by one literal candidate alone."""

from pyspark.sql import functions as F

from sondage.operators import admission
from sondage.operators.evidence import canonical

KEY = ("scan_metrics", "t", "metric", "m", "e", "full")
GOOD = dict(zip(("source", "target_id", "aspect", "metric", "entity_key", "window"), KEY), predicate="present", threshold=None, expectation="must_hold", role="necessary", eid_hint="E1")
SCHEMA = "candidate string, seq long, " + ", ".join(f"{c} {'double' if c == 'threshold' else 'string'}" for c in GOOD)
KEYS = "source string, target_id string, aspect string, metric string, entity_key string, window string"


def _admit(spark, candidates, supports=None, truths=(), delta=None):
    preds = [(c, i, *(GOOD | change).values()) for c, changes in candidates.items() for i, change in enumerate(changes, 1)]
    supports = [(c, "E1") for c in candidates] if supports is None else supports
    records = [("E1", *KEY, True), ("E2", *KEY, False), ("E3", *KEY[:3], "other", *KEY[4:], True), ("E4", *KEY, True)]
    return admission.admit(
        spark.createDataFrame([(c,) for c in candidates], "candidate string"), spark.createDataFrame(preds, SCHEMA), spark.createDataFrame(supports, "candidate string, eid string"),
        spark.createDataFrame([("T ",)], "target_id string"), spark.createDataFrame(list(truths), KEYS + ", predicate string, threshold double, truth boolean"),
        spark.createDataFrame(records, "eid string, " + KEYS + ", active boolean"), None if delta is None else spark.createDataFrame(delta, KEYS),
    )


def _violations(a):
    return sorted((r.candidate, r.seq, r.rule, r.reason) for r in a.violations.collect())


def test_form(spark):
    bad = {
        "predicate": {"predicate": "maybe"}, "threshold_missing": {"predicate": "magnitude_ge"}, "threshold_given": {"threshold": 1.0}, "window": {"window": "half"},
        "expectation": {"expectation": "true"}, "role": {"role": "vital"}, "source": {"source": "gossip"},
    }
    cases = {f"c-{k}": [v, {}] for k, v in bad.items()} | {"a": [{}, {"target_id": "far"}], "b": [{"aspect": "log"}], "d": [{"source": "get_k8s_state", "aspect": "event"}, {"source": "change", "aspect": "change", "predicate": "direction_up"}], "ok": [{}]}
    got = _admit(spark, cases)
    want = [(f"c-{k}", 1, "1c", k) for k in bad] + [("a", 2, "1a", "target"), ("b", 1, "1b", "aspect"), ("d", 2, "1d", "predicate")]
    assert _violations(got) == sorted(want)
    assert [r.candidate for r in got.decisions.filter("admitted").collect()] == ["ok"] and got.decisions.count() == len(cases)


def test_measured_and_bound(spark):
    m = {"metric": "seen", "eid_hint": None}
    cases = {
        "old": [m | {}], "half": [{}, m], "soft": [{"role": "corroborating"}, m], "against": [{"role": "corroborating"}, m | {"expectation": "must_not_hold"}], "narrow": [{}, m | {"window": "onset_narrow"}],
        "dead": [{"eid_hint": "E2"}], "other": [{"eid_hint": "E3"}], "loose": [{}], "none": [{}], "gone": [{"eid_hint": "E9"}], "empty": [],
    }
    supports = [(c, "E1") for c in ("half", "half", "soft", "against", "narrow")] + [("dead", "E2"), ("other", "E3"), ("loose", "E4"), ("gone", "E9")]
    truths = [(*KEY[:3], "seen", "e", "onset_narrow", "present", None, False), (*KEY[:3], "seen", "e", "full", "present", None, True)]
    got = _admit(spark, cases, supports, truths)
    late = {(r.candidate, r.rule) for r in got.violations.filter("seq is null").collect()}
    unbound = {(c, "support") for c in ("old", "dead", "other", "loose", "none", "gone", "empty")}
    assert late == unbound | {("old", "3a"), ("old", "3b"), ("soft", "3b"), ("empty", "3a"), ("empty", "3b")} and got.violations.count() == len(late)
    assert sorted(r.candidate for r in got.decisions.filter("admitted").collect()) == ["against", "half", "narrow"]
    assert sorted((r.candidate, r.reason) for r in got.unbound.collect()) == [("dead", "superseded"), ("gone", "unknown"), ("loose", "unhinted"), ("other", "selector")]
    assert sorted((r.candidate, r.seq) for r in got.tags.collect()) == [("half", 2), ("narrow", 2), ("old", 1), ("soft", 2)]
    again = _admit(spark, {"soft": cases["soft"]}, supports, truths, [(*KEY[:3], "seen", "e", "full")])
    assert [r.admitted for r in again.decisions.collect()] == [True]


def test_evidence_is_asked_without_measuring(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(admission, "measured", lambda *a, plain=admission.measured: asked.append(1) or plain(*a))
    got = _admit(spark, {"loose": [{}], "bad": [{"role": "vital"}]}, [("loose", "E4"), ("bad", "E4")])
    assert [(r.candidate, r.reason) for r in got.unbound.collect()] == [("loose", "unhinted")] and not asked
    assert {r.candidate: (r.predictions, r.bound, r.admitted) for r in got.decisions.collect()} == {"loose": (1, 0, False), "bad": (1, 0, False)} and asked


def test_spellings_fold_with_and_without_white_space(spark):
    said = {"Ab": "ab", " A  b ": "a b", "a\tb": "a b", "a\x0b\r\n b\f": "a b", "": "", "  ": "", "a\u00a0B": "a\u00a0b", None: None}
    got = spark.createDataFrame([(k,) for k in said], "k string").select("k", canonical(F.col("k")).alias("v"))
    assert dict(map(tuple, got.collect())) == said
