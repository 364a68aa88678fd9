"""Which candidate hypotheses are opened: form of their predictions, what is measured already, and the evidence that binds them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators.appending import ASPECTS, SOURCES, WINDOWS
from sondage.operators.evidence import KEY, canonical_keys
from sondage.operators.mapping import ALLOWED
from sondage.operators.mapping import rows as classes
from sondage.sources import durable

# Fixed values.
PREDICATES = ALLOWED["all"]
WITH_THRESHOLD = ("magnitude_ge", "magnitude_lt")
EXPECTATIONS = ("must_hold", "must_not_hold")
ROLES = ("necessary", "corroborating")

SELECTOR = [c for c in KEY if c != "window"]
TABLE = sorted({f"{r[0]}/{r[3]}" for r in classes()})
UNION = sorted({f"{r[0]}/{p}" for r in classes() for p in r[5]})


def form(predictions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rule 1 by prediction: (candidate, seq, rule, reason).

    1c: the first of the fields that is no such value, or a threshold that its predicate lacks or can't have. 1a: a target outside
    vocabulary(target_id). 1b and 1d, if the source is one: no class of the source has the aspect, none allows the predicate. That the
    metric or the entity exists is not asked, as a prediction may be of what nobody has looked at.
    """
    known = canonical_keys(vocabulary.select(*[F.col("target_id") if c == "target_id" else F.lit("").alias(c) for c in KEY])).select("target_id", F.lit(True).alias("__known")).distinct()
    p = predictions.join(known, "target_id", "left")
    no = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    needs = F.col("predicate").isin(*WITH_THRESHOLD)
    first = (
        F.when(no("source", SOURCES), "source").when(F.col("target_id") == "", "target_id").when(no("aspect", ASPECTS), "aspect").when(no("predicate", PREDICATES), "predicate")
        .when(needs & F.col("threshold").isNull(), "threshold_missing").when(~needs & F.col("threshold").isNotNull(), "threshold_given").when(no("window", WINDOWS), "window")
        .when(no("expectation", EXPECTATIONS), "expectation").when(no("role", ROLES), "role")
    )
    real = ~no("source", SOURCES)
    broken = F.array_compact(F.array(
        F.when(first.isNotNull(), F.struct(F.lit("1c").alias("rule"), first.alias("reason"))),
        F.when(F.col("__known").isNull(), F.struct(F.lit("1a").alias("rule"), F.lit("target").alias("reason"))),
        F.when(real & ~F.concat_ws("/", "source", "aspect").isin(*TABLE), F.struct(F.lit("1b").alias("rule"), F.lit("aspect").alias("reason"))),
        F.when(real & ~no("predicate", PREDICATES) & ~F.concat_ws("/", "source", "predicate").isin(*UNION), F.struct(F.lit("1d").alias("rule"), F.lit("predicate").alias("reason"))),
    ))
    return p.select("candidate", "seq", F.explode(broken).alias("v")).select("candidate", "seq", "v.*")


def measured(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """predictions with ``truth``, null where truths(KEY, predicate, threshold, truth) says nothing of their key in any window.

    The window of a prediction doesn't count, lest it be put again under another one; of several windows the first in ``WINDOWS`` does.
    """
    on = [*SELECTOR, "predicate", "__at"]
    at = F.coalesce(F.col("threshold").cast("string"), F.lit("")).alias("__at")
    place = F.array_position(F.array(*map(F.lit, WINDOWS)), F.col("window"))
    known = canonical_keys(truths).filter(F.col("truth").isNotNull() & (place > 0)).groupBy(*SELECTOR, "predicate", at).agg((F.min(2 * place + F.col("truth").cast("int")) % 2 == 1).alias("truth"))
    return predictions.withColumn("__at", at).join(known, on, "left").drop("__at")


def bind(supports: DataFrame, predictions: DataFrame, records: DataFrame) -> DataFrame:
    """supports(candidate, eid) with a null ``reason`` where the eid is bound, else why it isn't.

    Bound: an active one of records(eid, KEY, active), named in the ``eid_hint`` of one of the candidate's predictions, with the key of the first
    of those. A support that is named twice is bound once; of records with one eid, and of predictions with one seq, the least key counts.
    """
    known = canonical_keys(records).groupBy("eid").agg(F.min(F.struct(F.struct(*KEY).alias("key"), "active")).alias("__r")).select("eid", "__r.active", F.col("__r.key").alias("__key"))
    hints = predictions.filter("eid_hint is not null").groupBy("candidate", F.col("eid_hint").alias("eid")).agg(F.min(F.struct("seq", F.struct(*KEY).alias("key")))["key"].alias("__hint"))
    rows = supports.select("candidate", "eid").distinct().join(known, "eid", "left").join(hints, ["candidate", "eid"], "left")
    why = (
        F.when(F.col("__key").isNull(), "unknown").when(~F.coalesce("active", F.lit(False)), "superseded").when(F.col("__hint").isNull(), "unhinted")
        .when(F.col("__hint") != F.col("__key"), "selector")
    )
    return rows.select("candidate", "eid", why.alias("reason"))


class Admission:
    """The parts of an admission, each made when it is first asked for, so that a question of the evidence doesn't measure predictions.

    Predictions meet the truths once, before the candidates that break rule 1 are known; these leave at their aggregate.
    """

    def __init__(self, candidates: DataFrame, predictions: DataFrame, supports: DataFrame, vocabulary: DataFrame, truths: DataFrame, records: DataFrame, delta: DataFrame | None) -> None:
        self._candidates, self._p, self._supports, self._vocabulary = candidates.select("candidate").distinct(), canonical_keys(predictions), supports, vocabulary
        self._truths, self._records, self._delta = truths, records, delta

    @cached_property
    def _broken(self) -> DataFrame:
        return durable(form(self._p, self._vocabulary), "form")

    @cached_property
    def _badly(self) -> DataFrame:
        return self._broken.select("candidate").distinct()

    @cached_property
    def _seen(self) -> DataFrame:
        """All predictions with truth, pre_satisfied and whether their key is open again."""
        holds = F.coalesce(F.col("truth") == (F.col("expectation") == "must_hold"), F.lit(False))
        seen = measured(self._p, self._truths).withColumn("pre_satisfied", holds)
        if self._delta is None:
            seen = seen.withColumn("__again", F.lit(False))
        else:
            again = canonical_keys(self._delta).select(*KEY).distinct().withColumn("__again", F.lit(True))
            seen = seen.join(again, KEY, "left").fillna(False, ["__again"])
        return seen.select("candidate", "seq", "truth", "role", "pre_satisfied", "__again")

    @cached_property
    def _tied(self) -> DataFrame:
        return bind(self._supports.join(self._badly, "candidate", "left_anti"), self._p, self._records)

    @cached_property
    def _judged(self) -> DataFrame:
        """Each candidate with its counts, whether it breaks rule 1 (``__bad``), and what it breaks else (``__late``)."""
        live = (F.col("role") == "necessary") & (~F.col("pre_satisfied") | F.col("__again"))
        per = self._seen.groupBy("candidate").agg(
            F.count(F.lit(1)).alias("predictions"), F.count_if("pre_satisfied").alias("pre_satisfied"), F.count_if(F.col("truth").isNull()).alias("__open"), F.count_if(live).alias("__live")
        )
        n = self._tied.filter("reason is null").groupBy("candidate").agg(F.count(F.lit(1)).alias("bound"))
        bad = self._badly.withColumn("__bad", F.lit(True))
        all_ = self._candidates.join(bad, "candidate", "left").join(per, "candidate", "left").join(n, "candidate", "left")
        all_ = all_.fillna(0, ["predictions", "pre_satisfied", "__open", "__live", "bound"]).fillna(False, ["__bad"])
        rule = lambda r, why: F.struct(F.lit(r).alias("rule"), F.lit(why).alias("reason"))
        late = F.array_compact(F.array(
            F.when(F.col("bound") == 0, rule("support", "unbound")), F.when(F.col("__open") == 0, rule("3a", "all_measured")), F.when(F.col("__live") == 0, rule("3b", "none_necessary_open"))
        ))
        return all_.withColumn("__late", late)

    @property
    def decisions(self) -> DataFrame:
        """candidate, predictions, pre_satisfied, bound, admitted"""
        sound = lambda c: F.when(F.col("__bad"), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
        return self._judged.select("candidate", "predictions", sound("pre_satisfied"), sound("bound"), (~F.col("__bad") & (F.size("__late") == 0)).alias("admitted"))

    @property
    def violations(self) -> DataFrame:
        """candidate, seq (null: of the candidate), rule, reason"""
        none = F.lit(None).cast(self._broken.schema["seq"].dataType).alias("seq")
        return self._broken.unionByName(self._judged.filter("not __bad").select("candidate", none, F.explode("__late").alias("v")).select("candidate", "seq", "v.*"))

    @property
    def unbound(self) -> DataFrame:
        """candidate, eid, reason"""
        return self._tied.filter("reason is not null")

    @property
    def tags(self) -> DataFrame:
        """candidate, seq, tag"""
        met = self._seen.filter("pre_satisfied").join(self._badly, "candidate", "left_anti")
        return self._broken.select("candidate", "seq", F.lit("undecidable").alias("tag")).distinct().unionByName(met.select("candidate", "seq", F.lit("pre_satisfied").alias("tag")))


def admit(candidates: DataFrame, predictions: DataFrame, supports: DataFrame, vocabulary: DataFrame, truths: DataFrame, records: DataFrame, delta: DataFrame | None = None) -> Admission:
    """candidates(candidate), predictions(candidate, seq, KEY, predicate, threshold, expectation, role, eid_hint) and the rest as above.

    A candidate that breaks rule 1 is judged by it alone. Rule 2 tags a prediction ``pre_satisfied`` that is measured and comes out as it
    expects. Rule 3: one prediction at least isn't measured (``3a``), and one that is necessary isn't pre_satisfied, or its key is among the
    delta(KEY) that new evidence has opened again (``3b``). ``support``: no eid is bound. Each step is a join by key and an aggregate by candidate.
    """
    return Admission(candidates, predictions, supports, vocabulary, truths, records, delta)
