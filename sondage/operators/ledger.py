"""Judgement of hypotheses: which evidence qualifies, what is still unseen, how candidates merge, how sure a report may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the confidence rubric, in hundredths.
BANDS = {"confirmed": 80, "probable": 50}
ITEM, CLAMP = 5, 10


def confidence(hypotheses: DataFrame) -> DataFrame:
    """hypotheses(status, lineages, temporal, weak, qualified, unexamined, required) with the items that apply and the value; 0 without a band."""
    band = F.when(F.col("status") == "confirmed", BANDS["confirmed"]).when(F.col("status") == "probable", BANDS["probable"]).otherwise(0)
    items = {
        "lineage_ge3": (F.col("lineages") >= 3, ITEM), "temporal_confirmed": (F.col("temporal"), ITEM), "weak_majority": (F.col("weak") > F.col("qualified"), -ITEM),
        "unexamined_over_third": ((F.col("required") > 0) & (3 * F.col("unexamined") > F.col("required")), -ITEM),
    }
    applies = {n: (band > 0) & F.coalesce(c, F.lit(False)) for n, (c, _) in items.items()}
    total = sum((F.when(applies[n], d).otherwise(0) for n, (_, d) in items.items()), F.lit(0))
    value = (band + F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), total))) / 100
    named = F.concat_ws(",", *[F.when(c, n) for n, c in applies.items()])
    return hypotheses.withColumns({"band": band / 100, "items": named, "value": value})


def existential(predicate: Column, must_hold: Column) -> Column:
    """Claims that one sight proves; absence and "less than" are claims on the whole window, and a negation turns each into the other."""
    some = ~predicate.isin("absent", "magnitude_lt")
    return F.when(must_hold, some).otherwise(~some)


def qualify(rows: DataFrame) -> DataFrame:
    """The state of each of seven clauses (pass, fail, unknown, no_source) and whether the evidence qualifies: none fails, none is unknown.

    rows(id, heir, counter, predicate, must_hold, availability, confidence, scope_omitted, omitted, from_at, to_at, change_from, change_to,
    need_from, need_to, lag_status, lag_s, now, sample_n, min_sample). A null heir is a cycle; evidence against a claim (counter) and claims
    on a whole window need a window that covers the needed one, else one sight inside it is enough.
    """
    c = F.col
    passed = lambda cond: F.when(cond, "pass").otherwise("fail")
    missing_window = c("need_from").isNull() | c("need_to").isNull() | c("from_at").isNull() | c("to_at").isNull()
    covers = (c("from_at") <= c("need_from")) & (c("to_at") >= c("need_to"))
    seen_from = F.coalesce("change_from", "from_at")
    seen_to = F.when(c("change_from").isNull(), c("to_at")).otherwise(F.coalesce("change_to", "change_from"))
    inside = (seen_to >= c("need_from")) & (seen_from <= c("need_to"))
    arrived = c("now") >= c("to_at") + F.make_dt_interval(secs=c("lag_s"))
    clauses = {
        "active": passed(F.coalesce(c("heir") == c("id"), F.lit(False))),
        "available": passed(F.when(c("counter"), ~c("availability").isin("missing", "not_applicable")).otherwise(c("availability").isin("observed", "observed_zero"))),
        "trusted": passed(c("confidence") == "normal"),
        "untruncated": passed((F.coalesce("scope_omitted", F.lit(0)) == 0) & (F.coalesce("omitted", F.lit(0)) == 0)),
        "window": F.when(missing_window, "unknown").when(covers, "pass").when(c("counter") | ~existential(c("predicate"), c("must_hold")), "fail").otherwise(passed(inside)),
        "arrived": F.when(~F.coalesce(c("lag_status") == "observed", F.lit(False)) | c("to_at").isNull() | c("now").isNull(), "unknown").otherwise(passed(arrived)),
        "sample": F.when(c("sample_n").isNull() | c("min_sample").isNull(), "no_source").otherwise(passed(c("sample_n") >= c("min_sample"))),
    }
    judged = rows.withColumns(clauses)
    failed = F.concat_ws(",", *[F.when(c(n).isin("fail", "unknown"), n) for n in clauses])
    return judged.withColumn("failed", failed).withColumn("qualified", F.col("failed") == "")


def unseen_views(required: DataFrame, not_applicable: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """Required views that apply and that no finding shows."""
    return required.select(*key).distinct().join(not_applicable.select(*key), key, "left_anti").join(observed.select(*key), key, "left_anti")


def changed_keys(before: DataFrame, now: DataFrame) -> DataFrame:
    """Keys that are new or whose evidence, as an ordered list of (key, place, eid), is another now."""
    both = now.select("key", "place", F.col("eid").alias("__now")).join(before.select("key", "place", F.col("eid").alias("__before")), ["key", "place"], "full")
    other = both.groupBy("key").agg(F.count("__now").alias("__n"), F.bool_or(~F.col("__now").eqNullSafe(F.col("__before"))).alias("__other"))
    return other.filter("__n > 0 and __other").select("key")


def merged(candidates: DataFrame, predictions: DataFrame, support: DataFrame) -> DataFrame:
    """One row for each group of candidates(id, grp, source, target, depth, prior): predictions(id, key) and support(id, eid) are joined as sets.

    The target is that of the longest chain, the prior the highest; of equal ones the first candidate's counts.
    """
    first = lambda *by: F.struct(*by, (-F.col("id")).alias("i"))
    base = candidates.groupBy("grp").agg(
        F.count(F.lit(1)).alias("merged_count"), F.min("id").alias("lead"), F.min_by("source", "id").alias("source"), F.count_distinct("source").alias("sources"),
        F.max_by("target", first("depth")).alias("target"), F.max("depth").alias("depth"), F.max("prior").alias("prior"), F.min_by("depth", "id").alias("__d"),
    )
    of = candidates.select("id", "grp")
    preds = predictions.join(of, "id").groupBy("grp").agg(F.count_distinct("key").alias("predictions"), (F.count("key") - F.count_distinct("key")).alias("repeated"))
    eids = support.filter("eid <> ''").join(of, "id").groupBy("grp").agg(F.count_distinct("eid").alias("support"))
    rows = base.join(preds, "grp", "left").join(eids, "grp", "left").na.fill(0, ["predictions", "repeated", "support"])
    return rows.withColumn("chain_replaced", F.col("depth") > F.col("__d")).drop("__d")


def front(groups: DataFrame, most: int = 5) -> DataFrame:
    """The candidates that a round goes on with."""
    return groups.orderBy(F.desc("prior"), "lead").limit(most)


def misgrouped(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that are in no group or in several, and members that are no candidates: empty for a partition."""
    n = groups.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = candidates.select("id", F.lit(True).alias("__known")).join(n, "id", "full")
    state = F.when(F.col("__known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select("id", state.alias("state")).filter("state is not null")


def audited(predictions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """predictions(id, hypothesis, role) after verdicts(id, pertinent, substantive, role_valid): out without a valid one, demoted where the role isn't."""
    valid = F.coalesce(F.col("pertinent") & F.col("substantive"), F.lit(False))
    demoted = valid & (F.col("role") == "necessary") & F.coalesce(~F.col("role_valid"), F.lit(False))
    rows = predictions.join(verdicts, "id", "left")
    return rows.select("id", "hypothesis", F.when(demoted, "corroborating").otherwise(F.col("role")).alias("role"), (~valid).alias("audited_out"), demoted.alias("demoted"))


def recheck(audit: DataFrame) -> DataFrame:
    """Hypotheses need two live predictions, one of them necessary."""
    live = ~F.col("audited_out")
    n = audit.groupBy("hypothesis").agg(F.count_if(live).alias("live"), F.count_if(live & (F.col("role") == "necessary")).alias("necessary"))
    return n.withColumn("admitted", (F.col("live") >= 2) & (F.col("necessary") >= 1))


def discriminating(predictions: DataFrame) -> DataFrame:
    """Candidates, and whether another one expects something else of an observation that they predict.

    Counted by key instead of paired: of all holders of a key, less those of the same expectation, less own ones of another.
    """
    held = predictions.select("id", "key", "expectation").distinct()
    by_key = held.groupBy("key").agg(F.count(F.lit(1)).alias("__all"))
    by_kind = held.groupBy("key", "expectation").agg(F.count(F.lit(1)).alias("__same"))
    own = held.groupBy("id", "key").agg(F.count(F.lit(1)).alias("__own"))
    rows = held.join(by_kind, ["key", "expectation"]).join(by_key, "key").join(own, ["id", "key"])
    return rows.groupBy("id").agg(F.bool_or(F.col("__all") - F.col("__same") - F.col("__own") + 1 > 0).alias("discriminating"))


def cohort(candidates: DataFrame) -> DataFrame:
    """One row: candidates(id, cause), how many causes they name that are not unknown, and the tags of the whole."""
    named = F.when((F.col("cause") != "") & ~F.startswith("cause", F.lit("unknown:")), F.col("cause"))
    n = candidates.agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct(named).alias("causes"))
    return n.withColumns({"diversity_unmet": F.col("causes") < 2, "count_below_min": F.col("candidates") < 3})


def unexplained(groups: DataFrame, findings: DataFrame, covered: DataFrame) -> DataFrame:
    """Targets of anomalous groups(target_id, anomalous) and findings(target_id, source, status), changes aside, that no hypothesis names."""
    odd = groups.filter("anomalous").select("target_id").union(findings.filter("source <> 'change' and status = 'anomalous'").select("target_id"))
    return odd.filter("target_id <> ''").distinct().join(covered.select("target_id"), "target_id", "left_anti")


def lineage(source: Column, target: Column, metric: Column, ref: Column) -> Column:
    """The same for the same series of the same target in any window: the first two parts of the reference, or the source without one."""
    stem = F.when(F.coalesce(ref, F.lit("")) == "", source).otherwise(F.substring_index(ref, ":", 2))
    return F.concat(F.lit("LIN-"), F.substring(F.sha2(F.concat_ws("|", stem, target, metric).cast("binary"), 256), 1, 12))


def statement(entity: Column, target: Column, aspect: Column, headline: Column, metric: Column, magnitude: Column) -> Column:
    """entity(target/aspect): headline [metric=magnitude], each part only if there is one; empty without an entity. Magnitudes have two digits."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    place = F.when(some(target) & some(aspect), F.concat(F.lit("("), target, F.lit("/"), aspect, F.lit(")"))).when(some(target), F.concat(F.lit("("), target, F.lit(")")))
    head = F.when(some(headline), F.concat(F.lit(": "), headline))
    size = F.when(some(metric) & magnitude.isNotNull(), F.concat(F.lit(" ["), metric, F.lit("="), magnitude.cast("decimal(20,2)").cast("string"), F.lit("]")))
    return F.when(some(entity), F.concat_ws("", entity, place, head, size)).otherwise("")


def collect_lag(rows: DataFrame) -> DataFrame:
    """rows(status, reason, requested_to, observed_to): by how many seconds the data end before the window, and whether that is known."""
    none = F.col("status") == "no_data"
    unknown = none | F.col("observed_to").isNull() | F.col("requested_to").isNull()
    state = F.when(none & (F.col("reason") == "backend_error"), "backend_error").when(unknown, "unknown").otherwise("observed")
    seconds = F.greatest(F.unix_seconds(F.col("requested_to").cast("timestamp")) - F.unix_seconds(F.col("observed_to").cast("timestamp")), F.lit(0))
    return rows.withColumns({"lag_status": state, "lag_s": F.when(state == "observed", seconds)})


def scopes(rows: DataFrame) -> DataFrame:
    """rows(target_id, class, metric, total, returned, omitted) summed by class and metric (``*`` without one): complete, and whether anything was there."""
    by = rows.groupBy("target_id", "class", F.coalesce(F.nullif("metric", F.lit("")), F.lit("*")).alias("metric"))
    n = by.agg(*[F.sum(c).alias(c) for c in ("total", "returned", "omitted")])
    return n.withColumns({"complete": F.col("omitted") == 0, "status": F.when(F.col("total") > 0, "normal").otherwise("no_data")})


def measured_any_window(rows: DataFrame, windows: list[str]) -> DataFrame:
    """rows(target_id, metric, window, status, truth): of each key the first window, in this order, that is measured; else the last one looked at."""
    place = F.array_position(F.array(*[F.lit(w) for w in windows]), F.col("window"))
    rows = rows.filter(place > 0).withColumns({"measured": F.col("status") == "ok", "__place": place})
    best = F.struct("measured", F.when(F.col("measured"), -F.col("__place")).otherwise(F.col("__place")))
    keys = rows.groupBy("target_id", "metric").agg(F.max_by(F.struct("measured", "window", "truth"), best).alias("m"))
    return keys.select("target_id", "metric", "m.measured", F.col("m.window").alias("window"), "m.truth")


def extended(known: DataFrame, added: DataFrame, version: int) -> tuple[DataFrame, int]:
    """A vocabulary of ids with what is new in ``added``; the version rises only if something is."""
    new = added.select("id").filter(F.col("id").cast("string") != "").distinct().join(known.select("id"), "id", "left_anti")
    return known.select("id").unionByName(new), version if new.isEmpty() else version + 1


def within_budget(records: DataFrame, budget: int) -> DataFrame:
    """records(id, target_id, tier, size) of each target in full until the budget is spent, the rest abbreviated; lower tiers first."""
    spent = F.sum("size").over(W.partitionBy("target_id").orderBy("tier", "id").rowsBetween(W.unboundedPreceding, 0))
    return records.withColumn("spent", spent).withColumn("form", F.when(F.col("spent") <= budget, "full").otherwise("short"))
