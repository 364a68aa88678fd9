"""Evidence: findings into records, active view, scope resolution, truth of predicates, ranking of hypotheses."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions import ranked
from sondage.sources import discard, durable

RATIO_EPS = 1e-12
LOW_SAMPLE = 10


def canonical(c: Column) -> Column:
    """Trimmed, inner white space collapsed, lower case. Only what has white space goes through the pattern, which costs far more than a look for it."""
    blank = reduce(or_, [F.contains(c, F.lit(x)) for x in " \t\n\x0b\f\r"])
    return F.lower(F.when(blank, F.trim(F.regexp_replace(c, r"\s+", " "))).otherwise(c))


def direction(observed: Column, baseline: Column) -> Column:
    return F.when(observed.isNull() | baseline.isNull(), "n/a").when(observed > baseline, "up").when(observed < baseline, "down").otherwise("flat")


def magnitude(kind: Column, observed: Column, baseline: Column) -> Column:
    """Ratios need a baseline that isn't zero; counts, durations and shares are what was observed; categories have none."""
    ratio = F.when(F.abs(baseline) > RATIO_EPS, observed / baseline)
    return F.when(kind == "ratio", ratio).when(kind.isin("count", "duration", "share"), observed)


def project(findings: DataFrame) -> DataFrame:
    """findings(id, target_id, metric, kind, observed, baseline, sample_n) to records with effect and quality."""
    m = magnitude(F.col("kind"), F.col("observed"), F.col("baseline"))
    low = (F.coalesce("sample_n", F.lit(0)) < LOW_SAMPLE) | ((F.col("kind") == "ratio") & m.isNull())
    seen = F.when(F.col("observed").isNull(), "missing").when(F.col("observed") == 0, "observed_zero").otherwise("observed")
    return findings.select(
        "id", "target_id", canonical(F.col("metric")).alias("metric"), "kind", m.alias("magnitude"),
        direction(F.col("observed"), F.col("baseline")).alias("direction"), seen.alias("availability"), F.when(low, "low").otherwise("normal").alias("confidence"),
    )


def active(records: DataFrame) -> DataFrame:
    """Records that no other one supersedes."""
    return records.join(records.filter("supersedes is not null").select(F.col("supersedes").alias("id")).distinct(), "id", "left_anti")


def heirs(records: DataFrame) -> DataFrame:
    """The active record at the end of each record's chain, however long it is; null where the chain runs into a cycle.

    Pointers are doubled: a round joins the open records with where their heir has got to, until no round closes one.
    """
    next_ = records.filter("supersedes is not null").groupBy(F.col("supersedes").alias("__of")).agg(F.min("id").alias("__next"))
    ids = records.select("id").distinct()
    at = ids.join(next_, F.col("id") == F.col("__of"), "left").select("id", F.coalesce("__next", "id").alias("heir"), F.col("__next").isNotNull().alias("open"))
    at = durable(at, "heirs")
    left = at.filter("open").count()
    while left:
        reached = at.select(F.col("id").alias("__of"), F.col("heir").alias("__next"), F.col("open").alias("__open"))
        moved = at.filter("open").join(reached, F.col("heir") == F.col("__of")).select("id", F.col("__next").alias("heir"), F.col("__open").alias("open"))
        old, at = at, durable(at.filter("not open").unionByName(moved), "heirs")
        discard(old)
        before, left = left, at.filter("open").count()
        if left == before:  # what a chain of any length leaves open shrinks with each round; a cycle does not
            break
    found = at.select(F.col("id").alias("__of"), F.when(~F.col("open"), F.col("heir")).alias("heir"))
    return records.select("id").join(found, F.col("id") == F.col("__of"), "left").select("id", "heir")


def resolve(asked: DataFrame, records: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each asked (target_id, metric): entity, ambiguous, scope, scope_incomplete or unmeasured."""
    n = records.groupBy("target_id", "metric").agg(F.count(F.lit(1)).alias("n"))
    cover = scopes.groupBy("target_id").agg(F.bool_and("complete").alias("complete"))
    rows = asked.join(n, ["target_id", "metric"], "left").join(cover, "target_id", "left")
    state = (
        F.when(F.col("n") == 1, "entity").when(F.col("n") > 1, "ambiguous").when(F.col("complete"), "scope")
        .when(~F.col("complete"), "scope_incomplete").otherwise("unmeasured")
    )
    return rows.select("target_id", "metric", state.alias("resolution"))


#: The axes of an observation's key, and what stands for any value of metric or entity_key in a scope.
KEY = ["source", "target_id", "aspect", "metric", "entity_key", "window"]
ANY = "*"


def canonical_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with spellings of their keys folded; a missing axis is empty."""
    return rows.withColumns({c: canonical(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in KEY})


def resolve_keys(asked: DataFrame, records: DataFrame, scopes: DataFrame) -> DataFrame:
    """asked(id, KEY) by records(eid, KEY, availability), else by the scopes(eid, KEY, availability, complete) that cover the key.

    ``resolution`` is entity (one record), ambiguous (more), scope, scope_incomplete (a covering scope was cut), or unmeasured; a key without
    an entity takes the records of every entity. ``availability`` is the record's; of covering scopes the first one's (by eid) that is
    missing or not_applicable, else observed_zero if all are so, else observed.

    A scope's metric or entity_key may be ``*``. So a key has four patterns, and covering is an equi-join of these with the scopes, which are
    added up by pattern before they are shuffled; no range or OR is joined.
    """
    asked, records, scopes = canonical_keys(asked).select("id", *KEY), canonical_keys(records), canonical_keys(scopes)
    n, one = F.count(F.lit(1)).alias("n"), F.min("availability").alias("own")
    exact = records.groupBy(*KEY).agg(n, one)
    loose = [c for c in KEY if c != "entity_key"]
    whole = F.col("entity_key").isin("", ANY)
    hits = asked.filter(~whole).join(exact, KEY).select("id", "n", "own")
    hits = hits.unionByName(asked.filter(whole).join(records.groupBy(*loose).agg(n, one), loose).select("id", "n", "own"))
    a = F.col("availability")
    unusable = F.min(F.when(a.isin("missing", "not_applicable"), F.struct("eid", "availability")))
    pattern = scopes.groupBy(*KEY).agg(F.bool_and("complete").alias("complete"), F.bool_and(a == "observed_zero").alias("zero"), unusable.alias("unusable"))
    open_ = asked.withColumns({"metric": F.explode(F.array_distinct(F.array("metric", F.lit(ANY))))})
    open_ = open_.withColumns({"entity_key": F.explode(F.array_distinct(F.array("entity_key", F.lit(ANY))))})
    covers = open_.join(pattern, KEY).groupBy("id").agg(
        F.bool_and("complete").alias("complete"), F.bool_and("zero").alias("zero"), F.min("unusable")["availability"].alias("unusable")
    )
    rows = asked.join(hits, "id", "left").join(covers, "id", "left")
    state = (
        F.when(F.col("n") == 1, "entity").when(F.col("n") > 1, "ambiguous").when(F.col("complete"), "scope")
        .when(~F.col("complete"), "scope_incomplete").otherwise("unmeasured")
    )
    of_scope = F.coalesce("unusable", F.when(F.col("zero"), "observed_zero").otherwise("observed"))
    seen = F.when(state == "entity", F.col("own")).when(state == "scope", of_scope)
    return rows.select("id", state.alias("resolution"), seen.alias("availability"))


def truth(rows: DataFrame) -> DataFrame:
    """rows(id, predicate, threshold, resolution, allowed, availability, magnitude, direction) to truth and the status of deriving it.

    A key that an entity's record resolves is present, whatever it measured; one that only a complete scope covers is absent, and has neither
    magnitude nor direction. ``allowed``: the record's class lets the predicate be asked; scopes have no class. The first that holds counts:
    unresolved, unknown_predicate, unusable_availability, class_not_allowed, no_magnitude, no_threshold, no_direction, ok.
    """
    p, m, d = F.col("predicate"), F.col("magnitude"), F.col("direction")
    sized, turned = F.coalesce(p.isin("magnitude_ge", "magnitude_lt"), F.lit(False)), F.coalesce(p.isin("direction_up", "direction_down"), F.lit(False))
    bare = F.coalesce(p.isin("present", "absent"), F.lit(False))
    entity = F.coalesce(F.col("resolution") == "entity", F.lit(False))
    status = (
        F.when(~F.coalesce(F.col("resolution").isin("entity", "scope"), F.lit(False)), "unresolved").when(~(sized | turned | bare), "unknown_predicate")
        .when(F.col("availability").isin("missing", "not_applicable"), "unusable_availability").when(entity & ~F.coalesce("allowed", F.lit(False)), "class_not_allowed")
        .when(sized & (~entity | m.isNull()), "no_magnitude").when(sized & F.col("threshold").isNull(), "no_threshold")
        .when(turned & ~(entity & F.coalesce(d.isin("up", "down", "flat"), F.lit(False))), "no_direction").otherwise("ok")
    )
    holds = (
        F.when(p == "present", entity).when(p == "absent", ~entity).when(p == "magnitude_ge", m >= F.col("threshold"))
        .when(p == "magnitude_lt", m < F.col("threshold")).when(p == "direction_up", d == "up").when(p == "direction_down", d == "down")
    )
    return rows.withColumn("status", status).withColumn("truth", F.when(F.col("status") == "ok", holds))


def judge(rows: DataFrame) -> DataFrame:
    """rows(resolution, status, truth, must_hold, role, qualified, counter) to the first row of the truth table that fires."""
    holds = F.col("truth") == F.col("must_hold")
    usable = F.col("resolution").isin("entity", "scope")
    fired = lambda row, verdict: F.struct(F.lit(row).alias("row"), F.lit(verdict).alias("verdict"))
    judged = (
        F.when(~usable, fired(1, "inconclusive")).when(F.col("status") != "ok", fired(2, "inconclusive"))
        .when(holds & F.col("qualified"), fired(3, "supported_qualified")).when(holds, fired(4, "supported_weak"))
        .when(F.col("role") != "necessary", fired(7, "inconclusive")).when(F.col("counter"), fired(5, "invalidated"))
        .otherwise(fired(6, "inconclusive"))
    )
    return rows.withColumn("j", judged).withColumn("row", F.col("j.row").cast("long")).withColumn("verdict", F.col("j.verdict")).drop("j")


def tally(judged: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return judged.groupBy("hypothesis").agg(
        F.count_if(v == "supported_qualified").alias("qualified"), F.count_if(v == "supported_weak").alias("weak"),
        F.count_if(v == "invalidated").alias("refuted"), F.count_if(F.col("role") == "necessary").alias("necessary"), F.count(F.lit(1)).alias("predicates"),
    )


def rank(tallies: DataFrame) -> DataFrame:
    """More qualified, more weak support, larger share of necessary predicates not refuted, earlier creation."""
    kept = F.when(F.col("necessary") > 0, 1 - F.col("refuted") / F.col("necessary")).otherwise(1.0)
    order = [F.desc("qualified"), F.desc("weak"), F.desc("kept"), F.asc("hypothesis")]
    decision = F.when(F.col("refuted") > 0, "refuted").when(F.col("qualified") >= 2, "confirmed").when(F.col("qualified") + F.col("weak") > 0, "provisional").otherwise("insufficient")
    return ranked(tallies.withColumn("kept", kept), order).withColumn("decision", decision)


def rollups(records: DataFrame) -> DataFrame:
    """Views by target: anomalous, weak, missing."""
    return records.groupBy("target_id").agg(
        F.count_if(F.col("direction").isin("up", "down")).alias("moved"), F.count_if(F.col("confidence") == "low").alias("weak"),
        F.count_if(F.col("availability") == "missing").alias("missing"), F.array_join(F.array_sort(F.collect_set("metric")), ",").alias("metrics"),
    )


def citations(prose: DataFrame, records: DataFrame, text_col: str = "text") -> DataFrame:
    """Ids like EIX-12 in a text, and whether an active record bears them."""
    cited = prose.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit("EIX-([0-9]+)"), F.lit(1)))).alias("n"))
    known = active(records).select(F.col("id").cast("string").alias("n"), F.lit(True).alias("ok"))
    return cited.join(known, "n", "left").select("doc_id", "n", F.coalesce("ok", F.lit(False)).alias("active"))


def excerpt(c: Column, most: int = 200) -> Column:
    """Control characters become blanks, white space collapses, role marks are escaped, the rest is clipped."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1F\x7F]", " "), " +", " "))
    return F.substring(F.regexp_replace(plain, r"(?i)<\|?(system|user|assistant)\|?>", "[ESC]"), 1, most)


def pseudonyms(c: Column) -> Column:
    """Scenario and case names become opaque tokens that stay equal for equal names."""
    parts = F.split(c, "(?:scenario|case)-[A-Za-z0-9]+", -1)
    names = F.regexp_extract_all(c, F.lit("((?:scenario|case)-[A-Za-z0-9]+)"), F.lit(1))
    opaque = F.transform(names, lambda n: F.concat(F.lit("opaque-"), F.substring(F.sha2(n.cast("binary"), 256), 1, 24)))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("p"), opaque.alias("o")), lambda z: F.array(z["p"], F.coalesce(z["o"], F.lit(""))))), "")
