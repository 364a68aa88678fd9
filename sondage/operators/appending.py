"""An append-only log of evidence: ids by arrival, and every rule that a record breaks, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions import ranked
from sondage.operators.evidence import KEY, canonical_keys
from sondage.operators.mapping import rows as classes
from sondage.sources import durable

# What a record's fields may say.
HEADLINE, EXCERPT = 120, 200
RECORD_KINDS = ("finding", "query_scope", "meta")
EFFECT_KINDS = ("ratio", "count", "duration", "share", "categorical")
DIRECTIONS = ("up", "down", "flat", "n/a")
AVAILABILITIES = ("observed", "observed_zero", "missing", "not_applicable")
CONFIDENCES = ("normal", "low")
WINDOWS = ("full", "onset_narrow")
SOURCES = tuple(dict.fromkeys(r[0] for r in classes()))
ASPECTS = tuple(dict.fromkeys(r[3] for r in classes()))


def eid(n: Column) -> Column:
    """EIX-0001, EIX-0002, ...; more digits where four don't do."""
    text = n.cast("string")
    return F.concat(F.lit("EIX-"), F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text))


def numbered(records: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """``records`` with n, gapless by arrival, and the eid of it."""
    return ranked(records, [F.col(c).asc() for c in order], "__n").withColumn("n", F.col("__n") + (start - 1)).drop("__n").withColumn("eid", eid(F.col("n")))


def _not_in(c: str, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(c).isin(*values), F.lit(False))


def invalid(log: DataFrame) -> DataFrame:
    """(n, eid, rule) for each rule that a record breaks by itself."""
    kind = F.col("record_kind")
    judged, finding, scope = F.coalesce(kind != "meta", F.lit(True)), F.coalesce(kind == "finding", F.lit(False)), F.coalesce(kind == "query_scope", F.lit(False))
    odd = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    rules = {
        "record_kind": _not_in("record_kind", RECORD_KINDS), "aspect": _not_in("aspect", ASPECTS), "source": _not_in("source", SOURCES),
        "headline_long": F.length("headline") > HEADLINE, "excerpt_long": F.length("excerpt") > EXCERPT,
        "scope_missing": scope & ~F.coalesce("scoped", F.lit(False)), "scope_misplaced": ~scope & F.coalesce("scoped", F.lit(False)),
        "window": judged & _not_in("window", WINDOWS), "supersedes_and_refines": F.col("supersedes").isNotNull() & F.col("refines").isNotNull(),
        "effect_kind": finding & _not_in("kind", EFFECT_KINDS), "direction": finding & _not_in("direction", DIRECTIONS),
        "categorical_magnitude": finding & (F.col("kind") == "categorical") & F.col("magnitude").isNotNull(), "finding_class": finding & (F.coalesce("class", F.lit("")) == ""),
        "availability": _not_in("availability", AVAILABILITIES), "confidence": _not_in("confidence", CONFIDENCES), "sample_negative": F.col("sample_n") < 0,
        "not_finite": odd("observed") | odd("baseline") | odd("magnitude"), "omitted_negative": F.col("omitted") < 0,
        "cut_untold": (F.col("omitted") > 0) & ~F.coalesce("truncated", F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in rules.items()]))
    return log.select("n", "eid", F.explode(broken).alias("rule"))


def broken_links(log: DataFrame) -> DataFrame:
    """(n, eid, rule) for each link that doesn't hold; log(n, eid, supersedes, refines, record_kind, KEY).

    A link names an earlier record: ``self`` and ``later`` are the links that a cycle needs, so a log without them has none. ``fork``: an
    earlier record supersedes the same one already; ``cross_kind`` and ``selector``: what is superseded differs in kind or key, which
    ``refines`` must, else it is ``refines_same``. One equi-join for each kind of link, and one aggregate for forks, by the record named.
    """
    log = canonical_keys(log)
    key = F.struct(*KEY)
    all_ = log.select(F.col("eid").alias("to"), F.col("n").alias("__n"), F.col("record_kind").alias("__kind"), key.alias("__key"))

    def named(column: str) -> DataFrame:
        own = log.filter(F.col(column).isNotNull()).select("n", "eid", F.col(column).alias("to"), "record_kind", key.alias("key"))
        return own.join(all_, "to", "left")

    def rules(rows: DataFrame, **extra: Column) -> DataFrame:
        there = F.coalesce(F.col("__n") < F.col("n"), F.lit(False))
        base = {"missing": F.col("__n").isNull(), "self": F.col("__n") == F.col("n"), "later": F.col("__n") > F.col("n")}
        broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in (base | {r: there & c for r, c in extra.items()}).items()]))
        return rows.select("n", "eid", F.explode(broken).alias("rule"))

    over = named("supersedes")
    first = over.filter("__n < n").groupBy("to").agg(F.min("n").alias("__first"))
    over = over.join(first, "to", "left")
    found = rules(over, fork=F.col("n") > F.col("__first"), cross_kind=~F.col("record_kind").eqNullSafe(F.col("__kind")), selector=F.col("key") != F.col("__key"))
    return found.unionByName(rules(named("refines"), refines_same=F.col("key") == F.col("__key")).withColumn("rule", F.concat(
        F.when(F.col("rule").isin("missing", "self", "later"), "refines_").otherwise(""), "rule")))


def append(log: DataFrame, arrivals: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The log with the arrivals behind it, up to the first that breaks a rule; and the violations(n, eid, rule) of all arrivals.

    An arrival may link to those before it in the same batch, by the eid that it will have. Nothing behind an offender is taken, as its
    ids would change with it. ``log`` holds n and eid and is taken to be right; an arrival that brings an ``eid`` breaks ``eid_given``.
    """
    start = log.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] + 1
    given = arrivals.withColumnRenamed("eid", "given") if "eid" in arrivals.columns else arrivals.withColumn("given", F.lit(None).cast("string"))
    batch = durable(numbered(given, order, start), "arrivals")
    links = broken_links(log.unionByName(batch.drop("given"), allowMissingColumns=True)).filter(F.col("n") >= start)
    broken = invalid(batch).unionByName(links).unionByName(batch.filter("given is not null").select("n", "eid", F.lit("eid_given").alias("rule")))
    broken = durable(broken, "violations")
    stop = broken.agg(F.min("n")).first()[0]
    taken = batch.drop("given") if stop is None else batch.drop("given").filter(F.col("n") < stop)
    return log.unionByName(taken.select(*[c for c in log.columns if c in taken.columns]), allowMissingColumns=True), broken
