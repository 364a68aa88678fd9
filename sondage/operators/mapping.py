"""Findings of many tools, each with keys of its own, to records of one form by a table of classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators.evidence import LOW_SAMPLE, RATIO_EPS, direction

# One line a class. source, class, names that findings give it, aspect, kind of effect, predicates allowed, entity columns,
# observed, baseline and magnitude keys, metric (key "metric" where empty), first and last key of the change.
# $target: whom the tool was asked about; $own: the finding's target_id, else that; $hash: the last part of its first reference.
CLASSES = """
scan_metrics; shifted; shifted; metric; ratio; all; ; current_median; baseline_median; ; ; ;
scan_metrics; appeared; appeared; metric; categorical; existence; ; representative; ; ; ; ;
scan_metrics; disappeared; disappeared; metric; share; existence; ; baseline_presence_ratio; ; ; ; ;
read_timeseries; series; series; metric; ratio; all; ; stats.median; baseline_median; ; ; onset.interval; onset.interval
list_events; episode; episode; event; duration; all; episode_id; duration_ms; ; ; ; open_at|derived_open_at; close_at
list_events; unpaired; unpaired; event; count; existence; detector,reason,at; ; ; ; ; at; at
list_events; k8s; k8s; event; count; all; namespace,kind,name,reason; count; ; ; ; first_at; last_at
sample_logs; new_in_window; new_in_window; log; count; all; template_id; current_count; baseline_count; ; ; first_at; last_at
sample_logs; surged; surged; log; count; all; template_id; current_count; baseline_count; ; ; ;
sample_logs; disappeared; disappeared; log; count; all; template_id; current_count; baseline_count; ; ; ;
sample_logs; frequent; frequent; log; count; all; template_id; current_count; baseline_count; ; ; ;
sample_logs; grep; grep,match; log; count; existence; at,$hash; ; ; ; ; at; at
db_slow_queries; sql; sql; db; ratio; all; sql_key; latency_ms_p50; baseline_latency_ms_p50; ratio_p50; latency_ms_p50; ;
db_blocking; event; event; db; count; all; $target,first_seen; blocked_peak; ; ; blocked_peak; first_seen; last_seen
breakdown_endpoints; endpoint_latency; endpoint_latency,entry,step,egress; endpoint; duration; all; section,kind,axis,label; p50_ms; baseline.p50_ms; ; p50_ms; ;
breakdown_endpoints; endpoint_failure; endpoint_failure,entry,step,egress; endpoint; share; all; section,kind,axis,label; failed_rate; baseline.failed_rate; ; failed_rate; ;
compare_peers; self; self; peer; categorical; direction; target_id; ; ; ; deviating; onset.interval; onset.interval
compare_peers; peer; peer; peer; categorical; direction; target_id; ; ; ; deviating; onset.interval; onset.interval
get_processes; process; process; process; share; all; process,pid; share; ; ; share; ;
get_snmp_traps; trap; trap; event; count; all; trap_type,trap_oid,$target; count; ; ; count; first_at; last_at
get_k8s_state; restart_increase; restart_increase; event; count; all; namespace,pod,signal; value; ; ; restart_increase; ;
get_k8s_state; crash_loop_back_off; crash_loop_back_off; event; count; existence; namespace,pod,signal; value; ; ; crash_loop_back_off; ;
get_k8s_state; oom_killed; oom_killed; event; count; existence; namespace,pod,signal; value; ; ; oom_killed; ;
get_k8s_state; waiting; waiting; event; count; existence; namespace,pod,signal; value; ; ; waiting; ;
change; change; change; change; count; existence; kind,$own,at; ; ; ; change; at; at
"""
META = """
scan_metrics; counts,disappearance_concurrency
read_timeseries; read_meta,onset_timeline
list_events; summary_meta
sample_logs; summary_meta,before,after
db_slow_queries; coverage,sql_text_full,sql_plan
db_blocking; coverage
breakdown_endpoints; coverage
compare_peers; verdict,peer_set,peers_folded,peers_excluded,compare_meta
change; summary_meta
"""
ALLOWED = {
    "all": ("present", "absent", "magnitude_ge", "magnitude_lt", "direction_up", "direction_down"),
    "existence": ("present", "absent"),
    "direction": ("present", "absent", "direction_up", "direction_down"),
}
CLASS_KEYS = ("class", "section", "kind", "signal", "relation", "observation")
DEFAULT_CLASS = {"read_timeseries": "series", "db_blocking": "event", "get_processes": "process", "change": "change"}

COLUMNS = ("source", "name", "class", "aspect", "kind", "allowed", "entity", "observed", "baseline", "magnitude", "metric", "change_from", "change_to")


def _lines(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(";")] for line in table.strip().splitlines()]


def rows() -> list[tuple]:
    """The table of classes, one row for each name that a finding may give a class."""
    out = []
    for source, cls, names, aspect, kind, allowed, entity, observed, baseline, magnitude, metric, first, last in _lines(CLASSES):
        cols = [c for c in entity.split(",") if c]
        out += [(source, n, cls, aspect, kind, list(ALLOWED[allowed]), cols, observed, baseline, magnitude, metric, first.split("|"), last.split("|")) for n in names.split(",")]
    return out


def classes(spark: SparkSession) -> DataFrame:
    kinds = {"allowed": "array<string>", "entity": "array<string>", "change_from": "array<string>", "change_to": "array<string>"}
    return spark.createDataFrame(rows(), ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in COLUMNS))


def _paths(*columns: str) -> list[str]:
    """What the table reads from findings in these columns."""
    found = set()
    for r in rows():
        for c in columns:
            v = r[COLUMNS.index(c)]
            found |= set(v if isinstance(v, list) else [v])
    return sorted(p for p in found if p and not p.startswith("$"))


def _variant(tree: Column, path: str) -> Column:
    return F.try_variant_get(tree, "$." + path, "variant")


def _number(tree: Column, path: str) -> Column:
    """A number as it stands; a text is none, whatever it says."""
    return F.when(F.schema_of_variant(_variant(tree, path)).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(tree, "$." + path, "double"))


def _text(tree: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(tree, "$." + path, "string"), F.lit(""))


def _true(tree: Column, path: str) -> Column:
    return F.coalesce((F.schema_of_variant(_variant(tree, path)) == "BOOLEAN") & F.try_variant_get(tree, "$." + path, "boolean"), F.lit(False))


def _pick(key: Column, paths: list[str], get) -> Column:
    """``get`` of the path that ``key`` names; the others are not read."""
    return reduce(lambda w, p: w.when(key == p, get(p)), paths, F)


def class_of(source: Column, tree: Column) -> Column:
    """The first of the class keys that is not empty, else what the source means by none; a change's own kind is no class."""
    first = F.coalesce(*[F.when(F.lit(k == "section") | (source != "change"), F.nullif(_text(tree, k), F.lit(""))) for k in CLASS_KEYS])
    none = reduce(lambda w, kv: w.when(source == kv[0], kv[1]), DEFAULT_CLASS.items(), F)
    return F.coalesce(first, none, F.lit(""))


def _doubtful(tree: Column) -> Column:
    """What a tool itself says against a finding, by class."""
    s, c = F.col("source"), F.col("class")
    state = _text(tree, "baseline.state")
    return (
        ((c == "appeared") & _true(tree, "episodic")) | ((s == "scan_metrics") & (c == "disappeared") & _true(tree, "intermittent_baseline"))
        | ((c == "series") & (_text(tree, "onset.skipped") == "") & _true(tree, "onset.outside_window"))
        | ((c == "episode") & (F.col("observed").isNull() | (_text(tree, "boundary") != "complete"))) | ((c == "k8s") & (_text(tree, "match_basis") != ""))
        | ((s == "sample_logs") & (c != "grep") & (_text(tree, "baseline_seen") == "baseline_unknown"))
        | ((c == "sql") & (_true(tree, "partial_presence") | (F.coalesce(_number(tree, "baseline_polls"), F.lit(0.0)) == 0)))
        | ((s == "db_blocking") & _number(tree, "gap_polls").isNotNull())
        | ((s == "breakdown_endpoints") & ((_text(tree, "verdict") == "insufficient_sample") | ~state.isin("", "ok")))
        | ((s == "compare_peers") & (_text(tree, "excluded") != ""))
    )


def allows(source: Column, cls: Column, predicate: Column) -> Column:
    """Whether the class lets the predicate be asked of its records; false for a class that the table lacks."""
    return F.coalesce(F.concat_ws("/", source, cls, predicate).isin(*sorted({f"{r[0]}/{r[2]}/{p}" for r in rows() for p in r[5]})), F.lit(False))


def availability(status: Column, reason: Column, complete: Column) -> Column:
    """Zero observations of a complete search are a zero; what was never collected doesn't apply; all other gaps are missing."""
    gap = F.when(reason == "zero_observations", F.when(complete, "observed_zero").otherwise("missing")).when(reason == "not_collected", "not_applicable")
    return F.when(status == "no_data", F.coalesce(gap, F.lit("missing"))).otherwise("observed")


def project(findings: DataFrame) -> DataFrame:
    """findings(id, source, target_id, finding, status, no_data_reason, omitted, truncated, degraded) to records.

    ``finding`` is a JSON object with the tool's own keys. A class of the table gives a ``finding`` record, an endpoint's two; any other a
    ``meta`` record, ``unknown`` unless it is one of those that bear no judgement. No record comes of an endpoint without the value, a
    series without a median, or a target that was not observed. A text that is no JSON object, or null, is a meta record of class ''.
    Texts of keys are as Spark writes JSON values: 5.0 stays 5.0. Times are given as they are written, null where they are none.

    The table has one row a class, so it is broadcast; all else is a projection of the rows.
    """
    spark = findings.sparkSession
    f = findings.withColumn("tree", F.try_parse_json("finding")).withColumn("name", class_of(F.col("source"), F.col("tree")))
    table = F.broadcast(classes(spark).withColumnsRenamed({c: f"__{c}" for c in COLUMNS[3:]}))
    rows = f.join(table, ["source", "name"], "left")
    tree, target = F.col("tree"), F.coalesce("target_id", F.lit(""))
    paths = _paths("entity", "change_from", "change_to")

    def text(key: Column) -> Column:
        own = F.coalesce(F.nullif(_text(tree, "target_id"), F.lit("")), target)
        digest = F.coalesce(F.element_at(F.split(_text(tree, "refs[0]"), ":"), -1), F.lit(""))
        return _pick(key, paths, lambda p: _text(tree, p)).when(key == "$target", target).when(key == "$own", own).when(key == "$hash", digest)

    value = lambda c: _pick(F.col(c), _paths(c.removeprefix("__")), lambda p: _number(tree, p))
    of_peers = F.col("source") == "compare_peers"
    seen = F.when(of_peers, _true(tree, "deviating").cast("double")).when(F.col("__observed") != "", value("__observed")).when(F.col("__kind") != "categorical", 1.0)
    rows = rows.withColumns({"observed": seen, "baseline": F.when(F.col("__baseline") != "", value("__baseline")), "__tool": value("__magnitude")})
    observed, baseline = F.col("observed"), F.col("baseline")
    ratio = F.coalesce("__tool", F.when(F.abs(baseline) >= RATIO_EPS, observed / baseline))
    by_zero = (F.col("__kind") == "ratio") & F.col("__tool").isNull() & observed.isNotNull() & baseline.isNotNull() & (F.abs(baseline) < RATIO_EPS)
    told = F.when(_text(tree, "direction").isin("up", "down"), _text(tree, "direction")).otherwise("n/a")
    sample = F.when(F.col("source") == "db_slow_queries", _number(tree, "polls_in_window")).when(F.col("source") == "db_blocking", _number(tree, "polls"))
    sample = sample.when(F.col("source") == "breakdown_endpoints", _number(tree, "count")).when(of_peers, _number(tree, "samples")).cast("long")
    rows = rows.withColumns({
        "magnitude": F.when(F.col("__kind") == "ratio", ratio).when(F.col("__kind") != "categorical", observed),
        "direction": F.when(of_peers, told).otherwise(direction(observed, baseline)), "sample_n": sample, "__zero": by_zero,
    })
    kept = F.col("class").isNull() | (
        (observed.isNotNull() | ~F.col("source").isin("read_timeseries", "breakdown_endpoints"))
        & ~((F.col("class") == "self") & of_peers & (F.schema_of_variant(_variant(tree, "observed")) == "BOOLEAN") & ~_true(tree, "observed")).eqNullSafe(True)
    )
    cut = (F.coalesce("omitted", F.lit(0)) > 0) | F.coalesce("truncated", F.lit(False))
    status = F.coalesce("status", F.lit("normal"))
    low = (
        F.coalesce("degraded", F.lit(False)) | ((status == "normal") & cut) | F.coalesce(F.col("sample_n") < LOW_SAMPLE, F.lit(False)) | F.coalesce(_doubtful(tree), F.lit(False))
        | F.coalesce("__zero", F.lit(False)) | ((F.col("__kind") == "ratio") & F.col("magnitude").isNull() & observed.isNotNull()).eqNullSafe(True)
    )

    def when(column: str, place: int) -> Column:
        """The first of the keys that holds a time; a key of an interval holds both, or none counts."""
        both = F.split(_text(tree, "onset.interval"), "/")
        is_time = lambda x: F.try_to_timestamp(x).isNotNull()
        interval = F.when((F.size(both) == 2) & is_time(F.get(both, F.lit(0))) & is_time(F.get(both, F.lit(1))), F.get(both, F.lit(place)))
        plain = F.get(F.filter(F.transform(column, text), is_time), F.lit(0))
        return F.when(F.array_contains(column, "onset.interval"), interval).otherwise(plain)

    first = when("__change_from", 0)
    is_finding = F.col("class").isNotNull()
    meta = [(s, n) for s, names in _lines(META) for n in names.split(",")]
    known = F.concat_ws("/", "source", "name").isin(*[f"{s}/{n}" for s, n in meta])
    on = lambda c: F.when(is_finding, c)
    return rows.filter(kept).select(
        "id", "source", "target_id", F.when(is_finding, "finding").otherwise("meta").alias("record_kind"), F.coalesce("class", "name").alias("class"),
        (~is_finding & ~known).alias("unknown"), F.col("__aspect").alias("aspect"), F.col("__kind").alias("kind"),
        on(F.array_join(F.transform("__entity", text), "|")).alias("entity_key"),
        on(F.coalesce(F.nullif("__metric", F.lit("")), _text(tree, "metric"))).alias("metric"), on(observed).alias("observed"), on(baseline).alias("baseline"),
        on(F.col("magnitude")).alias("magnitude"), on(F.col("direction")).alias("direction"), on(first).alias("change_from"),
        on(F.when(first.isNotNull(), when("__change_to", 1))).alias("change_to"), on(F.col("sample_n")).alias("sample_n"),
        availability(status, F.col("no_data_reason"), ~cut).alias("availability"), on(F.when(low, "low").otherwise("normal")).alias("confidence"),
    )
