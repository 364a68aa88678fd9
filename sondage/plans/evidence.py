"""Evidence queries: the events stand in for findings, their predicates and hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import blind
from sondage.operators import evidence as op
from sondage.operators import json_forms, mapping
from sondage.plans.base import Plans, rounded
from sondage.sources import telemetry as t

PLANS = Plans()
FINDINGS = """f as (select event_id as id, user_id % 40 as target_id, '  ' || upper(event_type) || '   Rate ' as metric,
  case event_id % 5 when 0 then 'ratio' when 1 then 'count' when 2 then 'duration' when 3 then 'share' else 'categorical' end as kind,
  case when event_id % 11 = 0 then null when event_id % 13 = 0 then 0 else value end as observed, case when event_id % 7 = 0 then 0 when event_id % 17 = 0 then null else value / 2 end as baseline,
  event_id % 30 as sample_n, case when event_id % 9 = 0 and event_id >= 18 then event_id - 18 end as supersedes, event_id from events)"""
RECORDS = f"""with {FINDINGS}, m as (select *, case when kind = 'ratio' then case when abs(baseline) > 1e-12 then observed / baseline end when kind in ('count', 'duration', 'share') then observed end as mag from f),
r as (select id, target_id, lower(trim(regexp_replace(metric, '\\s+', ' ', 'g'))) as metric, kind, mag as magnitude,
  case when observed is null or baseline is null then 'n/a' when observed > baseline then 'up' when observed < baseline then 'down' else 'flat' end as direction,
  case when observed is null then 'missing' when observed = 0 then 'observed_zero' else 'observed' end as availability,
  case when sample_n < 10 or (kind = 'ratio' and mag is null) then 'low' else 'normal' end as confidence, supersedes, event_id from m)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = t.read_table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(i % 5 == 0, "ratio").when(i % 5 == 1, "count").when(i % 5 == 2, "duration").when(i % 5 == 3, "share").otherwise("categorical")
    return e.select(
        i.alias("id"), (F.col("user_id") % 40).alias("target_id"), F.concat(F.lit("  "), F.upper("event_type"), F.lit("   Rate ")).alias("metric"), kind.alias("kind"),
        F.when(i % 11 == 0, None).when(i % 13 == 0, 0.0).otherwise(F.col("value")).alias("observed"),
        F.when(i % 7 == 0, 0.0).when(i % 17 == 0, None).otherwise(F.col("value") / 2).alias("baseline"), (i % 30).alias("sample_n"),
        F.when((i % 9 == 0) & (i >= 18), i - 18).alias("supersedes"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return op.project(f).join(f.select("id", "supersedes"), "id")


@PLANS.add(f"{RECORDS} select id, target_id, metric, kind, round(magnitude, 6) as magnitude, direction, availability, confidence from r")
def evidence_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.project(findings(spark, sf_dir)))


@PLANS.add(f"{RECORDS} select id, target_id, metric from r where id not in (select supersedes from r where supersedes is not null)")
def evidence_active_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.active(records(spark, sf_dir)).select("id", "target_id", "metric")


@PLANS.add(f"""{RECORDS.replace('with ', 'with recursive ', 1)}, n as (select supersedes, min(id) as nxt from r where supersedes is not null group by 1),
back as (select r.id, r.id as heir from r left join n on n.supersedes = r.id where nxt is null
  union all select n.supersedes, back.heir from back join n on n.nxt = back.id)
select r.id, heir from r left join back on r.id = back.id""")
def evidence_heirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.heirs(records(spark, sf_dir))


@PLANS.add(f"{RECORDS} select target_id, count(*) filter (direction in ('up', 'down')) as moved, count(*) filter (confidence = 'low') as weak, count(*) filter (availability = 'missing') as missing, string_agg(distinct metric, ',' order by metric) as metrics from r group by 1")
def evidence_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rollups(records(spark, sf_dir))


@PLANS.add(f"""{RECORDS}, asked as (select t.target_id, m.metric from range(50) t(target_id), (select distinct metric from r) m), own as (select target_id, metric, count(*) as n from r group by 1, 2),
c as (select target_id, bool_and(id % 3 <> 0 or target_id % 2 = 0) as complete from r group by 1)
select a.target_id, a.metric, case when n = 1 then 'entity' when n > 1 then 'ambiguous' when complete then 'scope' when not complete then 'scope_incomplete' else 'unmeasured' end as resolution
from asked a left join own on a.target_id = own.target_id and a.metric = own.metric left join c on a.target_id = c.target_id""")
def scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    asked = r.select("metric").distinct().select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("target_id"), "metric")
    scopes = r.select("target_id", ((F.col("id") % 3 != 0) | (F.col("target_id") % 2 == 0)).alias("complete"))
    return op.resolve(asked, r, scopes)


KEYED = """with k as (select l_orderkey * 8 + l_linenumber as eid, 'v' || l_linenumber::varchar as source, (l_suppkey % 10)::varchar as target_id, l_returnflag as aspect, 'm' || (l_orderkey % 4)::varchar as metric,
  'e' || (l_partkey % 60)::varchar as entity_key, l_linestatus as win, l_discount, l_quantity, l_tax,
  case when l_quantity < 3 then 'missing' when l_quantity < 20 then 'observed_zero' else 'observed' end as availability from lineitem),
asked as (select distinct concat_ws('|', source, target_id, aspect, metric, entity_key, win) as id, source, target_id, aspect, metric, entity_key, win from k),
r as (select * from k where l_tax < 0.02), s as (select eid, source, target_id, aspect, case when l_discount < 0.02 then '*' else metric end as metric, case when l_discount > 0.08 then '*' else entity_key end as entity_key, win, availability,
  l_quantity % 7 > 0 as complete from k where l_tax >= 0.02)"""


@PLANS.add(f"""{KEYED}, h as (select a.id, count(*) as n, min(availability) as own from asked a join r using (source, target_id, aspect, metric, entity_key, win) group by a.id),
c as (select a.id, bool_and(complete) as complete, bool_and(availability = 'observed_zero') as zero, arg_min(availability, s.eid) filter (availability = 'missing') as unusable from asked a join s
  on a.source = s.source and a.target_id = s.target_id and a.aspect = s.aspect and a.win = s.win and (s.metric = '*' or s.metric = a.metric) and (s.entity_key = '*' or s.entity_key = a.entity_key) group by a.id),
x as (select a.id, own, zero, unusable, case when n = 1 then 'entity' when n > 1 then 'ambiguous' when complete then 'scope' when not complete then 'scope_incomplete' else 'unmeasured' end as resolution
  from asked a left join h on a.id = h.id left join c on a.id = c.id)
select id, resolution, case resolution when 'entity' then own when 'scope' then coalesce(unusable, case when zero then 'observed_zero' else 'observed' end) end as availability from x""")
def scope_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = t.read_table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber as eid", "concat('v', l_linenumber) as source", "cast(l_suppkey % 10 as string) as target_id", "l_returnflag as aspect", "concat('m', l_orderkey % 4) as metric",
        "concat('e', l_partkey % 60) as entity_key", "l_linestatus as window", "l_discount", "l_quantity", "l_tax",
        "case when l_quantity < 3 then 'missing' when l_quantity < 20 then 'observed_zero' else 'observed' end as availability",
    )
    asked = k.select(*op.KEY).distinct().withColumn("id", F.concat_ws("|", *op.KEY))
    scopes = k.filter("l_tax >= 0.02").withColumns({
        "metric": F.when(F.col("l_discount") < 0.02, op.ANY).otherwise(F.col("metric")), "complete": F.col("l_quantity") % 7 > 0,
        "entity_key": F.when(F.col("l_discount") > 0.08, op.ANY).otherwise(F.col("entity_key")),
    })
    return op.resolve_keys(asked, k.filter("l_tax < 0.02"), scopes)


PREDICATES = f"""{RECORDS}, p as (select *, ['present', 'absent', 'magnitude_ge', 'magnitude_lt', 'direction_up', 'direction_down'][(event_id % 6)::int + 1] as predicate, case when event_id % 19 > 0 then 50.0 end as threshold from r),
pr as (select * replace (case when event_id % 17 = 0 then 'not_applicable' else availability end as availability), case when event_id % 8 = 0 then 'ambiguous' when event_id % 8 < 3 then 'scope' else 'entity' end as resolution,
  case event_id % 7 when 1 then predicate in ('present', 'absent') when 2 then predicate not like 'magnitude%' when 3 then false else true end as allowed from p),
q as (select *, case when resolution = 'ambiguous' then 'unresolved' when availability in ('missing', 'not_applicable') then 'unusable_availability' when resolution = 'entity' and not allowed then 'class_not_allowed'
  when predicate like 'magnitude%' and (resolution = 'scope' or magnitude is null) then 'no_magnitude' when predicate like 'magnitude%' and threshold is null then 'no_threshold'
  when predicate like 'direction%' and (resolution = 'scope' or direction = 'n/a') then 'no_direction' else 'ok' end as status,
  case predicate when 'present' then resolution = 'entity' when 'absent' then resolution = 'scope' when 'magnitude_ge' then magnitude >= threshold when 'magnitude_lt' then magnitude < threshold
  when 'direction_up' then direction = 'up' else direction = 'down' end as holds from pr),
tr as (select *, case when status = 'ok' then holds end as truth from q),
j0 as (select *, event_id % 4 > 0 as must_hold, case when event_id % 3 = 0 then 'supporting' else 'necessary' end as role,
  confidence = 'normal' as qualified, sample_ok as counter, event_id % 23 as hypothesis from (select *, event_id % 10 < 3 as sample_ok from tr)),
j as (select *, case when resolution = 'ambiguous' then 1 when status <> 'ok' then 2 when truth = must_hold and qualified then 3 when truth = must_hold then 4 when role <> 'necessary' then 7 when counter then 5 else 6 end::bigint as row from j0),
v as (select *, case row when 3 then 'supported_qualified' when 4 then 'supported_weak' when 5 then 'invalidated' else 'inconclusive' end as verdict from j),
t as (select hypothesis, count(*) filter (row = 3) as qualified, count(*) filter (row = 4) as weak, count(*) filter (row = 5) as refuted, count(*) filter (role = 'necessary') as necessary, count(*) as predicates from v group by 1)"""


def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("present", "absent", "magnitude_ge", "magnitude_lt", "direction_up", "direction_down")])
    i = F.col("id")
    r = records(spark, sf_dir).withColumns({
        "predicate": F.element_at(names, (i % 6).cast("int") + 1), "threshold": F.when(i % 19 > 0, 50.0), "availability": F.when(i % 17 == 0, "not_applicable").otherwise(F.col("availability")),
        "resolution": F.when(i % 8 == 0, "ambiguous").when(i % 8 < 3, "scope").otherwise("entity"), "source": F.when(i % 7 == 2, "compare_peers").otherwise("scan_metrics"),
        "class": F.when(i % 7 == 1, "appeared").when(i % 7 == 2, "self").when(i % 7 == 3, "counts").otherwise("shifted"),
    })
    return op.truth(r.withColumn("allowed", mapping.allows(F.col("source"), F.col("class"), F.col("predicate"))))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return op.judge(predicates(spark, sf_dir).withColumns({
        "must_hold": i % 4 > 0, "role": F.when(i % 3 == 0, "supporting").otherwise("necessary"),
        "qualified": F.col("confidence") == "normal", "counter": i % 10 < 3, "hypothesis": i % 23,
    }))


@PLANS.add(f"{PREDICATES} select id, predicate, status, truth from tr")
def predicate_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates(spark, sf_dir).select("id", "predicate", "status", "truth")


@PLANS.add(f"{PREDICATES} select id, row, verdict from v")
def truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("id", "row", "verdict")


@PLANS.add(f"{PREDICATES} select * from t")
def hypothesis_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.tally(judged(spark, sf_dir))


@PLANS.add(f"""{PREDICATES}, k as (select *, case when necessary > 0 then 1 - refuted / necessary else 1.0 end as kept from t)
select hypothesis, qualified, weak, refuted, necessary, predicates, round(kept, 6) as kept, row_number() over (order by qualified desc, weak desc, kept desc, hypothesis) as rank,
  case when refuted > 0 then 'refuted' when qualified >= 2 then 'confirmed' when qualified + weak > 0 then 'provisional' else 'insufficient' end as decision from k""")
def hypothesis_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(op.rank(op.tally(judged(spark, sf_dir))))


@PLANS.add("""with p as (select conv_id * 10 + turn as doc_id, 'see EIX-' || (turn * 9)::varchar || ' and EIX-' || (conv_id % 30)::varchar as text from conversations),
n as (select distinct doc_id, unnest(regexp_extract_all(text, 'EIX-([0-9]+)', 1)) as n from p), s as (select event_id as id, case when event_id % 9 = 0 and event_id >= 18 then event_id - 18 end as supersedes from events)
select n.doc_id, n.n, n.n in (select id::varchar from s where id not in (select supersedes from s where supersedes is not null)) as active from n""")
def citation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = t.read_table(spark, sf_dir, "conversations")
    prose = k.select((F.col("conv_id") * 10 + F.col("turn")).alias("doc_id"), F.concat(F.lit("see EIX-"), t.text(F.col("turn") * 9), F.lit(" and EIX-"), t.text(F.col("conv_id") % 30)).alias("text"))
    return op.citations(prose, records(spark, sf_dir))


@PLANS.add("""with x as (select conv_id, turn, '<|' || role || '|>' || chr(10) || '  ' || text as text from conversations),
y as (select conv_id, turn, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), ' +', ' ', 'g')) as text from x)
select conv_id, turn, substring(regexp_replace(text, '<\\|?(system|user|assistant)\\|?>', '[ESC]', 'gi'), 1, 200) as excerpt from y""")
def excerpt_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = t.read_table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n  "), F.col("text"))
    return k.select("conv_id", "turn", op.excerpt(text).alias("excerpt"))


@PLANS.add("""with x as (select conv_id, turn, 'a scenario-' || conv_id::varchar || ' and case-' || turn::varchar || '.' as text from conversations)
select conv_id, turn, 'a opaque-' || substring(sha256('scenario-' || conv_id::varchar), 1, 24) || ' and opaque-' || substring(sha256('case-' || turn::varchar), 1, 24) || '.' as text from x""")
def blind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = t.read_table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("a scenario-"), t.text("conv_id"), F.lit(" and case-"), t.text("turn"), F.lit("."))
    return k.select("conv_id", "turn", op.pseudonyms(text).alias("text"))


@PLANS.add("""with x as (select event_id, event_type = 'error' as told, event_type || '-' || user_id::varchar as name, json(props)::varchar as props from events),
y as (select *, '{"props":' || to_json(props)::varchar || ',"who":"opaque-' || substring(sha256('F12-A'), 1, 24) || ' seen"}' as raw from x)
select event_id, '{"note":"' || case when told then '[experiment annotation withheld]' else 'plain' end || '","raw":' || to_json(raw)::varchar
  || ',"target":"opaque-' || substring(sha256('scenario-' || name), 1, 24) || '"}' as clean,
  2 as removed_fields, told::int as redacted_strings, 2 as opaque_identifiers from y""")
def blind_filter_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes over all events, with JSON inside JSON inside JSON."""
    e = t.read_table(spark, sf_dir, "events")
    raw = F.to_json(F.struct(F.col("value").alias("golden"), "props", F.lit("F12-A seen").alias("who")))
    target = F.concat(F.lit("scenario-"), "event_type", F.lit("-"), t.text("user_id"))
    note = F.when(F.col("event_type") == "error", "command=inject F01-X").otherwise("plain")
    envelope = F.to_json(F.struct(F.col("user_id").alias("case_id"), target.alias("target"), raw.alias("raw"), note.alias("note")))
    return e.select("event_id", blind.blind_json(envelope).alias("b")).select("event_id", "b.*")


@PLANS.add("""select event_id, 'PD-' || substring(sha256('{"a":' || user_id::varchar || ',"b":' || json(props)::varchar || '}'), 1, 12) as digest, true as same from events""")
def params_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of a call, written in two orders."""
    e = t.read_table(spark, sf_dir, "events")
    one = F.concat(F.lit('{ "b" : '), "props", F.lit(', "a": '), t.text("user_id"), F.lit("}"))
    two = F.concat(F.lit('{"a":'), t.text("user_id"), F.lit(',"b":'), "props", F.lit("}"))
    return e.select("event_id", json_forms.params_digest(one).alias("digest"), (json_forms.params_digest(one) == json_forms.params_digest(two)).alias("same"))


@PLANS.add("""select l_orderkey, l_linenumber, '[{"cost":1.5,"filterPredicates":"' || repeat(l_returnflag, 200) || '…","id":' || l_linenumber::varchar || ',"operation":"SCAN"},{"id":'
  || l_orderkey::varchar || ',"parentId":' || l_linenumber::varchar || '}]' as plan from lineitem""")
def plan_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nodes for each line, with fields that are null, empty, unknown or long."""
    li = t.read_table(spark, sf_dir, "lineitem")
    line, order = t.text("l_linenumber"), t.text("l_orderkey")
    first = F.concat(F.lit('{"id":'), line, F.lit(',"parentId":null,"operation":"SCAN","x":1,"cost":1.5,"accessPredicates":"","filterPredicates":"'), F.repeat("l_returnflag", 201), F.lit('"}'))
    second = F.concat(F.lit('{"parentId":'), line, F.lit(',"id":'), order, F.lit(',"options":null}'))
    plan = json_forms.pruned_plan(F.concat(F.lit("["), first, F.lit(","), second, F.lit("]")))
    return li.select("l_orderkey", "l_linenumber", plan.alias("plan"))
