"""Preference pairs from chosen and rejected conversations, in DataFrame functions alone.

Both conversations of a pair are ordered by turn; the longest common prefix of equal (role, text) turns is rendered once as
the prompt, and what follows on each side becomes a completion. A completion's mask has one digit for each of its turns: 1
for an assistant's turn, whose characters carry the loss, 0 for any other.

One shuffle by pair. A pair's rows meet in one row since they become one string; pairs themselves are independent.

Defined cases: a null role or text is rendered as an empty one, and two nulls are equal turns; rows with equal turn numbers
are ordered by role, then text, and repeated rows stay repeated turns; a pair with one side only has an empty prefix and an
empty completion on the other side; rows with a null key form a pair of their own; extra columns are ignored; an empty
table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _render(turns: Column) -> Column:
    """Fixed format: <|role|>, newline, text, newline for each turn."""
    one = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))
    return F.array_join(F.transform(turns, one), "")


def _mask(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.when(t["role"] == "assistant", "1").otherwise("0")), "")


def _loss_chars(turns: Column) -> Column:
    own = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"]))


def preference_pairs(rows: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """One row for each pair: prompt, completions, masks. ``chosen`` tells which side a row is on."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    sides = rows.groupBy(pair.alias("pair_id")).agg(
        F.array_sort(F.collect_list(F.when(chosen, turn))).alias("c"), F.array_sort(F.collect_list(F.when(~chosen, turn))).alias("r")
    )
    shorter = F.least(F.size("c"), F.size("r"))
    head = lambda side: F.slice(F.col(side), F.lit(1), shorter)
    equal = F.zip_with(head("c"), head("r"), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    same = F.coalesce(F.nullif(F.array_position(equal, F.lit(False)), F.lit(0)) - 1, shorter)
    cut = sides.withColumn("n", same.cast("int"))
    rest = lambda side: F.slice(F.col(side), F.col("n") + 1, F.size(side))
    return cut.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prefix"),
        _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest("c")).alias("chosen"),
        _render(rest("r")).alias("rejected"),
        _mask(rest("c")).alias("chosen_mask"),
        _mask(rest("r")).alias("rejected_mask"),
        _loss_chars(rest("c")).alias("chosen_loss_chars"),
        _loss_chars(rest("r")).alias("rejected_loss_chars"),
    )


def op8_preference_format(conversations: DataFrame) -> DataFrame:
    """Neighbours by conv_id are a pair: 2k is chosen, 2k + 1 rejected."""
    side = F.coalesce(F.pmod(F.col("conv_id"), F.lit(2)), F.lit(0))
    return preference_pairs(conversations.select("conv_id", "turn", "role", "text"), F.floor(F.col("conv_id") / 2).cast("long"), side == 0)


ORACLE = """
with t as (
  select (conv_id // 2)::bigint as pair_id, coalesce(conv_id % 2, 0) = 0 as is_c, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations),
p as (select pair_id, count(*) filter (is_c) as nc, count(*) filter (not is_c) as nr from t group by pair_id),
bad as (
  select c.pair_id, min(c.i) as i from t c join t r on c.pair_id = r.pair_id and c.i = r.i
  where c.is_c and not r.is_c and (c.role <> r.role or c.text <> r.text) group by c.pair_id),
n as (select p.pair_id, least(nc, nr, coalesce(bad.i - 1, 1000000)) as n from p left join bad using (pair_id)),
s as (select t.*, n.n, '<|' || role || '|>' || chr(10) || text || chr(10) as body, role = 'assistant' as a from t join n using (pair_id))
select pair_id, max(n)::bigint as n_prefix,
  coalesce(string_agg(body, '' order by i) filter (is_c and i <= n), '') as prompt,
  coalesce(string_agg(body, '' order by i) filter (is_c and i > n), '') as chosen,
  coalesce(string_agg(body, '' order by i) filter (not is_c and i > n), '') as rejected,
  coalesce(string_agg(a::int::varchar, '' order by i) filter (is_c and i > n), '') as chosen_mask,
  coalesce(string_agg(a::int::varchar, '' order by i) filter (not is_c and i > n), '') as rejected_mask,
  coalesce(sum(length(text)) filter (is_c and i > n and a), 0)::bigint as chosen_loss_chars,
  coalesce(sum(length(text)) filter (not is_c and i > n and a), 0)::bigint as rejected_loss_chars
from s group by pair_id
"""
