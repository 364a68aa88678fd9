"""Transitions into episodes, polls into blocking events, audit rows into changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.sources import discard, durable

#: So many bands of a pairing are sorted in one piece.
STRETCH = 64


def fold_episodes(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Open and close of each episode in a window, and on which side it is cut."""
    own = rows.filter(F.col("transition").isin("open", "close"))
    own = own.filter((F.col("at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("at") < F.lit(end).cast("timestamp_ntz")))
    is_open, is_close = F.col("transition") == "open", F.col("transition") == "close"
    order = F.struct("at", "event_id")
    folded = own.groupBy("episode_id").agg(
        F.count_if(is_open).alias("n_open"), F.count_if(is_close).alias("n_close"),
        F.min(F.when(is_open, F.col("at"))).alias("open_at"), F.max(F.when(is_close, F.col("at"))).alias("close_at"),
        F.max_by("severity", F.when(is_close, order)).alias("peak"), F.max_by("severity", F.when(is_open, order)).alias("open_severity"),
        F.max_by("detector", order).alias("detector"),
    )
    boundary = F.when(F.col("n_open") == 0, "opened_before_window").when(F.col("n_close") == 0, "closed_after_window").otherwise("complete")
    return folded.withColumn("boundary", boundary)


def unpaired(rows: DataFrame, most: int) -> DataFrame:
    """The latest transitions that are neither open nor close."""
    return rows.filter(~F.col("transition").isin("open", "close")).orderBy(F.desc("at"), F.desc("event_id")).limit(most)


def deduplicate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Events pushed again count once, with their largest count."""
    return rows.groupBy(*keys).agg(F.max("severity").alias("max_count"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def poll_interval(polls: DataFrame) -> DataFrame:
    """The commonest gap between polls in seconds; of equally common ones the smaller."""
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(W.partitionBy("engine").orderBy("ts")).cast("timestamp"))
    n = polls.select("engine", gap.alias("gap")).filter("gap > 0").groupBy("engine", "gap").count()
    return n.groupBy("engine").agg(F.max_by("gap", F.struct("count", -F.col("gap"))).alias("interval"))


def blocking_events(polls: DataFrame, peak: int = 3) -> DataFrame:
    """Consecutive polls with blocked sessions; a quiet poll ends an event, a missing one is only counted."""
    w = W.partitionBy("engine").orderBy("ts")
    marked = polls.withColumn("is_on", F.col("blocked") > 0).withColumn("breaks", F.sum((~F.col("is_on")).cast("int")).over(w))
    on = marked.filter("is_on").join(poll_interval(polls), "engine", "left")
    own = W.partitionBy("engine", "breaks").orderBy("ts")
    step = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(own).cast("timestamp"))
    on = on.withColumn("missing", F.greatest(F.coalesce(F.floor(step / F.col("interval")) - 1, F.lit(0)), F.lit(0)))
    events = on.groupBy("engine", "breaks").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("polls"), F.max("blocked").alias("blocked_peak"),
        F.max_by("ts", F.struct("blocked", "ts")).alias("representative"), F.max_by("blocked", "ts").alias("blocked_last"),
        F.sum("missing").cast("long").alias("gap_polls"),
    )
    return events.drop("breaks").withColumn("anomalous", F.col("blocked_peak") >= peak)


def fold_changes(rows: DataFrame) -> DataFrame:
    """Audit rows of one category, target and second are one change with variants by (detail, action)."""
    second = F.date_trunc("second", "at")
    variant = rows.groupBy("category", "target_id", second.alias("second"), "detail", "action").agg(F.count(F.lit(1)).alias("n"))
    return variant.groupBy("category", "target_id", "second").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("variants"))


def _claims(left: DataFrame, right: DataFrame, seconds: int) -> DataFrame:
    """One round of :func:`pair_consumed`: id, pairing and partner of the left rows that no earlier open row can change any more.

    Rows of a key are sorted by stretches of time; a right row also lies in the stretches that its band reaches, a left row as a ghost in
    the next stretches as long as it can still claim what rows there want. ``n`` rights stand in a row's band, ``safe`` of them beyond the band
    of the open row before; only that one's band can hold rights of this one that an earlier row may claim.
    """
    length = seconds * STRETCH + 1
    stretch = lambda t: F.floor(t / length).cast("long")
    none = F.lit(None).cast("long")
    asks = left.select("id", "key", "t", none.alias("rid"), F.lit(True).alias("real"), stretch(F.col("t")).alias("stretch"))
    own_, reach = stretch(F.col("t")), stretch(F.col("t") + 2 * seconds)
    ghosts = left.filter(reach > own_).select("id", "key", "t", none.alias("rid"), F.lit(False).alias("real"), F.explode(F.sequence(own_ + 1, reach)).alias("stretch"))
    theirs = right.select(
        none.alias("id"), "key", "t", F.col("id").alias("rid"), F.lit(False).alias("real"),
        F.explode(F.array_distinct(F.array(stretch(F.col("t") - seconds), stretch(F.col("t")), stretch(F.col("t") + seconds)))).alias("stretch"),
    )
    by = W.partitionBy("key", "stretch").orderBy("t")
    upto, below = by.rangeBetween(W.unboundedPreceding, seconds), by.rangeBetween(W.unboundedPreceding, -seconds - 1)
    own = asks.unionByName(ghosts).unionByName(theirs).withColumns({
        "to": F.count("rid").over(upto), "from": F.count("rid").over(below), "last": F.last("rid", ignorenulls=True).over(upto),
    }).filter("rid is null")
    order = W.partitionBy("key", "stretch").orderBy("t", "id")
    own = own.withColumns({"p_to": F.lag("to").over(order), "p_from": F.lag("from").over(order)})
    same = F.coalesce((F.col("to") == F.col("p_to")) & (F.col("from") == F.col("p_from")), F.lit(False))
    own = own.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(order))
    n, safe = F.col("to") - F.col("from"), F.col("to") - F.greatest(F.col("from"), F.coalesce("p_to", "from"))
    state = F.when(n == 0, "unmatched").when(safe >= 2, "ambiguous").when((n == 1) & (safe == 1), "unique_inferred")
    own = own.withColumn("state", F.when(~same | (n == 0), state))
    # rows that want the same rights share the lot of the first of them, if that one claims none
    first = F.first(F.when(F.col("real"), F.col("state"))).over(W.partitionBy("key", "stretch", "run").orderBy("t", "id"))
    own = own.withColumn("pairing", F.coalesce("state", F.when(first == "ambiguous", first)))
    fixed = own.filter("real and pairing is not null")
    return fixed.select("id", "pairing", F.when(F.col("pairing") == "unique_inferred", F.col("last")).alias("partner"))


def pair_consumed(left: DataFrame, right: DataFrame, seconds: int) -> DataFrame:
    """left(id, at, key) against right(id, at, key) within +-seconds, in the order of time and id: a left row with one right row left
    over takes it (unique_inferred), so that later rows can't; with more it takes none (ambiguous), with none it is unmatched.

    Each round fixes the rows whose outcome no earlier open row can change, all keys and stretches at once, and removes what they took;
    the first open row of a key is always among them. Rounds follow the longest chain of rows that wait for each other, not the number
    of rows; each is stored, and the driver sees one count. Rows without a key or a time are unmatched.
    """
    at = F.unix_seconds(F.col("at").cast("timestamp"))
    whole = "key is not null and t is not null"
    open_ = durable(left.select("id", "key", at.alias("t")), "open")
    none = F.lit(None).cast(right.schema["id"].dataType)
    done = [open_.filter(f"not ({whole})").select("id", F.lit("unmatched").alias("pairing"), none.alias("partner"))]
    open_ = open_.filter(whole)
    rest = durable(right.select("id", "key", at.alias("t")).filter(whole), "rest")
    while not open_.isEmpty():
        fixed = durable(_claims(open_, rest, seconds), "fixed")
        done.append(fixed)
        now = durable(open_.join(fixed.select("id"), "id", "left_anti"), "open")
        taken = fixed.filter("partner is not null").select(F.col("partner").alias("id"))
        left_over = durable(rest.join(taken, "id", "left_anti"), "rest")
        discard(rest)
        if len(done) > 2:  # the first table also holds the rows without a key
            discard(open_)
        open_, rest = now, left_over
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
