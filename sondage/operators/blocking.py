"""Sessions of databases that wait for each other: fields by engine, roles, chains, changes of the roots, time lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.sources import discard, durable

# The JSON key of each field by engine.
SESSION_KEYS = {"postgresql": "pid", "mysql": "tid", "mariadb": "tid", "cubrid": "tid", "oracle": "sid", "tibero": "sid", "mssql": "sid"}
BLOCKER_KEYS = {
    "postgresql": "blockingPid", "oracle": "blockingSession", "tibero": "blockingSession", "mysql": "blockingTid",
    "mariadb": "blockingTid", "cubrid": "blockingTid", "mssql": "blockingSid",
}
WAIT_KEYS = {"postgresql": "waitEvent", "oracle": "event", "tibero": "event", "mssql": "waitType"}
SQL_KEYS = {"postgresql": "sqlHash", "mysql": "sqlHash", "mariadb": "sqlHash", "oracle": "sqlId", "tibero": "sqlId", "cubrid": "sqlId", "mssql": "queryHash"}
VERIFIED = ("postgresql", "oracle")

#: A time line of more polls than this shows its first and last half of them.
TIMELINE_POLLS = 60

#: Edges of a poll that are walked in one piece.
MOST_EDGES = 1_000


def json_field(body: Column, engine: Column, keys: dict[str, str]) -> Column:
    """The field that an engine keeps under its own key; null for an engine without one and for a body that is no JSON."""
    value = F.lit(None).cast("string")
    for key in sorted(set(keys.values())):
        value = F.when(engine.isin(*[e for e, k in keys.items() if k == key]), F.get_json_object(body, f"$.{key}")).otherwise(value)
    return value


def session_fields(rows: DataFrame) -> DataFrame:
    """rows(database, engine, poll, body) with session, blocker (0 where there is none), wait and sql_key (empty), and whether pairs are verified."""
    body, engine = F.col("body"), F.col("engine")
    whole = lambda keys: F.coalesce(json_field(body, engine, keys).try_cast("long"), F.lit(0))
    words = lambda keys: F.coalesce(json_field(body, engine, keys), F.lit(""))
    return rows.select(
        "database", "engine", "poll", whole(SESSION_KEYS).alias("session"), whole(BLOCKER_KEYS).alias("blocker"),
        words(WAIT_KEYS).alias("wait"), words(SQL_KEYS).alias("sql_key"), F.when(engine.isin(*VERIFIED), "verified").otherwise("unverified").alias("pairing"),
    )


def roles(sessions: DataFrame) -> DataFrame:
    """Each session of a poll once: root (others wait for it alone), both, or blocked_only; sessions in no wait are left out.

    A row tells of two sessions, its own and the one it waits for, so one pass and one aggregate find both; a poll without a name or a number has no pairs.
    """
    keys = ["database", "poll", "session"]
    own = F.when(F.col("session") > 0, F.struct("session", "blocker", F.lit(False).alias("blocking")))
    paired = F.col("database").isNotNull() & F.col("poll").isNotNull()
    waited = F.when((F.col("blocker") > 0) & paired, F.struct(F.col("blocker").alias("session"), F.lit(None).cast("long").alias("blocker"), F.lit(True).alias("blocking")))
    told = sessions.select("database", "poll", F.explode(F.array_compact(F.array(own, waited))).alias("s")).select("database", "poll", "s.*")
    both = told.groupBy(*keys).agg(F.max("blocker").alias("blocker"), F.max("blocking").alias("blocking"), F.count_if(~F.col("blocking")).alias("__own"))
    role = F.when(F.col("blocking") & (F.col("blocker") <= 0), "root").when(F.col("blocking"), "both").otherwise("blocked_only")
    return both.filter("__own > 0 and (blocking or blocker > 0)").select(*keys, "blocker", role.alias("role"))


def _depths(row: np.ndarray, at: np.ndarray, to: np.ndarray, rows: int) -> np.ndarray:
    """For each of ``rows`` polls the sessions on its longest chain. Edges lead to the edge of their blocker in the same poll; what they reach doubles each round."""
    n = len(at)
    code = np.unique(np.concatenate([at, to]), return_inverse=True)[1]
    key = np.concatenate([row, row]) * (2 * n + 1) + code
    order = np.argsort(key[:n])
    place = np.minimum(np.searchsorted(key[:n], key[n:], sorter=order), n - 1)
    step = np.append(np.where(key[order[place]] == key[n:], order[place], n), n)  # n: the end of a chain
    rounds = int(np.bincount(row).max()).bit_length()

    def reached(step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where all steps end, how many there are to a place that leads to itself, and the least place on the way."""
        steps, least = (step != np.arange(n + 1)).astype(np.int64), np.minimum(np.arange(n + 1), step)
        for _ in range(rounds):
            steps, least, step = steps + steps[step], np.minimum(least, least[step]), step[step]
        return step, steps, least

    end, _, least = reached(step)
    circle = np.unique(end[end < n])  # all places of all circles
    size = np.bincount(least[circle], minlength=n + 1)
    size[n] = 1  # the last blocker, which waits for nobody
    step[circle] = circle
    end, steps, _ = reached(step)
    deepest = np.zeros(rows, dtype=np.int64)
    np.maximum.at(deepest, row, (steps + np.where(end < n, size[least[end]], 1))[:n])
    return deepest


def _walked(polls: DataFrame) -> DataFrame:
    """polls(database, poll, edges: arrays of session and blocker) with their depth."""

    def depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = b.column(2)
            row = np.repeat(np.arange(len(edges)), pc.list_value_length(edges).to_numpy(zero_copy_only=False))
            at, to = (pc.struct_field(edges.flatten(), i).to_numpy(zero_copy_only=False) for i in (0, 1))
            depth = _depths(row, at, to, len(edges)) if len(row) else np.zeros(len(edges), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.maximum(depth, 2))], names=["database", "poll", "depth"])

    kind = dict(polls.dtypes)
    return polls.mapInArrow(depths, f"database {kind['database']}, poll {kind['poll']}, depth long")


def chain_depth(edges: DataFrame) -> DataFrame:
    """edges(database, poll, session, blocker): the sessions on the longest chain of each poll, where no session is counted twice.

    A session waits for one other, so chains are walked in the arrays of a poll, in time nearly linear in its edges. Polls of more than
    ``MOST_EDGES`` are walked by joins instead.
    """
    keys = ["database", "poll"]
    step = durable(edges.groupBy(*keys, F.col("session").alias("__at")).agg(F.max("blocker").alias("__to")), "edges")
    hot = durable(step.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_EDGES).select(*keys), "hot")
    some = not hot.isEmpty()
    cold = step.join(hot, keys, "left_anti") if some else step
    linked = F.col("__to").isNotNull() & F.col("database").isNotNull() & F.col("poll").isNotNull()
    out = _walked(cold.groupBy(*keys).agg(F.collect_list(F.when(linked, F.struct("__at", "__to"))).alias("edges")))
    return out.unionByName(_joined(step.join(hot, keys, "left_semi"))) if some else out


def _joined(step: DataFrame) -> DataFrame:
    """Depths of polls(database, poll, __at, __to) of any size.

    Every session walks to its blocker as long as that is new to it. One round is one join on the session reached, so hot polls are
    dealt over their sessions; rounds end when no walk goes on.
    """
    keys = ["database", "poll"]
    walk = step.select(*keys, F.array("__at").alias("path"), F.col("__at").alias("__cur"))
    done, rounds = None, []
    while True:
        went = walk.join(step.withColumnRenamed("__at", "__cur"), [*keys, "__cur"], "left")
        on = F.col("__to").isNotNull() & ~F.array_contains("path", F.coalesce("__to", F.lit(-1)))
        went = durable(went.select(*keys, on.alias("on"), F.when(on, F.concat("path", F.array("__to"))).otherwise(F.col("path")).alias("path"), F.col("__to").alias("__cur")), "walks")
        rounds.append(went)
        ended = went.filter("not on").groupBy(*keys).agg(F.max(F.size("path")).alias("depth"))
        done = ended if done is None else done.unionByName(ended)
        walk = went.filter("on").drop("on")
        if walk.isEmpty():
            break
    out = durable(done.groupBy(*keys).agg(F.greatest(F.max("depth"), F.lit(2)).cast("long").alias("depth")), "depths")
    for r in rounds:
        discard(r)
    return out


def root_changes(sessions_by_role: DataFrame) -> DataFrame:
    """The sets of roots that each database had poll by poll, and whether a set gave way to another; polls without roots don't count."""
    sets = sessions_by_role.filter("role = 'root'").groupBy("database", "poll").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("session").cast("string"))), ",").alias("roots")
    )
    changed = F.col("roots") != F.lag("roots").over(W.partitionBy("database").orderBy("poll"))
    seen = sets.withColumn("changed", F.coalesce(changed, F.lit(False)))
    return seen.groupBy("database").agg(F.count(F.lit(1)).alias("polls"), F.count_distinct("roots").alias("root_sets"), F.count_if("changed").alias("n_changes"), F.max("changed").alias("migrated"))


def timeline(polls: DataFrame, most: int = TIMELINE_POLLS) -> DataFrame:
    """polls(database, poll, ...) of each database, the first and the last half of ``most`` where there are more."""
    by = W.partitionBy("database")
    placed = polls.withColumn("__n", F.count(F.lit(1)).over(by)).withColumn("__first", F.row_number().over(by.orderBy("poll")))
    kept = (F.col("__n") <= most) | (F.col("__first") <= most // 2) | (F.col("__first") > F.col("__n") - most // 2)
    return placed.filter(kept).withColumn("truncated", F.col("__n") > most).drop("__n", "__first")
