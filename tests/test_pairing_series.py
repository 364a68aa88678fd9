"""Consumed pairing, change points and look-ups against sequential ones."""

import math
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sondage.functions import quantiles
from sondage.operators import episodes, feeds, series

DAY = datetime(2024, 1, 1)


def _plain_pairs(left, right, seconds):
    used, out = set(), {}
    for i, t, k in sorted(left, key=lambda x: (x[1] or DAY, x[0])):
        open_ = [r for r, u, q in right if r not in used and k is not None and q == k and t is not None and abs((u - t).total_seconds()) <= seconds]
        if len(open_) == 1:
            used.add(open_[0])
        out[i] = ("unmatched" if not open_ else "unique_inferred" if len(open_) == 1 else "ambiguous", open_[0] if len(open_) == 1 else None)
    return out


@pytest.mark.parametrize(("seed", "n", "span", "stretch"), [(1, 60, 60, 64), (2, 60, 400, 1), (3, 60, 300, 2), (4, 80, 150, 1)])
def test_consumed_pairs_equal_a_walk_in_order(spark, monkeypatch, seed, n, span, stretch):
    monkeypatch.setattr(episodes, "STRETCH", stretch)
    rng = random.Random(seed)
    at = lambda: DAY + timedelta(seconds=rng.randrange(span))
    left = [(i, at(), rng.choice("ab")) for i in range(n)] + [(900, None, "a"), (901, at(), None)]
    right = [(1000 + i, at(), rng.choice("ab")) for i in range(n * 2 // 3)]
    kind = "id long, at timestamp_ntz, key string"
    got = episodes.pair_consumed(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), 4)
    want = _plain_pairs(left, right, 4)
    assert {r.id: (r.pairing, r.partner) for r in got.collect()} == want
    assert len(Counter(p for p, _ in want.values())) == 3


def test_rows_of_one_moment_take_few_rounds(spark):
    """Thousands of rows that want the same two rights are fixed together."""
    left = spark.range(3000).select("id", F.lit(DAY).cast("timestamp_ntz").alias("at"), F.lit("k").alias("key"))
    right = spark.range(2).select((F.col("id") + 9000).alias("id"), F.lit(DAY).cast("timestamp_ntz").alias("at"), F.lit("k").alias("key"))
    assert episodes.pair_consumed(left, right, 2).groupBy("pairing").count().collect() == [("ambiguous", 3000)]
    got = episodes.pair_consumed(left, right.limit(1), 2)
    assert {tuple(r) for r in got.groupBy("pairing").count().collect()} == {("unique_inferred", 1), ("unmatched", 2999)}
    assert got.filter("partner is not null").first().id == 0


def _plain_changes(points, tolerance=1e-9):
    out, kept = [], None
    for at, v in sorted(points):
        if kept is not None and abs(v - kept) > tolerance * max(abs(v), abs(kept)):
            out.append((at, kept, v))
            kept = v
        kept = v if kept is None else kept
    return out


@pytest.mark.parametrize("tolerance", [1e-9, 0.3])
def test_change_points_over_many_chunks(spark, monkeypatch, tolerance):
    """A drift within the tolerance, whose kept value passes through many chunks, jumps, and a gap."""
    monkeypatch.setattr(series, "CHUNK", 7)
    rng = random.Random(5)
    drift = [("drift", i, 1.0 + 0.01 * i) for i in range(120)]
    jumps = [("jumps", i if i < 60 else i + 900, float(rng.choice([1, 1, 1, 2, 50]))) for i in range(120)]
    rows = [*drift, *jumps, ("one", 3, 1.0), ("flat", 1, 2.0), ("flat", 900, 2.0), ("void", 1, None)]
    rng.shuffle(rows)
    got = series.change_points(spark.createDataFrame(rows, "name string, bucket long, value double"), tolerance=tolerance)
    want = {n: _plain_changes([(b, v) for m, b, v in rows if m == n and v is not None], tolerance) for n in ("drift", "jumps", "one", "flat")}
    assert sorted(tuple(r) for r in got.select("name", "bucket", "was", "is").collect()) == sorted((n, *c) for n, cs in want.items() for c in cs)


def test_stability_of_changed_sparse_and_constant_series(spark):
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 1.0), ("b", 1, 5.0), ("c", 1, 5.0), ("c", 2, 5.0), ("c", 3, 5.0)]
    got = series.stability(spark.createDataFrame(rows, "name string, bucket long, value double"), 10)
    assert {r.name: (r.n, r.changes, r.stability) for r in got.collect()} == {"a": (3, 2, "changed"), "b": (1, 0, "unknown_sparse"), "c": (3, 0, "observed_constant")}


def test_a_million_points_of_one_series(spark):
    rows = spark.range(1_000_000).select(F.lit("s").alias("name"), F.col("id").alias("bucket"), F.floor(F.col("id") / 1000).cast("double").alias("value"))
    assert series.change_points(rows).count() == 999


def test_onset_needs_three_tenths_of_the_buckets(spark):
    base = spark.createDataFrame([("a", i, 1.0) for i in range(9)], "name string, bucket long, value double")
    now = spark.createDataFrame([("a", 100 + i, 1.0 if i < 1 else 9.0) for i in range(3)], "name string, bucket long, value double")
    assert series.onset(now, base, expected=10).count() == 1
    assert series.onset(now, base, expected=11).count() == 0


def test_nearest_of_one_busy_key(spark):
    """Twenty thousand rows of one key: a frame that is read anew for each row takes most of a minute."""
    at = (F.lit(DAY) + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).cast("timestamp_ntz")
    asked = spark.range(20_000).select("id", F.lit("k").alias("k"), at.alias("ts"))
    began = time.time()
    got = feeds.nearest(asked, asked.filter("id % 10 = 0").select("k", "ts"), "k").filter("captured <> ts").count()
    assert got == 18_000 and time.time() - began < 20


def test_quantiles_of_a_hot_group_lie_in_many_ranges(spark):
    rng = random.Random(9)
    rows = [("hot", float(rng.randrange(4000))) for _ in range(9000)] + [("few", 1.0), ("few", 2.0), ("one", 5.0), ("void", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.a, r.b, r.c) for r in quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.0}).collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    between = lambda q: hot[int(q * 8999)] + (hot[min(int(q * 8999) + 1, 8999)] - hot[int(q * 8999)]) * (q * 8999 % 1)
    assert got == {"hot": (pytest.approx(between(0.5)), pytest.approx(between(0.95)), hot[0]), "few": (1.5, pytest.approx(1.95), 1.0), "one": (5.0, 5.0, 5.0)}


def test_robust_stats_by_hand(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 8, -20)] + [("b", 3.0)], "name string, value double")
    got = {r.name: (r.n, r.med, r.scale, r.mad) for r in series.robust_stats(df).collect()}
    assert got == {"a": (5, 2.0, 20.0, 2.0), "b": (1, 3.0, 3.0, 0.0)}


def test_halves_that_a_sum_misses_are_rounded_alike(spark):
    sums = [60.76 + 65.27 + 67.96 + 6.01, 67.96 + 6.01 + 65.27 + 60.76, math.nextafter(200, 0), 199.999999]  # of 200, in any order
    rows = spark.createDataFrame([(s,) for s in sums], "s double").select("s", series.whole(F.col("s") / 80).alias("v"))
    assert dict(map(tuple, rows.collect())) == {s: 3.0 for s in sums[:3]} | {199.999999: 2.0}
