"""Metric series: buckets, folds, robust comparison of two windows, onsets, shares."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.functions import quantiles, ranked
from sondage.sources import discard, durable

#: Thresholds of the comparisons.
Z_SHIFTED = 3.0
PRESENCE_INTERMITTENT = 0.30
THIN_SAMPLES = 10
MAD_SCALE = 1.4826


def within(df: DataFrame, start: datetime | str, end: datetime | str, ts: str = "ts") -> DataFrame:
    """Half-open window."""
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def bucket_mean(df: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Mean of the raw samples by series and bucket; empty buckets are absent."""
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds).cast("long") * seconds
    return df.groupBy(*keys, at.alias("bucket")).agg(F.avg("value").alias("value"))


def fold_grade(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Series that differ by grade only become one: the larger value; ``mismatch`` marks grades that disagree."""
    top, low = F.max("value"), F.min("value")
    differs = (top - low) > 1e-9 * F.greatest(F.abs(top), F.abs(low))
    return buckets.groupBy(*keys, "bucket").agg(top.alias("value"), differs.alias("mismatch"))


def mean_over(folded: DataFrame) -> DataFrame:
    return folded.groupBy("name", "bucket").agg(F.avg("value").alias("value"))


def whole(value: Column) -> Column:
    """The nearest whole number of a mean. Its last bits depend on the order of its sum, so they go first, lest a half falls to either side."""
    return F.round(F.round(value, 9))


def increases(series: DataFrame, key: str = "name") -> DataFrame:
    """Adjacent differences of a counter; a reset counts 0; the first point has none."""
    step = F.col("value") - F.lag("value").over(W.partitionBy(key).orderBy("bucket"))
    steps = series.select(key, "bucket", step.alias("step")).filter("step is not null")  # greatest() would take 0 for null
    return steps.select(key, "bucket", F.greatest("step", F.lit(0.0)).alias("value"))


def robust_stats(series: DataFrame, key: str = "name") -> DataFrame:
    """n, median, mad, scale (largest absolute value) of each series; medians are exact, and no series is held in memory."""
    top = series.groupBy(key).agg(F.count("value").alias("n"), F.max(F.abs("value")).alias("scale"))
    med = quantiles(series, [key], "value", {"med": 0.5})
    apart = series.join(med, key).withColumn("__apart", F.abs(F.col("value") - F.col("med")))
    return top.join(med, key).join(quantiles(apart, [key], "__apart", {"mad": 0.5}), key).select(key, "n", "med", "scale", "mad")


def classify(current: DataFrame, baseline: DataFrame, expected_base: int, shifted: float = Z_SHIFTED, key: str = "name") -> DataFrame:
    """Four classes by metric: disappeared, appeared, shifted, steady; z is not capped."""
    c = robust_stats(current, key).select(key, *[F.col(x).alias(f"c_{x}") for x in ("n", "med", "scale")])
    b = robust_stats(baseline, key).select(key, *[F.col(x).alias(f"b_{x}") for x in ("n", "med", "scale", "mad")])
    both = c.join(b, key, "full").filter(~F.col(key).contains(".bands") & ~F.endswith(F.col(key), F.lit(".raw")))
    scale = F.greatest("c_scale", "b_scale")
    scale = F.when(scale == 0, F.lit(1.0)).otherwise(scale)
    least = F.greatest(MAD_SCALE * F.col("b_mad"), 0.05 * F.abs("b_med"), 0.01 * scale, F.lit(1e-9))
    z = F.abs(F.col("c_med") - F.col("b_med")) / least
    kind = F.when(F.col("c_n").isNull(), "disappeared").when(F.col("b_n").isNull(), "appeared").when(z >= shifted, "shifted").otherwise("steady")
    return both.select(
        key, kind.alias("class"), F.when(F.col("c_n").isNotNull() & F.col("b_n").isNotNull(), z).alias("z"),
        F.col("c_med").alias("current_median"), F.col("b_med").alias("baseline_median"),
        (F.coalesce("b_n", F.lit(0)) / expected_base < PRESENCE_INTERMITTENT).alias("intermittent"),
        (F.coalesce("b_n", F.lit(0)) < THIN_SAMPLES).alias("thin"),
    )


def onset(current: DataFrame, baseline: DataFrame, threshold: float = Z_SHIFTED, key: str = "name", expected: int = 0) -> DataFrame:
    """First bucket that deviates together with one of the next two existing buckets, and the bucket before it.

    A series with less than 30 % of the ``expected`` buckets has none, as its first point would be taken for it; 0: as many as there are.
    """
    b = robust_stats(baseline, key)
    top = current.groupBy(key).agg(F.max(F.abs("value")).alias("c_scale"), F.count(F.lit(1)).alias("c_n"))
    if expected:
        top = top.filter(F.col("c_n") / expected >= PRESENCE_INTERMITTENT)
    scale = F.greatest("c_scale", "scale")
    scale = F.when(scale == 0, F.lit(1.0)).otherwise(scale)
    least = F.greatest(MAD_SCALE * F.col("mad"), 0.05 * F.abs("med"), 0.01 * scale, F.lit(1e-9))
    w = W.partitionBy(key).orderBy("bucket")
    marked = current.join(b, key).join(top, key).withColumn("over", (F.abs(F.col("value") - F.col("med")) / least >= threshold).cast("int"))
    marked = marked.select(
        key, "bucket", "over", F.sum("over").over(w.rowsBetween(0, 2)).alias("near"), F.lag("bucket").over(w).alias("before"),
        F.row_number().over(w).alias("i"),
    )
    first = marked.filter("over = 1 and near >= 2").groupBy(key).agg(F.min(F.struct("bucket", "before", "i")).alias("o"))
    return first.select(
        key, F.col("o.before").alias("onset_from"), F.col("o.bucket").alias("onset_to"),
        F.when(F.col("o.i") == 1, "outside_window").otherwise("found").alias("state"),
    )


def timeline(onsets: DataFrame) -> DataFrame:
    """Onsets in order with the gap to the one before; overlapping intervals can't be ordered."""
    found = ranked(onsets.filter("state = 'found'"), [F.asc("onset_from"), F.asc("onset_to"), F.asc("name")])
    last = found.select((F.col("rank") + 1).alias("rank"), F.col("onset_to").alias("__before"))
    before = F.col("__before")
    return found.join(last, "rank", "left").select(
        "name", "onset_from", "onset_to",
        F.when(before.isNull(), "first").when(F.col("onset_from") < before, "indeterminate").otherwise("after").alias("versus_previous"),
        F.when(F.col("onset_from") >= before, F.col("onset_from") - before).alias("gap_seconds"),
    )


def downsample(series: DataFrame, most: int, total: bool = False, key: str = "name") -> DataFrame:
    """At most ``most`` points by merging equally many neighbours; the group's first bucket is its time."""
    w = W.partitionBy(key)
    i = F.row_number().over(w.orderBy("bucket")) - 1
    size = F.ceil(F.count(F.lit(1)).over(w) / most)
    parts = series.withColumn("part", F.floor(i / size).cast("long"))
    return parts.groupBy(key, "part").agg(F.min("bucket").alias("bucket"), (F.sum if total else F.avg)("value").alias("value"))


def top_groups(buckets: DataFrame, label: str, most: int) -> DataFrame:
    """The label's ``most`` largest values by sum, all others merged as (other) by summing each bucket."""
    sums = buckets.groupBy(label).agg(F.sum("value").alias("total"))
    top = F.broadcast(sums.orderBy(F.desc("total"), label).limit(most).select(label, F.col(label).alias("group")))  # at most ``most`` rows
    rows = buckets.join(top, label, "left").withColumn("group", F.coalesce("group", F.lit("(other)")))
    return rows.groupBy("group", "bucket").agg(F.sum("value").alias("value"))


def window_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"),
        F.max_by("value", F.struct("ts", "value")).alias("last"), F.count(F.lit(1)).alias("n"),
    )


def change_verdict(current: Column, baseline: Column, share: float = 0.5) -> Column:
    """Changed by more than ``share`` of the baseline; any value is a change from zero, except zero."""
    return (
        F.when(current.isNull() | baseline.isNull(), "no_data").when(baseline == 0, F.when(current == 0, "normal").otherwise("anomalous"))
        .when(F.abs(current - baseline) / F.abs(baseline) > share, "anomalous").otherwise("normal")
    )


def relative_change(current: DataFrame, baseline: DataFrame, key: str = "name") -> DataFrame:
    """Rank by |current - baseline| / max(|baseline|, 1e-9) of the means; a new metric comes before all."""
    c, b = (d.groupBy(key).agg(F.avg("value").alias(n)) for d, n in ((current, "c"), (baseline, "b")))
    score = F.abs(F.col("c") - F.col("b")) / F.greatest(F.abs("b"), F.lit(1e-9))
    rows = c.join(b, key, "left").select(key, "c", "b", score.alias("score"), F.col("b").isNull().alias("is_new"))
    return ranked(rows, [F.desc("is_new"), F.desc_nulls_last("score"), F.asc(key)])


def share_of_total(df: DataFrame, label: str, dominant: float = 0.5) -> DataFrame:
    sums = df.groupBy(label).agg(F.sum("value").alias("total"))
    share = F.col("total") / F.lit(df.agg(F.sum("value")).first()[0])
    return sums.select(label, "total", share.alias("share"), (share >= dominant).alias("dominant"))


def silent_targets(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Targets that emitted before and don't now; one alone is isolated, more are widespread."""
    gone = baseline.select("target_id").distinct().join(current.select("target_id").distinct(), "target_id", "left_anti")
    alone = gone.limit(2).count() <= 1
    return gone.select("target_id", F.lit("isolated" if alone else "widespread").alias("scope"))


def capacity(usage: DataFrame, limits: DataFrame, on: str) -> DataFrame:
    """Usage against its limit after surplus labels are summed; a limit of 0 or less, or none, is unmatched."""
    u = usage.groupBy(on).agg(F.sum("value").alias("used"))
    m = limits.groupBy(on).agg(F.sum("value").alias("limit"))
    ok = F.col("limit") > 0
    return u.join(m, on, "left").select(on, "used", F.when(ok, F.col("limit")).alias("limit"), F.when(ok, 100 * F.col("used") / F.col("limit")).alias("percent"))


#: Points of a series that are folded in one piece.
CHUNK = 10_000


def _folded(chunks: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key, chunk, last (the value kept at its end) and the changes within of each chunk, from the value ``start`` kept before it."""

    def fold(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("bucket")
        bucket, value = points["bucket"].to_numpy(), points["value"].to_numpy(dtype=float)
        kept = points["start"].iloc[0]
        kept = value[0] if kept is None or kept != kept else float(kept)
        found = []
        for at, v in zip(bucket.tolist(), value.tolist(), strict=True):
            if abs(v - kept) > tolerance * max(abs(v), abs(kept)):
                found.append({"bucket": at, "was": kept, "is": v})
                kept = v
        return pd.DataFrame({key: [points[key].iloc[0]], "chunk": [points["chunk"].iloc[0]], "last": [kept], "changes": [found]})

    kind = dict(chunks.dtypes)
    points = f"`{key}` {kind[key]}, chunk long, last double, changes array<struct<bucket: {kind['bucket']}, was: double, `is`: double>>"
    return chunks.groupBy(key, "chunk").applyInPandas(fold, points)


def change_points(series: DataFrame, key: str = "name", tolerance: float = 1e-9) -> DataFrame:
    """Points whose value differs from the last one that changed by more than a relative tolerance, so that a slow drift is seen too.

    A series is cut into chunks of about ``CHUNK`` points by time, which are folded by themselves, in time linear in their points. A chunk
    needs the value kept before it: at first it starts from its own first value, then from what the chunk before ended with, until no
    end differs any more. As a change forgets what was before, that takes two or three rounds, however long the series. Points without
    a value or a time don't count.
    """
    rows = series.select(key, F.col("bucket"), F.col("value").cast("double").alias("value")).filter(F.col("value").isNotNull() & F.col("bucket").isNotNull())
    spans = rows.groupBy(key).agg(F.min("bucket").alias("__lo"), F.max("bucket").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    share = (F.col("bucket") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1)
    chunk = F.floor(share * F.ceil(F.col("__n") / CHUNK)).cast("long")
    chunks = durable(rows.join(spans, key).select(key, "bucket", "value", chunk.alias("chunk")), "chunks")
    ends = durable(_folded(chunks.withColumn("start", F.lit(None).cast("double")), key, tolerance), "ends")
    while True:
        before = F.lag("last").over(W.partitionBy(key).orderBy("chunk"))
        starts = ends.select(key, "chunk", before.alias("start"))
        now = durable(_folded(chunks.join(starts, [key, "chunk"]), key, tolerance), "ends")
        old = ends.select(key, "chunk", F.col("last").alias("__was"))
        moved = not now.join(old, [key, "chunk"]).filter("not last <=> __was").isEmpty()
        discard(ends)
        ends = now
        if not moved:
            return ends.select(key, F.explode("changes").alias("c")).select(key, "c.*")


def stability(series: DataFrame, expected: int, key: str = "name", tolerance: float = 1e-9) -> DataFrame:
    """Each series with its number of points and changes, its ends, and whether it changed, was observed constant, or has too few of the
    ``expected`` points to tell (under 30 %)."""
    seen = series.filter(F.col("value").isNotNull() & F.col("bucket").isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("bucket").alias("first_at"), F.max("bucket").alias("last_at"), F.max_by("value", "bucket").alias("last_value")
    )
    changes = change_points(series, key, tolerance).groupBy(key).agg(F.count(F.lit(1)).alias("changes"))
    rows = seen.join(changes, key, "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
    sparse = (F.lit(expected) > 0) & (F.col("n") * 10 < expected * 3)
    return rows.withColumn("stability", F.when(F.col("changes") > 0, "changed").when(sparse, "unknown_sparse").otherwise("observed_constant"))


def restart_increase(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Largest less smallest value by series, where it rose; the ``most`` largest."""
    up = df.groupBy(*keys).agg((F.max("value") - F.min("value")).alias("increase")).filter("increase > 0")
    return up.orderBy(F.desc("increase"), *keys).limit(most)


def pod_probes(samples: DataFrame, counters: list[str]) -> DataFrame:
    """samples(namespace, pod, container, probe, value) to one row for each pod and probe, in which its containers add up.

    Counters by how far they rose (largest less smallest), states by their largest value. A measured zero is a row and no finding; a pod
    without samples is no row.
    """
    rise = F.when(F.col("probe").isin(counters), F.max("value") - F.min("value")).otherwise(F.max("value"))
    each = samples.filter("value is not null").groupBy("namespace", "pod", "probe", "container").agg(rise.alias("v"))
    return each.groupBy("namespace", "pod", "probe").agg(F.sum("v").alias("value"), F.count(F.lit(1)).alias("containers")).withColumn("finding", F.col("value") > 0)
