"""Exact quantiles without a buffer of a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.sources import durable


def quantiles(rows: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """One row for each group with its quantiles, interpolated between neighbours; ``levels`` names them.

    Values are counted first, on both sides of the shuffle, and dealt by ranges of (group, value), so that a large group lies in many of
    them. A running sum within a range, on top of what the group has in the ranges before, says which value stands at a position. So no
    group is an array in memory or one sorted stream. Nulls don't count; a group of nulls has no row.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    dealt = durable(counts.repartitionByRange(*keys, "__v").withColumn("__range", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*keys, "__range").agg(F.sum("__n").alias("__sum"))
    group = W.partitionBy(*keys)
    before = F.coalesce(F.sum("__sum").over(group.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*keys, "__range", before.alias("__before"), F.sum("__sum").over(group).alias("__all"))
    own = W.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumn("__own", F.sum("__n").over(own)).join(parts, [*keys, "__range"]).withColumn("__to", F.col("__own") + F.col("__before"))

    def standing(position: Column) -> Column:
        return F.max(F.when((F.col("__to") > position) & (F.col("__to") - F.col("__n") <= position), F.col("__v")))

    found = []
    for name, level in levels.items():
        position = level * (F.col("__all") - 1)
        found += [standing(F.floor(position)).alias(f"__lo_{name}"), standing(F.ceil(position)).alias(f"__hi_{name}"), F.max(position - F.floor(position)).alias(f"__part_{name}")]
    ends = placed.groupBy(*keys).agg(*found)
    between = lambda n: F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__part_{n}")
    return ends.select(*keys, *[between(n).alias(n) for n in levels])
