"""Positions in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.sources import durable


def ranked(rows: DataFrame, order: list[Column], into: str = "rank") -> DataFrame:
    """``rows`` with their position (from 1) in a total order.

    The rows are dealt by ranges of the order and stored, so that both passes see the same ranges; each range is numbered by itself
    and starts behind those before it. The driver holds one count for each range.
    """
    dealt = durable(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = sorted((r["__range"], r["count"]) for r in dealt.groupBy("__range").count().collect())
    start, before = {}, 0
    for part, n in counts:
        start[part], before = before, before + n
    offsets = F.create_map(*[F.lit(x) for pair in start.items() for x in pair]) if start else F.lit(None).cast("map<int,int>")
    behind = F.coalesce(F.element_at(offsets, F.col("__range")), F.lit(0))
    own = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return dealt.withColumn(into, (own + behind).cast("long")).drop("__range")
