"""Contiguous shards of minimal largest size.

Rows with equal text are one atomic group and always meet in one shard. Groups stand in the order of a 64-bit hash of the
text; that order is cut into at most ``atoms`` runs (the hash's leading values), each a union of whole groups, and the runs
are what the minimax partition cuts between. The driver so holds a table of proven size, while every row counts.
The largest shard exceeds the optimum over single groups by at most the largest run, about 1 / ``atoms`` of all bytes
unless one text alone is larger.

Slots number the rows of a shard without gaps. They come from counts by (stored file, shard) and a running count inside the
file, so no shard is ever sorted or collected in one task, even if copies of one text are a third of all. A file holds so
few rows that it is one Parquet row group, which one task reads from its first row to its last.

Defined cases: a null text has no bytes (size 16) and the checksum and group of the empty text; repeated rows are rows like
others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.sources import durable

ATOMS = 65_536
#: Of some 30 bytes each; Parquet's row groups have 128 MB.
ROWS_PER_FILE = 1_000_000


def shards_needed(sizes: np.ndarray, capacity: int) -> list[int]:
    """Greedy check: the first atom of each shard when none may exceed ``capacity`` (at least the largest size)."""
    ends = np.cumsum(sizes)
    starts, at, filled = [], 0, 0
    while at < len(sizes):
        starts.append(at)
        at = int(np.searchsorted(ends, filled + capacity, side="right"))
        filled = int(ends[at - 1])
    return starts


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity by binary search, and the first atom of each shard under it."""
    if not len(sizes):
        return 0, []
    low, high = int(max(sizes.max(), -(-int(sizes.sum()) // shards))), int(sizes.sum())
    while low < high:
        middle = (low + high) // 2
        if len(shards_needed(sizes, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low, shards_needed(sizes, low)


def assign_shards(docs: DataFrame, shards: int = 40, atoms: int = ATOMS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row. Two passes over a narrow stored table, no shuffle of rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = durable(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(atoms)).cast("int").alias("atom"),
        ),
        "shards",
        rows_per_file=ROWS_PER_FILE,
    )
    sizes = rows.groupBy("atom").agg(F.sum("size").alias("size")).toPandas().sort_values("atom")  # <= atoms rows
    _, starts = minimax_cuts(sizes["size"].to_numpy(dtype=np.int64), shards)
    firsts = sizes["atom"].to_numpy()[starts]

    placed = rows.withColumn("file", F.col("_metadata.file_name")).mapInArrow(
        lambda it: _place(it, firsts), "doc_id long, size long, text_crc32 long, file string, shard int, nth long"
    )
    before = W.partitionBy("shard").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    begin = (
        placed.groupBy("file", "shard").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("file", "shard", "begin")
    )
    return placed.join(begin, ["file", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("nth")).alias("slot")
    )


def _place(batches: Iterator[pa.RecordBatch], firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row's shard, and how many earlier rows of its file are in that shard."""
    seen: dict[str, np.ndarray] = {}
    for b in batches:
        shard = np.searchsorted(firsts, b.column("atom").to_numpy(), side="right") - 1
        kinds = b.column("file").dictionary_encode()
        key = kinds.indices.to_numpy().astype(np.int64) * len(firsts) + shard
        nth = pd.Series(key).groupby(key).cumcount().to_numpy().astype(np.int64)
        for i, name in enumerate(kinds.dictionary.to_pylist()):
            mine = kinds.indices.to_numpy() == i
            n = seen.setdefault(name, np.zeros(len(firsts), dtype=np.int64))
            nth[mine] += n[shard[mine]]
            n += np.bincount(shard[mine], minlength=len(firsts))
        columns = [b.column("doc_id"), b.column("size"), b.column("text_crc32"), b.column("file"), pa.array(shard, pa.int32()), pa.array(nth)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "text_crc32", "file", "shard", "nth"])


def op5_minimax_shards(docs: DataFrame) -> DataFrame:
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
