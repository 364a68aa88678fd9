"""Stupid-backoff language model scores over trigrams, bigrams and words, from packed blocks.

Words are hashed to 64 bits. ``trigrams`` stores them in blocks of whole texts: a block's different words once, and small codes for their
places. ``fit`` counts the (before, context, word) trigrams of all blocks, and nothing is cut from the counts (``min_count`` is 1 unless
a caller asks for more). A trigram in the table scores count(before, context, word) / count(before, context), any other one backs off to
``ALPHA`` * count(context, word) / count(context), and from there to ``ALPHA`` squared * count(word) / count(all).

Each block sends its different trigrams with their counts, packed, to the bucket of their (before, context); a bucket adds them up and
sends log scores on to the buckets of the trigrams. ``score`` sends a text's different trigrams to the same buckets, where each is looked
up, and adds the logarithms up for each document. Buckets hold some ``BUCKET_WORDS`` places of words, so their number follows the input,
and a frequent trigram comes once from each block (``fit``) or text (``score``). Tables of bigrams and words are plain rows and joins.

``fit`` and ``score`` take any two corpora. ``score_own`` scores a corpus by its own counts, through both: every trigram is looked
up, and one that isn't in the table would back off; as all of them are, none does, and the tables below are not made. The trigrams are
taken in ``SLICES`` parts by the hash of their context, one after the other: all counts of trigrams and bigrams of a context lie in one
part, those of words are of the whole corpus. Only the documents' sums stay, so the disk holds one part at a time. Nothing is collected
but numbers of words.

Defined cases: null and empty texts have no words, log_score 0 and a null mean; a very long text is one text of a block like others; rows with
the same doc_id (or none) are scored as one document; repeated rows count as often as they stand in the corpus; ties have no part
in a score; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.probminhash import GOLDEN, mix
from sondage.sources import durable, text_batches

ALPHA = 0.4
SLICES = 6
#: A block ends with the text that brings it to so many words (or texts, whose numbers in it have 16 bits).
BLOCK_WORDS, BLOCK_TEXTS = 500_000, 50_000
BLOCKS_PER_FILE = 8
BUCKET_WORDS = 250_000
#: What separates words.
BLANKS = r"[\x20\x09-\x0D]+"
#: Stands twice before the first word of a text.
START = 0
U = np.uint64


def _hashes(text_col: str) -> Column:
    """The words' hashes in order."""
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), BLANKS)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Blocks of whole texts, stored: block, ids (doc_id of each text), n (words), sizes (words of each text, packed unsigned 32-bit), words
    (their hashes, packed 64-bit), codes (the place in ``words`` of each word, packed unsigned 32-bit); and which part of the contexts
    is meant (``part`` of ``parts``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        sizes: list[np.ndarray] = []
        hashes: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            size, flat = np.concatenate(sizes), np.concatenate(hashes)
            words, codes = np.unique(flat, return_inverse=True)
            packed = [size.astype("<u4").tobytes(), words.tobytes(), codes.astype("<u4").tobytes()]
            own = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([len(flat)], pa.int64())]
            return pa.RecordBatch.from_arrays([*own, *(pa.array([p], pa.binary()) for p in packed)], names=["block", "ids", "n", "sizes", "words", "codes"])

        for b in batches:
            texts, doc_ids = b.column("h"), b.column("doc_id").to_pylist()
            edges = texts.offsets.to_numpy().astype(np.int64)
            flat, at = texts.values.to_numpy(), 0
            held = sum(map(len, hashes))
            while at < len(doc_ids):  # up to the text that fills the block
                to = min(int(np.searchsorted(edges, edges[at] + BLOCK_WORDS - held)), len(doc_ids), at + BLOCK_TEXTS - len(ids))
                to = max(to, at + 1)
                ids += doc_ids[at:to]
                sizes.append(np.diff(edges[at : to + 1]))
                hashes.append(flat[edges[at] : edges[to]])
                held += int(edges[to] - edges[at])
                at = to
                if held >= BLOCK_WORDS or len(ids) >= BLOCK_TEXTS:
                    yield block()
                    number, held = number + 1, 0
                    ids, sizes, hashes = [], [], []
            hashes = [h.copy() for h in hashes]  # not views of the batch
        if ids:
            yield block()

    rows = text_batches(docs).select("doc_id", _hashes(text_col).alias("h"))
    kind = "block long, ids array<long>, n long, sizes binary, words binary, codes binary"
    return _slice(durable(rows.mapInArrow(cut, kind), "blocks", BLOCKS_PER_FILE, "zstd"), 0, 1)


def _slice(grams: DataFrame, part: int, parts: int) -> DataFrame:
    return grams.withColumns({"part": F.lit(part), "parts": F.lit(parts)})


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a * GOLDEN + U(1)) * GOLDEN + b)


def _places(block: dict) -> dict[str, np.ndarray]:
    """Of every word of a block whose context is in the part: its text's number, context, word, and the hashes of (before, context) and of
    the whole trigram."""
    size = np.frombuffer(block["sizes"], "<u4").astype(np.int64)
    word = np.frombuffer(block["words"], "<u8")[np.frombuffer(block["codes"], "<u4")]
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    behind = lambda k: np.where(place < k, U(START), np.concatenate([np.zeros(k, U), word])[: len(word)])
    context, before = behind(1), behind(2)
    if block["parts"] > 1:
        mine = mix(context + GOLDEN) % U(block["parts"]) == U(block["part"])
        doc, before, context, word = doc[mine], before[mine], context[mine], word[mine]
    pair = _key(before, context)
    return {"doc": doc, "context": context, "word": word, "pair": pair, "tri": _key(pair, word)}


def _changes(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before, the first row included."""
    n = len(sorted_columns[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def _range(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash; larger hashes have no smaller bucket."""
    return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _blobs(bucket: np.ndarray, columns: dict[str, np.ndarray], **same: int) -> pa.RecordBatch:
    """One row for each bucket (ascending) with its stretch of each column, packed."""
    first = _changes(bucket)
    edges = np.append(first, len(bucket)).astype(np.int32)
    out = {"bucket": pa.array(bucket[first], pa.int64())} | {k: pa.array(np.full(len(first), v), pa.int64()) for k, v in same.items()}
    for name, c in columns.items():
        c = np.ascontiguousarray(c)
        out[name] = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edges * np.int32(c.itemsize)), pa.py_buffer(c)])
    return pa.RecordBatch.from_pydict(out)


def _flat(table: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A packed column's numbers, and how many each row has."""
    rows = [np.frombuffer(b, kind) for b in table[name].to_pylist()]
    return np.concatenate([np.zeros(0, kind), *rows]), np.array([len(r) for r in rows], dtype=np.int64)


def _from_blocks(grams: DataFrame, make: Callable[[dict], pa.RecordBatch], kind: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield make({c: b.column(c)[i].as_py() for c in b.schema.names})

    return grams.select("block", "sizes", "words", "codes", "part", "parts").mapInArrow(each, kind)


def _words(grams: DataFrame) -> int:
    return grams.agg(F.sum(F.col("n") / F.col("parts"))).first()[0] or 0


def _trigram_table(grams: DataFrame, min_count: int) -> DataFrame:
    buckets = max(1, math.ceil(_words(grams) / BUCKET_WORDS))

    def send(block: dict) -> pa.RecordBatch:
        p = _places(block)
        order = np.argsort(p["tri"], kind="stable")
        tri = p["tri"][order]
        first = _changes(tri)
        pair, n = p["pair"][order][first], np.diff(np.append(first, len(tri))).astype("<u4")
        bucket = _range(pair, buckets)
        order = np.argsort(bucket, kind="stable")
        return _blobs(bucket[order], {"pair": pair[order], "tri": tri[first][order], "n": n[order]})

    def count(table: pa.Table) -> pa.Table:
        (pair, _), (tri, _), (n, _) = (_flat(table, c, k) for c, k in (("pair", "<u8"), ("tri", "<u8"), ("n", "<u4")))
        order = np.argsort(tri, kind="stable")
        first = _changes(tri[order])
        pair, tri, n = pair[order][first], tri[order][first], np.add.reduceat(n[order].astype(np.int64), first)
        _, back = np.unique(pair, return_inverse=True)
        log = np.log(n / np.bincount(back, n)[back])
        often = n >= min_count
        return pa.Table.from_batches([_blobs(_range(tri[often], buckets), {"tri": tri[often], "log": log[often]})])

    sent = _from_blocks(grams, send, "bucket long, pair binary, tri binary, n binary")
    high = sent.groupBy("bucket").applyInArrow(count, "bucket long, tri binary, log binary")
    return high.withMetadata("bucket", {"buckets": buckets})


def _bigrams(grams: DataFrame) -> DataFrame:
    """context, word (hashes), n: a block's counts."""

    def counted(block: dict) -> pa.RecordBatch:
        p = _places(block)
        order = np.lexsort((p["word"], p["context"]))
        context, word = p["context"][order], p["word"][order]
        first = _changes(context, word)
        n = np.diff(np.append(first, len(word)))
        return pa.RecordBatch.from_pydict({"context": context[first].view(np.int64), "word": word[first].view(np.int64), "n": n})

    return _from_blocks(grams, counted, "context long, word long, n long")


def fit(grams: DataFrame, min_count: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of log scores: of trigrams, packed by bucket (bucket, tri, log), and (context, word, mid) of bigrams, both seen ``min_count``
    times; and (word, low) of all words."""
    count = lambda rows, *by: rows.groupBy(*by).agg(F.sum("n").alias("n"))
    two = count(_bigrams(grams), "context", "word")
    total = F.broadcast(two.agg(F.sum("n").alias("total")))  # one row
    all_of = count(two, "context").withColumnRenamed("n", "n_context")
    mid = two.filter(F.col("n") >= min_count).join(all_of, "context")
    mid = mid.select("context", "word", (F.log(F.col("n") / F.col("n_context")) + math.log(ALPHA)).alias("mid"))
    low = count(two, "word").crossJoin(total).select("word", (F.log(F.col("n") / F.col("total")) + 2 * math.log(ALPHA)).alias("low"))
    return _trigram_table(grams, min_count), mid, low


def _looked_up(grams: DataFrame, high: DataFrame, found: bool) -> DataFrame:
    """For each block and bucket, packed: of each text the sum of its trigrams' scores ``s``, how many have one (``n``) and how many there
    are (``words``); or, not ``found``, rows of block, doc (the text's number in it), context, word, n of those that have none."""
    buckets = high.schema["bucket"].metadata["buckets"]
    salts = max(1, math.ceil(_words(grams) / BUCKET_WORDS / buckets / 2))  # of a corpus much larger than that of the table
    more = () if found else ("context", "word")

    def send(block: dict) -> pa.RecordBatch:
        p = _places(block)
        order = np.argsort(p["tri"], kind="stable")  # texts stay in order
        tri, doc = p["tri"][order], p["doc"][order]
        first = _changes(tri, doc)
        n = np.diff(np.append(first, len(tri))).astype("<u4")
        own = {"tri": tri[first], "doc": doc[first].astype("<u2"), "n": n} | {c: p[c][order][first] for c in more}
        return _blobs(_range(tri[first], buckets), own, block=block["block"])

    def look(asked: pa.Table, table: pa.Table) -> pa.Table:
        (key, _), (log, _) = _flat(table, "tri", "<u8"), _flat(table, "log", "<f8")
        order = np.argsort(key, kind="stable")
        key, log = key[order], log[order]
        (tri, size), (doc, _), (n, _) = (_flat(asked, c, k) for c, k in (("tri", "<u8"), ("doc", "<u2"), ("n", "<u4")))
        at = np.minimum(np.searchsorted(key, tri), max(len(key) - 1, 0))
        has = key[at] == tri if len(key) else np.zeros(len(tri), dtype=bool)
        row = np.repeat(np.arange(len(size)), size)
        block = asked["block"].to_numpy()
        if not found:
            (context, _), (word, _) = (_flat(asked, c, "<i8") for c in more)
            columns = {"block": block[row], "doc": doc.astype(np.int32), "context": context, "word": word, "n": n.astype(np.int64)}
            return pa.table({k: c[~has] for k, c in columns.items()})
        text, back = np.unique(row << 16 | doc, return_inverse=True)
        s = np.bincount(back[has], log[at[has]] * n[has], len(text)) if has.any() else np.zeros(len(text))
        of, words = np.bincount(back, n * has, len(text)), np.bincount(back, n, len(text))
        sums = _blobs(text >> 16, {"doc": (text & 0xFFFF).astype("<u2"), "s": s, "n": of.astype("<u4"), "words": words.astype("<u4")})
        return pa.Table.from_batches([sums]).set_column(0, "block", pa.array(block[sums.column("bucket").to_numpy()], pa.int64()))

    asked = _from_blocks(grams, send, "bucket long, block long, tri binary, doc binary, n binary" + "".join(f", {c} binary" for c in more))
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    asked = asked.withColumn("salt", salt)
    table = high.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    kind = "block long, doc binary, s binary, n binary, words binary" if found else "block long, doc int, context long, word long, n long"
    return asked.groupBy("bucket", "salt").cogroup(table.groupBy("bucket", "salt")).applyInArrow(look, kind)


def _by_text(sums: DataFrame, grams: DataFrame) -> DataFrame:
    """doc_id, s, n, words of every text, from packed sums."""

    def add(sums: pa.Table, block: pa.Table) -> pa.Table:
        ids = block["ids"].combine_chunks().flatten()
        doc = _flat(sums, "doc", "<u2")[0]
        own = {c: np.bincount(doc, _flat(sums, c, k)[0], len(ids)) for c, k in (("s", "<f8"), ("n", "<u4"), ("words", "<u4"))}
        return pa.table({"doc_id": ids, "s": own["s"].astype(float), "n": own["n"].astype(np.int64), "words": own["words"].astype(np.int64)})

    return sums.groupBy("block").cogroup(grams.select("block", "ids").groupBy("block")).applyInArrow(add, "doc_id long, s double, n long, words long")


def score(grams: DataFrame, high: DataFrame, mid: DataFrame, low: DataFrame, unseen: float = -20.0) -> DataFrame:
    """doc_id, n_words, n_backoff (words without a trigram), log_score. ``unseen`` is the score of a word that the tables don't have.

    The sums of the trigrams are stored. Only if some word lacks one, the tables of bigrams and words are read at all.
    """
    first = durable(_by_text(_looked_up(grams, high, True), grams), "sums")
    parts = first.select("doc_id", "s", "n", F.lit(0).cast("long").alias("b"))
    if not first.filter("n < words").isEmpty():
        texts = grams.select("block", F.posexplode("ids").alias("doc", "doc_id"))
        second = _looked_up(grams, high, False).join(mid, ["context", "word"], "left").join(low, "word", "left")
        backed = second.select("block", "doc", "n", (F.coalesce("mid", "low", F.lit(unseen)) * F.col("n")).alias("s"))
        backed = backed.groupBy("block", "doc").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        parts = parts.unionByName(backed.join(texts, ["block", "doc"]).select("doc_id", "s", "n", F.col("n").alias("b")))
    return parts.groupBy("doc_id").agg(
        F.sum("n").cast("long").alias("n_words"), F.sum("b").cast("long").alias("n_backoff"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("log_score")
    )


def score_own(docs: DataFrame, text_col: str = "text", parts: int = SLICES) -> DataFrame:
    """doc_id, n_words, n_backoff, log_score of every document by the counts of all of them."""
    grams = trigrams(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col), text_col)
    low = fit(grams)[2]
    sums = []
    for part in range(parts):
        mine = _slice(grams, part, parts)
        high, mid, _ = fit(mine)
        sums.append(score(mine, high, mid, low))
    return reduce(DataFrame.unionByName, sums).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_backoff", "log_score")])


def op7_backoff_lm(docs: DataFrame) -> DataFrame:
    mean = F.col("log_score") / F.nullif(F.col("n_words"), F.lit(0))
    return score_own(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_backoff", F.round(mean, 5).alias("mean_log_score"))


ORACLE = """
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
g as (select doc_id, unnest(list_concat(['', ''], ws)[:-3]) as a, unnest(list_concat([''], ws)[:-2]) as b, unnest(ws) as w from d where len(ws) > 0),
t as (select a, b, w, count(*) as n from g group by all),
c as (select a, b, count(*) as n from g group by all),
s as (select doc_id, ln(t.n / c.n) as s from g join t using (a, b, w) join c using (a, b)),
x as (select doc_id, count(*) as nw, sum(s) as s from s group by doc_id)
select i.doc_id, coalesce(nw, 0)::bigint as n_words, 0::bigint as n_backoff, round(s / nw, 5) as mean_log_score
from (select distinct doc_id from documents) i left join x on i.doc_id is not distinct from x.doc_id
"""
