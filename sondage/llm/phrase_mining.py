"""Phrases of two to four words that stand together more often than their parts, by language.

1. Texts are split into pieces and equal pieces become one row with its multiplicity (``pieces``).
2. Blocks of pieces of one language become codes into the block's own word list (``blocks``). Words are counted over these lists;
   those seen often enough get numbers, and each block asks for its words' numbers by a shuffled join (``numbered``).
3. Each block adds up its own n-grams by multiplicity and packs them by hash bucket (``packed``); a rare word can't be in a frequent
   phrase, so n-grams end there. Each bucket is counted in duckdb, which spills what exceeds its memory (``counted``). As blocks send
   every n-gram once, a frequent one weighs no more than any other, and the number of buckets grows with the corpus.
4. Candidates ask for the counts of their parts by shuffled joins (``scored``). Parts of a frequent phrase are as frequent, so all
   counts asked for are there.

Counts are exact: words are numbered, not hashed. Scores are decimals where products pass 64 bits.

Defined cases: null and empty texts have no pieces; a null lang is ``und``; a very long text or piece is taken whole (a block holds whole
pieces); repeated rows count as often as they stand; ties at the limit are ordered by a, then by the phrase's bytes; a language without
phrases has no rows; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.functions import ranked
from sondage.sources import discard, durable, text_batches

#: What ends a piece, what separates words.
PIECE_END = r"[.,;:!?\x0A-\x0D]"
BLANKS = r"[\x20\x09]+"
LONGEST = 4
MIN_COUNT = 30
#: A phrase goes if a longer one has this share (percent) of its places.
SUBSUMED = 80
SCALE = 2_000_000
LIMIT = 2_000
#: Bytes of pieces in a block, and words of the corpus for each bucket.
BLOCK_BYTES = 8_000_000
BLOCKS_PER_FILE = 4
WORDS_PER_BUCKET = 4_000_000
#: Of duckdb's counting, in each task; beyond it goes to the task's scratch folder.
DUCKDB_MEMORY = "300MB"


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, piece (its words joined by blanks) and n (how often it stands in the corpus)."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), ascii_uppercase, ascii_lowercase)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.explode(F.split(low, PIECE_END)).alias("piece"))
    words = rows.select("lang", F.trim(F.regexp_replace("piece", BLANKS, " ")).alias("piece")).filter("piece <> ''")
    return words.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))


def blocks(rows: DataFrame) -> DataFrame:
    """One row for each block of pieces of one language: block, lang, words, counts (of the words, by multiplicity), codes (packed
    unsigned 32-bit), sizes (words of each piece, packed so too) and times (each piece's multiplicity, packed signed 64-bit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        open_: dict[str, tuple[dict[str, int], list[int], list[int], list[int]]] = {}
        kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        names = ["block", "lang", "words", "counts", "codes", "sizes", "times"]

        def block(lang: str) -> pa.RecordBatch:
            code, codes, sizes, times = open_[lang]
            own, n = np.array(codes, dtype="<u4"), np.array(times, dtype="<i8")
            weight = np.repeat(n, sizes)
            order = np.argsort(own, kind="stable")
            first = np.flatnonzero(np.diff(own[order], prepend=-1))
            row = [number, lang, list(code), np.add.reduceat(weight[order], first), own.tobytes(), np.array(sizes, dtype="<u4").tobytes(), n.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        size = 0
        for b in batches:
            for lang, piece, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                code, codes, sizes, times = open_.setdefault(lang, ({}, [], [], []))
                words = piece.split(" ")
                codes += [code.setdefault(w, len(code)) for w in words]
                sizes.append(len(words))
                times.append(n)
                size += len(piece)
                if size > BLOCK_BYTES:
                    for done in open_:
                        yield block(done)
                        number += 1
                    open_.clear()
                    size = 0
        for done in open_:
            yield block(done)
            number += 1

    kind = "block long, lang string, words array<string>, counts array<long>, codes binary, sizes binary, times binary"
    return durable(text_batches(rows).mapInArrow(cut, kind), "blocks", BLOCKS_PER_FILE)


def _unique(grams: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of ``grams`` with a hash and the sum of their weights."""
    h = np.zeros(len(grams), dtype=np.uint64)
    for c in range(grams.shape[1]):
        h = (h ^ grams[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    if not len(order):
        return grams, h, weight
    same = (grams[order[1:]] == grams[order[:-1]]).all(axis=1)
    if (~same & (h[order[1:]] == h[order[:-1]])).any():  # two n-grams of one hash: sort by the words themselves
        order = np.lexsort(grams.T)
        same = (grams[order[1:]] == grams[order[:-1]]).all(axis=1)
    first = np.concatenate([[0], np.flatnonzero(~same) + 1])
    return grams[order[first]], h[order[first]], np.add.reduceat(weight[order], first)


def _pack(columns: list[np.ndarray]) -> bytes:
    table = pa.table({f"c{i}": c for i, c in enumerate(columns)})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def packed(texts: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """size (2 to ``LONGEST``), bucket and rows: a block's n-grams of frequent words with their sums, packed."""

    def grams(block: pa.Table, own: pa.Table) -> pa.Table:
        number = np.zeros(len(block["words"][0]), dtype=np.int64)
        number[own["code"].to_numpy()] = own["id"].to_numpy()
        codes, sizes, times = (np.frombuffer(block[c][0].as_py(), dtype=k) for c, k in (("codes", "<u4"), ("sizes", "<u4"), ("times", "<i8")))
        ids, piece = number[codes], np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(ids)
        out: list[tuple[int, int, bytes]] = []
        for k in range(2, LONGEST + 1):
            at = at[at + k <= len(ids)]
            at = at[(piece[at + k - 1] == piece[at]) & (ids[at + k - 1] > 0)]
            rows, h, n = _unique(np.stack([ids[at + j] for j in range(k)], axis=1), times[piece[at]])
            to = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.diff(to[order], prepend=-1))
            for lo, hi in zip(edges, np.append(edges, len(order))[1:], strict=True):
                mine = order[lo:hi]
                out.append((k, int(to[mine[0]]), _pack([*rows[mine].T, n[mine]])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["size", "bucket", "rows"])

    return texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(grams, "size int, bucket long, rows binary")


def counted(rows: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """w (the numbers of a phrase's words) and a, of all phrases of two words and more that stand ``min_count`` times."""

    def count(bucket: pa.Table) -> pa.Table:
        import duckdb

        k = bucket["size"][0].as_py()
        words = ", ".join(f"c{i}" for i in range(k))
        near = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]  # where the executor's own scratch is
        with tempfile.TemporaryDirectory(dir=near if os.path.isdir(near) else None) as scratch:
            with duckdb.connect(config={"memory_limit": DUCKDB_MEMORY, "threads": 1, "temp_directory": scratch}) as db:
                db.execute("create table g (" + ", ".join(f"c{i} bigint" for i in range(k + 1)) + ")")
                for packed_rows in bucket["rows"]:
                    part = pa.ipc.open_stream(packed_rows.as_py()).read_all()  # noqa: F841  duckdb finds it by name
                    db.execute("insert into g select * from part")
                got = db.sql(f"select [{words}] as w, sum(c{k})::bigint as a from g group by {words} having sum(c{k}) >= {min_count}").to_arrow_table()
        return got.cast(pa.schema([("w", pa.list_(pa.int64())), ("a", pa.int64())]))

    return rows.groupBy("size", "bucket").applyInArrow(count, "w array<long>, a long")


def _within(phrase: str = "w") -> F.Column:
    """All shorter stretches of two words and more of a phrase."""
    stretch = lambda n: F.transform(F.sequence(F.lit(1), F.size(phrase) - n + 1), lambda at: F.slice(phrase, at, F.lit(n)))
    return F.flatten(F.array(*[F.when(F.size(phrase) > n, stretch(n)).otherwise(F.array()) for n in range(2, LONGEST)]))


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """w, a, l, r, score of the phrases that no longer one subsumes; ``words``: id and f."""
    longer = found.filter(F.size("w") > 2).select(F.explode(_within()).alias("w"), "a").groupBy("w").agg(F.max("a").alias("longest"))
    kept = found.join(longer, "w", "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < SUBSUMED * F.col("a"))).drop("longest")
    counts = found.unionByName(words.select(F.array("id").alias("w"), F.col("f").alias("a")))
    cuts = kept.select("w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    parts = cuts.select("w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("first"), F.slice("w", F.col("k") + 1, F.size("w")).alias("rest"))
    parts = parts.join(counts.select(F.col("w").alias("first"), F.col("a").alias("l")), "first")
    parts = parts.join(counts.select(F.col("w").alias("rest"), F.col("a").alias("r")), "rest")
    score = F.expr(f"(cast(a as decimal(20,0)) * cast({SCALE} as decimal(8,0))) div cast(l + r as decimal(20,0))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")
    return parts.groupBy("w", "a").agg(lowest).select("w", "a", "m.l", "m.r", F.col("m.score").cast("long").alias("score"))


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limit: int = LIMIT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``limit`` phrases of each language."""
    texts = durable(pieces(docs, text_col, lang_col), "pieces")
    cut = blocks(texts)
    discard(texts)
    requests = cut.select("block", "lang", F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))).alias("code", "x"))
    requests = requests.select("block", "lang", "code", "x.word", "x.n")
    words = durable(requests.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    numbered = durable(ranked(words.filter(F.col("f") >= MIN_COUNT), [F.desc("f"), F.col("lang"), F.col("word")], "id"), "numbered")
    asked = durable(requests.join(numbered, ["lang", "word"]).select("block", "code", "id"), "asked")
    n_words = words.agg(F.sum("f")).first()[0] or 0
    rows = durable(packed(cut, asked, 1 + n_words // WORDS_PER_BUCKET), "packed")
    found = durable(counted(rows), "grams")
    discard(rows)
    rated = scored(found, numbered)
    lang = rated.join(numbered.select("id", "lang"), F.element_at("w", 1) == F.col("id")).drop("id")
    by_score = [F.desc("score"), F.desc("a")]
    best = durable(lang.withColumn("at", F.rank().over(W.partitionBy("lang").orderBy(*by_score))).filter(F.col("at") <= limit).drop("at"), "best")
    spelled = best.select("w", F.posexplode("w").alias("pos", "id")).join(numbered.select("id", "word"), "id")
    spelled = spelled.groupBy("w").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.struct("pos", "word")))["word"]).alias("phrase"))
    order = W.partitionBy("lang").orderBy(*by_score, "phrase")
    named = best.join(spelled, "w").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)
    return named.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(docs: DataFrame) -> DataFrame:
    return phrases(docs.select("text", "lang"))


ORACLE = f"""
with p as (select coalesce(lang, 'und') as lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as ws from p),
o as (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, range(1, 5) t(k) where len(ws) >= k),
c as (select lang, ws[i:i + k - 1] as g, count(*) as f from o group by all having k = 1 or count(*) >= 30),
n as (select lang, sum(f)::bigint as n from c where len(g) = 1 group by lang),
longer as (select lang, g[i:i + k - 1] as g, max(f) as m from (select lang, g, f, k, unnest(range(1, len(g) - k + 2)) as i from c, range(2, 4) t(k) where len(g) > k) group by all),
kept as (select c.lang, c.g, c.f as a from c left join longer using (lang, g) where len(c.g) > 1 and (m is null or 100 * m < 80 * c.f)),
cuts as (select kept.lang, kept.g, a, k, x.f as l, y.f as r, (2000000::hugeint * a) // (x.f + y.f) as score
         from kept, range(1, 4) t(k), c x, c y where k < len(kept.g) and x.lang = kept.lang and y.lang = kept.lang and x.g = kept.g[1:k] and y.g = kept.g[k + 1:]),
best as (select lang, g, a, unnest(arg_min({{'score': score, 'l': l, 'r': r}}, score * 4 + k)) from cuts group by lang, g, a),
ranks as (select *, array_to_string(g, ' ') as phrase, row_number() over (partition by lang order by score desc, a desc, encode(array_to_string(g, ' '))) as rank from best)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranks join n using (lang) where rank <= 2000
"""
