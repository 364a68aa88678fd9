"""Alignment of two tokenizers' tokens, as joins over token ends.

Byte offsets where a token of A and a token of B both end cut a text into groups; all tokens of a group are linked. The alignment
itself is relational: tokens are exploded with their positions, windowed sums of their lengths give their ends, a full outer equi-join
on text and end finds the cuts, and the running count of cuts before a token is its group.

Texts are not aligned as wholes but by distinct *pieces*. A piece ends before a blank or line end that follows something visible, and
before ``. , ; : ! ?`` after a Latin letter. A's pattern always breaks there, and no token of B reaches over such a place (``Pair`` looks
through B's vocabulary when it is loaded), so a text's tokens are those of its pieces in order, and both tokenizers end where a piece
ends. Equal pieces are encoded and aligned once in the whole corpus:

1. Blocks of texts become codes into a block's own list of pieces (``blocks``).
2. Distinct pieces are encoded by both tokenizers (``encoded``) and aligned (``aligned``).
3. Each block asks for its pieces by a shuffled join. What comes back meets the block's codes, so no task holds more than one block
   and its pieces, and nothing is broadcast or collected.

The number of documents that hold a pair of ids linked is counted by block and added up. Every intermediate table is stored in the
shared folder, so a lost executor costs a part of one step.

Defined cases: null and empty texts have no tokens (zeros, empty ``groups``), and so have texts whose joined A or B bytes differ from
blank and text (U+2581 is such a character); strings of special tokens are plain text; a very long text is a block of its own, and a
very long word one long piece; repeated rows count as often as they stand; ties for an id's best partner are all best; a null doc_id
stays null; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sondage.llm.speculative_bpe import byte_alphabet
from sondage.sources import discard, durable, text_batches

#: Text bytes of a block; texts are never cut, so a longer one is a block of its own.
BLOCK_BYTES = 8_000_000
BLOCKS_PER_FILE = 4
#: Links of so many pieces are looked at together, up to the end of a document.
PIECES_AT_ONCE = 500_000
#: Answers so many are sorted by block and packed together.
ROWS_AT_ONCE = 200_000
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
CUT = re.compile(f"(?<=\\S)(?=[ \\n])|(?<=[{LATIN}])(?=[.,;:!?])")
#: A linked pair is one 32-bit number, so either vocabulary may have so many ids.
IDS = 1 << 16
KEEP_PARTITIONING = "spark.sql.requireAllClusterKeysForCoPartition"


class RunOfBlanks(Exception):
    """A blank stands after white space, so pieces can't be told word by word."""


class Pieces(dict):
    """Codes of pieces in the order of their first places; each word is cut once."""

    def __init__(self) -> None:
        super().__init__()
        self.code: dict[str, int] = {}

    def _codes(self, pieces: list[str]) -> list[int]:
        return [self.code.setdefault(p, len(self.code)) for p in pieces]

    def __missing__(self, word: str) -> list[int]:
        if not word or word[-1].isspace():
            raise RunOfBlanks
        if word.isalpha():
            pieces = [" " + word]
        elif word[-1] in ".,;:!?" and word[:-1].isalpha() and word.isascii():
            pieces = [" " + word[:-1], word[-1]]
        else:
            pieces = CUT.split(" " + word)
        self[word] = found = self._codes(pieces)
        return found

    def of(self, text: str) -> list[int]:
        try:
            return list(chain.from_iterable(map(self.__getitem__, text.split(" ")))) if text else []
        except RunOfBlanks:
            return self._codes(CUT.split(" " + text))


class Pair:
    """The two tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for t, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(to_byte[c] for c in t)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        spelled = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode("utf-8", "surrogatepass") for i, t in enumerate(spelled)
        ]
        if max(len(self.a_bytes), len(self.b_bytes)) > IDS:
            raise ValueError(f"a vocabulary has more than {IDS} ids")
        for i, t in enumerate(spelled):
            if not self.b.is_byte(i) and ("\n" in t or CUT.search(t.replace("▁", " "))):
                raise ValueError(f"pieces can't be cut for this model: token {t!r} reaches over a cut")

    def encode(self, pieces: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """A's and B's ids of each piece; nothing where the joined bytes differ from the piece."""
        first = self.a.encode_batch(pieces, add_special_tokens=False)
        # a line end is a byte of its own, so what follows it is encoded as within a text, without B's own blank
        second = self.b.encode(["\n" + p for p in pieces], num_threads=1)
        for p, x, y in zip(pieces, first, second, strict=True):
            own, ids, y = p.encode("utf-8", "surrogatepass"), x.ids, y[2:]
            same = b"".join([self.a_bytes[i] for i in ids]) == own and b"".join([self.b_bytes[i] for i in y]) == own
            yield (ids, y) if same else ([], [])


@functools.lru_cache(maxsize=2)
def _pair(a_file: str, b_file: str) -> Pair:
    import public_tokenizers

    return Pair(public_tokenizers.path(a_file), public_tokenizers.path(b_file))


def blocks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each block of texts: block, doc_ids and n (pieces of each text), pieces, codes (unsigned 32-bit, packed by zstd)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, n, codes, pieces, size = [], [], [], Pieces(), 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate([np.empty(0, dtype="<u4"), *codes]).tobytes()
            flat = pa.compress(flat, "zstd", asbytes=True)
            row = [[number], [ids], [n], [list(pieces.code)], [flat]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["block", "doc_ids", "n", "pieces", "codes"])

        for b in batches:
            bytes_of = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for doc, text, more in zip(b.column(0).to_pylist(), b.column(1), bytes_of, strict=True):
                if ids and size + more > BLOCK_BYTES:
                    yield block()
                    number, ids, n, codes, pieces, size = number + 1, [], [], [], Pieces(), 0
                found = pieces.of(text.as_py() or "")
                codes.append(np.array(found, dtype="<u4"))
                ids.append(doc)
                n.append(len(found))
                size += more
        if ids:
            yield block()

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_col)
    kind = "block long, doc_ids array<long>, n array<int>, pieces array<string>, codes binary"
    return durable(rows.mapInArrow(cut, kind), "blocks", BLOCKS_PER_FILE, "zstd")


def encoded(pieces: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """pid, piece with the ids and byte lengths of its tokens (a_ids, a_lens, b_ids, b_lens); no ids where the bytes differ."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_file, b_file)
        sizes = [np.array([len(x) for x in t], dtype=np.int32) for t in (pair.a_bytes, pair.b_bytes)]
        for b in batches:
            both = list(pair.encode(b.column("piece").to_pylist()))
            out = [b.column("pid"), b.column("piece")]
            for side, size in enumerate(sizes):
                at = pa.array(np.concatenate([[0], np.cumsum([len(x[side]) for x in both])]).astype(np.int32))
                flat = np.array(list(chain.from_iterable(x[side] for x in both)), dtype=np.int32)
                out += [pa.ListArray.from_arrays(at, pa.array(flat)), pa.ListArray.from_arrays(at, pa.array(size[flat]))]
            yield pa.RecordBatch.from_arrays(out, names=["pid", "piece", "a_ids", "a_lens", "b_ids", "b_lens"])

    ids = "array<int>"
    return text_batches(pieces).mapInArrow(encode, f"pid long, piece string, a_ids {ids}, a_lens {ids}, b_ids {ids}, b_lens {ids}")


def token_ends(pieces: DataFrame, side: str) -> DataFrame:
    """pid, end (bytes up to the token's last one) and id of every token of tokenizer ``side``."""
    token = F.arrays_zip(F.col(f"{side}_ids").alias("id"), F.col(f"{side}_lens").alias("len"))
    rows = pieces.select("pid", F.posexplode(token).alias("pos", "t"))
    upto = F.sum("t.len").over(W.partitionBy("pid").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("pid", upto.alias("end"), F.col("t.id").alias(side))


def groups(pieces: DataFrame) -> DataFrame:
    """pid, g (from 0), a and b: the ids of the tokens of each group, in order."""
    ends = token_ends(pieces, "a").join(token_ends(pieces, "b"), ["pid", "end"], "full_outer")
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)
    before = W.partitionBy("pid").orderBy("end").rowsBetween(W.unboundedPreceding, -1)
    placed = ends.withColumn("g", F.coalesce(F.sum(cut).over(before), F.lit(0)))
    listed = lambda side: F.array_sort(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", side))))
    ids = lambda side: F.transform(F.col(f"{side}s"), lambda t: t[side]).alias(side)
    return placed.groupBy("pid", "g").agg(listed("a").alias("as"), listed("b").alias("bs")).select("pid", "g", ids("a"), ids("b"))


def aligned(pieces: DataFrame) -> DataFrame:
    """pid, n_a, n_b, n_groups, groups (their ids as text) and links (a * 2^16 + b for every linked pair of occurrences, as 32 bits) of each piece."""
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.shiftleft(x, 16).bitwiseOR(y))))
    text = F.concat_ws("|", F.concat_ws(",", F.col("a").cast("array<string>")), F.concat_ws(",", F.col("b").cast("array<string>")))
    rows = groups(pieces.repartition("pid")).select("pid", "g", F.size("a").alias("n_a"), F.size("b").alias("n_b"), pairs.alias("p"), text.alias("t"))
    whole = rows.groupBy("pid").agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count(F.lit(1)).alias("n_groups"),
        F.array_sort(F.collect_list(F.struct("g", "t"))).alias("ts"), F.flatten(F.collect_list("p")).alias("links"),
    )
    return whole.select("pid", "n_a", "n_b", "n_groups", F.concat_ws(";", F.col("ts.t")).alias("groups"), "links")


def _each_document(block: pa.Table, known: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, codes, the text number of each code, and which texts have tokens; ``known`` says which pieces have."""
    n = np.array(block["n"][0].as_py(), dtype=np.int64)
    codes = np.frombuffer(pa.decompress(block["codes"][0].as_py(), 4 * int(n.sum()), "zstd"), dtype="<u4")
    text = np.repeat(np.arange(len(n)), n)
    lost = np.bincount(text[~known[codes]], minlength=len(n)) > 0
    return block["doc_ids"].combine_chunks().flatten(), codes, text, (n > 0) & ~lost


def _spread(table: pa.Table, name: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: where each code's values begin, how many they are, and all values."""
    lists = table[name].combine_chunks()
    code = table["code"].to_numpy()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    start, n = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    start[code], n[code] = np.cumsum(length) - length, length
    return start, n, lists.flatten().to_numpy(zero_copy_only=False)


def _count_pairs(block: pa.Table, asked: pa.Table) -> pa.Table:
    """pair and the number of the block's documents that hold it linked."""
    size = block["n_pieces"][0].as_py()
    start, n, links = _spread(asked, "links", size)
    _, codes, text, valid = _each_document(block, n > 0)
    kinds, local = np.unique(links, return_inverse=True)
    total = np.zeros(len(kinds), dtype=np.int64)
    stay = valid[text]
    held = np.unique(text[stay] * size + codes[stay])  # each document's pieces once
    first = np.flatnonzero(np.diff(held // size, prepend=-1))  # where a document begins
    edges = first[np.unique(np.searchsorted(first, np.arange(0, len(held), PIECES_AT_ONCE)).clip(max=len(first) - 1))] if len(first) else first
    for at, to in zip(edges, np.append(edges, len(held))[1:], strict=True):
        doc, code = held[at:to] // size, held[at:to] % size
        often = n[code]
        place = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often) + np.repeat(start[code], often)
        total += np.bincount(np.unique(np.repeat(doc, often) * len(kinds) + local[place]) % len(kinds), minlength=len(kinds))
    some = total > 0
    return pa.table({"pair": pa.array(kinds[some].astype(np.int32)), "n": pa.array(total[some])})


FACTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _sum_documents(block: pa.Table, asked: pa.Table) -> pa.Table:
    """Each document of a block: the sums over its pieces, and its groups as text."""
    size = block["n_pieces"][0].as_py()
    code = asked["code"].to_numpy()
    known = np.zeros(size, dtype=bool)
    known[code] = asked["n_a"].to_numpy() > 0
    ids, codes, text, valid = _each_document(block, known)
    n = np.bincount(text, minlength=len(ids))
    to = np.cumsum(n)
    out = {"doc_id": ids}
    for name in FACTS:
        own = np.zeros(size, dtype=np.int64)
        own[code] = asked[name].to_numpy()
        upto = np.concatenate([[0], np.cumsum(own[codes])])
        out[name] = pa.array(np.where(valid, upto[to] - upto[to - n], 0))
    spelled = [""] * size
    for c, t in zip(code.tolist(), asked["groups"].to_pylist(), strict=True):
        spelled[c] = t
    out["groups"] = pa.array([";".join([spelled[c] for c in codes[e - k : e].tolist()]) if v else "" for e, k, v in zip(to, n, valid, strict=True)], pa.string())
    return pa.table(out)


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column block) as few, compressed ones: block, own (rows of that block) and bytes (their size before)."""
    names = [c for c in rows.columns if c != "block"]

    def part(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("block").combine_chunks()
        at = np.flatnonzero(np.diff(table["block"].to_numpy(), prepend=-1))
        blocks_, own, size = table["block"].to_numpy()[at], [], []
        for lo, hi in zip(at, np.append(at, len(table))[1:], strict=True):
            whole = pa.concat_batches(table.select(names).slice(lo, hi - lo).to_batches()).serialize()
            own.append(pa.compress(whole, "zstd", asbytes=True))
            size.append(whole.size)
        return pa.RecordBatch.from_arrays([pa.array(blocks_), pa.array(own, pa.binary()), pa.array(size, pa.int64())], names=["block", "own", "bytes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS_AT_ONCE:
                yield part(held)
                held, n = [], 0
        if n:
            yield part(held)

    return rows.mapInArrow(pack, "block long, own binary, bytes long")


def _met(texts: DataFrame, asked: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], kind: str) -> DataFrame:
    """``work`` on each block and what its pieces got."""
    schema = to_arrow_schema(asked.drop("block").schema)

    def unpacked(block: pa.Table, own: pa.Table) -> pa.Table:
        parts = [pa.decompress(b.as_py(), n.as_py(), "zstd") for b, n in zip(own["own"], own["bytes"], strict=True)]
        return work(block, pa.Table.from_batches([pa.ipc.read_record_batch(p, schema) for p in parts], schema))

    texts = texts.select("block", "doc_ids", "n", "codes", F.size("pieces").alias("n_pieces"))
    return texts.groupBy("block").cogroup(_packed(asked).groupBy("block")).applyInArrow(unpacked, kind)


def align(docs: DataFrame, a_file: str = "byte_bpe_50k.json", b_file: str = "piece_bpe_32k.model", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), and the corpus's linked ids
    (a, b, n_docs, best: no partner of this a has more)."""
    texts = blocks(docs, text_col)
    requests = texts.select("block", F.posexplode("pieces").alias("code", "piece"))
    kinds = requests.select("piece").distinct().withColumn("pid", F.monotonically_increasing_id())
    pieces = durable(encoded(kinds, a_file, b_file), "pieces", codec="zstd")
    asked = durable(requests.join(pieces.select("piece", "pid"), "piece").select("block", "code", "pid"), "asked", codec="zstd")
    conf = docs.sparkSession.conf
    was = conf.get(KEEP_PARTITIONING)
    conf.set(KEEP_PARTITIONING, "false")  # pieces are dealt by pid, which is enough for joins on pid and end
    try:
        whole = durable(aligned(pieces), "aligned", codec="zstd")
    finally:
        conf.set(KEEP_PARTITIONING, was)
    discard(pieces)
    held = _met(texts, asked.join(whole.select("pid", "links"), "pid").select("block", "code", "links"), _count_pairs, "pair int, n long")
    counts = durable(held.groupBy("pair").agg(F.sum("n").alias("n_docs")), "pairs").withColumn("a", F.shiftrightunsigned("pair", 16))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    ids = durable(counts.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")), "ids")
    links = whole.select("pid", F.explode("links").alias("pair")).join(ids, "pair")
    scored = links.groupBy("pid").agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if("best").alias("n_best"), F.sum("n_docs").alias("count_sum")
    )
    facts = durable(whole.drop("links").join(scored, "pid"), "facts", codec="zstd")
    discard(whole)
    got = _met(texts, asked.join(facts, "pid").drop("pid"), _sum_documents, "doc_id long, " + ", ".join(f"{f} long" for f in FACTS) + ", groups string")
    return got, ids.select(F.shiftrightunsigned("pair", 16).alias("a"), F.col("pair").bitwiseAND(IDS - 1).alias("b"), "n_docs", "best")


def op11_token_alignment(docs: DataFrame) -> DataFrame:
    got, _ = align(docs.select("doc_id", "text"))
    return got.select("doc_id", *FACTS, F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups"), 256)).alias("groups_sha256"))
