"""Exact Jaccard join of word 4-grams by a token-group matrix, and the components of its links.

Two texts link when 100 * |intersection| >= ``PERCENT`` * |union| of their shingle sets (64-bit hashes).

1. Equal sets become one (``sets``). Similar ones are dealt next to each other by their least shingle hashes and cut into groups of
   at most ``MEMBERS``; a group's token union is its column of the matrix (``Group.union``). Links within a group are found at once.
   (Of a set's ``LEAST`` hashes the one that most sets have names its group, so few copies of a family stand aside.)
2. Which groups can hold a partner is told by exact signatures (``signatures``): a set's tokens fall into k parts by hash, where k
   exceeds the largest symmetric difference that linked sets of this size can have. So linked sets have a part in common, token for
   token, and their groups a signature. A passage that many texts share doesn't make them meet, as it never fills a whole part alone.
   As k exceeds that difference by some, linked sets have several parts in common (``need``), and groups with fewer don't meet.
3. For two groups that met, each text's overlap with the other group's union bounds its overlap with every member; only texts whose
   bound reaches the threshold are opened, and those are compared exactly (``linked``).
4. First every group is compared with the least group of each signature. Components are formed; a pair of groups that meets only
   beside that one is compared unless all its texts lie in one component already. Nothing is capped: each pair of groups that shares a
   signature is compared or known to add nothing.

Signatures come from groups, not from texts, so a family of n near copies counts as n / ``MEMBERS``. A group is bounded in texts and
bytes, so no task holds more than two of them at a time; nothing is broadcast or collected except by Spark itself behind its threshold.

Sizes: class c holds sizes from ``bounds()[c]`` on, and linked sets lie in one class or in neighbouring ones. A set signs at its own level
and at the next, so both sign at the level of the larger one, where the difference is at most 6 / 37 of the class's largest size. A part
without tokens is signed only by sets with so few parts in use that all of these may differ; regular ones never need it.

Defined cases: null and empty texts have no shingles and link with nothing (component_id is their own doc_id); texts under four words are
one shingle; a very long text is a group of its own; repeated rows have one set; different texts under one doc_id are judged each by
itself; rows without doc_id link with nothing (component_id null); other columns, whatever their names, are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.llm.probminhash import GOLDEN, U, components, mix
from sondage.sources import discard, durable, text_batches

SHINGLE = 4
PERCENT = 85
MEMBERS = 512
GROUP_BYTES = 1_000_000
BYTES_AT_ONCE = 1_000_000
#: Least hashes by which similar sets become neighbours.
LEAST = 3


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct shingle of every text, sorted by both."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))  # A-Z and ASCII white space only
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    doc, flat = np.repeat(np.arange(len(texts)), n), words.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at either end of a text makes an empty word
    if not full.any():
        return doc[:0], np.zeros(0, dtype=np.uint64)
    code = flat.dictionary_encode()
    h = pd.util.hash_array(code.dictionary.to_numpy(zero_copy_only=False), categorize=False)[code.indices.to_numpy()][full]
    doc = doc[full]
    n = np.bincount(doc, minlength=len(texts))
    whole = np.minimum(n, size)[doc]
    left = n[doc] - (np.arange(len(h)) - (np.cumsum(n) - n)[doc])  # words from here to the end of the text
    key = np.zeros(len(h), dtype=np.uint64)
    for k in range(size):
        ahead = np.concatenate([h[k:], np.zeros(min(k, len(h)), dtype=np.uint64)])
        key = np.where(k < whole, mix(key * GOLDEN + ahead + U(k + 1)), key)
    doc, key = doc[left >= whole], key[left >= whole]
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    return doc[first], key[first]


def _seed(s: int) -> np.ndarray:
    return mix(np.full(1, s, dtype=np.uint64) * GOLDEN)


def _summed(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.uint64)
    np.add.at(out, at, values)
    return out


def _portions(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Whole texts, so many at a time that their words fit in memory."""
    size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - size) // BYTES_AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for at, to in zip(edges, edges[1:], strict=False):
        if to > at:
            yield b.slice(at, to - at)


def sets(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """doc_id, n, k1, k2 of every row (the keys name its shingle set); and sid, k1, k2, least (doc_id), m (least hashes), text of every
    distinct set of rows with a doc_id. Both are stored."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _portions(whole, "text"):
                size = b.num_rows
                doc, key = shingles(b.column("text").to_pylist())
                n = np.bincount(doc, minlength=size)
                k1, k2 = (_summed(mix(key ^ _seed(s)), doc, size).view(np.int64) for s in (1, 2))
                least = np.zeros((size, LEAST), dtype=np.int64)
                some = np.flatnonzero(n)
                for s in range(LEAST):
                    if len(some):
                        least[some, s] = np.minimum.reduceat(mix(key ^ _seed(s + 3)), (np.cumsum(n) - n)[some]).view(np.int64)
                m = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * LEAST), pa.array(least.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(k1), pa.array(k2), m, b.column("text")], names=["doc_id", "n", "k1", "k2", "m", "text"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    drawn = durable(rows.mapInArrow(draw, "doc_id long, n long, k1 long, k2 long, m array<long>, text string"), "drawn", codec="zstd")
    own = durable(drawn.select("doc_id", "n", "k1", "k2"), "rows")
    kinds = drawn.filter("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.first("m").alias("m"), F.first("text").alias("text"))
    kinds = durable(kinds.withColumn("sid", F.monotonically_increasing_id()), "sets", codec="zstd")
    discard(drawn)
    return own, kinds


class Group:
    """Shingle sets of a few texts: all tokens in order with their owners, and the union of the sets."""

    def __init__(self, texts: list[str]):
        self.doc, self.key = shingles(texts)
        self.size = np.bincount(self.doc, minlength=len(texts))
        order = np.argsort(self.key, kind="stable")
        self.sorted, self.owner = self.key[order], self.doc[order]
        self.union = self.sorted[np.concatenate([[True], self.sorted[1:] != self.sorted[:-1]])] if len(order) else self.sorted

    def bound(self, other: Group) -> np.ndarray:
        """Of each text: how many of its tokens the other group's union has."""
        at = np.searchsorted(other.union, self.key)
        at[at == len(other.union)] = 0
        return np.bincount(self.doc[other.union[at] == self.key], minlength=len(self.size))


def linked(x: Group, y: Group) -> list[tuple[int, int]]:
    """Links between the texts of two groups, without those that follow from others."""
    open_x, open_y = (100 * a.bound(b) >= PERCENT * a.size for a, b in ((x, y), (y, x)))
    root = list(range(len(x.size) + len(y.size)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    found = []
    edges = np.searchsorted(x.doc, np.arange(len(x.size) + 1))
    for i in np.flatnonzero(open_x).tolist() if open_y.any() else ():
        own = x.key[edges[i] : edges[i + 1]]
        lo, hi = np.searchsorted(y.sorted, own, "left"), np.searchsorted(y.sorted, own, "right")
        n = hi - lo
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        both = np.bincount(y.owner[place], minlength=len(y.size))
        for j in np.flatnonzero(open_y & (100 * both >= PERCENT * (len(own) + y.size - both)) & (both > 0)).tolist():
            a, b = find(i), find(len(x.size) + j)
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((i, j))
    return found


def grouped(kinds: DataFrame) -> DataFrame:
    """g, sids, texts of groups of similar sets; a and b: links within. Stored."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        sids, texts, size, name = [], [], 0, None

        def done() -> pa.RecordBatch:
            own = Group(texts) if len(sids) > 1 else None
            links = [(sids[i], sids[j]) for i, j in linked(own, own) if i != j] if own else []
            row = [number, sids, texts, [a for a, _ in links], [b for _, b in links]]
            kinds_ = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds_, strict=True)], names=["g", "sids", "texts", "a", "b"])

        for b in batches:
            for sid, m, text in zip(*[b.column(c).to_pylist() for c in ("sid", "name", "text")], strict=True):
                if sids and (m != name or len(sids) == MEMBERS or size + len(text) > GROUP_BYTES):
                    yield done()
                    number, sids, texts, size = number + 1, [], [], 0
                name = m
                sids.append(sid)
                texts.append(text)
                size += len(text)
        if sids:
            yield done()

    least = kinds.select("sid", F.explode("m").alias("name"))
    often = least.groupBy("name").agg(F.count(F.lit(1)).alias("c"))
    names = least.join(often, "name").groupBy("sid").agg(F.max(F.struct("c", "name"))["name"].alias("name"))
    order = ["name", "size", "sid"]
    rows = kinds.select("sid", "text", F.length("text").alias("size")).join(names, "sid").repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(text_batches(rows).mapInArrow(group, "g long, sids array<long>, texts array<string>, a array<long>, b array<long>"), "groups", codec="zstd")


@functools.cache
def bounds() -> np.ndarray:
    """The least size of each class: sets that are two classes apart can't link."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 100 // PERCENT + 1))
    return np.array(out, dtype=np.int64)


def level_parts(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest symmetric difference of linked sets at a level, and its number of parts: one more, and some to spare."""
    most = 2 * (bounds()[level + 1] - 1) * (100 - PERCENT) // (100 + PERCENT)
    return most, most + 4 + most // 8


def signatures(doc: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of all sets, given by text number and token, whose they are, and how many of them a linked set has at least; ``n``: the
    sets' sizes."""
    own = np.searchsorted(bounds(), np.maximum(n, 1), side="right") - 1
    out, owners, needs = [], [], []
    for above in (0, 1):
        level = own + above
        most, parts = level_parts(level)
        most, parts = np.where(n > 0, most, 0), np.where(n > 0, parts, 0)
        start = np.cumsum(parts) - parts
        part = start[doc] + (mix(key ^ mix(level[doc].astype(np.uint64) * GOLDEN + U(17))) % np.maximum(parts, 1)[doc].astype(np.uint64)).astype(np.int64)
        size = int(parts.sum())
        tokens, used = _summed(mix(key + GOLDEN), part, size), np.bincount(part, minlength=size) > 0
        owner = np.repeat(np.arange(len(n)), parts)
        in_use = np.bincount(owner[used], minlength=len(n))
        signed = used | (in_use <= most)[owner]
        name = (level[owner].astype(np.uint64) << U(40)) + (np.arange(size) - start[owner]).astype(np.uint64)
        out.append(mix(tokens ^ mix(name + U(1)))[signed])
        owners.append(owner[signed])
        needs.append(np.maximum(in_use - most, 1)[owner[signed]])
    return np.concatenate(out), np.concatenate(owners), np.concatenate(needs)


def _signed(groups: DataFrame) -> DataFrame:
    """sig, g and need, once for each group but where its texts are far apart in memory."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("texts")
            group = np.repeat(b.column("g").to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            own = pa.RecordBatch.from_arrays([pa.array(group), lists.flatten()], names=["g", "text"])
            for part in _portions(own, "text"):
                doc, key = shingles(part.column("text").to_pylist())
                sig, owner, need = signatures(doc, key, np.bincount(doc, minlength=part.num_rows))
                g = part.column("g").to_numpy()[owner]
                order = np.argsort(sig, kind="stable")  # g ascends in each portion, so what a group's texts share comes together
                sig, g = sig[order], g[order]
                first = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (g[1:] != g[:-1])])[: len(sig)])
                least = np.minimum.reduceat(need[order], first) if len(first) else need
                yield pa.RecordBatch.from_arrays([pa.array(sig[first].view(np.int64)), pa.array(g[first]), pa.array(least)], names=["sig", "g", "need"])

    return text_batches(groups).select("g", "texts").mapInArrow(sign, "sig long, g long, need long")


def _opened(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """a and b (sids) of links between the groups x and y of each pair; stored."""

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = functools.lru_cache(maxsize=16)(lambda _, texts: Group(list(texts)))
        for b in batches:
            out: list[tuple[int, int]] = []
            for x, y, x_sids, y_sids, x_texts, y_texts in zip(*[b.column(c).to_pylist() for c in ("x", "y", "x_sids", "y_sids", "x_texts", "y_texts")], strict=True):
                out += [(x_sids[i], y_sids[j]) for i, j in linked(known(x, tuple(x_texts)), known(y, tuple(y_texts)))]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    of = lambda side: groups.select(F.col("g").alias(side), F.col("sids").alias(f"{side}_sids"), F.col("texts").alias(f"{side}_texts"))
    bytes_of = durable(groups.select("g", F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t)).alias("bytes")), "sizes")
    moved = pairs.select(F.explode(F.array("x", "y")).alias("g")).join(bytes_of, "g").agg(F.sum("bytes")).first()[0] or 0
    slices = 1 + moved // max(1, bytes_of.agg(F.sum("bytes")).first()[0] or 0)  # one after the other, so the disk holds about the texts once more
    found = []
    for i in range(slices):
        own = pairs.filter(F.pmod(F.xxhash64("x", "y"), F.lit(slices)) == i)
        both = own.join(of("x"), "x").join(of("y"), "y")
        found.append(durable(text_batches(both).mapInArrow(open_, "a long, b long"), "links"))
    return reduce(DataFrame.unionByName, found)


def links(groups: DataFrame) -> DataFrame:
    """a and b (sids): links enough to connect all that are linked."""
    sign = W.partitionBy("sig")
    met = _signed(groups).withColumn("lead", F.min(F.struct("g", "need")).over(sign)).withColumn("last", F.max("g").over(sign))
    met = met.filter("lead.g < last").groupBy("sig", "g", F.col("lead.g").alias("lead"), F.col("lead.need").alias("lead_need"))
    met = durable(met.agg(F.min("need").alias("need")), "met")  # members of one group share signatures
    enough = lambda rows, x, y, other: rows.groupBy(x.alias("x"), y.alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.greatest("need", other)).alias("least")
    ).filter("n >= least").select("x", "y")
    star = durable(enough(met.filter("g > lead"), F.col("lead"), F.col("g"), "lead_need"), "pairs")
    found = groups.select(F.explode(F.arrays_zip("a", "b")).alias("l")).select("l.a", "l.b").unionByName(_opened(star, groups))
    found = durable(found, "links")
    root = components(found)
    # a group's root, if all its texts have one
    member = groups.select("g", F.explode("sids").alias("key")).join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    of = member.groupBy("g").agg(F.when(F.min("root") == F.max("root"), F.min("root")).alias("root"))
    many = durable(met.join(of, "g"), "many")
    mains = many.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("sig").agg(F.max_by("root", "c").alias("main"), F.count(F.lit(1)).alias("roots"))
    open_ = many.join(mains.filter("roots > 1 or main is null"), "sig").withColumn("few", F.expr("main is null or root is null or root <> main"))
    few = open_.filter("few").select("sig", F.col("g").alias("o"), F.col("root").alias("o_root"), F.col("need").alias("o_need"))
    rest = open_.join(few, "sig").filter("(if(few, g < o, g <> o)) and (root is null or o_root is null or root <> o_root)")
    rest = enough(rest, F.least("g", "o"), F.greatest("g", "o"), "o_need").join(star, ["x", "y"], "left_anti")
    more = _opened(durable(rest, "pairs"), groups)
    discard(met)
    return found.unionByName(more)


def joined(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, kinds = sets(docs, text_col)
    groups = grouped(kinds)
    named = durable(kinds.select("sid", "k1", "k2", "least"), "named")
    discard(kinds)
    root = components(links(groups))
    named = named.join(root.withColumnRenamed("key", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    got = rows.join(named.join(least, "root").select("k1", "k2", "component"), ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return got.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op13_jaccard_groups(docs: DataFrame) -> DataFrame:
    return joined(docs.select("doc_id", "text"))


ORACLE = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as materialized (select distinct doc_id, hash(g) as h, g from (select doc_id, unnest(case when len(ws) between 1 and 3 then [ws] when len(ws) > 3 then [ws[i:i + 3] for i in range(1, len(ws) - 2)] else [] end) as g from w)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
o as materialized (select x.doc_id as a, y.doc_id as b, count(*) as o from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
e as materialized (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)),
both_ways as materialized (select a, b from e union all select b, a from e),
r as (select a, b from both_ways union select r.a, t.b from r join both_ways t on r.b = t.a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(min(b), d.doc_id)) as component_id
from documents d left join n using (doc_id) left join r on r.a = d.doc_id group by d.doc_id, n
"""
