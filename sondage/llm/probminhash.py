"""Near-duplicates by ProbMinHash.

A text is a bag of word shingles (five words; a shorter text is one shingle), weighted by their counts. Each element sends
the arrivals of a Poisson process with its weight as rate to random components of the signature; a component keeps the
element that arrived first, and an element stops as soon as it can't be first anywhere. Two signatures agree in a component
with the probability Jaccard similarity J_P of their bags (for bags without repetition: the Jaccard similarity).

Equal texts collapse first; a text's id is a 64-bit hash of its words, so among 5e10 different texts some 70 may share one.
Signatures are cut into ``BANDS`` x ``ROWS``; texts that share a band form a group. Work is linear in a group, never all pairs:

1. Each group is led by the text that meets most others, and every member is compared with its leader. Candidates are verified
   on all their shingles (J_P >= 0.8, on 32-bit hashes). Verified links form components; a group within one component is done.
2. In a group of several components in which at most ``FEW`` texts lie outside the largest one, those are compared with all
   members of other components.
3. The members of any larger group meet again in narrower groups: those that differ from their leader in the same place, by the
   ``APART`` least of its places (``differences``: copies of shingles that the text has beyond the leader's; for a part of the leader
   also those that it lacks). Texts similar to each other but not to their leader differ from it in the same places, in their counts as
   well. The leader itself is gone, so the groups shrink; from step 1 on until none is left. After ``DEPTH`` rounds, what is left is
   compared as in step 2, whatever its size.

Classes are the connected components. At J_P = 0.8 two texts miss all bands with probability 3e-5.

Defined cases: a null text is an empty one; texts without words are copies of each other; a very long text is one bag like others
(batches are cut between texts); rows without doc_id are in no class (class_id null) and always stay; repeated rows are copies;
different texts under one doc_id are judged each by itself; of equally connected texts the one with the larger id leads; case and
kind of white space don't matter; other columns, whatever their names, are ignored (the query) or kept (``keep_one``); an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from sondage.sources import discard, durable, text_batches

SHINGLE = 5
SIMILAR = 0.8
ROWS, BANDS = 5, 26
SLOTS = ROWS * BANDS
BYTES_AT_ONCE = 1_000_000
#: Groups with at most so many texts outside their largest component are compared in full.
FEW = 16
#: So many places where it differs from its leader name a text's narrower groups.
APART = 16
DEPTH = 3
#: A table of so many rows (a few numbers each) is broadcast; any larger one is shuffled.
MAX_BROADCAST = 50_000
#: So many keys, a number each, are broadcast to pick the bags of pairs before these are shuffled.
MAX_KEYS = 2_000_000
U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look independent (SplitMix64's finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bags(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and count of every distinct shingle of every text, sorted by both."""
    n = np.array([len(w) for w in words])
    flat = np.array([w for ws in words for w in ws], dtype=object)
    doc = np.repeat(np.arange(len(words)), n)
    if not len(flat):
        return doc, np.zeros(0, dtype=np.uint64), np.zeros(0)
    code, kinds = pd.factorize(flat)
    h = pd.util.hash_array(np.array([k.decode("utf-8", "surrogatepass") for k in kinds], dtype=object), categorize=False)[code]
    size = np.minimum(n, SHINGLE)[doc]
    left = n[doc] - (np.arange(len(flat)) - (np.cumsum(n) - n)[doc])  # words from here to the end of the text
    key = np.zeros(len(flat), dtype=np.uint64)
    for k in range(SHINGLE):
        ahead = np.concatenate([h[k:], np.zeros(min(k, len(h)), dtype=np.uint64)])
        key = np.where(k < size, mix(key * GOLDEN + ahead + U(k + 1)), key)
    starts = left >= size
    doc, key = doc[starts], key[starts]
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
    return doc[first], key[first], np.diff(np.concatenate([first, [len(doc)]])).astype(float)


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x SLOTS elements: in each component the one that arrives first."""
    best = np.full(n * SLOTS, np.inf)
    who = np.zeros(n * SLOTS, dtype=np.uint64)
    time = np.zeros(len(key))
    limit = np.full(n, np.inf)
    step = 0
    while len(key):
        step += 1
        x = mix(key ^ mix(np.full(1, step, dtype=np.uint64) * GOLDEN))
        time = time - np.log(((x >> U(11)).astype(float) + 0.5) * 2.0**-53) / weight
        slot = doc * SLOTS + (mix(x + GOLDEN) % U(SLOTS)).astype(np.int64)
        np.minimum.at(best, slot, time)
        won = best[slot] == time
        who[slot[won]] = key[won]
        open_ = np.unique(doc)
        limit[open_] = best.reshape(n, SLOTS)[open_].max(axis=1)
        stay = time < limit[doc]
        doc, key, weight, time = doc[stay], key[stay], weight[stay], time[stay]
    return who.reshape(n, SLOTS)


def band_keys(who: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of the components of each band."""
    parts = who.reshape(len(who), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * GOLDEN + parts[:, :, r])
    return key.view(np.int64)


def pack(key: np.ndarray, weight: np.ndarray) -> bytes:
    """Sorted 32-bit shingles, and their counts behind if one differs from 1."""
    k = (key >> U(32)).astype(np.uint32)  # sorted, as key is
    return k.tobytes() + (b"" if (weight == 1).all() else weight.astype(np.uint32).tobytes()) + (b"\0" if (weight == 1).all() else b"\1")


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(b[:-1], dtype=np.uint32)
    if b[-1]:
        return k[: len(k) // 2], k[len(k) // 2 :].astype(float)
    return k, np.ones(len(k))


def aligned(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elements of two bags, sorted, and their counts in each."""
    keys, back = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    x, y = (np.bincount(r, w, len(keys)) for r, w in ((back[: len(a[0])], a[1]), (back[len(a[0]) :], b[1])))
    return keys, x, y


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements i of 1 / sum_j max(a_j / a_i, b_j / b_i)."""
    return _jaccard(*aligned(a, b)[1:])


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x):
        return 1.0
    both = (x > 0) & (y > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = x / y  # infinite where only a has the element
    order = np.argsort(ratio)
    r, xs, ys = ratio[order], x[order], y[order]
    ysum, xsum = np.concatenate([[0], np.cumsum(ys)]), np.concatenate([np.cumsum(xs[::-1])[::-1], [0]])
    at = np.searchsorted(r, ratio[both], side="right")  # elements up to here weigh b_j / b_i, those beyond a_j / a_i
    return float((1 / (ysum[at] / y[both] + xsum[at] / x[both])).sum())


def _copies(keys: np.ndarray, low: np.ndarray, high: np.ndarray, side: int) -> np.ndarray:
    """The ``APART`` least hashes of (shingle, number of its copy) for the copies from ``low`` up to ``high``."""
    n = np.maximum(high - low, 0).astype(np.int64)
    i = np.arange(n.sum()) + np.repeat(low.astype(np.int64) - (np.cumsum(n) - n), n)
    h = mix(np.repeat(keys, n).astype(np.uint64) << U(32) | i.astype(np.uint64) << U(1) | U(side))
    return np.sort(h)[:APART]


def differences(keys: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Names of where a text (counts ``y``) differs from its leader (counts ``x``).

    They are the least copies of shingles that it has beyond the leader's; and, where it lacks at least twice as much as it has beyond
    (a part of its leader), the least copies it lacks. Counts are compared after dividing by the median ratio of the common shingles,
    as J_P knows shares only: a text and its double differ in nothing.
    """
    both = (x > 0) & (y > 0)
    if both.any():
        ratio = y[both] / x[both]
        middle = np.partition(ratio, (len(ratio) - 1) // 2)[(len(ratio) - 1) // 2]
        y = np.rint(y / middle)
    more, less = np.maximum(y - x, 0).sum(), np.maximum(x - y, 0).sum()
    found = _copies(keys, x, y, 0)
    if less >= 2 * more:
        found = np.concatenate([found, _copies(keys, y, x, 1)])
    return (found >> U(32)).astype(np.uint32)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // BYTES_AT_ONCE  # whole texts, so many at a time that their words fit in memory
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        for at, to in zip(edges, edges[1:], strict=False):
            if to > at:
                words = [(t or "").lower().encode("utf-8", "surrogatepass").split() for t in b.column("text").slice(at, to - at).to_pylist()]
                own = [b.column(c).slice(at, to - at) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, *_sketch_words(words)], names=["doc_id", "text_hash", "key", "bands", "bag"])


def _sketch_words(words: list[list[bytes]]) -> list[pa.Array]:
    names = [int.from_bytes(hashlib.blake2b(b" ".join(w), digest_size=8).digest(), "little", signed=True) for w in words]
    own = {k: i for i, k in reversed(list(enumerate(names)))}  # equal texts once
    place = {k: j for j, k in enumerate(own)}
    doc, key, weight = bags([words[i] for i in own.values()])
    bands = band_keys(signatures(doc, key, weight, len(own)))
    edge = np.searchsorted(doc, np.arange(len(own) + 1))
    packed = [pack(key[edge[j] : edge[j + 1]], weight[edge[j] : edge[j + 1]]) for j in range(len(own))]
    rows = [place[k] for k in names]
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS)
    return [pa.array(names, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(bands[rows].ravel())), pa.array([packed[j] for j in rows], pa.binary())]


def sketches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, key (of the text's words) for every row with a doc_id; and for every key its bands, its bag and its
    least row (doc_id, text_hash). Both are stored, as all later steps read them."""
    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").filter("doc_id is not null")
    kind = "doc_id long, text_hash long, key long, bands array<long>, bag binary"
    drawn = durable(rows.mapInArrow(_sketch, kind), "sketches")
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    texts = durable(drawn.groupBy("key").agg(least, F.first("bands").alias("bands"), F.first("bag").alias("bag")), "texts")
    own = durable(drawn.select("doc_id", "text_hash", "key"), "rows")
    discard(drawn)
    return own, texts


def _small(df: DataFrame, n: int) -> DataFrame:
    """``df`` with at most ``n`` rows, to be joined: broadcast if these are few."""
    return F.broadcast(df) if n <= MAX_BROADCAST else df


def compare(leader: bytes, text: bytes) -> tuple[bool, list[int]]:
    """Whether two bags are similar, and the names of where the second one differs."""
    keys, x, y = aligned(unpack(leader), unpack(text))
    return _jaccard(x, y) >= SIMILAR - 1e-9, differences(keys, x, y).view(np.int32).tolist()


@F.pandas_udf(StructType().add("similar", "boolean").add("apart", ArrayType(IntegerType())))
def _compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compare(x, y) for x, y in zip(a, b, strict=True)], columns=["similar", "apart"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys with ``similar`` and ``apart``, by their bags; the result is stored.

    Few pairs are broadcast to the texts, whose bags then meet by pair, so that no leader is a hot key. Many are joined with the bags
    by plain shuffles: where one text leads many others, AQE splits its partition. Only bags that some pair asks for are shuffled; their
    keys are broadcast unless there may be more than ``MAX_KEYS``.
    """
    pairs = durable(pairs, "pairs")
    n = pairs.count()
    bags = texts.select("key", "bag")
    if not n:
        return pairs.withColumns({"similar": F.lit(False), "apart": F.array().cast("array<int>")})
    if n <= MAX_BROADCAST:
        ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("key"))
        bag_of = lambda end: F.first(F.when(F.col("key") == F.col(end), F.col("bag")), ignorenulls=True)
        both = bags.join(F.broadcast(ends), "key").groupBy("a", "b").agg(bag_of("a").alias("x"), bag_of("b").alias("y"))
    else:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        bags = bags.join(F.broadcast(asked) if 2 * n <= MAX_KEYS else asked, "key", "left_semi")
        both = pairs.join(bags.select(F.col("key").alias("a"), F.col("bag").alias("x")), "a")
        both = both.join(bags.select(F.col("key").alias("b"), F.col("bag").alias("y")), "b")
    got = durable(both.select("a", "b", _compared("x", "y").alias("c")).select("a", "b", "c.similar", "c.apart"), "verified")
    discard(pairs)
    return got


def _leaders(met: DataFrame) -> DataFrame:
    """met(h, key, n) with the ``leader`` of each group, the text that meets most others, and how many these are (``w``)."""
    weight = met.groupBy("key").agg(F.sum("n").alias("w"))
    lead = met.join(weight, "key").groupBy("h").agg(F.max(F.struct("w", "key")).alias("lead"))
    return met.select("h", "key").join(lead.select("h", F.col("lead.key").alias("leader"), "lead.w"), "h")


def _crowded(member: DataFrame) -> DataFrame:
    """member(h, key) of the groups of two texts and more, with their number ``n``."""
    return member.join(member.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "h")


def _mixed(led: DataFrame, root: DataFrame) -> DataFrame:
    """led(h, key, leader) with ``root``, ``main`` (the group's largest component) and ``rest`` (texts outside it), where there are such."""
    rows = led.join(_small(root, root.count()), "key", "left").withColumn("root", F.coalesce("root", "key"))
    parts = rows.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
    group = parts.groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("rest"))
    return rows.join(group.filter("rest > 0"), "h")


def _across(mixed: DataFrame) -> DataFrame:
    """Pairs of each text outside its group's largest component with all texts of other components."""
    few = mixed.filter("root <> main").select("h", F.col("key").alias("x"), F.col("root").alias("x_root"))
    met = mixed.join(few, "h").filter("root <> x_root")
    return met.select(F.least("x", "key").alias("a"), F.greatest("x", "key").alias("b")).distinct()


def links(texts: DataFrame) -> DataFrame:
    """key and root of all texts that are linked to others, by enough similar pairs to connect every class."""
    member = texts.select("key", F.explode("bands").alias("h"))  # a band's number is part of its hash
    found: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        met = _crowded(member)
        if depth == 1:  # by far the largest: later rounds have few members, and read them again
            met = durable(met, "groups")
        led = durable(_leaders(met), "leaders")
        if depth == 1:
            discard(met)
        pairs = led.filter("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
        judged = _verify(pairs, texts)
        found.append(judged.filter("similar").select("a", "b"))
        if depth == 1:  # later rounds add few links; that their groups count as mixed only means more comparisons
            root = components(found.pop())
            found.append(root.select(F.col("root").alias("a"), F.col("key").alias("b")))
        mixed = durable(_mixed(led, root), "mixed")
        discard(led)
        light = F.col("rest") <= FEW if depth < DEPTH else F.lit(True)
        known = judged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        across = _verify(_across(mixed.filter(light)).join(known, ["a", "b"], "left_anti"), texts)
        more = across.filter("similar").select("a", "b")
        found.append(more)
        # texts that differ in the same place from the same leader, of each text's leaders the one that meets most others
        met = mixed.filter(~light & (F.col("key") != F.col("leader"))).groupBy("key")
        own = met.agg(F.max(F.struct("w", "leader")).alias("l")).select("key", "l.leader")
        own = own.join(judged.select(F.col("a").alias("leader"), F.col("b").alias("key"), "apart"), ["leader", "key"])
        narrower = own.select("key", "leader", F.explode("apart").alias("e")).select("key", F.xxhash64("leader", "e").alias("h"))
        member = durable(narrower.distinct(), "narrower")
        discard(mixed)
        if member.isEmpty():
            break
    return root if depth == 1 and more.isEmpty() else components(reduce(DataFrame.unionByName, found))


def components(edges: DataFrame) -> DataFrame:
    """key and root (the least key of its component) by alternating large and small stars until nothing changes; each round is stored."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    before, n = None, now.count()
    while True:
        # large star: every neighbour above a node is tied to the least node around
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.filter("v > u").join(_small(least, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the neighbours below a node, and itself, are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_small(low, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = durable(small.filter("u <> v").distinct(), "edges")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if before is not None:  # the first edges are the caller's
            discard(now)
        now, n = new, state[0]
        if state == before:
            return now.select(F.col("u").alias("key"), F.col("v").alias("root"))
        before = state


def _classed(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key and root of every text, and for each root class_id, n_texts and the row (doc_id, text_hash) that stays."""
    root = links(texts)
    named = texts.select("key", "least").join(_small(root, root.count()), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = durable(named, "named")
    discard(texts)
    whole = named.groupBy("root").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n_texts"))
    return named, whole.select("root", F.col("least.doc_id").alias("class_id"), "n_texts", "least")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), n_texts (different texts in it) for every row."""
    rows, texts = sketches(docs)
    named, whole = _classed(texts)
    named = named.select("key", "root").join(whole, "root").select("key", "class_id", "n_texts")
    got = rows.select("doc_id", "key").join(named, "key").select("doc_id", "class_id", "n_texts")
    alone = docs.filter("doc_id is null").select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("n_texts")
    )
    return got.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id, with its own columns; only texts of repeated rows are shuffled."""
    rows, texts = sketches(docs)
    _, whole = _classed(texts)
    often = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("__n"))
    first = whole.select("least.*").join(often, ["doc_id", "text_hash"])
    first = durable(first.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("__n").alias("n")), "kept")
    whole_rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.struct("*").alias("row"))
    kept = whole_rows.join(first, ["id", "hash"])
    again = kept.filter("n > 1").dropDuplicates(["id", "hash"])
    return kept.filter("n = 1").select("row.*").unionByName(again.select("row.*")).unionByName(docs.filter("doc_id is null"))


def op10_probminhash(docs: DataFrame) -> DataFrame:
    return classes(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
