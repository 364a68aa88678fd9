"""Toxicity by a weighted lexicon.

Texts are folded (lower case, homoglyphs to Latin letters, digits and signs inside words to the letters they stand for) and
matched by one Aho-Corasick automaton for words, word beginnings and exception phrases. A hit inside an exception phrase
doesn't count, and word beginnings count from two hits in a text on, since one may be chance. The weights of words, plain and
per length of the text, and of beginnings per length give the score through a calibration of four parameters.

The lexicon is a short base list plus words and word beginnings learned from labelled rows: candidates by log odds over
distinct texts (a text has a beginning if it has it twice and in ``DENSE`` of its words), then a greedy cover of the toxic ones, so that words which merely come along with copies are not taken. The
fit takes a bounded sample of labelled rows (``MAX_LABELLED``, lowest hashes first); every row is scored.

Defined cases: null and empty texts have no hits and get the score of a text without hits; a very long text is matched whole, in
one pass; without labels the base list and its default calibration hold; repeated rows get equal scores; of entries at one place the
heaviest counts, of equally useful terms the more specific one is learned; other columns are ignored, and ``into`` replaces a column
of that name; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.sources import text_batches

MAX_LABELLED = 20_000
MAX_CANDIDATES = 4_000
MIN_SUPPORT = 5
BEGINNINGS = (4, 5, 6, 7, 8)
#: A text has a word beginning if at least so many of its words, and such a share of them, start so.
LEAST, DENSE = 2, 0.01

#: Common insults, with weights in log odds that labelled rows replace.
BASE = {
    "idiot": 3.0, "idiots": 3.0, "moron": 3.0, "morons": 3.0, "stupid": 2.5, "dumbass": 3.0, "loser": 2.5, "losers": 2.5,
    "scum": 3.0, "scumbag": 3.0, "trash": 2.0, "worthless": 2.5, "pathetic": 2.5, "disgusting": 2.5, "imbecile": 3.0,
    "bastard": 3.0, "retard": 3.0, "asshole": 3.5, "bitch": 3.5, "shithead": 3.5, "clown": 2.0, "freak": 2.0, "vermin": 2.5,
}
#: Phrases in which such a word is harmless.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "take out the trash", "white trash bag", "clown fish", "circus clown", "class clown",
    "idiot proof", "sore loser", "bitch session", "freak accident", "freak wave", "control freak", "stupid question",
)
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans("авеіјкмнорсѕтухһԁɡαβεικνορτυχ", "abeijkmhopcstyxhdgabeikvoptux")
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: A run of such digits stands for letters if a letter touches it on both sides, or it is a single digit beside one.
SIGN = re.compile(r"(?<=[a-z])[013457]+(?=[a-z])|(?<![0-9a-z])[013457](?=[a-z])|(?<=[a-z])[013457](?![0-9a-z])|[@$](?=[@$]*[a-z])")
#: Characters of no width.
NO_WIDTH = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
WORD = re.compile(r"[^\W\d_]+")


def fold_text(text: str | None) -> str:
    """Lower case; full-width letters, accents, characters of no width and homoglyphs to plain letters; digits and signs in words to letters."""
    t = (text or "").lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t.translate(NO_WIDTH)) if not unicodedata.combining(c)).translate(HOMOGLYPHS)
    return SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), t)


@dataclass(frozen=True)
class Lexicon:
    words: dict[str, float] = field(default_factory=lambda: dict(BASE))
    beginnings: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    slope: float = 1.5
    per_length: float = 0.5
    per_beginning: float = 0.5

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        return _automaton(tuple(sorted(self.words.items())), tuple(sorted(self.beginnings.items())))

    def __getstate__(self) -> dict:  # each Python worker builds its own automaton
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ np.array([self.slope, self.per_length, self.per_beginning]), -30, 30)))


@functools.lru_cache(maxsize=2)
def _automaton(words: tuple, beginnings: tuple) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for term, weight in words:
        entries.setdefault(term, []).append(("word", len(term), weight))
    for term, weight in beginnings:
        entries.setdefault(term, []).append(("begin", len(term), weight))
    for term in EXCEPTIONS:
        entries.setdefault(term, []).append(("except", len(term), 0.0))
    for term, e in entries.items():
        a.add_word(term, e)
    a.make_automaton()
    return a


def hits(text: str | None, lexicon: Lexicon) -> list[tuple[int, int, float, str]]:
    """(start, end, weight, kind) in the folded text; at one start the heaviest entry counts."""
    t = fold_text(text)
    automaton = lexicon.automaton
    found: dict[int, tuple[int, int, float, str]] = {}
    spared: list[tuple[int, int]] = []
    for last, entries in automaton.iter(t):
        end = last + 1
        for kind, n, weight in entries:
            start = end - n
            if start and t[start - 1].isalpha() or kind != "begin" and end < len(t) and t[end].isalpha():
                continue
            if kind == "except":
                spared.append((start, end))
            elif start not in found or found[start][2] < weight:
                found[start] = (start, end, weight, kind)
    return [h for h in found.values() if not any(a <= h[0] and h[1] <= b for a, b in spared)] if spared else list(found.values())


def measures(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """For each text the logarithm of 1 plus the weight of its words, that per 100 words, and that of its beginnings per 100 words."""
    out = np.zeros((len(texts), 3))
    for row, t in zip(out, texts, strict=True):
        words, begins = ([h[2] for h in found if h[3] == kind] for found in [hits(t, lexicon)] for kind in ("word", "begin"))
        size = max(1, len((t or "").split()))
        row[:] = sum(words), 100 * sum(words) / size, 100 * sum(begins) / size * (len(begins) >= LEAST)
    return np.log1p(out)


def terms(text: str | None) -> set[str]:
    """Words of a folded text, and the beginnings that are dense in it, marked with a star."""
    own = WORD.findall(fold_text(text))
    begins = Counter(w[:n] for w in own for n in BEGINNINGS if len(w) > n)
    return set(own) | {b + "*" for b, n in begins.items() if n >= max(LEAST, DENSE * len(own))}


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for part in np.array_split(np.arange(len(b)), max(1, len(b) // 100)):
            got = [(k, y, t) for k, y, text in b.iloc[part].itertuples(index=False) for t in terms(text)]
            yield pd.DataFrame(got, columns=["key", "toxic", "term"])


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """``labels``: doc_id and toxic of the rows that may be learned from."""
    spark = docs.sparkSession
    own = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).toPandas()
    if not sample["toxic"].sum() or sample["toxic"].all():
        return Lexicon()
    ids = F.broadcast(spark.createDataFrame(sample[["doc_id", "toxic"]], "doc_id long, toxic int"))  # <= MAX_LABELLED rows
    text = F.coalesce("text", F.lit(""))
    rows = text_batches(docs).select("doc_id", text.alias("text")).join(ids, "doc_id")
    # equal texts count once
    once = rows.groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    seen = once.select("key", "toxic", "text").mapInPandas(_explode, "key string, toxic int, term string")
    totals = once.agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, n = float(totals["p"] or 0), float(totals["n"] or 0)
    odds = F.log((F.col("hit") + 0.5) / (p + 1.0)) - F.log((F.col("n") - F.col("hit") + 0.5) / (n - p + 1.0))
    candidates = (
        seen.groupBy("term").agg(F.sum("toxic").alias("hit"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("hit") >= MIN_SUPPORT) & (F.col("hit") >= 0.8 * F.col("n")))
        .withColumn("weight", odds).orderBy(F.desc(F.col("hit") * F.col("weight")), "term").limit(MAX_CANDIDATES).toPandas()
    )
    if not len(candidates):
        return Lexicon()
    wanted = F.broadcast(spark.createDataFrame(candidates[["term"]], "term string"))  # <= MAX_CANDIDATES rows
    held = seen.filter("toxic = 1").join(wanted, "term").groupBy("term").agg(F.collect_list("key").alias("keys")).toPandas()
    chosen = greedy_cover(candidates, dict(zip(held["term"], map(set, held["keys"]), strict=True)))
    words = BASE | {t: w for t, w in chosen.items() if not t.endswith("*")}
    lexicon = Lexicon(words, {t[:-1]: w for t, w in chosen.items() if t.endswith("*")})
    return calibrate(once, lexicon)


def greedy_cover(candidates: pd.DataFrame, held: dict[str, set]) -> dict[str, float]:
    """The heaviest candidates that each explain ``MIN_SUPPORT`` toxic texts which no chosen one explains."""
    chosen: dict[str, float] = {}
    covered: set = set()
    order = candidates.assign(whole=~candidates["term"].str.endswith("*"), size=candidates["term"].str.len())
    gains = {t: held.get(t, set()) for t in order["term"]}
    rank = {r.term: (r.weight, r.whole, r.size) for r in order.itertuples()}
    while gains:
        for t in list(gains):
            gains[t] = gains[t] - covered
            if len(gains[t]) < MIN_SUPPORT:
                del gains[t]
        if gains:
            # of terms that explain equally many, the more specific one: heavier, a whole word, longer
            best = max(gains, key=lambda t: (len(gains[t]) * rank[t][0], rank[t][1], rank[t][2], t))
            chosen[best] = float(rank[best][0])
            covered |= gains.pop(best)
    return chosen


def calibrate(rows: DataFrame, lexicon: Lexicon, ridge: float = 0.05) -> Lexicon:
    """Logistic regression of the labels on the measures of the (bounded) sample, by Newton steps."""
    got = rows.select("toxic", _measured(lexicon)("text").alias("m")).toPandas()
    x = np.column_stack([np.ones(len(got)), np.stack(got["m"].to_list())])
    y, w = got["toxic"].to_numpy(dtype=float), np.zeros(4)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(4)
        w += np.linalg.solve(h, x.T @ (y - q) - ridge * w)
    return Lexicon(lexicon.words, lexicon.beginnings, *map(float, w))


def _measured(lexicon: Lexicon) -> object:
    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(measures(texts.tolist(), lexicon)))

    return measured.asNondeterministic()


def score_texts(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1. No shuffle."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(lexicon.calibrated(measures(texts.tolist(), lexicon)))

    return text_batches(docs).withColumn(into, score.asNondeterministic()(F.col(text_col)))


def fold(doc_id: str = "doc_id", n: int = 3) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def op4_toxicity_lexicon(docs: DataFrame, labels: DataFrame) -> DataFrame:
    lexicon = fit(docs, labels.filter(fold() != 1))
    scored = score_texts(docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
