"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule. A policy is
a named, versioned mask over those bits, so a new policy or an ablation never reads the texts again.

Defined cases: a null text has no words (all counts 0, fails ``few_words``); an empty text likewise; repeated rows get
equal ledger rows; other columns of the input pass through, and the ledger lives in one struct column, so a clash of
names can only concern that one (parameter ``into``); an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.sources import text_batches

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_adjacent", "n_shout", "n_alpha",
)
LEDGER_TYPE = ", ".join(f"{m} bigint" for m in MEASURES)

#: (bit, rule, SQL over the measurements that is true where the rule fails). Bits never change meaning.
RULES = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbol_heavy", "100 * n_symbols > 4 * word_chars"),
    (3, "duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    (4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    (5, "adjacent_repeats", "n_words >= 10 and 100 * n_adjacent > 15 * n_words"),
    (6, "shouting", "n_words >= 10 and 100 * n_shout > 40 * n_words"),
    (7, "few_letters", "n_words > 0 and 100 * n_alpha < 60 * n_words"),
)
BIT = {name: bit for bit, name, _ in RULES}


def mask(*rules: str) -> int:
    return sum(1 << BIT[r] for r in rules)


#: Versioned policies: the bits that reject a document. Old versions stay, so that their results can be reproduced.
POLICIES = {
    "base-v1": mask("few_words", "repeated_windows"),
    "web-v1": mask("few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "word_length"),
    "web-v2": mask(*BIT),
}
BLANKS = b" \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WORDS_AT_ONCE = 300_000


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[str], list[list[bytes]]]]:
    """Texts with their words, so many at a time that the words fit in memory; one text is never cut."""
    part: list[str] = []
    words: list[list[bytes]] = []
    n = 0
    for t in texts:
        t = t or ""
        w = t.encode("utf-8", "surrogatepass").split()  # bytes.split() knows exactly the six ASCII blanks
        if part and n + len(w) > WORDS_AT_ONCE:
            yield part, words
            part, words, n = [], [], 0
        part.append(t)
        words.append(w)
        n += len(w)
    if part:
        yield part, words


def _shouted(word: str) -> bool:
    return len(word) >= 2 and word.isupper() and sum(map(str.isalpha, word)) >= 2


def measure_texts(texts: list[str | None]) -> pd.DataFrame:
    """The measurements of each text, by numpy over all words of a block at once."""
    out = []
    for part, words in _blocks(texts):
        n = np.array([len(w) for w in words], dtype=np.int64)
        flat = [w for ws in words for w in ws]
        d = len(part)
        doc = np.repeat(np.arange(d), n)
        repeat = adjacent = shout = alpha = np.zeros(d, dtype=np.int64)
        if flat:
            code, kinds = pd.factorize(np.array(flat, dtype=object))
            kinds = [k.decode("utf-8", "surrogatepass") for k in kinds]
            loud = np.fromiter(map(_shouted, kinds), dtype=bool, count=len(kinds))
            alphabetic = np.fromiter((any(map(str.isalpha, k)) for k in kinds), dtype=bool, count=len(kinds))
            shout = np.bincount(doc, loud[code], d)
            alpha = np.bincount(doc, alphabetic[code], d)
            same = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
            adjacent = np.bincount(doc[1:], same, d)
        if len(flat) > 2:
            inside = doc[2:] == doc[:-2]
            code = code.astype(np.int64)
            pair = pd.factorize(code[:-2] * (code.max() + 1) + code[1:-1])[0]
            window = pd.factorize(pair * (code.max() + 1) + code[2:])[0]
            window = pd.factorize(window * d + doc[:-2])[0]
            window[~inside] = window.max() + 1
            twice = (np.bincount(window) >= 2)[window] & inside
            covered = np.zeros(len(flat), dtype=bool)
            for k in range(3):
                covered[k : len(flat) - 2 + k] |= twice
            repeat = np.bincount(doc, covered, d)
        lines = [[x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")] for t in part]
        n_lines = np.array([len(x) for x in lines])
        out.append(
            pd.DataFrame(
                {
                    "n_words": n,
                    "word_chars": [len(t) - sum(map(t.count, " \t\n\r\x0b\x0c")) for t in part],
                    "n_symbols": [sum(map(t.count, SYMBOLS)) for t in part],
                    "n_dup_lines": n_lines - np.array([len(set(x)) for x in lines]),
                    "n_repeat_words": repeat,
                    "n_lines": n_lines,
                    "n_adjacent": adjacent,
                    "n_shout": shout,
                    "n_alpha": alpha,
                }
            ).astype("int64")
        )
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=list(MEASURES), dtype="int64")


def ledger(docs: DataFrame, text_col: str = "text", into: str = "ledger") -> DataFrame:
    """``docs`` with a struct column: the measurements and ``failed``, one bit for each failed rule. No shuffle."""

    @F.pandas_udf(LEDGER_TYPE)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return measure_texts(texts.tolist())

    raw = f"__{into}_measures"
    rows = text_batches(docs).withColumn(raw, measured.asNondeterministic()(F.col(text_col)))
    with_bits = [F.col(f"{raw}.{m}").alias(m) for m in MEASURES]
    return rows.withColumn(into, F.struct(*with_bits, _bits(raw).alias("failed"))).drop(raw)


def _bits(struct: str) -> Column:
    total = F.lit(0).cast("long")
    for bit, _, fails in RULES:
        sql = fails
        for m in sorted(MEASURES, key=len, reverse=True):
            sql = sql.replace(m, f"`{struct}`.§{MEASURES.index(m)}§")
        for i, m in enumerate(MEASURES):
            sql = sql.replace(f"§{i}§", m)
        total = total + F.when(F.expr(sql), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
    return total


def passes(policy: str, into: str = "ledger") -> Column:
    """True where a ledger row fails no rule of the policy."""
    return F.col(f"{into}.failed").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablation(rows: DataFrame, policy: str, into: str = "ledger") -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the policy would keep without it.

    The ledger is first counted by bit pattern (at most 2 ** rules rows), so the shuffle doesn't grow with the corpus.
    """
    patterns = rows.groupBy(F.col(f"{into}.failed").bitwiseAND(F.lit(POLICIES[policy]).cast("long")).alias("bits")).count()
    rules = [(name, 1 << bit) for bit, name, _ in RULES if POLICIES[policy] >> bit & 1]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in rules]))
    rows = patterns.withColumn("r", each).select("bits", "count", "r.rule", "r.bit")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0)).cast("long")
    return rows.groupBy("rule").agg(
        n(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        n(F.col("bits") == F.col("bit")).alias("n_only"),
        n(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def filter_documents(docs: DataFrame, policy: str = "web-v2") -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    rows = ledger(docs, into="__ledger")
    return rows.filter(passes(policy, "__ledger")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_rule_ledger(docs: DataFrame, policy: str = "web-v2") -> DataFrame:
    base_failed = F.col("ledger.failed").bitwiseAND(F.lit(POLICIES["base-v1"]).cast("long")) != 0
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id",
        *[f"ledger.{m}" for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed.alias("base_failed"),
        (~base_failed & passes(policy)).alias("kept"),
        F.col("ledger.failed").alias("failed_bits"),
    )
