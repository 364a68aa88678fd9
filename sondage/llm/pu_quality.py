"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are enough: a linear model on bounded text measurements minimises the non-negative
unbiased risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))  of the logistic loss. The class prior pi is estimated from the
scores of *all* rows: the smallest ratio of unlabelled to positive mass above a threshold.

The fit itself takes bounded samples (``MAX_POSITIVE`` trusted rows, ``MAX_UNLABELLED`` texts, lowest hashes first); every
row counts for the prior and is scored. Nothing but measurements of the text enters a score.

Defined cases: null and empty texts are measured as texts without words and get a score like others; a very long text is measured
whole; a table without labels or without rows gets the neutral model, score 0.5; repeated rows get equal scores; of rows with equal
hashes any may be sampled, which are equal in id and features; rows without doc_id may be sampled but are never trusted; other
columns are ignored (the query) or pass through (``score_texts``, where ``into`` replaces a column of that name).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.rule_ledger import measure_texts
from sondage.sources import durable, text_batches

MAX_POSITIVE = 20_000
MAX_UNLABELLED = 40_000
FEATURES = (
    "symbols", "exclaims", "bars", "dup_lines", "repeats", "adjacent", "shout", "no_letters",
    "long_words", "short_words", "length",
)
#: Where a measurement is half way to its largest effect; shares of a text beyond it hardly differ.
HALF = 0.05


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


NEUTRAL = Model(np.zeros(len(FEATURES)), 0.0, 0.5)


def features(texts: list[str | None]) -> np.ndarray:
    """One row for each text, all entries between 0 and 1."""
    texts = [t or "" for t in texts]
    m = measure_texts(texts)
    words, chars, lines = (np.maximum(m[c].to_numpy(), 1) for c in ("n_words", "word_chars", "n_lines"))
    each = m["word_chars"].to_numpy() / words
    shares = [
        m["n_symbols"] / chars,
        np.array([t.count("!") for t in texts]) / chars,
        np.array([t.count("|") for t in texts]) / words,
        m["n_dup_lines"] / lines,
        m["n_repeat_words"] / words,
        m["n_adjacent"] / words,
        m["n_shout"] / words,
        1 - m["n_alpha"] / words,
    ]
    out = [np.asarray(s) / (np.asarray(s) + HALF) for s in shares]
    out += [np.clip((each - 6) / 6, 0, 1), np.clip((4 - each) / 3, 0, 1), np.clip(np.log10(words) / 4, 0, 1)]
    return np.column_stack(out) if texts else np.zeros((0, len(FEATURES)))


def featurise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with an array column ``features``."""

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(features(texts.tolist())))

    return text_batches(docs).withColumn("features", measured.asNondeterministic()(F.col(text_col)))


def nnpu_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> Model:
    """Full-batch Adam on the non-negative risk; a negative estimate of the negatives' risk is driven back up."""
    d = positive.shape[1]
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    p, u = (np.column_stack([x, np.ones(len(x))]) for x in (positive, unlabelled))
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (p, u))
        gain = prior * p.T @ (sp - 1) / len(p)  # of log(1 + e^-z) over positives
        rest = u.T @ su / len(u) - prior * p.T @ sp / len(p)  # of log(1 + e^z) over unlabelled, less the positives' part
        risk = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        g = gain + rest if risk >= 0 else -rest
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(w[:-1], float(w[-1]), prior)


def _scored(model: Model) -> object:
    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(rows.to_list())) if len(rows) else np.zeros(0))

    return score


def class_prior(counts: pd.DataFrame) -> float:
    """``counts`` by score bin: unlabelled and positive rows. The least U / P mass ratio above a threshold, with one s.e. added."""
    if not len(counts) or not counts["positive"].sum():
        return 0.5
    c = counts.sort_values("bin", ascending=False)
    u, p = c["unlabelled"].cumsum() / c["unlabelled"].sum(), c["positive"].cumsum() / c["positive"].sum()
    n = c["positive"].cumsum()
    ratio = (u / p) * (1 + 1 / np.sqrt(n.clip(lower=1)))
    return float(np.clip(ratio[n > 0.1 * c["positive"].sum()].min(), 0.05, 0.98))


def fit(rows: DataFrame, positives: DataFrame, usable: Column) -> Model:
    """``rows``: doc_id and features of all texts; ``positives``: doc_id of trusted ones; ``usable``: rows that may be learned from."""
    known = positives.select("doc_id").distinct().withColumn("trusted", F.lit(True))
    marked = rows.filter(usable).join(known, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    n = marked.agg(F.count(F.lit(1)).alias("u"), F.count_if("trusted").alias("p")).first()
    u, p = _sample(marked, n["u"], MAX_UNLABELLED), _sample(marked.filter("trusted"), n["p"], MAX_POSITIVE)
    if not len(p) or not len(u):
        return NEUTRAL
    first = nnpu_fit(p, u, 0.5)
    bins = marked.select(F.floor(_scored(first)("features") * 200).alias("bin"), "trusted")
    counts = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("unlabelled"), F.count_if("trusted").alias("positive")).toPandas()
    return nnpu_fit(p, u, class_prior(counts))


def _sample(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """Features of at most ``most`` of ``n`` rows, lowest hashes first.

    A threshold on the hash leaves hardly more than ``most`` rows before they are sorted, so what the tasks send doesn't grow
    with their number; with the margin of 1.2, fewer than ``most`` stay only by a chance of less than 1e-9 (then all that stay are taken).
    """
    low = F.xxhash64("doc_id", "features")
    if n > most:
        rows = rows.filter(low < int(2**64 * min(1.2 * most / n, 1.0)) - 2**63)
    got = rows.orderBy(low).limit(most).select("features").toPandas()["features"]
    return np.stack(got.to_list()) if len(got) else np.zeros((0, len(FEATURES)))


def fold(doc_id: str = "doc_id", n: int = 4) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """Measure all texts once (a narrow stored table), then fit without the held-out fold."""
    rows = durable(featurise(docs.select("doc_id", "text")).select("doc_id", "features"), "features")
    return rows, fit(rows, labels.filter((F.col("quality") == 1) & (fold() != 2)), fold() != 2)


def score_texts(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(features(texts.tolist())))

    return text_batches(docs).withColumn(into, score.asNondeterministic()(F.col("text")))


def filter_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score is ``least`` or more, with their own columns."""
    _, model = train(docs, labels)
    return score_texts(docs, model, "__score").filter(F.col("__score") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_pu_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows, model = train(docs, labels)
    scored = rows.withColumn("score", _scored(model).asNondeterministic()(F.col("features")))
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
