"""Phrases against a plain count of all n-grams."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from sondage.llm import phrase_mining

KIND = "doc_id long, text string, lang string"


def _plain(rows, limit=phrase_mining.LIMIT):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = tuple(x for x in re.split(r"[ \t]+", piece) if x)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][w[i : i + k]] += 1
    out = []
    for lang, own in f.items():
        longest = Counter()
        for g, a in own.items():
            if len(g) > 2 and a >= 30:
                for k in range(2, len(g)):
                    for i in range(len(g) - k + 1):
                        longest[g[i : i + k]] = max(longest[g[i : i + k]], a)
        rated = []
        for g, a in own.items():
            if len(g) > 1 and a >= 30 and 100 * longest[g] < 80 * a:
                score, _, l, r = min((2_000_000 * a // (own[g[:k]] + own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))  # noqa: E741
                rated.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rated)[:limit], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def _got(df, **more):
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in names) for r in phrase_mining.phrases(df, **more).collect())


def _corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Éa", "X", "ß", "日本"]
    some = ["New York City", "of the\tpeople  by", "a b c d", "X y", "as well as", "ein Éa"]
    text = lambda: "".join(rng.choice([*words, *some, *some]) + rng.choice([" ", " ", " ", "  ", ", ", ".\n", "\r", "\t"]) for _ in range(rng.randrange(40)))
    return [(i, text(), rng.choice(["en", "de", None, ""])) for i in range(n)]


def test_all_phrases(spark):
    rows = _corpus(500, 1) + [(900, None, "en"), (901, "", None), (902, " ,.\n", "fr"), (None, "a b " * 5000, "long"), (None, "a b " * 5000, "long")]
    want = _plain(rows)
    assert len(want) > 20
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], KIND + ", n long, piece string")
    assert _got(df) == want


def test_small_blocks_many_buckets_and_a_limit_with_ties(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "BLOCK_BYTES", 300)
    monkeypatch.setattr(phrase_mining, "WORDS_PER_BUCKET", 100)
    rows = _corpus(300, 2) + [(i, f"q{i % 7} z{i % 7}. u{i % 7} v{i % 7}", "en") for i in range(280)]
    for limit in (3, 9):
        assert _got(spark.createDataFrame(rows, KIND).repartition(5), limit=limit) == _plain(rows, limit)


def test_nothing_to_find(spark):
    assert _got(spark.createDataFrame([], KIND)) == []
    assert _got(spark.createDataFrame([(1, "once only", "en"), (2, None, None)], KIND)) == []


def test_ngrams_whose_hashes_meet_stay_apart(monkeypatch):
    grams = np.array([[1, 2], [1, 2], [3, 4], [2, 1]])
    rows, _, n = phrase_mining._unique(grams, np.array([1, 2, 3, 4]))
    assert dict(zip(map(tuple, rows.tolist()), n.tolist(), strict=True)) == {(1, 2): 3, (3, 4): 3, (2, 1): 4}


def test_scores_beyond_64_bits(spark):
    big = 6 * 10**15
    found = spark.createDataFrame([([1, 2], big)], "w array<long>, a long")
    words = spark.createDataFrame([(1, big + 1), (2, big + 2)], "id long, f long")
    r = phrase_mining.scored(found, words).first()
    assert (r.l, r.r, r.score) == (big + 1, big + 2, 2_000_000 * big // (2 * big + 3))
