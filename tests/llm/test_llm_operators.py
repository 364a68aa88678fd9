"""The training-data operators against brute force and on odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import (
    backoff_lm, license_rules, minimax_shards, preference_format, probminhash, pu_quality, rule_ledger, speculative_bpe,
    template_decontam, toxicity_lexicon,
)

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", None, None, None), (4, "a", "en", "s", 1), (None, "no id here at all", "en", "s", 1),
    (5, "same text again and again " * 30, "en", "s", 1), (5, "same text again and again " * 30, "en", "s", 1), (6, "same text again and again " * 30, "en", "s", 1),
    (7, "word " * 50_000, "en", "s", 1), (8, "\x00\x01é漢字𝒳 MIT License <|endoftext|>", "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KIND).withColumns({"score": F.lit(1), "words": F.lit("x"), "ledger": F.lit(0), "ids": F.lit(0)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_rows(spark, odd, labels, rows):
    d = odd if rows == "odd" else odd.limit(0)
    want = ODD if rows == "odd" else []
    ids = sorted(-1 if r[0] is None else r[0] for r in want)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short")], "item_id long, text string")
    got = {}
    for name, f, more in (("op1", pu_quality.op1_pu_quality, (labels,)), ("op2", license_rules.op2_license_rules, ()), ("op4", toxicity_lexicon.op4_toxicity_lexicon, (labels,)), ("op5", minimax_shards.op5_minimax_shards, ()), ("op6", rule_ledger.op6_rule_ledger, ()), ("op9", speculative_bpe.op9_speculative_bpe, ()), ("op10", probminhash.op10_probminhash, ())):
        all_rows = f(d, *more).collect()  # collected, so that nothing is pruned
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in all_rows) == ids, name
        got[name] = {r.doc_id: r for r in all_rows}
    assert template_decontam.op3_template_decontam(d, bench).collect() == []
    lm = {r.doc_id: r for r in backoff_lm.op7_backoff_lm(d).collect()}
    assert set(lm) == {r[0] for r in want}
    if not want:
        return
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for op in ("op1", "op2", "op4") for r in got[op].values() if op != "op2")
    assert got["op2"][1][1:6] == (0, 0, None, None, "") and got["op2"][1].score == 0 and got["op2"][8].base_labels == "mit"
    assert got["op5"][1].size == 16 and got["op5"][4].size == 17 and got["op5"][5].text_crc32 == got["op5"][6].text_crc32 and got["op5"][5].shard == got["op5"][6].shard
    assert [got["op6"][i].n_words for i in (1, 2, 3, 4, 5, 7)] == [0, 0, 0, 1, 150, 50_000] and got["op6"][7].n_repeat_words == 50_000 and not any(r.kept for r in got["op6"].values())
    assert got["op9"][1].n_tokens == got["op9"][2].n_tokens == 0 and got["op9"][1].ids_sha256 == hashlib.sha256(b"").hexdigest() and got["op9"][5] [1:] == got["op9"][6][1:]
    assert [got["op10"][i].class_id for i in (1, 2, 3, 4, 5, 6, 7, 8, None)] == [1, 1, 1, 4, 5, 5, 7, 8, None]
    assert (lm[1].n_words, lm[1].mean_log_score) == (0, None) and lm[5].n_words == 300 and lm[7].n_words == 50_000


def test_license_base_columns(spark):
    texts = ["MIT License. mit license", "x GNU General Public-License, cc by: CC BY-NC 4.0", "commit licenses", "Licensed under the Apache License, Version 2.0."]
    got = {r.doc_id: r for r in license_rules.op2_license_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [k for p in license_rules.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
    assert got[1].labels == "cc-by,cc-by-nc,gpl" and got[3].labels == "apache" and got[2].labels == ""


def test_rules_by_brute_force(docs):
    got = {r.doc_id: r for r in rule_ledger.op6_rule_ledger(docs).collect()}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_repeat_words, g.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert g.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (g.base_failed and g.kept)


def test_ablation_adds_up(docs):
    rows = rule_ledger.ledger(docs)
    kept = rows.filter(rule_ledger.passes("web-v2")).count()
    for r in rule_ledger.ablation(rows, "web-v2").collect():
        assert r.n_kept_without == kept + r.n_only and r.n_failed >= r.n_only


def test_shards_are_minimax():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes, k = rng.integers(1, 50, 12), int(rng.integers(1, 5))
        best = min(max(p) for p in _splits(list(sizes), k))
        cap, starts = minimax_shards.minimax_cuts(sizes, k)
        assert cap == best and len(starts) <= k


def _splits(s, k):
    if k == 1 or len(s) == 1:
        yield [sum(s)]
        return
    yield [sum(s)]
    for i in range(1, len(s)):
        for rest in _splits(s[i:], k - 1):
            yield [sum(s[:i]), *rest]


def test_shard_slots(docs):
    got = minimax_shards.op5_minimax_shards(docs.unionAll(docs)).toPandas()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1 and len(got) == 2 * docs.count()


def test_tokens_equal_the_library(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    texts = {r.doc_id: r.text or "" for r in docs.collect()} | {-1: "ΑΣ Don't 12 <|endoftext|>x y", -2: ""}
    rows = docs.sparkSession.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in speculative_bpe.op9_speculative_bpe(rows).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest() and r.n_tokens == len(ids)


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(1)
    words = [[b"%d" % x for x in rng.integers(0, 40, 300)] for _ in range(2)]
    words[1][60:] = words[0][60:]
    doc, key, weight = probminhash.bags(words)
    a, b = ((key[doc == i] >> np.uint64(32), weight[doc == i]) for i in (0, 1))
    x, y = (dict(zip(k.tolist(), w.tolist(), strict=True)) for k, w in (a, b))
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x | y) for i in x if i in y)
    assert probminhash.probability_jaccard(a, b) == pytest.approx(want)
    who = probminhash.signatures(doc, key, weight, 2)
    assert abs((who[0] == who[1]).mean() - want) < 0.15


def test_classes_by_brute_force(docs):
    rows = docs.collect()
    bag = {}
    for r in rows:
        doc, key, weight = probminhash.bags([(r.text or "").lower().encode().split()])
        bag[r.doc_id] = (key >> np.uint64(32), weight)
    root = {i: i for i in bag}
    find = lambda i: i if root[i] == i else find(root[i])
    ids = sorted(bag)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if probminhash.probability_jaccard(bag[a], bag[b]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.class_id for r in probminhash.op10_probminhash(docs).collect()}
    assert got == {i: find(i) for i in ids}


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: " ".join(r.text.split()) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in " ".join((r.text or "").split())}
    assert {(r.doc_id, r.item_id) for r in template_decontam.op3_template_decontam(docs, bench).collect()} == want


def test_other_numbers_are_found_and_inconsistent_ones_not(spark):
    bench = spark.createDataFrame([(1, "A train leaves at 10 km from town and Anna walks 10 km back while the dog sleeps near the old mill")], "item_id long, text string")
    filler = "some words come before this and "
    texts = ["A train leaves at {0} km from town and {1} walks {2} km back while the dog sleeps near the old mill".format(*x) for x in (("12", "Berta", "12"), ("12", "Berta", "13"))]
    docs = spark.createDataFrame([(i, filler + t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = template_decontam.op3_template_decontam(docs, bench).collect()
    assert [r.doc_id for r in got] == [0] and got[0].changed_slots >= 2


def test_toxic_words(spark):
    lex = toxicity_lexicon.Lexicon()
    n = lambda t: len(toxicity_lexicon.hits(t, lex))
    assert n("You IDIOT!") == n("you 1d10t") == n("y іdiot") == 1 and n("idiotic trash can clown fish") == 0 and n(None) == 0


def test_preference_prefix(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "x"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "y"), (2, 0, None, None), (None, 0, "user", "z")]
    got = {r.pair_id: r for r in preference_format.op8_preference_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[0].n_prefix == 2 and got[0].prompt == "<|user|>\nq\n<|assistant|>\na\n" and got[0].chosen == "<|user|>\nx\n" and got[0].chosen_mask == "0"
    assert got[1].n_prefix == 0 and got[1].rejected == "" and None in got


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = pu_quality.op1_pu_quality(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    rows = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_pipeline_stages_keep_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    tokens = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert all(r.n_tokens == len(r.ids) // 4 and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() for r in tokens) and len(tokens) == n
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        assert 0.5 * n < kept.count() <= n
