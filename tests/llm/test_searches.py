"""Near-duplicates, decontamination, toxicity and tokens on cases that a narrower or slower search would lose."""

import random

import numpy as np
import pytest

from sondage.llm import backoff_lm, probminhash, speculative_bpe, template_decontam, toxicity_lexicon

KIND = "doc_id long, text string"


def _classes(rows):
    """Class of each row number by comparing all pairs."""
    bag = []
    for _, t in rows:
        _, key, weight = probminhash.bags([(t or "").lower().encode().split()])
        bag.append((key >> np.uint64(32), weight))
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if probminhash.probability_jaccard(bag[i], bag[j]) >= probminhash.SIMILAR - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def _family(n, blocks, variants, common, seed):
    """Pages of a common part and one variant of each block: those that differ in one block are similar, others hardly."""
    rng = random.Random(seed)
    words = lambda k, name: " ".join(f"{name}{i}" for i in range(k))
    page = lambda: " ".join([words(common, "c"), *[words(18, f"b{b}v{rng.randrange(variants)}w") for b in range(blocks)]])
    return [(i, page()) for i in range(n)]


def test_classes_of_a_templated_family(spark):
    rows = _family(250, 5, 5, 110, 1)
    got = {r.doc_id: r.class_id for r in probminhash.op10_probminhash(spark.createDataFrame(rows, KIND)).collect()}
    assert [got[i] for i, _ in rows] == _classes(rows)


def test_classes_where_no_table_is_small_enough_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(probminhash, "MAX_BROADCAST", 0)
    rows = _family(120, 5, 3, 110, 3)
    got = {r.doc_id: r.class_id for r in probminhash.op10_probminhash(spark.createDataFrame(rows, KIND)).collect()}
    assert [got[i] for i, _ in rows] == _classes(rows)


def test_classes_of_variants_of_one_text(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(200):
        t = list(base)
        for _ in range(rng.randrange(1, 14)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = {r.doc_id: r.class_id for r in probminhash.op10_probminhash(spark.createDataFrame(rows, KIND)).collect()}
    assert [got[i] for i, _ in rows] == _classes(rows)


def test_long_repeats_are_similar_whatever_their_number_of_shingles(spark):
    a = "a b c d e " * 400
    rows = [(1, a), (2, a + "x y z q r s t u v w k l m"), (3, "nothing of the kind is in here at all")]
    got = {r.doc_id: r.class_id for r in probminhash.op10_probminhash(spark.createDataFrame(rows, KIND)).collect()}
    assert _classes(rows) == [0, 0, 2] and got == {1: 1, 2: 1, 3: 3}


def test_one_id_with_two_texts_keeps_both(spark):
    rows = [(1, "the first text of the pair that shares an id"), (1, "quite another one which has not a word of it"), (1, "the first text of the pair that shares an id"), (2, "The first  text of the pair that shares an id"), (None, "x")]
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as key", "2 as h", "3 as __n")
    kept = probminhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, rows[0][1]), (1, rows[1][1]), (0, "x")])


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.key: r.root for r in probminhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_short_items_match_as_a_whole(spark):
    bench = spark.createDataFrame([(1, "What is 3 + 4 ?"), (2, "name the largest city of Peru"), (3, "why not"), (4, None), (5, " ?! ")], "item_id long, text string")
    texts = ["What is 3 + 4 ?", "so, what is 3 + 4? seven", "they had to name the largest city of Chile there", "why not", "and why not go", None, "", "name the largest town"]
    docs = spark.createDataFrame(list(enumerate(texts)), KIND)
    got = {(r.doc_id, r.item_id) for r in template_decontam.op3_template_decontam(docs, bench).collect()}
    assert got == {(0, 1), (1, 1), (2, 2), (3, 3)}


@pytest.mark.parametrize("text", ["you 1d10t", "You IDIOT!", "y іdiot", "ｉｄｉｏｔ", "ídiót", "id​iot", "an idi0t."])
def test_folded_spellings(text):
    assert len(toxicity_lexicon.hits(text, toxicity_lexicon.Lexicon())) == 1


def test_numbers_stay_numbers():
    assert toxicity_lexicon.fold_text("in 2010, 1500 and 3.14") == "in 2010, 1500 and 3.14"


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    return speculative_bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_very_long_words_equal_the_library(bpe):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    rng = random.Random(3)
    for word in ("a" * 5_001, "".join(rng.choice("etaoinshr") for _ in range(20_000)), "é漢" * 300, "ab" * 40):
        assert np.frombuffer(bpe.encode([word])[0], dtype="<u4").tolist() == t.encode(word, add_special_tokens=False).ids


def test_a_long_word_takes_time_in_proportion(bpe):
    import time

    rng = random.Random(4)
    word = "".join(rng.choice("etaoinshr") for _ in range(1_000_000))
    began = time.process_time()
    bpe.encode([word])
    assert time.process_time() - began < 60  # scanning for each merge would take hours


def test_own_scores_are_those_of_fit_and_score(spark):
    texts = ["the old mill sleeps", "the old dog sleeps  the old dog", " \n the old mill\tsleeps ", "", None, "Ünder ünder ÜNDER", "a " * 3000]
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id"), (0, "a second text of one id")], KIND)
    grams = backoff_lm.trigrams(docs)
    want = {r.doc_id: (r.n_words, r.n_backoff, pytest.approx(r.log_score)) for r in backoff_lm.score(grams, *backoff_lm.fit(grams)).collect()}
    for parts in (1, 3):
        assert {r.doc_id: (r.n_words, r.n_backoff, r.log_score) for r in backoff_lm.score_own(docs, parts=parts).collect()} == want
    assert backoff_lm.score_own(docs.limit(0)).collect() == []


def _repeated_blocks(pairs, seed):
    """Pairs of similar texts of the same 16 blocks, each block some times over; texts of different pairs differ in the counts alone."""
    rng = random.Random(seed)
    block = [" ".join(f"b{b}w{i}" for i in range(12)) for b in range(16)]
    rows = []
    for _ in range(pairs):
        n = [rng.choice((1, 1, 2, 3, 4)) for _ in block]
        for _ in range(2):
            rows.append((len(rows), " ".join(" ".join([block[b]] * n[b]) for b in range(16))))
            b = rng.randrange(16)
            n[b] = max(1, n[b] + rng.choice((-1, 1)))
    return rows


def _nested(n, seed):
    """Texts that are parts of one long text: most are similar to a few others, hardly any to the whole."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words))]
    for i in range(1, n):
        long = rng.randrange(120, 300)
        at = rng.randrange(400 - long)
        rows.append((i, " ".join(words[at : at + long])))
    return rows


@pytest.mark.parametrize("rows", [_repeated_blocks(300, 5), _nested(250, 6)], ids=["repeated blocks", "nested"])
def test_classes_of_texts_that_have_nothing_of_their_own(spark, rows):
    got = {r.doc_id: r.class_id for r in probminhash.op10_probminhash(spark.createDataFrame(rows, KIND)).collect()}
    assert [got[i] for i, _ in rows] == _classes(rows)


def test_own_scores_go_through_the_tables(spark, monkeypatch):
    """With tables cut to what occurs twice, the others back off to bigrams and words: every level is in the way of the query."""
    texts = ["a b c d", "a b c e", "x b c", "", None, "q r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = backoff_lm.fit
    grams = backoff_lm.trigrams(docs)
    want = {r.doc_id: (r.n_words, r.n_backoff, pytest.approx(r.log_score)) for r in backoff_lm.score(grams, *plain(grams, 2)).collect()}
    monkeypatch.setattr(backoff_lm, "fit", lambda grams: plain(grams, 2))
    assert {r.doc_id: (r.n_words, r.n_backoff, r.log_score) for r in backoff_lm.score_own(docs, parts=2).collect()} == want
    assert {i: b for i, (_, b, _) in want.items()} == {0: 1, 1: 1, 2: 3, 3: 0, 4: 0, 5: 2}


def test_trigrams_travel_packed_and_in_many_buckets(spark, monkeypatch):
    """A row for each word made the tables of op7 outgrow the disk; blocks hold many texts, and buckets of any number give the same scores."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(40))) for i in range(60)], KIND)
    tables = lambda: backoff_lm.fit(backoff_lm.trigrams(docs.filter("doc_id < 9")))
    grams = backoff_lm.trigrams(docs)
    scores = lambda: {r.doc_id: (r.n_words, r.n_backoff, pytest.approx(r.log_score)) for r in backoff_lm.score(grams, *tables()).collect()}
    assert grams.count() < 10 and tables()[0].count() < 10
    want = scores()
    monkeypatch.setattr(backoff_lm, "BUCKET_WORDS", 50)
    assert tables()[0].count() > 10 and scores() == want and sum(b for _, b, _ in want.values()) > 0


def test_pieces_between_white_space_are_encoded_once(bpe, monkeypatch):
    """Encoding cut every text into words by a regex; now it sees each different piece once, and the tokens are the library's."""
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["It's the cat,the DOG's\x1cend\x1f \x85next line　wide", "ΟΔΟΣ ΣΑΣ,ΟΔΟΣ", "é ́x a b", "<|endoftext|>it's<|startoftext|> <|endoftext|", "\x1d", "日本語 and 12,345.67!?", ""]
    for texts in (odd, [" ".join(odd) * 3]):
        assert [np.frombuffer(p, dtype="<u4").tolist() for p in bpe.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    seen = []
    plain = bpe.split
    monkeypatch.setattr(bpe, "split", type("Split", (), {"findall": staticmethod(lambda p: seen.append(p) or plain.findall(p))}))
    bpe.encode(["some-thing's new, and some-thing's new, " * 500])
    assert 0 < len(seen) <= 3


def test_only_bags_of_pairs_are_shuffled(spark, monkeypatch):
    """Many pairs made all bags of the corpus meet their keys by a shuffle; now the keys are broadcast, and few bags travel."""
    texts = probminhash.sketches(spark.createDataFrame([(i, f"some words of text number {i}") for i in range(20)], KIND))[1]
    key = [r.key for r in texts.orderBy("least").collect()]
    pairs = spark.createDataFrame([(key[0], key[1]), (key[2], key[3])], "a long, b long")
    monkeypatch.setattr(probminhash, "MAX_BROADCAST", 0)
    rows, plain = [], probminhash.F.broadcast
    monkeypatch.setattr(probminhash.F, "broadcast", lambda df: rows.append(df.count()) or plain(df))
    got = probminhash._verify(pairs, texts).collect()
    assert rows == [4] and {(r.a, r.b) for r in got} == {(key[0], key[1]), (key[2], key[3])}
