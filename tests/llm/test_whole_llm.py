"""The training-data operators on cases that a narrower search would lose."""

import itertools
import math
import re
from collections import Counter
from re import _parser

import pytest

from sondage.llm import backoff_lm, license_rules, template_decontam

SF = "/root/testdata/sf0.001"


def _spellings(parsed):
    """Every text that a license pattern matches: literals, sets, alternatives and optional groups."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append([chr(c) for _, c in arg])
        elif name == "BRANCH":
            parts.append([t for p in arg[1] for t in _spellings(p)])
        elif name == "SUBPATTERN":
            parts.append(_spellings(arg[-1]))
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            parts.append(["", *_spellings(arg[2])])
        else:
            raise AssertionError(name)
    return ["".join(x) for x in itertools.product(*parts)]


def test_license_keywords_cover_every_spelling():
    for r in license_rules.rules():
        for text in _spellings(_parser.parse(r["pattern"])):
            assert set(text.split()) & set(r["keywords"].split()), (r, text)
            assert any(f" {g}" in f" {text}" for g in license_rules.GATES), (r, text)


def test_license_spellings_without_the_short_keyword(spark):
    want = {
        "Creative Commons Attribution-NonCommercial 4.0": "cc-by-nc", "Creative Commons Attribution-ShareAlike 3.0": "cc-by-sa",
        "Creative Commons Attribution-NoDerivs 2.5": "cc-by-nd", "CC BY NonCommercial NoDerivatives 4.0": "cc-by,cc-by-nc-nd",
        "CC BY NonCommercial ShareAlike 4.0": "cc-by,cc-by-nc-sa", "GNU Library General Public License": "lgpl", "GNU Lesser General Public License": "lgpl",
        "PSF License": "python",
    }
    rows = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_rules.op2_license_rules(rows).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def _grams(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return list(zip(["", "", *w], ["", *w], w, strict=False))


def _backoff(train, text):
    """n_words, n_backoff, log score of a text by counts that nothing is cut from."""
    three = Counter(g for t in train for g in _grams(t))
    two, context3, context2, one = Counter(), Counter(), Counter(), Counter()
    for (a, b, c), n in three.items():
        two[b, c] += n
        context3[a, b] += n
        context2[b] += n
        one[c] += n
    total, backed, all_words = 0.0, 0, _grams(text)
    for a, b, c in all_words:
        backed += (a, b, c) not in three
        if (a, b, c) in three:
            total += math.log(three[a, b, c] / context3[a, b])
        elif (b, c) in two:
            total += math.log(0.4 * two[b, c] / context2[b])
        else:
            total += math.log(0.16 * one[c] / sum(one.values())) if c in one else -20.0
    return len(all_words), backed, total


def test_backoff_goes_from_trigrams_to_words(spark):
    train = ["the old mill sleeps", "the old dog sleeps", "a dog walks", None]
    other = ["the old mill walks", "a dog sleeps", "mill the unheard", ""]
    tables = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(other)), "doc_id long, text string")
    got = {r.doc_id: r for r in backoff_lm.score(backoff_lm.trigrams(tables[1]), *backoff_lm.fit(backoff_lm.trigrams(tables[0]))).collect()}
    for i, t in enumerate(other):
        n, backed, total = _backoff(train, t)
        assert (got[i].n_words, got[i].n_backoff, got[i].log_score) == (n, backed, pytest.approx(total))


def test_backoff_counts_what_occurs_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()
    rows = spark.createDataFrame([(r.doc_id, r.text) for r in docs], "doc_id long, text string")
    three = Counter(g for r in docs for g in _grams(r.text))
    pairs = Counter()
    for (a, b, _), n in three.items():
        pairs[a, b] += n
    for r in backoff_lm.op7_backoff_lm(rows).collect():
        own = [g for d in docs if d.doc_id == r.doc_id for g in _grams(d.text)]
        mean = sum(math.log(three[g] / pairs[g[:2]]) for g in own) / len(own) if own else None
        assert (r.n_words, r.n_backoff) == (len(own), 0)
        assert r.mean_log_score == (None if mean is None else pytest.approx(mean, abs=2e-5))


BEFORE, AFTER = "some plain words come before this and ", " while more plain words follow after it"
FAMILY = "the farmer in our village sold {} apples and {} pears at the market on the hill last week"
TITLE = "Every Title In This Item Is Written With Capital Letters So That Nothing Is Left For A Template Here"
NUMBERS = "add 12 14 16 18 20 22 24 and 26 28 30 32 34 36 38 to get 40 42 44 46 48 50"


def test_every_item_of_a_family_is_found(spark):
    bench = spark.createDataFrame([(1, FAMILY.format(3, 3)), (2, FAMILY.format(3, 4))], "item_id long, text string")
    texts = [FAMILY.format(3, 4), FAMILY.format(3, 3), FAMILY.format(7, 9), "nothing of this kind is told in a text about the weather of the north"]
    docs = spark.createDataFrame([(i, BEFORE + t + AFTER) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.changed_slots for r in template_decontam.op3_template_decontam(docs, bench).collect()}
    assert got[0, 2] == 0 and (0, 1) not in got and got[1, 1] == 0 and got[2, 2] == 2 and (2, 1) not in got
    assert [r.doc_id for r in template_decontam.remove_contaminated(docs, bench).collect()] == [3]


def test_items_that_are_all_placeholders_are_found_verbatim(spark):
    items = [TITLE, TITLE.upper().replace("EVERY", "NO"), NUMBERS]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    other = ["Other Titles Are Also Written With Capital Letters And Hold Only Names But They Are Not The Same Words", "add " + "7 9 " * 10]
    docs = spark.createDataFrame([(i, BEFORE + t + AFTER) for i, t in enumerate([*items, *other])], "doc_id long, text string")
    rows = template_decontam.op3_template_decontam(docs, bench).collect()
    assert {(i, i) for i in range(len(items))} <= {(r.doc_id, r.item_id) for r in rows} and {r.doc_id for r in rows} == {0, 1, 2}
    assert sorted(r.doc_id for r in template_decontam.remove_contaminated(docs, bench).collect()) == [3, 4]


def test_other_numbers_in_an_item_of_few_template_windows(spark):
    bench = spark.createDataFrame([(1, "the sum of the first numbers is taken " + NUMBERS)], "item_id long, text string")
    changed = "the sum of the first numbers is taken " + re.sub("[0-9]+", lambda m: str(int(m[0]) + 100), NUMBERS)
    docs = spark.createDataFrame([(1, BEFORE + changed + AFTER)], "doc_id long, text string")
    assert [r.item_id for r in template_decontam.op3_template_decontam(docs, bench).collect()] == [1]
