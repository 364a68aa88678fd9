"""The Jaccard join against a comparison of all pairs."""

import random

import numpy as np
import pytest

from sondage.llm import jaccard_groups

KIND = "doc_id long, text string"


def _set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def _plain(rows):
    bags = [_set(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    links = 0
    for i, (doc, _) in enumerate(rows):
        for j in range(i):
            both = len(bags[i] & bags[j])
            if bags[i] and bags[j] and doc is not None and rows[j][0] is not None and 100 * both >= 85 * (len(bags[i]) + len(bags[j]) - both):
                root[find(i)] = find(j)
                links += 1
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(b), None if d is None else least[find(i)]) for i, ((d, _), b) in enumerate(zip(rows, bags, strict=True))), key=repr), links


def _got(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND + ", n long, sid string").repartition(parts)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups.op13_jaccard_groups(df).collect()), key=repr)


def _edited(rng, base, n):
    t = list(base)
    for _ in range(n):
        at = rng.randrange(len(t))
        t[at : at + rng.choice([0, 1, 2])] = [f"x{rng.randrange(10**6)}"] * rng.choice([0, 1, 1])
    return " ".join(t)


def _near_copies(seed, n, length, most):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(length)}" for _ in range(length)]
    return [(i, _edited(rng, base, rng.randrange(most))) for i in range(n)]


def _chains(seed, n):
    """Texts that each link to the one before and to few others."""
    rng = random.Random(seed)
    t, out = [f"c{i}" for i in range(120)], []
    for i in range(n):
        out.append((i, " ".join(t)))
        at = rng.randrange(len(t) - 3)
        t[at : at + 2] = [f"n{i}a", f"n{i}b"]
    return out


def _passages(seed, n):
    """Unlike texts that share a long passage, and some copies with a word more."""
    rng = random.Random(seed)
    shared = " ".join(f"p{i}" for i in range(60))
    own = lambda: " ".join(f"o{rng.randrange(10**7)}" for _ in range(rng.randrange(5, 90)))
    out = [f"{own()} {shared} {own()}" for _ in range(n)]
    return list(enumerate(out + [t + " more" for t in out[::5]]))


def _nested(seed):
    """Each text is a part of the next one, at sizes about the threshold."""
    words = [f"k{i}" for i in range(400)]
    return [(i, " ".join(words[:n])) for i, n in enumerate(range(3, 400, 7))]


@pytest.mark.parametrize("rows", [_near_copies(1, 250, 150, 14), _near_copies(2, 150, 30, 5), _chains(3, 200), _passages(4, 150), _nested(5)])
def test_components(spark, monkeypatch, rows):
    monkeypatch.setattr(jaccard_groups, "MEMBERS", 4)  # many groups
    want, links = _plain(rows)
    assert links > 20
    assert _got(spark, rows) == want


def test_groups_of_the_usual_size_and_short_texts(spark):
    rng = random.Random(6)
    rows = _near_copies(7, 200, 60, 6) + [(1000 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(7)))) for i in range(150)]
    assert _got(spark, rows) == _plain(rows)[0]


def test_odd_rows(spark):
    long_ = " ".join(f"v{i}" for i in range(60_000))
    rows = [
        (5, None), (4, ""), (3, " \n\t"), (9, "One two"), (8, "one\ttwo"), (7, "one two three four"), (6, "ÉTÉ à b c"), (2, "été à b c"), (None, "one two"),
        (20, long_), (19, long_ + " end"), (11, "same id"), (11, "another text"), (12, "same id"), (12, "same id"), (30, "a\x1cb c"), (31, "a\x85b c"), (None, None),
    ]
    assert _got(spark, rows) == _plain(rows)[0]
    assert _got(spark, []) == []


def test_linked_sets_share_a_signature():
    """Token numbers at every size about the threshold, differing as much as linked sets may."""
    rng = np.random.default_rng(8)
    for n in [*range(1, 60), 100, 333, 1000, 3001]:
        for _ in range(4):
            m = rng.integers(-(-n * 85 // 100), n + 1)  # the smaller one's size
            most = (85 * (n + m)) // 185 + ((85 * (n + m)) % 185 > 0)  # the least overlap of linked sets
            if most > m:
                continue
            x = rng.integers(0, 2**63, size=n).astype(np.uint64)
            y = np.concatenate([x[:most], rng.integers(0, 2**63, size=m - most).astype(np.uint64)])
            (sig, _, need), (other, _, other_need) = (jaccard_groups.signatures(np.zeros(len(s), dtype=np.int64), np.sort(s), np.array([len(s)])) for s in (x, y))
            both = set(sig.tolist()) & set(other.tolist())
            least = [max(a[k] for a in (dict(zip(sig.tolist(), need, strict=True)), dict(zip(other.tolist(), other_need, strict=True)))) for k in both]
            assert both and len(both) >= min(least), (n, m, most)


def test_sets_whose_parts_in_use_may_all_differ_meet_in_empty_ones(monkeypatch):
    """With all tokens in one part, only parts without tokens are equal."""
    monkeypatch.setattr(jaccard_groups, "mix", lambda x: np.asarray(x, dtype=np.uint64))
    x = np.arange(1, 8, dtype=np.uint64) * np.uint64(5 * 7 * 11 * 13)
    signs = [jaccard_groups.signatures(np.zeros(len(s), dtype=np.int64), s, np.array([len(s)]))[0] for s in (x, x[:-1])]
    assert set(signs[0].tolist()) & set(signs[1].tolist())
