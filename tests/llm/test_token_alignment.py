"""Token alignment against a plain one of whole texts."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sondage.llm import token_alignment

KIND = "doc_id long, text string"


def _bytes_of():
    alphabet = {c: b for b, c in enumerate(token_alignment.byte_alphabet())}
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    first = lambda t: [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]

    def second(t):
        spelled = [(i, b.id_to_piece(i)) for i in b.encode(t)]
        return [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in spelled]

    return first, second


def _plain(rows):
    """The contract read word for word: whole texts, cuts by sets of ends, all pairs of a group."""
    first, second = _bytes_of()
    grouped = []
    for _, text in rows:
        a, b = (first(text), second(text)) if text else ([], [])
        if b"".join(x for _, x in a) != (" " + (text or "")).encode() or b"".join(x for _, x in b) != (" " + (text or "")).encode():
            grouped.append([])
            continue
        ends = [[sum(len(x) for _, x in t[: k + 1]) for k in range(len(t))] for t in (a, b)] if len(a) < 400 else [_upto(a), _upto(b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], 0
        for c in cuts:
            groups.append(([i for (i, _), e in zip(a, ends[0], strict=True) if at < e <= c], [i for (i, _), e in zip(b, ends[1], strict=True) if at < e <= c]))
            at = c
        grouped.append(groups)
    links = [[(x, y) for g in groups for x in g[0] for y in g[1]] for groups in grouped]
    count = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (doc, _), groups, own in zip(rows, grouped, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sums = [sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own)]
        out.append((doc, *sums, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


def _upto(tokens):
    out, at = [], 0
    for _, x in tokens:
        at += len(x)
        out.append(at)
    return out


def _got(df):
    names = ["doc_id", *token_alignment.FACTS, "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in token_alignment.op11_token_alignment(df).collect()), key=repr)


ODD = [
    None, "", " ", "\n", "  two  blanks ", " leading", "trailing ", "line\nline\n\n third\n \nx", "tab\there\r\nthere", "a▁b", "▁",
    "<|endoftext|> and <s>x</s> <unk> <0x0A>", "It's don't WE'LL 'sup 's", "3.14, 2024-01-02; 1,000,000!", "naïve Straße, Ñandú: ¿qué? œuvre.", "日本語 テキスト。漢字",
    "emoji 👩‍👩‍👧 🏳️‍🌈!!", "a b c　d", "x" * 3000, "=" * 200 + " " * 90 + "-" * 77, "zero\u0000byte \x1cfs \x85nel", "é å", "!!!???...", "(a).(b),[c];",
    "same text", "same text", "Ⅷ ½ ٣ x²", "​zero width﻿",
]


def test_odd_texts_and_repeated_rows(spark):
    rows = list(enumerate(ODD)) + [(None, "no id"), (None, None), (3, "an id twice")]
    assert _got(spark.createDataFrame(rows, KIND)) == _plain(rows)


def test_small_blocks_and_columns_of_other_names(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 200)
    rows = [(i, f"{t} the same end") for i, t in enumerate(ODD) if t and len(t) < 1000]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND + ", block long, piece string").repartition(3)
    assert _got(df) == _plain(rows)


def test_documents_of_the_smallest_table(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert _got(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")) == _plain(rows)


def test_pairs_of_ids(spark):
    _, ids = token_alignment.align(spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the the")], KIND))
    first, second = _bytes_of()
    the = (first("the")[0][0], second("the")[0][0])
    found = {(r.a, r.b): (r.n_docs, r.best) for r in ids.collect()}
    assert found[the] == (3, True) and len(found) == 3 and all(n == 1 for p, (n, _) in found.items() if p != the)


def test_empty_table(spark):
    assert token_alignment.op11_token_alignment(spark.createDataFrame([], KIND)).collect() == []


def test_a_model_whose_tokens_cross_a_cut_is_refused():
    pair = token_alignment._pair("byte_bpe_50k.json", "piece_bpe_32k.model")
    assert pair.b_bytes[pair.b.piece_to_id("<0x0A>")] == b"\n"
    assert token_alignment.CUT.search("a b") and token_alignment.CUT.search("x,") and not token_alignment.CUT.search(", x"[:1])


@pytest.mark.parametrize("text", [t for t in ODD if t])
def test_pieces_are_the_text(text):
    pieces = token_alignment.Pieces()
    codes = pieces.of(text)
    assert "".join(list(pieces.code)[c] for c in codes) == " " + text
