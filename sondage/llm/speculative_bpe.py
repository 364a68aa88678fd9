"""BPE encoding by speculation, and decoding.

For each new word a greedy longest match proposes tokens. A proposal is right if and only if every adjacent pair of its
tokens is compatible, i.e. merging the pair's own characters gives that pair back: merges on either side of a boundary that
no merge crosses don't see each other. All adjacent pairs of a batch are looked up at once in a sorted table of verdicts
(new pairs are judged by merging two tokens); only the words with an incompatible pair are merged exactly.

Texts are cut at white space, which no word holds, and the encoding of each different piece is put together from those of its words once.
Encodings of words and pieces are remembered in each Python worker, up to ``CACHE_WORDS`` of either, and ``CACHE_CHARS`` characters of
pieces; then that memory starts anew, which changes speed and nothing else. Rows never meet, so there is no shuffle, and a lost executor costs its own partitions.

Defined cases: a null text is an empty one; an empty text has no tokens (empty packed ids, empty decoded text); a very long text is
encoded whole, and a very long word merged in n log n; of equal merges the leftmost comes first; strings of special tokens in a text
become these tokens, as in the tokenizers library; repeated rows get equal results; other columns pass through untouched, except that
``into``, ``ids`` and ``decoded`` replace columns of those names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.sources import text_batches

CACHE_WORDS = 200_000
CACHE_CHARS = 8_000_000
CHARS_AT_ONCE = 1_000_000
END = "</w>"
NO_MERGE = 1 << 62
#: Words of more characters are merged by a heap; shorter ones faster by scanning.
LONG_WORD = 64
#: The characters at which str.split cuts and that are no White_Space.
SEPARATORS = re.compile("[\x1C-\x1F]")
#: Unicode's White_Space, for which Python's \\s has four characters too many.
WHITE_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def byte_alphabet() -> list[str]:
    """The printable character for each byte: itself if it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


@functools.cache
def general_category(kind: str) -> str:
    """Ranges of all characters whose general category starts with ``kind``, for use inside a regex class."""
    has = [unicodedata.category(chr(c))[0] == kind for c in range(sys.maxunicode + 1)]
    edges = [c for c in range(1, len(has)) if has[c] != has[c - 1]]
    return "".join(f"\\U{a:08X}-\\U{b - 1:08X}" for a, b in zip(edges[::2], edges[1::2], strict=True))


class WordBpe:
    """A word-level BPE vocabulary file with end-of-word suffix, NFC, lower case and byte alphabet."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.size
        for t, i in (self.ids | self.special).items():
            self.tokens[i] = t
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        # pair -> rank and new token in one number each, so that the smallest one is the first merge
        self.merges = {self.ids[a] * self.size + self.ids[b]: rank * self.size + self.ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.reach: dict[str, int] = {}  # longest token with the same first two characters
        for t in self.ids:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        letters = r"|[\p{L}]+"  # no other alternative starts with a letter, so the commonest may come first
        pattern = letters[1:] + "|" + pattern.replace(letters, "", 1)
        for kind in "LN":
            pattern = pattern.replace(f"\\p{{{kind}}}", general_category(kind))
        self.split = re.compile(pattern.replace(r"\s", WHITE_SPACE))
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.blank = re.compile(f"[{WHITE_SPACE}]+")
        self.to_char = dict(enumerate(byte_alphabet()))
        self.codes = np.empty(0, dtype=np.int64)
        self.fits = np.empty(0, dtype=bool)
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    # ---- words

    def cut(self, text: str) -> list[str]:
        """What stands between white space, normalized."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() has a rule for a word's last sigma
        if SEPARATORS.search(text):
            return [p for p in self.blank.sub(" ", text).lower().split(" ") if p]
        return text.lower().split()

    def words(self, text: str) -> list[str]:
        return [w for p in self.cut(text) for w in self.split.findall(p)]

    def characters(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_char)

    # ---- speculate

    def propose(self, chars: str) -> list[int]:
        """Greedy longest match; no look-up is longer than the longest token."""
        out, at, n = [], 0, len(chars)
        while at < n:
            rest = self.ids.get(chars[at:] + END) if n - at <= self.longest else None
            if rest is not None:
                out.append(rest)
                break
            for to in range(min(n - 1, at + self.reach.get(chars[at : at + 2], 1)), at, -1):
                found = self.ids.get(chars[at:to])
                if found is not None:
                    out.append(found)
                    at = to
                    break
            else:
                raise ValueError(f"no token for {chars[at]!r}")
        return out

    # ---- merge exactly

    def merge(self, chars: str, ended: bool = True) -> list[int]:
        parts = [self.ids[c] for c in chars[:-1]] + [self.ids[chars[-1] + END * ended]]
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        get, none = self.merges.get, NO_MERGE
        ranks = [get(a * self.size + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            parts[at : at + 2] = [best % self.size]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] * self.size + parts[at], none)
            if at < len(ranks):
                ranks[at] = get(parts[at] * self.size + parts[at + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order (least rank, then leftmost) from a heap over linked neighbours: n log n."""
        n, size, get = len(parts), self.size, self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or get(parts[i] * size + parts[j]) != m:  # one of the two has been merged since
                continue
            parts[i], parts[j] = m % size, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (m := get(parts[x] * size + parts[y])) is not None:
                    heapq.heappush(heap, (m, x))
        return [t for t in parts if t >= 0]

    # ---- verify

    def _judge(self, code: int) -> bool:
        a, b = divmod(code, self.size)
        left = [] if a == self.size else [a]  # a word of one token stands alone
        chars = "".join(self.tokens[i] for i in [*left, b])
        ended = chars.endswith(END) and b not in (self.ids.get(c) for c in ("<", "/", "w", ">"))
        return self.merge(chars[: -len(END)] if ended else chars, ended) == [*left, b]

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Verdicts for pair codes, one sorted look-up for all."""
        asked, back = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.codes, asked)
        known = np.zeros(len(asked), dtype=bool)
        known[at < len(self.codes)] = self.codes[at[at < len(self.codes)]] == asked[at < len(self.codes)]
        if not known.all():
            fresh = asked[~known]
            if len(self.codes) > 4 * CACHE_WORDS:
                self.codes, self.fits, fresh = self.codes[:0], self.fits[:0], asked
            codes_ = np.concatenate([self.codes, fresh])
            fits_ = np.concatenate([self.fits, np.fromiter(map(self._judge, fresh.tolist()), dtype=bool, count=len(fresh))])
            order = np.argsort(codes_, kind="stable")
            self.codes, self.fits = codes_[order], fits_[order]
            at = np.searchsorted(self.codes, asked)
        return self.fits[at][back]

    def learn(self, words: list[str]) -> None:
        """Encode new words into the cache."""
        if not words:
            return
        chars = [self.characters(w) for w in words]
        proposals = [self.propose(c) for c in chars]
        n = np.array([len(p) for p in proposals])
        flat = np.array([i for p in proposals for i in p], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), n)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        left = np.empty_like(flat)
        left[1:] = flat[:-1]
        left[first] = self.size
        check = (n[word] == 1) | (np.arange(len(flat)) != first[word])  # each pair, and words of one token
        wrong = np.zeros(len(words), dtype=bool)
        wrong[word[check][~self.compatible(left[check] * self.size + flat[check])]] = True
        packed = flat.astype("<u4").tobytes()
        for i, w in enumerate(words):
            self.cache[w] = np.array(self.merge(chars[i]), dtype="<u4").tobytes() if wrong[i] else packed[4 * first[i] : 4 * (first[i] + n[i])]

    # ---- texts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each text."""
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for t in texts:  # whole texts, so many at a time that their words fit in memory
            part.append(t or "")
            size += len(part[-1])
            if size > CHARS_AT_ONCE:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part)

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.specials.split(t) if any(s in t for s in self.special) else [t] for t in texts]
        cut = [[p if i % 2 else self.cut(p) for i, p in enumerate(ps)] for ps in parts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if len(self.pieces) > CACHE_WORDS or self.held > CACHE_CHARS:
            self.pieces.clear()
            self.held = 0
        fresh = [p for p in set(chain.from_iterable(chain.from_iterable(ps[::2] for ps in cut))) if p not in self.pieces]
        words = [self.split.findall(p) for p in fresh]
        self.learn(list({w for ws in words for w in ws if w not in self.cache}))
        self.pieces.update((p, b"".join([self.cache[w] for w in ws])) for p, ws in zip(fresh, words, strict=True))
        self.held += sum(map(len, fresh))
        get = self.pieces.__getitem__
        return [b"".join([self.special[p].to_bytes(4, "little") if i % 2 else b"".join(map(get, p)) for i, p in enumerate(ps)]) for ps in cut]

    def decode(self, packed: list[bytes]) -> list[str]:
        """The file names no decoder, so tokens are joined by blanks, as the library does."""
        return [" ".join(map(self.tokens.__getitem__, np.frombuffer(p, dtype="<u4").tolist())) for p in packed]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def _path(name: str) -> str:
    """A public tokenizer's file, found on the executor that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, file: str = "word_bpe_49k.json", text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with a binary column of packed token ids."""

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series(tokenizer(_path(file)).encode(texts.tolist()), dtype=object)

    return text_batches(docs).withColumn(into, encoded.asNondeterministic()(F.col(text_col)))


def decode(rows: DataFrame, file: str = "word_bpe_49k.json", ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text that packed ids stand for."""

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        return pd.Series(tokenizer(_path(file)).decode(ids.tolist()), dtype=object)

    return rows.withColumn(into, decoded.asNondeterministic()(F.col(ids_col)))


def round_trip(docs: DataFrame, file: str = "word_bpe_49k.json", text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with packed ids and the text that they stand for, both from one Python worker."""

    @F.pandas_udf("ids binary, decoded string")
    def both(texts: pd.Series) -> pd.DataFrame:
        bpe = tokenizer(_path(file))
        packed = bpe.encode(texts.tolist())
        return pd.DataFrame({"ids": pd.Series(packed, dtype=object), "decoded": pd.Series(bpe.decode(packed), dtype=object)})

    rows = text_batches(docs).withColumn("__both", both.asNondeterministic()(F.col(text_col)))
    return rows.withColumns({ids: F.col("__both.ids"), decoded: F.col("__both.decoded")}).drop("__both")


def _digests() -> list[Column]:
    return [
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    ]


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the packed token ids to train on, their number, and what their round trip is checked by."""
    return round_trip(docs.select("doc_id", "text")).select("doc_id", "ids", *_digests())


def op9_speculative_bpe(docs: DataFrame) -> DataFrame:
    return round_trip(docs.select("doc_id", "text")).select("doc_id", *_digests())
