"""BPE encoding and decoding with a contiguous rank array.

The words of a chunk that no cache knows are laid out as a matrix of parts beside a matrix
of the ranks of adjacent parts. Each step scans every word's ranks for the minimum (leftmost
first), deletes the boundary there and refreshes the two neighbouring ranks. Words over
LONG parts, for which repeated scans would be quadratic, use a heap with the same order.

A tokenizer file holds a vocabulary, merges, a normaliser (NFC, white space to one space,
lower case) and a word pattern; its path is a parameter and must be readable on executors.
Letters, numbers and lower case are those of the library (Unicode 16 patterns and Unicode 17
lower-casing over this Python's tables, of Unicode 15.1), so that every code point is split as
it splits it. Null and empty texts have no ids and decode to "". Very long texts and words are
encoded whole: memory grows with the longest text of a task, time with its length (times its
logarithm within a long word). Equal ranks merge leftmost first. Equal rows get equal results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattica.llm.common import map_texts

#: Most parts of a word that the rank arrays take.
LONG = 64
#: Words a task remembers; at more it starts anew, with equal results.
CACHE_WORDS = 400_000

#: The word pattern of the file that is compiled to explicit sets of code points.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_NONE = np.int32(2**31 - 1)

# What the library's Unicode 16 patterns and Unicode 17 lower-casing know beyond Unicode 15.1.
#: First and last code point of further letters.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
#: First and last code point of further numbers.
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: First and last further capital, and the lower case of the first.
CAPITALS_17 = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB),
    (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: White space of the pattern.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_LOWER_17 = {c: to + c - first for first, last, to in CAPITALS_17 for c in range(first, last + 1)}
_CAPITAL_17 = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in CAPITALS_17) + "]")


def _set(category: str, more: tuple[tuple[int, int], ...], below: int) -> str:
    """A character class of the code points whose category begins so, and of further ranges."""
    ranges: list[list[int]] = []
    extra = {c for a, b in more for c in range(a, b + 1)}
    for c in range(below):
        if unicodedata.category(chr(c))[0] == category or c in extra:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


_BEYOND = re.compile("[\u0250-\U0010ffff]")


@lru_cache(maxsize=2)
def _words(below: int) -> re.Pattern:
    """The word pattern over explicit sets, for texts of code points below a bound."""
    letters, numbers = _set("L", LETTERS_16, below), _set("N", NUMBERS_16, below)
    return re.compile(rf"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{numbers}]|[^{SPACES}{letters}{numbers}]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free code point from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBPE:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in {**vocabulary, **self.added}.items()}
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        written = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = _words(0x110000) if written == _WORD_PATTERN else regex.compile(written)
        self.quick = _words(0x250) if written == _WORD_PATTERN else self.pattern
        letters = byte_letters()
        self.inner = np.array([vocabulary[x] for x in letters], np.int32)
        self.last = np.array([vocabulary[x + self.suffix] for x in letters], np.int32)
        pairs = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.append((vocabulary[a] << 32 | vocabulary[b], rank, vocabulary[a + b]))
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs], np.int32)
        self.merged = np.empty(len(pairs), np.int32)
        for _, rank, made in pairs:
            self.merged[rank] = made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; negative ids pair with nothing."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for high in (4, 6, 8, 10, 12, 16, 24, 32, LONG):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for at in range(0, len(rows), 1 << 14):
                part = rows[at : at + (1 << 14)]
                for i, ids in zip(part.tolist(), self._array(words, part, sizes[part], high), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self._heap(words[i])
        return out

    def _array(self, words: list[bytes], rows: np.ndarray, sizes: np.ndarray, width: int) -> Iterable[np.ndarray]:
        data = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows.tolist()), np.uint8).reshape(len(rows), width)
        columns = np.arange(width)
        final = np.where(columns < sizes[:, None], self.inner[data], -1).astype(np.int32)
        each = np.arange(len(rows))
        final[each, sizes - 1] = self.last[data[each, sizes - 1]]
        parts = np.concatenate([final, np.full((len(rows), 2), -1, np.int32)], axis=1)
        ranks = np.full((len(rows), width + 1), _NONE, np.int32)
        ranks[:, : width - 1] = self.rank(parts[:, : width - 1], parts[:, 1:width])
        live = each
        while len(live):
            at = ranks.argmin(axis=1)
            line = np.arange(len(live))
            best = ranks[line, at]
            some = best != _NONE
            if not some.all():
                final[live[~some]] = parts[~some, :width]
                live, parts, ranks, at, best = live[some], parts[some], ranks[some], at[some], best[some]
                line = np.arange(len(live))
                if not len(live):
                    break
            # delete the boundary after `at`: what stands right of it moves one place left
            moved = columns[None, :] + (columns[None, :] > at[:, None])
            parts[:, :width] = np.take_along_axis(parts, moved, 1)
            moved = columns[None, :] + (columns[None, :] >= at[:, None])
            ranks[:, :width] = np.take_along_axis(ranks, moved, 1)
            parts[line, at] = self.merged[best]
            ranks[line, at] = self.rank(parts[line, at], parts[line, at + 1])
            left = at > 0
            ranks[line[left], at[left] - 1] = self.rank(parts[line[left], at[left] - 1], parts[line[left], at[left]])
        left = (final >= 0).sum(axis=1)
        return (final[i, :n] for i, n in enumerate(left.tolist()))

    def _heap(self, word: bytes) -> np.ndarray:
        data = np.frombuffer(word, np.uint8)
        ids = self.inner[data]
        ids[-1] = self.last[data[-1]]
        first = self.rank(ids[:-1], ids[1:])
        parts, after, before = ids.tolist(), [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)
        known: dict[int, int] = {}

        def push(i: int, j: int) -> None:
            key = parts[i] << 32 | parts[j]
            if key not in known:
                known[key] = int(self.rank(np.array([parts[i]]), np.array([parts[j]]))[0])
            if known[key] != _NONE:
                heapq.heappush(heap, (known[key], i, parts[i], parts[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([p for p in parts if p >= 0], np.int32)

    def normalize(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-casing goes by code point: no final form
            text = _CAPITAL_17.sub(lambda m: chr(_LOWER_17[ord(m[0])]), text)
        return text.lower()

    def words(self, text: str) -> list[str]:
        text = self.normalize(text)
        return (self.pattern if _BEYOND.search(text) else self.quick).findall(text)

    def pieces(self, text: str) -> Iterable[tuple[str, bool]]:
        """The text's words, and the added tokens that stand in it as such."""
        at = 0
        for m in self.split_added.finditer(text) if self.split_added else ():
            yield from ((w, False) for w in self.words(text[at : m.start()]))
            yield m[0], True
            at = m.end()
        yield from ((w, False) for w in self.words(text[at:]))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        memory = Memory(self)
        return [np.frombuffer(ids, "<u4").tolist() for ids, _ in memory.encode(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.token[i] for i in ids)


class Memory:
    """Encodes texts, remembering the words it has met."""

    def __init__(self, bpe: WordBPE) -> None:
        self.bpe = bpe
        self.known: dict[str, tuple[bytes, str]] = {}
        self.special = {f"\0{t}": i for t, i in bpe.added.items()}  # no word holds NUL and a token's text

    def _learn(self, words: set[str]) -> None:
        token = self.bpe.token
        for word in words & self.special.keys():
            self.known[word] = (np.array([self.special[word]], "<u4").tobytes(), word[1:])
        plain = [w for w in words if w not in self.special]
        for word, ids in zip(plain, self.bpe.encode_words([w.encode() for w in plain]), strict=True):
            self.known[word] = (ids.astype("<u4").tobytes(), " ".join([token[i] for i in ids.tolist()]))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the decoded text."""
        bpe = self.bpe
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        split = []
        for text in texts:
            if any(token in text for token in bpe.added):
                split.append([f"\0{w}" if added else w for w, added in bpe.pieces(text)])
            else:
                split.append(bpe.words(text))
        got = [list(map(known.get, words)) for words in split]
        new = {w for words, found in zip(split, got, strict=True) if None in found for w, x in zip(words, found, strict=True) if x is None}
        self._learn(new)
        out = []
        for words, found in zip(split, got, strict=True):
            if None in found:
                found = [known[w] for w in words]
            out.append((b"".join([x[0] for x in found]), " ".join([x[1] for x in found])))
        return out


@lru_cache(maxsize=2)
def _loaded(path: str) -> WordBPE:
    return WordBPE(path)


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
TOKENS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]


def _kernel(path: str, digest: bool) -> Callable[[], Callable]:
    def make() -> Callable[[list[bytes]], list]:
        memory = Memory(_loaded(path))

        def kernel(texts: list[bytes]) -> list[list]:
            made = memory.encode([t.decode("utf-8", "replace") for t in texts])
            n = [len(ids) // 4 for ids, _ in made]
            if digest:
                return [n, [_sha256(ids) for ids, _ in made], [_sha256(shown.encode()) for _, shown in made]]
            return [n, [np.frombuffer(ids, "<i4") for ids, _ in made], [shown for _, shown in made]]

        return kernel

    return make


def bpe_tokens(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, ids and decoded to each row."""
    return map_texts(docs, text, TOKENS, _kernel(path, False), keep)


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As bpe_tokens, with digests of the ids and of the decoded text in their stead."""
    return map_texts(docs, text, DIGESTS, _kernel(path, True), keep)
