"""Alignment of two tokenizers over the same bytes.

A text with a space before it is cut by a byte-level BPE (A) and by sentence pieces (B, which
adds the space itself). Where tokens of both end at one byte a group ends; a group links each of
its A tokens with each of its B tokens. Over all documents, a pair of ids counts the documents
that hold it linked.

mapInPandas encodes, merges the two runs of cumulative ends and writes, for each block of texts
(BLOCK_BYTES; one longer text is a block alone), the different linked pairs of the block with
the number of its documents that hold each, and for each document the places of its pairs in
that list. Only blocks' pairs are shuffled: Spark sums them to counts, takes the largest count of
each id of either side, and joins both back to blocks, whose documents then look up their own
pairs. A pair that stands everywhere is a row for each block; its sums are made before they are
shuffled, and its join can be split. Pairs within a group are expanded in slices, so memory is
bounded by a block, or by one very long text.

Null and empty texts have no tokens, nor have texts whose bytes A or B does not give back (B
writes U+2581 for a space, so it cannot stand in a text): they count 0 and have '' for groups.
Special tokens' strings are plain text. Repeated rows count as documents of their own and get
equal results; ties for the largest count all are the best. Empty tables give none. Result
columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import names_clash, written

#: Bytes of text whose pairs are counted together before they are shuffled.
BLOCK_BYTES = 1 << 22
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 19
#: Linked pairs that are expanded at once.
EXPAND = 1 << 20
#: The pattern by which A cuts texts before it merges bytes (fixed value of the byte-level pre-tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points from which the library of the vocabulary file itself encodes a text.
LONG = 1 << 18

FIELDS = [*[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum")], T.StructField("groups_sha256", T.StringType())]


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(a_path)
        self.whole.encode_special_tokens = True
        letters = _byte_letters()
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        # ids are in the order of merges, so they are ranks as well
        ranks = {self.a_bytes[i]: i for token, i in vocab.items() if token not in special}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Token ids of each text by A and B; none where either does not give the bytes back."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            if not text:
                out.append(([], []))
                continue
            spaced = " " + text
            a = self.fast.encode_ordinary(spaced) if len(text) < LONG else self.whole.encode(spaced, add_special_tokens=False).ids
            want = spaced.encode()
            same = b"".join(map(self.b_bytes.__getitem__, b)) == want and b"".join(map(self.a_bytes.__getitem__, a)) == want
            out.append((a, b) if same else ([], []))
        return out


@cache
def encoders(a_path: str, b_path: str) -> Encoders:
    return Encoders(a_path, b_path)


@cache
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below 100,000, from the right, and how many there are."""
    n = np.arange(100_000)
    return np.stack([48 + n // 10**k % 10 for k in range(4, -1, -1)], axis=1).astype(np.uint8), np.maximum(1, sum((n >= 10**k).astype(np.int8) for k in range(5)))


def written_groups(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of `a1,a2|b1;a3|b2` of groups in order, without a last mark for each document, and
    where each document's end. docs: of each group."""
    n_groups = len(docs)
    in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    n = len(a) + len(b)
    ids, marks, doc = np.empty(n, np.int64), np.empty(n, np.uint8), np.empty(n, np.int64)
    for own, group, place, last, mark in ((a, group_a, np.arange(len(a)) + before_b[group_a], before_a + in_a - 1, ord("|")), (b, group_b, np.arange(len(b)) + (before_a + in_a)[group_b], before_b + in_b - 1, ord(";"))):
        ids[place], doc[place] = own, docs[group]
        own_marks = np.full(len(own), ord(","), np.uint8)
        own_marks[last] = mark
        marks[place] = own_marks
    digits, size = _digits()
    cells = np.empty((n, 6), np.uint8)
    cells[:, :5] = digits[ids]
    cells[:, 5] = marks
    keep = np.arange(6)[None, :] >= 5 - size[ids][:, None]
    ends = np.flatnonzero(np.diff(doc, append=-1))
    keep[ends, 5] = False
    return cells[keep], np.cumsum(keep.sum(axis=1))[ends]


def merged_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ends of a are ends of b, and the other way: both runs ascend, and numpy's stable sort merges two
    runs by two pointers."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    run = both[order]
    met = np.flatnonzero(run[1:] == run[:-1])
    shared = np.zeros(len(both), bool)
    shared[order[met]] = shared[order[met + 1]] = True
    return shared[: len(a)], shared[len(a) :]


def _counted(key: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its numbers."""
    every, at = np.unique(key, return_inverse=True)
    return every, np.bincount(at, often, len(every)).astype(np.int64)


def linked_pairs(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, docs: np.ndarray, bits: int, b_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links): each pair of ids that a document holds linked. A pair is a << b_bits | b, of `bits` bits."""
    one, other = _counted(group_a << 32 | a, np.ones(len(a))), _counted(group_b << 32 | b, np.ones(len(b)))
    group = one[0] >> 32
    first = np.searchsorted(other[0], group << 32)
    width = np.searchsorted(other[0], (group + 1) << 32) - first
    ends = np.cumsum(width)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPAND, "right")))
        w = width[at:to]
        mine = np.repeat(np.arange(at, to), w)
        its = np.arange(len(mine)) - np.repeat(np.cumsum(w) - w, w) + first[mine]
        key = docs[group[mine]] << bits | (one[0][mine] & 0xFFFFFFFF) << b_bits | (other[0][its] & 0xFFFFFFFF)
        found.append(_counted(key, one[1][mine] * other[1][its]))
        if len(found) > 16:
            found = [_counted(*(np.concatenate(x) for x in zip(*found)))]
        at = to
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    key, links = found[0] if len(found) == 1 else _counted(*(np.concatenate(x) for x in zip(*found)))
    return key >> bits, key & ((1 << bits) - 1), links


def align(texts: list[str], known: Encoders) -> tuple[dict[str, list], list[np.ndarray], list[np.ndarray]]:
    """Numbers and digest of each text's groups, its linked pairs (ascending) and how often each is linked."""
    b_bits = (len(known.b_bytes) - 1).bit_length()
    bits = (len(known.a_bytes) - 1).bit_length() + b_bits
    made = known.encode(texts)
    n = len(texts)
    n_a, n_b = (np.array([len(x[k]) for x in made], np.int64) for k in (0, 1))
    a, b = (np.fromiter((i for x in made for i in x[k]), np.int64, int(m.sum())) for k, m in ((0, n_a), (1, n_b)))
    doc_a = np.repeat(np.arange(n), n_a)
    # the texts one after the other are one run of bytes, as a text's last ends are those of A and of B
    end_a, end_b = merged_ends(np.cumsum(known.a_size[a]), np.cumsum(known.b_size[b]))
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    docs = doc_a[end_a]
    n_groups = np.bincount(docs, minlength=n)
    of_groups = np.bincount(group_a, minlength=len(docs)) * np.bincount(group_b, minlength=len(docs))
    n_links = np.bincount(docs, of_groups, n).astype(np.int64)
    digests = [""] * n
    if len(docs):
        data, ends = written_groups(a, b, group_a, group_b, docs)
        view, start = memoryview(data), 0
        for i, end in zip(np.flatnonzero(n_groups).tolist(), ends.tolist(), strict=True):
            digests[i] = hashlib.sha256(view[start:end]).hexdigest()
            start = end
    doc, pair, links = linked_pairs(a, b, group_a, group_b, docs, bits, b_bits)
    cut = np.searchsorted(doc, np.arange(1, n))
    numbers = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests}
    return numbers, np.split(pair, cut), np.split(links, cut)


def _in_blocks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


#: Types that pass pandas unchanged, nulls included; columns of others pass as one JSON text.
_PLAIN = (T.StringType, T.BooleanType, T.DateType, T.DecimalType, T.BinaryType)


def _aligned(docs: DataFrame, keep: list[str], a_path: str, b_path: str) -> DataFrame:
    """Rows of documents (with `places` of their pairs in the block's list, and `links`, empty where all are one)
    and, for each block, a row with `pairs` and the number of `holders` of each."""
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType([T.StructField("__block", T.LongType()), *[T.StructField(f.name, f.dataType) for f in kept], *[f for f in FIELDS if f.name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")], *[T.StructField(f"__{n}", T.BinaryType()) for n in ("places", "links")], T.StructField("__pairs", T.ArrayType(T.LongType())), T.StructField("__holders", T.ArrayType(T.LongType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        known = encoders(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        for frame in frames:
            texts = [x if isinstance(x, str) else "" for x in frame["__text"]]
            sizes = [len(x) + 16 for x in texts]
            for start, end in _in_blocks(sizes, BLOCK_BYTES):
                numbers: dict[str, list] = {}
                pairs: list[np.ndarray] = []
                links: list[np.ndarray] = []
                for i, j in _in_blocks(sizes[start:end], SLICE_BYTES):
                    some, own, often = align(texts[start + i : start + j], known)
                    for name, values in some.items():
                        numbers.setdefault(name, []).extend(values)
                    pairs += own
                    links += often
                every, at, holders = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
                places = np.split(at.astype(np.uint32), np.cumsum([len(p) for p in pairs])[:-1])
                yield pd.DataFrame(numbers | {"__block": block, **{c: frame[c].iloc[start:end].to_numpy() for c in keep}, "__places": [p.tobytes() for p in places], "__links": [x.astype(np.uint32).tobytes() if (x > 1).any() else b"" for x in links], "__pairs": None, "__holders": None})
                yield pd.DataFrame({"__block": [block], **dict.fromkeys([*keep, *numbers]), "__places": [None], "__links": [None], "__pairs": [every], "__holders": [holders]})
                block += 1

    return docs.select(*[F.col(f"`{c}`") for c in keep], "__text").mapInPandas(run, schema)


def pair_counts(rows: DataFrame, b_bits: int) -> DataFrame:
    """pair, a, b, n (documents that hold it linked), and the largest n of its a and of its b."""
    each = rows.groupBy("pair").agg(F.sum("holders").alias("n"))
    each = written(each.select("pair", F.shiftright("pair", b_bits).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << b_bits) - 1)).alias("b"), "n"))
    for side in ("a", "b"):
        each = each.join(each.groupBy(side).agg(F.max("n").alias(f"most_{side}")), side)
    return each


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds FIELDS to each row: n_best and n_best_b count links whose pair is the commonest of its A id and of
    its B id, count_sum adds up the counts of all links. keep: columns that stay (all, unless a result column has the name)."""
    keep = [c for c in (names_clash(docs, FIELDS) if keep is None else keep) if c.lower() not in {f.name.lower() for f in FIELDS}]
    simple = [c for c in keep if isinstance(docs.schema[c].dataType, _PLAIN)]
    rest = T.StructType([docs.schema[c] for c in keep if c not in simple])
    key = docs.select(*[F.col(f"`{c}`") for c in simple], F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in rest])).alias("__rest") if len(rest) else F.lit(None).cast("string").alias("__rest"), F.col(f"`{text}`").cast("string").alias("__text"))
    made = written(_aligned(key, [*simple, "__rest"], a_path, b_path))
    b_bits = (len(encoders(a_path, b_path).b_bytes) - 1).bit_length()
    rows = made.where("__pairs is not null").select(F.col("__block").alias("block"), F.posexplode(F.arrays_zip("__pairs", "__holders")).alias("at", "z")).select("block", "at", F.col("z.__pairs").alias("pair"), F.col("z.__holders").alias("holders"))
    counts = pair_counts(rows, b_bits).select("pair", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))
    told = rows.select("block", "at", "pair").join(counts, "pair").select("block", "at", "n", "best_a", "best_b")
    own = made.where("__pairs is null").drop("__pairs", "__holders")
    made_names = [f.name for f in own.schema.fields if f.name not in ("__block", "__places", "__links")]
    out = T.StructType([*[own.schema[n] for n in made_names], *[f for f in FIELDS if f.name in ("n_best", "n_best_b", "count_sum")]])

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        values = np.zeros((3, size), np.int64)
        at = right.column("at").to_numpy()
        for k, name in enumerate(("best_a", "best_b", "n")):
            values[k, at] = right.column(name).to_numpy()
        sums = []
        for places, links in zip(left.column("__places").to_pylist(), left.column("__links").to_pylist(), strict=True):
            own_values = values[:, np.frombuffer(places, np.uint32)]
            sums.append((own_values * np.frombuffer(links, np.uint32).astype(np.int64)).sum(axis=1) if links else own_values.sum(axis=1))
        told = np.array(sums, np.int64).reshape(-1, 3)
        return pa.table([left.column(n) for n in made_names] + [pa.array(told[:, k], pa.int64()) for k in range(3)], names=[*made_names, "n_best", "n_best_b", "count_sum"])

    both = own.groupBy("__block").cogroup(told.groupBy("block")).applyInArrow(look_up, out)
    back = F.from_json("__rest", rest) if len(rest) else None
    return both.select(*[F.col(f"`{c}`") if c in simple else back[c].alias(c) for c in keep], *[f.name for f in FIELDS])
