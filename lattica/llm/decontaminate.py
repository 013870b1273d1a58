"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard holds all texts of a chunk. Its words become codes of the benchmark's vocabulary (0 if
not in it; words are told apart by hashes of 128 bits). No match crosses a word outside that
vocabulary, so the shard's suffix array holds every suffix that begins in a run of known words
as long as the shortest window, sorted to the depth of a window. Every suffix of every benchmark
item that holds a window is searched in it by bisection. What it finds are the places where at
least a window stands; those that begin a match (the words before differ) are extended to the
right, word by word, to the longest verbatim match.

The benchmark reaches the tasks as broadcast blocks of at most BLOCK_BYTES of text, read one
after the other: no block grows with the data, and a task unites the hits of all blocks. A block
is a few arrays, so a further one costs a shard their reading and its own search.
Rows never meet, so there is no shuffle. Null and empty texts have no words and no hits;
items without words have no windows; items that share a text all occur; a null item id shows
as "null". Equal rows get equal results. A very long text is searched whole, in memory that
grows with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import PLAIN, Words, map_texts, span_hashes, words_of

#: Consecutive item words in a window; a shorter item is one window.
WINDOW = 10
#: Most bytes of benchmark text in a broadcast block (one longer item is a block alone).
BLOCK_BYTES = 16 << 20


@dataclass
class Block:
    """Benchmark items as codes: two hashes of each word of the vocabulary, item ids, codes (0 after each item),
    and the suffixes that hold a window: where they begin, their item and place in it, words of the window."""

    vocabulary: np.ndarray
    second: np.ndarray
    ids: list[str]
    codes: np.ndarray
    start: np.ndarray
    item: np.ndarray
    place: np.ndarray
    size: np.ndarray


def _spread(codes: np.ndarray, doc: np.ndarray, n: int, window: int) -> np.ndarray:
    """The codes with a 0 after each of n texts, and `window` more at the end."""
    out = np.zeros(len(codes) + n + window, np.int64)
    out[np.arange(len(codes)) + doc] = codes
    return out


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of codes as bytes that sort as the codes do."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def make_block(items: list[tuple[str, bytes]], window: int) -> Block:
    words = words_of([text for _, text in items], PLAIN)
    vocabulary, first, codes = np.unique(words.hashes, return_index=True, return_inverse=True)
    second = span_hashes(words.data, words.starts, words.ends, 1)[first]
    n = np.diff(words.first)
    size = np.minimum(n, window)
    held = np.where(n > 0, n - size + 1, 0)
    item = np.repeat(np.arange(len(items)), held)
    place = np.arange(len(item)) - np.repeat(np.cumsum(held) - held, held)
    return Block(vocabulary, second, [i for i, _ in items], _spread(codes + 1, words.doc, len(items), window), words.first[item] + item + place, item, place, size[item])


def codes_of(words: Words, block: Block) -> np.ndarray:
    """Each word's code in the block's vocabulary, or 0."""
    place = np.minimum(np.searchsorted(block.vocabulary, words.hashes), len(block.vocabulary) - 1)
    known = np.flatnonzero(block.vocabulary[place] == words.hashes)
    same = span_hashes(words.data, words.starts[known], words.ends[known], 1) == block.second[place[known]]
    codes = np.zeros(len(words.hashes), np.int64)
    codes[known[same]] = place[known[same]] + 1
    return codes


def suffix_array(codes: np.ndarray, shortest: int, window: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes that begin with `shortest` known words, sorted by their first `window` codes, and those as keys."""
    known = np.zeros(len(codes) + 2, bool)
    known[1:-1] = codes != 0
    edges = np.flatnonzero(known[1:] != known[:-1])
    begin, held = edges[0::2], edges[1::2] - edges[0::2] - shortest + 1
    begin, held = begin[held > 0], held[held > 0]
    starts = np.repeat(begin - np.cumsum(held) + held, held) + np.arange(held.sum())
    rows = codes[starts[:, None] + np.arange(window)]
    rows[np.cumsum(rows == 0, axis=1) > 0] = 0  # nothing beyond a run's end
    bits = int(largest).bit_length()
    columns = []
    for at in range(0, window, 63 // bits):  # neighbouring codes packed to a number
        packed = np.zeros(len(rows), np.int64)
        for column in rows[:, at : at + 63 // bits].T:
            packed = packed << bits | column
        columns.append(packed)
    order = np.lexsort(columns[::-1])
    return starts[order], _keys(rows[order])


def search_shard(words: Words, block: Block, window: int) -> np.ndarray:
    """The longest verbatim matches of at least a window: rows (document, document word, item, item word, words)."""
    none = np.empty((0, 5), np.int64)
    if not len(block.start) or not len(words.hashes):
        return none
    n_docs = len(words.first) - 1
    codes = _spread(codes_of(words, block), words.doc, n_docs, window)
    suffixes, keys = suffix_array(codes, int(block.size.min()), window, len(block.vocabulary))
    if not len(suffixes):
        return none
    asked = block.codes[block.start[:, None] + np.arange(window)]
    beyond = np.arange(window) >= block.size[:, None]
    asked[beyond] = 0
    low = np.searchsorted(keys, _keys(asked), "left")
    asked[beyond] = 0xFFFFFFFF
    found = np.maximum(np.searchsorted(keys, _keys(asked), "right") - low, 0)
    query = np.repeat(np.arange(len(found)), found)
    at = suffixes[np.repeat(low - np.cumsum(found) + found, found) + np.arange(found.sum())]
    begins = (block.place[query] == 0) | (codes[at - 1] != block.codes[block.start[query] - 1])
    query, at = query[begins], at[begins]
    start, length = block.start[query], block.size[query].copy()
    going = np.arange(len(at))
    while len(going):
        code = codes[at[going] + length[going]]
        going = going[(code != 0) & (code == block.codes[start[going] + length[going]])]
        length[going] += 1
    first = words.first[:-1] + np.arange(n_docs)
    doc = np.searchsorted(first, at, "right") - 1
    return np.stack([doc, at - first[doc], block.item[query], block.place[query], length], axis=1)


MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()), T.StructField("item_word", T.LongType()), T.StructField("words", T.LongType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType(), False)),
    T.StructField("matches", T.ArrayType(MATCH, False)),
]


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, limit: int) -> Iterator[Block]:
    """The benchmark's items, block by block; the driver holds one block at a time."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")), F.col(f"`{text}`").cast("string")).where(F.col(f"`{text}`").isNotNull())
    items: list[tuple[str, bytes]] = []
    size = 0
    for name, value in rows.toLocalIterator():
        value = value.encode()
        if items and size + len(value) > limit:
            yield make_block(items, window)
            items, size = [], 0
        items.append((name, value))
        size += len(value)
    yield make_block(items, window)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, n_hit (words inside any occurring window), items (sorted ids) and the longest matches."""
    context = docs.sparkSession.sparkContext
    parts = [context.broadcast(b) for b in _blocks(benchmark, item_id, item_text, window, block_bytes)]

    def make() -> Callable[[list[bytes]], list]:
        def kernel(texts: list[bytes]) -> list[list]:
            words = words_of(texts, PLAIN)
            n_words = np.diff(words.first)
            base = words.first[:-1] + np.arange(len(texts))
            cover = np.zeros(len(words.hashes) + len(texts) + 1, np.int64)
            items: list[set[str]] = [set() for _ in texts]
            matches: list[list[tuple]] = [[] for _ in texts]
            for part in parts:
                block = part.value
                rows = search_shard(words, block, window)
                np.add.at(cover, base[rows[:, 0]] + rows[:, 1], 1)
                np.add.at(cover, base[rows[:, 0]] + rows[:, 1] + rows[:, 4], -1)
                for d, w, i, p, n in rows.tolist():
                    items[d].add(block.ids[i])
                    matches[d].append({"item_id": block.ids[i], "doc_word": w, "item_word": p, "words": n})
                if len(parts) > 1:  # a task holds one block at a time
                    del block
                    part.__dict__.pop("_value", None)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
            return [n_words.tolist(), (hit[base + n_words] - hit[base]).tolist(), [sorted(x) for x in items], [sorted(x, key=lambda m: (m["doc_word"], m["item_id"], m["item_word"])) for x in matches]]

        return kernel

    return map_texts(docs, text, FIELDS, make, keep)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    own = docs.columns
    marked = find_overlaps(docs.withColumns({"__row": F.struct(*[F.col(f"`{c}`") for c in own])}), benchmark, text, keep=["__row"], **options)
    return marked.where("n_hit = 0").select("__row.*")
