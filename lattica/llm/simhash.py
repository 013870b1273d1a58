"""SimHash fingerprints and their components, compared bit by bit in vertical blocks.

A bit of a text's fingerprint is set if it is set in over half the hashes of the text's shingles
(three words, ASCII capitals lower-cased, repeats included; a shorter text is one shingle, a
wordless one has fingerprint 0). Fingerprints that differ in RADIUS bits or fewer are linked.

Equal fingerprints are one node. Two nodes that differ in r bits or fewer agree in two of r + 2
parts of their bits, so nodes meet in buckets, one for each two parts; a bucket of more than
SPLIT nodes is split by two parts of its other bits in the same way, after which 16 bits are free
(65,536 nodes at most, for a radius of 2). Buckets are cut into pieces of two blocks of BLOCK nodes, wherever
they run. So each pair meets, work grows with the nodes, and no piece with a hot bucket.

A piece stores the planes of its bits as vertical words of 64 lanes (those in which all nodes agree are left
out). A query flips the planes at its own set bits and adds them up in carry-save counters of a
few words: two planes and the ones make new ones and a carry. Every few planes the blocks in which all
lanes exceed the radius are abandoned. Nodes of small buckets are compared with their neighbours at
each distance, a lane for each pair. Of the links within a piece those that join something new leave it,
between the least nodes of what they join.

Null texts are empty; a null doc_id has no part in the least doc_id of a component (null if there is no other).
Repeated rows are one node and each gets its row. A very long text is hashed whole: memory grows
with the longest text of a task. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import checkpointed, map_texts, written
from lattica.llm.graph import components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Nodes of a bucket on each side of a piece.
BLOCK = 1024
#: Nodes from which a bucket is split by further bits.
SPLIT = 4096
#: Nodes of a bucket up to which its pairs are lanes.
SMALL = 24
#: Planes between looks at which blocks are left.
STEP = 8
#: Rows of small pieces that are compared together.
TOGETHER = 1 << 16

_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)


def fingerprints(texts: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    sizes = []
    for text in texts:
        words = text.lower().split()  # bytes: ASCII letters and white space only
        if len(words) <= n:
            made = [b" ".join(words)] if words else []
        else:
            line = b" ".join(words)
            starts = list(accumulate(map(len, words), lambda at, size: at + size + 1, initial=0))
            made = [line[i : j - 1] for i, j in zip(starts, starts[n:])]
        sizes.append(len(made))
        hashes += [xxh64_intdigest(x, SEED) for x in made]
    size = np.array(sizes, np.int64)
    out = np.zeros(len(texts), _U)
    some = np.flatnonzero(size)
    if len(some):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.cumsum(size) - size
        count = np.add.reduceat(bits, first[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * count > size[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def planes_of(nodes: np.ndarray) -> np.ndarray:
    """(64, words): bit i of all nodes as a row of words of 64 lanes, the last one filled up with zeros."""
    bits = np.unpackbits(nodes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((64, -(-len(nodes) // 64) * 64), np.uint8)
    lanes[:, : len(nodes)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


class Counters:
    """Distances of many lanes in bits of their own words: counts up to the radius, and `over` beyond."""

    def __init__(self, shape: tuple[int, ...], radius: int) -> None:
        self.radius = radius
        self.parts = [np.zeros(shape, _U) for _ in range(max(1, radius.bit_length()))]
        self.over = np.zeros(shape, _U)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Counts two planes up: they and the ones make new ones and a carry of weight two."""
        ones = self.parts[0]
        half = ones ^ x
        carry = (ones & x) | (half & y)
        self.parts[0] = half ^ y
        for k in range(1, len(self.parts)):
            self.parts[k], carry = self.parts[k] ^ carry, self.parts[k] & carry
        self.over |= carry

    def within(self) -> np.ndarray:
        """Words of the lanes that do not exceed the radius."""
        more, same = self.over.copy(), np.full(self.over.shape, _ALL)
        for k in reversed(range(len(self.parts))):
            if self.radius >> k & 1:
                same &= self.parts[k]
            else:
                more |= same & self.parts[k]
                same &= ~self.parts[k]
        return ~more

    def keep(self, cells: np.ndarray) -> None:
        self.parts = [p[cells] for p in self.parts]
        self.over = self.over[cells]


def _lanes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, lane) of the set bits."""
    return np.nonzero(np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def _varying(nodes: np.ndarray) -> list[int]:
    """Bits in which the nodes are not all alike."""
    mask = int(np.bitwise_or.reduce(nodes ^ nodes[0]))
    return [k for k in range(64) if mask >> k & 1]


def near_lanes(x: np.ndarray, radius: int) -> np.ndarray:
    """Which of the differences have no more than `radius` bits."""
    planes = planes_of(x)
    words = np.arange(planes.shape[1])
    count = Counters(words.shape, radius)
    for at in range(0, 64, 2):
        count.add(planes[at, words], planes[at + 1, words])
        if (at + 2) % STEP == 0:
            left = count.within()
            alive = np.flatnonzero(left)
            if len(alive) < len(words):
                count.keep(alive)
                words = words[alive]
    word, lane = _lanes(count.within())
    found = words[word] * 64 + lane
    return found[found < len(x)]


def near_in_block(queries: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node of the block) of all pairs that differ in no more than `radius` bits."""
    bits = _varying(np.concatenate([queries, block]))
    if not bits:
        each = np.arange(len(queries)), np.arange(len(block))
        return np.repeat(each[0], len(block)), np.tile(each[1], len(queries))
    planes = planes_of(block)[bits]
    flips = np.where((queries[:, None] >> np.array(bits, _U)) & _U(1), _ALL, _U(0)).T
    query, word = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(planes.shape[1]), indexing="ij"))
    count = Counters(query.shape, radius)
    none = np.zeros(1, _U)
    for at in range(0, len(bits), 2):
        x = planes[at, word] ^ flips[at, query]
        y = planes[at + 1, word] ^ flips[at + 1, query] if at + 1 < len(bits) else none
        count.add(x, y)
        if (at + 2) % STEP == 0:
            alive = np.flatnonzero(count.within())
            if len(alive) < len(query):  # abandoned blocks are not looked at again
                count.keep(alive)
                query, word = query[alive], word[alive]
    at, lane = _lanes(count.within())
    node = word[at] * 64 + lane
    real = node < len(block)
    return query[at][real], node[real]


class Forest:
    """What is joined among n nodes; join() gives the links that join something new."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = [], []
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            top, bottom = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            parent = np.arange(len(self.root))
            np.minimum.at(parent, top, bottom)
            moved = np.unique(top)
            high.append(moved)
            low.append(parent[moved])
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.root = parent[self.root]
        return (np.concatenate(high), np.concatenate(low)) if high else (np.empty(0, np.int64), np.empty(0, np.int64))


def links_of_small(piece: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the nodes of each piece; pieces' rows lie together."""
    forest = Forest(len(nodes))
    found = []
    for step in range(1, len(nodes)):
        own = np.flatnonzero(piece[step:] == piece[:-step])
        if not len(own):
            break
        near = own[near_lanes(nodes[own] ^ nodes[own + step], radius)]
        found.append(forest.join(near + step, near))
    return tuple(nodes[np.concatenate(x)] if x else nodes[:0] for x in zip(*found)) if found else (nodes[:0], nodes[:0])


def links_of_blocks(nodes: np.ndarray, mine: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks of a bucket, or within one."""
    forest = Forest(len(nodes))
    first = np.flatnonzero(mine == mine[0])
    rest = np.flatnonzero(mine != mine[0])
    block = rest if len(rest) else first
    found = []
    for at in range(0, len(first), 256):
        query, node = near_in_block(nodes[first[at : at + 256]], nodes[block], radius)
        found.append(forest.join(block[node], first[at + query]))
    return tuple(nodes[np.concatenate(x)] for x in zip(*found))


def _bits(value: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))


def _parts(low: int, width: int, n: int) -> list[tuple[int, int]]:
    """(low, width) of n parts of some bits."""
    cuts = [low + width * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys(value: Column, width: int, radius: int) -> tuple[Column, int]:
    """An array of (key, rest): the number of two of radius + 2 parts with their bits, and the other bits; and how many those are at most."""
    parts = _parts(0, width, radius + 2)
    made, most = [], 0
    for number, two in enumerate(combinations(range(len(parts)), 2)):
        key, rest, size, left = F.lit(number).cast("long"), F.lit(0).cast("long"), 0, 0
        for k, (low, w) in enumerate(parts):
            if k in two:
                key, size = F.shiftleft(key, w).bitwiseOR(_bits(value, low, w)), size + w
            else:
                rest, left = F.shiftleft(rest, w).bitwiseOR(_bits(value, low, w)), left + w
        made.append(F.struct(key.alias("key"), rest.alias("rest")))
        most = max(most, left)
    return F.array(*made), most


def _pieces(nodes: DataFrame, radius: int) -> DataFrame:
    """key, sub, low, high, mine, node: the blocks of nodes that meet. Buckets with one node are left out."""
    keys, width = _keys(F.col("node"), 64, radius)
    entries = nodes.select("node", F.explode(keys).alias("k")).select("node", "k.key", "k.rest")
    sizes = checkpointed(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    met = entries.join(sizes, "key")
    plain = met.where(F.col("size") <= SPLIT).select("key", F.lit(-1).cast("long").alias("sub"), "size", "node")
    if sizes.where(F.col("size") > SPLIT).isEmpty():
        shared = plain
    else:
        subs, _ = _keys(F.col("rest"), width, radius)
        large = met.where(F.col("size") > SPLIT).select("key", "node", F.explode(subs).alias("k")).select("key", F.col("k.key").alias("sub"), "node")
        counts = checkpointed(large.groupBy("key", "sub").agg(F.count("*").alias("size")).where("size > 1"))
        shared = plain.unionByName(large.join(counts, ["key", "sub"]).select("key", "sub", "size", "node"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = shared.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.select("key", "sub", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node")


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links that join what nodes (node, a long each once) of no more than `radius` bits apart join."""
    order = ["key", "sub", "low", "high", "mine"]
    pieces = _pieces(nodes, radius).repartition("key", "sub", "low", "high").sortWithinPartitions(*order)

    def links(rows: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        """rows: the order's columns, a column each."""
        new = np.ones(node.shape, bool)
        new[1:] = (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(node)))
        piece = np.cumsum(new) - 1
        few = (size <= SMALL)[piece]
        found = [links_of_small(piece[few], node[few], radius)]
        for k in np.flatnonzero(size > SMALL).tolist():
            own = slice(start[k], start[k] + size[k])
            found.append(links_of_blocks(node[own], rows[4, own], radius))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, node = np.empty((5, 0), np.int64), np.empty(0, _U)
        for batch in batches:
            more = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)])
            rows = np.concatenate([rows, more], axis=1)
            node = np.concatenate([node, batch.column(5).to_numpy().view(_U)])
            if len(node) > TOGETHER:
                last = rows[:4] == rows[:4, -1:]
                cut = int(np.flatnonzero(~last.all(axis=0))[-1]) + 1 if not last.all() else 0
                if cut:
                    yield links(rows[:, :cut], node[:cut])
                    rows, node = rows[:, cut:], node[cut:]
        if len(node):
            yield links(rows, node)

    return pieces.mapInArrow(run, "a long, b long")


def _kernel() -> Callable[[list[bytes]], list]:
    return lambda texts: [fingerprints(texts).view(np.int64)]


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """doc_id, node (the fingerprint as a long), fingerprint (16 hexadecimal digits) and component_id of each row:
    the least doc_id that links lead to."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    prints = written(map_texts(base, "text", [T.StructField("node", T.LongType())], _kernel, keep=["doc_id"]))
    nodes = written(prints.groupBy("node").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(nodes.select("node"), radius))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = checkpointed(rooted.join(named, "root").select("node", "component_id"))
    digits = F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint")
    return prints.join(named, "node").select("doc_id", "node", digits, "component_id")
