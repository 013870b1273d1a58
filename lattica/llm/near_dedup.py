"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Words are runs of digits, letters (ASCII and Latin-1 capitals lower-cased) and code points
from U+0080; a text's shingles are its runs of five words, weighted by how often each occurs.
Fewer words make one shingle; a text of none but other characters is one shingle; null and
empty texts have none and are a class each.

Each shingle is a Poisson process whose rate is its weight; an arrival hits a random register
and the earliest arrival there names its shingle. A text's processes stop once they are later
than all its registers, so registers agree with the probability Jaccard of two texts; registers
of the same shingles without their counts agree with the plain Jaccard. Bands of either kind
of registers make buckets. A link needs, by exact comparison of the shingles, a probability
Jaccard or a plain Jaccard of 0.8. It is looked for in two steps:

1. In each bucket the text with most bucket mates overall is compared with all others there.
2. In buckets that still hold several classes, texts of different classes are compared by
   their registers, in blocks of bounded size (a bucket of n texts becomes (n / BLOCK)^2 / 2
   pieces of work, wherever they run), first by the banded ones, then by LONG further ones.
   Only pairs that agree, in registers of one kind, in at least the share that 0.8 less four
   standard errors leaves are compared exactly.

So no pair of a bucket is lost that a link does not already join, and what leaves a block are
near misses only; each leaves the least bucket that its texts share. Comparisons within an
open bucket grow with the square of its texts, in work but not in rows: its pieces are of
bounded size. Equal texts are one node from the start, so copies make no pairs; a node is a
64-bit hash of the text, and among 1e11 different texts about 270 pairs would be taken for
copies. A class's id is its least doc_id (nulls last). Repeated rows belong to one class and each
gets a row; of texts with as many bucket mates the one with the greatest hash is compared first. A very
long text is sketched whole: memory grows with the longest text of a task. With 32 bands of 6
registers of each kind a pair at exactly 0.8 by either Jaccard shares no bucket with
probability 6e-5 at most, one at 0.85 with 3e-7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import PLAIN, checkpointed, chunks, map_texts, mix64, span_hashes, window_hashes, words_of, written
from lattica.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
#: Texts of a bucket that a piece of work holds on each side.
BLOCK = 1000
#: Registers of the sketches that rule out near misses in open buckets.
LONG = 512
#: Slots of the table by which rows are sorted out before a join; with more keys than half of them it is left away.
SLOTS = 1 << 21

_U = np.uint64


def weighted_shingles(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) in no set order."""
    words = words_of(texts, PLAIN, fold_latin=True)
    size = np.diff(words.first)
    doc = words.doc
    windows = window_hashes(words.hashes, n)
    own = np.flatnonzero(doc[: len(windows)] == doc[n - 1 :]) if len(windows) else np.empty(0, np.int64)
    docs, hashes = [doc[own]], [windows[own]]
    for k in range(1, n):
        few = np.flatnonzero(size == k)
        if len(few):
            total = np.zeros(len(few), _U)
            for i in range(k):
                total = mix64(total + words.hashes[words.first[few] + i])
            docs.append(few)
            hashes.append(total + _U(k))
    bare = [i for i in np.flatnonzero(size == 0).tolist() if texts[i]]
    if bare:
        docs.append(np.array(bare))
        hashes.append(np.concatenate([span_hashes(np.frombuffer(texts[i], np.uint8), np.array([0]), np.array([len(texts[i])])) for i in bare]))
    doc, shingle = np.concatenate(docs), np.concatenate(hashes)
    key = shingle ^ mix64(doc.astype(_U) + _U(1))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    at = order[first]
    return doc[at], shingle[at], np.diff(np.append(first, len(key)))


def prob_min_hash(n_texts: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """Per text, the shingle of the earliest arrival in each register."""
    times = np.full(n_texts * registers, np.inf)
    winner = np.zeros(n_texts * registers, _U)
    elements = np.bincount(doc, minlength=n_texts)
    alone = elements[doc] == 1
    winner.reshape(n_texts, registers)[doc[alone]] = shingle[alone, None]
    doc, shingle, rate = doc[~alone], shingle[~alone], weight[~alone].astype(np.float64)
    now = np.zeros(len(doc))
    k = 0
    while len(doc):
        steps = int(np.clip(8192 // len(doc), 1, 64))
        salts = mix64(np.arange(k + 1, k + steps + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
        k += steps
        bits = mix64(shingle[:, None] ^ salts)
        waits = -np.log(((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        waits[:, 0] += now
        arrivals = np.cumsum(waits, axis=1)
        now = arrivals[:, -1]
        slot = (doc[:, None] * registers + (mix64(bits) % _U(registers)).astype(np.int64)).ravel()
        arrivals = arrivals.ravel()
        early = np.flatnonzero(arrivals < times[slot])
        slot, arrivals, named = slot[early], arrivals[early], early // steps
        np.minimum.at(times, slot, arrivals)
        won = arrivals == times[slot]
        winner[slot[won]] = shingle[named[won]]
        latest = times.reshape(n_texts, registers).max(axis=1)
        going = now < latest[doc]
        if not going.all():
            doc, shingle, rate, now = doc[going], shingle[going], rate[going], now[going]
    return winner.reshape(n_texts, registers)


def plain_min_hash(winner: np.ndarray, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The registers that prob_min_hash makes of the shingles without their counts, from those with them, and which texts repeat a shingle."""
    n, registers = winner.shape
    again = np.bincount(doc[weight > 1], minlength=n) > 0
    own = again[doc]
    place = np.cumsum(again) - 1
    out = winner.copy()
    out[again] = prob_min_hash(int(again.sum()), place[doc[own]], shingle[own], np.ones(int(own.sum())), registers)
    return out, again


def band_hashes(winner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    split = winner.reshape(len(winner), bands, rows)
    total = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=_U)), (len(winner), bands)).copy()
    for i in range(rows):
        total = mix64(total * _U(0x2545F4914F6CDD1D) + split[:, :, i])
    return total


def jaccards(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard and plain Jaccard of two (sorted shingles, counts)."""
    union, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    wa, wb = np.zeros(len(union)), np.zeros(len(union))
    wa[at[: len(a[0])]] = a[1]
    wb[at[len(a[0]) :]] = b[1]
    shared = (wa > 0) & (wb > 0)
    total = 0.0
    for (x, y), n in zip(*np.unique(np.stack([wa[shared], wb[shared]], axis=1), axis=0, return_counts=True), strict=True):
        total += n / np.maximum(wa / x, wb / y).sum()
    return total, shared.sum() / max(1, len(union))


def _sketch_kernel(bands: int, rows: int) -> Callable[[], Callable]:
    def make() -> Callable[[list[bytes]], list]:
        def kernel(texts: list[bytes]) -> list:
            doc, shingle, weight = weighted_shingles(texts)
            some = np.bincount(doc, minlength=len(texts))
            winner = prob_min_hash(len(texts), doc, shingle, weight, bands * rows)
            plain, again = plain_min_hash(winner, doc, shingle, weight)
            made = np.concatenate([band_hashes(winner, bands, rows), band_hashes(plain, bands, rows)], axis=1).view(np.int64)
            own = np.ones(made.shape, bool)
            own[~again, bands:] = False  # without repeated shingles both are the same
            made = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(own.sum(axis=1))]).astype(np.int32), made[own])
            kinds = (mix64(x).astype(np.uint8) for x in (winner, plain))
            short = [x.tobytes() + (y.tobytes() if k else b"") for x, y, k in zip(*kinds, again, strict=True)]
            return [some, made, short]

        return kernel

    return make


def _profile(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    made = np.frombuffer(shingles, _U)
    return made, np.frombuffer(counts, np.uint32) if counts else np.ones(len(made), np.uint32)


def _verify(pairs: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    side = lambda n: profiles.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}"), F.col("counts").alias(f"c{n}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "ca", "sb", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(i, 64) for batch in batches for i in range(0, batch.num_rows, 64)):
            rest = (c.to_pylist() for c in part.columns[2:])
            good = pa.array([max(jaccards(_profile(sa, ca), _profile(sb, cb))) >= similarity for sa, ca, sb, cb in zip(*rest, strict=True)], pa.bool_())
            yield part.select(["a", "b"]).filter(good)

    return both.mapInArrow(run, "a long, b long")


def maybe_among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose key (a long hash) is not wanted, to spare a join's shuffle: a table of
    SLOTS slots says which keys could be. The join that decides has to follow."""
    if wanted.count() > SLOTS // 2:
        return rows
    slots = np.zeros(SLOTS, bool)  # at most SLOTS / 2 rows reach the driver
    slots[wanted.select(F.pmod(key, F.lit(SLOTS)).alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True
    shared = rows.sparkSession.sparkContext.broadcast(slots)
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value[batch.column(at).to_numpy() % SLOTS]))

    return rows.mapInArrow(run, rows.schema)


def _profiles(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles, counts of the given nodes. Copies become one before the shuffle, which moves each
    text with bucket mates once (every different text once if there are more than SLOTS / 2 of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, 1, 1 << 19):
                doc, shingle, weight = weighted_shingles(texts)
                order = np.lexsort((shingle, doc))
                cut = np.searchsorted(doc[order], np.arange(len(texts) + 1))
                shingle, weight = shingle[order], weight[order].astype(np.uint32)
                spans = list(zip(cut[:-1], cut[1:], strict=True))
                counts = [weight[i:j].tobytes() if (weight[i:j] > 1).any() else b"" for i, j in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle[i:j].tobytes() for i, j in spans], pa.binary()), pa.array(counts, pa.binary())], names=["node", "shingles", "counts"])

    nodes = checkpointed(nodes.select("node").distinct())
    own = maybe_among(base.select("node", "text"), "node", nodes).dropDuplicates(["node"]).join(nodes, "node", "left_semi")
    return own.select("node", "text").mapInArrow(run, "node long, shingles binary, counts binary")


def _both_kinds(sketches: list[bytes], n: int) -> np.ndarray:
    """Sketches as (text, kind, register); where no shingle is repeated both kinds are the same and one is kept."""
    return np.frombuffer(b"".join(x if len(x) > n else x + x for x in sketches), np.uint8).reshape(len(sketches), 2, n)


def _near_misses(members: DataFrame, similarity: float, bands: int, rows: int) -> DataFrame:
    """members: bucket, size, node, root, short, long, bands. Pairs (a, b) of different roots that their registers do not rule out."""
    least, least_long = (similarity - 4 * (similarity * (1 - similarity) / n) ** 0.5 for n in (bands * rows, LONG))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = own.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    own = own.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "mine").select("bucket", "low", "high", "mine", "node", "root", "short", "long", "bands")

    def compare(rows_: list[tuple]) -> Iterator[tuple[int, int]]:
        bucket, low, high = rows_[0][:3]
        mine = np.array([r[3] for r in rows_])
        node, root = (np.array([r[k] for r in rows_], np.int64) for k in (4, 5))
        short, long = (_both_kinds([r[k] for r in rows_], n) for k, n in ((6, bands * rows), (7, LONG)))
        for i in range(len(rows_)):
            if mine[i] != low:
                break
            start = i + 1 if low == high else int(np.searchsorted(mine, high))
            to = start + np.flatnonzero(root[start:] != root[i])
            if not len(to):
                continue
            same = short[to] == short[i]
            near = to[(same.mean(axis=2) >= least).any(axis=1)]
            for j in near[((long[near] == long[i]).mean(axis=2) >= least_long).any(axis=1)].tolist():
                if np.intersect1d(rows_[i][8], rows_[j][8]).min() == bucket:  # one of the buckets they share
                    yield max(node[i], node[j]), min(node[i], node[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            bands_ = batch.column(8)
            cut = bands_.offsets.to_numpy()
            lists = [bands_.values.to_numpy()[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
            for row in zip(*(c.to_pylist() for c in batch.columns[:8]), lists, strict=True):
                if waiting and row[:3] != waiting[0][:3]:
                    found += compare(waiting)
                    waiting = []
                waiting.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        found = list(compare(waiting)) if waiting else []
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return own.mapInArrow(run, "a long, b long").distinct()


def _long_sketches(profiles: DataFrame) -> DataFrame:
    """node, long: a byte of each of LONG registers of each profile with counts, and of LONG without if they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                made = [_profile(s, c) for s, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                doc = np.repeat(np.arange(len(made)), [len(s) for s, _ in made])
                shingle, weight = np.concatenate([s for s, _ in made]), np.concatenate([c for _, c in made])
                winner = prob_min_hash(len(made), doc, shingle, weight, LONG)
                plain, again = plain_min_hash(winner, doc, shingle, weight)
                kinds = (mix64(x).astype(np.uint8) for x in (winner, plain))
                long = [x.tobytes() + (y.tobytes() if k else b"") for x, y, k in zip(*kinds, again, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(long, pa.binary())], names=["node", "long"])

    return profiles.select("node", "shingles", "counts").mapInArrow(run, "node long, long binary")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, versions: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, node (a hash of its text), n_shingles, class_id, and
    root, which also tells apart classes without ids (null for texts without shingles).
    versions (doc_id, text): other texts of some documents, such as those before a change; a
    document is also in the classes that its versions are in."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.lit(True).alias("own"))
    if versions is not None:
        base = base.unionByName(versions.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(False).alias("own")))
    base = base.withColumn("node", F.xxhash64("text"))
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType(), False)), T.StructField("short", T.BinaryType())]
    sketches = written(map_texts(base, "text", fields, _sketch_kernel(bands, rows), keep=["doc_id", "node", "own"], limit=1 << 19))

    entries = sketches.where("n_shingles > 0").select("node", F.explode("bands").alias("bucket"))
    # copies are one node, so a bucket has several texts where its least and greatest node differ
    # (tables of keys are cut off from their aggregates, so that adaptive execution can split a hot key's join)
    shared = checkpointed(entries.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket"))
    members = checkpointed(entries.join(shared, "bucket", "left_semi").distinct())
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    members = members.join(sizes, "bucket")
    members = checkpointed(members.join(members.groupBy("node").agg(F.sum("size").alias("degree")), "node"))
    profiles = written(_profiles(base, members))

    heads = checkpointed(members.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("h")).select("bucket", F.col("h.node").alias("head")))
    stars = members.join(heads, "bucket").where("node <> head").select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
    links = _verify(stars, profiles, similarity)
    if versions is not None:
        some = sketches.where("n_shingles > 0 and doc_id is not null")
        pairs = some.where("not own").select("doc_id", F.col("node").alias("a")).distinct().join(some.where("own").select("doc_id", F.col("node").alias("b")).distinct(), "doc_id")
        links = links.unionByName(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    links = checkpointed(links)
    roots = components(links)

    told = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = checkpointed(told.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket"))
    open_ = checkpointed(told.join(several, "bucket", "left_semi").select("bucket", "size", "node", "root"))
    nodes = checkpointed(open_.select("node").distinct())
    # copies become one in the task that reads them, before the join
    shorts = maybe_among(sketches.select("node", "short", "bands"), "node", nodes).dropDuplicates(["node"]).join(nodes, "node", "left_semi")
    longs = _long_sketches(profiles.join(nodes, "node", "left_semi"))
    more = checkpointed(_verify(_near_misses(open_.join(shorts.join(longs, "node"), "node"), similarity, bands, rows), profiles, similarity))
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    rooted = sketches.where("own").select("doc_id", "node", "n_shingles").join(roots, "node", "left").withColumn("root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")))
    least = checkpointed(rooted.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("class_id")))
    named = rooted.join(least, "root", "left")
    return named.select("doc_id", "node", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "root")


def earlier_versions(docs: DataFrame, originals: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text of the originals of those docs whose text is another by now. An id that stands for
    several different originals has no version, nor has a null id."""
    key, own = F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    raw = originals.select(key.alias("doc_id"), own.alias("text")).where("doc_id is not null")
    marks = raw.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("h"), F.max("h").alias("other")).where("h = other")
    now = docs.select(key.alias("doc_id"), F.xxhash64(own).alias("now"))
    changed = checkpointed(now.join(marks, "doc_id").where("now <> h").select("doc_id").distinct().withColumn("key", F.xxhash64("doc_id")))
    return maybe_among(raw.withColumn("key", F.xxhash64("doc_id")), "key", changed).join(changed, ["doc_id", "key"], "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"])


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options: object) -> DataFrame:
    """docs with one row of each near-duplicate class: that of the least doc_id. Repeated rows become one."""
    found = near_duplicates(docs, text, doc_id, **options)
    heads = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("h")).select("h.doc_id", "h.node")
    heads = heads.unionByName(found.where("n_shingles = 0").select("doc_id", "node"))
    heads = heads.select(F.col("node").alias("__node"), F.xxhash64("doc_id").alias("__place")).distinct()
    own = docs.withColumns({"__node": F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), "__place": F.xxhash64(F.col(f"`{doc_id}`"))})
    return own.join(heads, ["__node", "__place"], "left_semi").dropDuplicates(["__node", "__place"]).select(*[F.col(f"`{c}`") for c in docs.columns])
