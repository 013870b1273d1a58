"""Masked pseudo-likelihood from a bidirectional window network.

Each word of a text is predicted from the WINDOW words on both of its sides; the conditional
log-probabilities of all words add up to the text's score. The network (embeddings of left and of
right neighbours, nearer ones counting more, one tanh layer, a weight vector and a bias for every
word of the vocabulary) says how much
likelier than by its share of the corpus a word is between its neighbours:
p(w | c) = share(w) exp(s(w, c)) / Z(c). Z(c), the mean of exp(s) over words by share, is estimated
from DRAWS fixed words, at even steps of the cumulative shares to the power FLATTER and weighted
back, so scores do not depend on chance, batches or partitions. Training is sampled softmax: a batch shares NOISE words drawn
by share, against which each of its words is told apart. Outputs start at zero, that is at the
shares.

What is gathered from the corpus covers all of it: counts of every word, and training on every
word of every text, predicted from its neighbours only. The commonest words, OWN at most, are
vocabulary entries of their own (words as common as the first one that does not fit are left
out together, so ties do not depend on order); the others are dealt by a hash to SHARED further
entries, in which each counts an equal share. Parameters have a fixed size however large the
corpus. Texts are dealt by a hash of their rows to shards of about SHARD_WORDS words. A shard
trains its own copy in numpy, text after text; the copies of a round are then averaged, each
parameter row by the words that moved it, and the next round goes on from there. Of n shards,
about sqrt(n) train at once in about sqrt(n) rounds: both steps and parallelism grow with the
corpus, and the parameters do not depend on how the input is partitioned (but for which of its
shards hold which copies of wholly equal rows). A round that leaves the finite numbers fails.

Words are what lies between ASCII white space, in lower case. Null, empty and wordless texts
have no tokens, log_likelihood 0 and no mean. A very long text is scored and trained on whole (memory
grows with the longest text of a task). Rows never meet in scoring; repeated rows get equal
scores. An empty corpus gives a model of equal shares.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import chunks, let_go, map_texts, mix64, shared_folder, words_of, written

#: Vocabulary entries: the commonest words have their own, others share.
OWN = 1 << 17
SHARED = 1 << 15
#: Context words the network knows: the commonest entries, others by hash; one more stands for none.
INPUTS = 8192
OWN_INPUTS = 7680
WINDOW = 3
NEARNESS = (1.0, 0.7, 0.5)
WIDTH = 15  # and a bias: 16 numbers a row
BATCH = 1024
NOISE = 64
DRAWS = 256
FLATTER = 0.75
RATE = 0.07
#: Words of a shard, which is trained in order by one task.
SHARD_WORDS = 1_000_000
#: Rows of the table whose changes are added up together.
BLOCK = 4096
EMBEDDINGS = 2 * (INPUTS + 1)
WORDS = EMBEDDINGS + 1

_U = np.uint64
_LOWER = bytes(i + 32 if 65 <= i <= 90 else 32 if i in (9, 10, 11, 12, 13) else i for i in range(256))


def hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and each text's first word."""
    words = words_of(texts, _LOWER, fold_latin=True)
    return words.hashes, words.first


@dataclass(frozen=True)
class Vocabulary:
    """known: hashes of the words with entries of their own, sorted, and their entries (by commonness).
    log_share: of a word, by entry. draw: cumulative shares of the entries. inputs: the context word of each entry."""

    known: np.ndarray
    entry: np.ndarray
    log_share: np.ndarray
    draw: np.ndarray
    inputs: np.ndarray

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each word."""
        other = (len(self.known) + (hashes % _U(SHARED))).astype(np.int32)
        if not len(self.known):
            return other
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.entry[at], other)

    @cached_property
    def fixed(self) -> tuple[np.ndarray, np.ndarray]:
        """The fixed words of Z, and their weights."""
        share = np.diff(np.concatenate([[0], self.draw]))
        flat = share**FLATTER / (share**FLATTER).sum()
        words = np.minimum(np.searchsorted(np.cumsum(flat), (np.arange(DRAWS) + 0.5) / DRAWS, "right"), len(share) - 1)
        weight = share[words] / flat[words]
        return words, (weight / weight.sum()).astype(np.float32)

    def drawn(self, places: np.ndarray) -> np.ndarray:
        """Entries at places (0 to 1) of the cumulative shares."""
        return np.minimum(np.searchsorted(self.draw, places, "right"), len(self.draw) - 1)


def make_vocabulary(hashes: np.ndarray, counts: np.ndarray, shared_counts: np.ndarray, shared_words: np.ndarray) -> Vocabulary:
    """From the words with entries of their own, and by shared entry the occurrences and number of the others."""
    order = np.lexsort((hashes, -counts))
    entry = np.empty(len(hashes), np.int32)
    entry[order] = np.arange(len(hashes), dtype=np.int32)
    by_hash = np.argsort(hashes)
    weight = np.concatenate([counts[order], shared_counts]) + 0.5
    share = weight / weight.sum()
    log_share = np.log(share)
    log_share[len(hashes) :] -= np.log(np.maximum(shared_words, 1))
    each = np.arange(len(weight))
    inputs = np.where(each < min(OWN_INPUTS, len(hashes)), each, OWN_INPUTS + (mix64(each.astype(_U)) % _U(INPUTS - OWN_INPUTS)).astype(np.int64))
    return Vocabulary(hashes[by_hash], entry[by_hash], log_share.astype(np.float32), np.cumsum(share), inputs.astype(np.int32))


def first_table(entries: int) -> np.ndarray:
    """All parameters as rows of WIDTH weights and a bias: each context word's embeddings to the left and to
    the right, the hidden bias, words (at zero)."""
    table = np.zeros((WORDS + entries, WIDTH + 1), np.float32)
    table[:EMBEDDINGS, :WIDTH] = np.random.default_rng(7).standard_normal((EMBEDDINGS, WIDTH)) * 0.1
    return table


def stream(inputs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context words of texts one after the other, WINDOW times none between them, and the words' places there."""
    doc = np.repeat(np.arange(1, len(first), dtype=np.int64), np.diff(first))
    at = np.arange(len(inputs)) + WINDOW * doc
    out = np.full(len(inputs) + WINDOW * len(first), INPUTS, np.int32)
    out[at] = inputs
    return out, at


def hidden_layer(table: np.ndarray, ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """tanh of the weighted sums of neighbours' embeddings, and a column of ones for the words' biases.
    ids: a stretch of the stream with WINDOW more on both sides of the words; own: places of the words after those."""
    n = len(ids) - 2 * WINDOW
    each = table[:EMBEDDINGS].reshape(INPUTS + 1, 2 * (WIDTH + 1))[ids]
    left, right = each[:, : WIDTH + 1], each[:, WIDTH + 1 :]
    total = np.empty((n, WIDTH + 1), np.float32)
    total[:] = table[EMBEDDINGS]
    for k, weight in enumerate(NEARNESS, 1):
        both = left[WINDOW - k : n + WINDOW - k] + right[WINDOW + k : n + WINDOW + k]
        both *= np.float32(weight)
        total += both
    hidden = total[own] if len(own) < n else total
    np.tanh(hidden, out=hidden)
    hidden[:, WIDTH] = 1
    return hidden


def batches_of(at: np.ndarray, size: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """For each batch its words, its stretch of the stream, and the words' places there."""
    for i in range(0, len(at), size):
        own = at[i : i + size]
        yield slice(i, i + len(own)), slice(own[0] - WINDOW, own[-1] + WINDOW + 1), own - own[0]


class Trainer:
    """Adagrad with a step size for each row of the table, one batch after the other. used: words that moved a row."""

    def __init__(self, table: np.ndarray, squares: np.ndarray) -> None:
        self.table, self.squares = table.copy(), squares.copy()
        self.used = np.zeros(len(table), np.int64)

    def learn(self, ids: np.ndarray, at: np.ndarray, entries: np.ndarray, noise: np.ndarray) -> None:
        n, m = len(entries), len(ids) - 2 * WINDOW
        hidden = hidden_layer(self.table, ids, at)
        own, other = self.table[WORDS + entries], self.table[WORDS + noise]
        right = np.einsum("ij,ij->i", own, hidden)
        wrong = hidden @ other.T
        top = np.maximum(wrong.max(axis=1), right)
        wrong -= top[:, None]
        np.exp(wrong, out=wrong)
        right = np.exp(right - top)
        total = wrong.sum(axis=1)
        total += right
        wrong /= total[:, None]
        miss = right / total - 1
        back = wrong @ other
        own *= miss[:, None]
        back += own
        back *= 1 - hidden * hidden  # the column of ones has no gradient
        words = np.concatenate([hidden * miss[:, None], wrong.T @ hidden])
        self._step(np.concatenate([entries, noise]), words.reshape(n + len(noise), 1, -1), WORDS)
        if n < m:
            spread = np.zeros((m, WIDTH + 1), np.float32)
            spread[at] = back
        else:
            spread = back
        grad = np.zeros((m + 2 * WINDOW, 2, WIDTH + 1), np.float32)
        for k, weight in enumerate(NEARNESS, 1):
            part = spread * np.float32(weight)
            grad[WINDOW - k : m + WINDOW - k, 0] += part
            grad[WINDOW + k : m + WINDOW + k, 1] += part
        self._step(ids, grad, 0)
        self._move(np.array([EMBEDDINGS]), back.sum(axis=0).reshape(1, 1, -1), np.array([n]), EMBEDDINGS)

    def _step(self, rows: np.ndarray, grad: np.ndarray, base: int) -> None:
        """Moves each row by the sum of its gradients, over the root of their number. grad: (row, part, number)."""
        order = np.argsort(rows, kind="stable")
        own = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        often = np.diff(np.append(starts, len(own)))
        self._move(own[starts].astype(np.int64), np.add.reduceat(grad[order], starts, axis=0), often, base)

    def _move(self, rows: np.ndarray, total: np.ndarray, often: np.ndarray, base: int) -> None:
        parts = total.shape[1]
        total /= np.sqrt(often).astype(np.float32)[:, None, None]
        at = rows if base == EMBEDDINGS else (base + rows[:, None] * parts + np.arange(parts)).ravel()
        total = total.reshape(len(at), -1)
        squares = self.squares[at] + np.einsum("ij,ij->i", total, total) / np.float32(WIDTH + 1)
        self.squares[at] = squares
        total *= (np.float32(RATE) / np.sqrt(squares))[:, None]
        self.table[at] -= total
        self.used[at] += np.repeat(often, parts)

    def learn_texts(self, entries: np.ndarray, first: np.ndarray, known: Vocabulary, seed: int, batch: int) -> None:
        rng = np.random.default_rng(seed)
        ids, at = stream(known.inputs[entries], first)
        for words, stretch, own in batches_of(at, batch):
            self.learn(ids[stretch], own, entries[words], known.drawn(rng.random(NOISE)))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """hash, n: occurrences of every word over all texts, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.empty(0, _U), np.empty(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["hash", "n"])

        for batch in batches:
            for _, texts in chunks(batch, 0, 1 << 23):
                new, often = np.unique(hashes_of(texts)[0], return_counts=True)
                every, at = np.unique(np.concatenate([words, new]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, often]), len(every)).astype(np.int64)
                words = every
                if len(words) > 1 << 20:
                    yield rows()
                    words, counts = np.empty(0, _U), np.empty(0, np.int64)
        yield rows()

    return written(docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))


def learn_vocabulary(counts: DataFrame, own: int = OWN) -> tuple[Vocabulary, int]:
    """The vocabulary of counted words, and how many words there are in all. The driver gets at most
    3000 sizes, `own` words and SHARED sums."""
    sized = counts.withColumn("size", F.floor(F.log2("n") * 64).cast("int"))
    sizes = sorted(((r["size"], r.words, r.n) for r in sized.groupBy("size").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()), reverse=True)
    least, taken = 1 << 30, 0
    for size, words, _ in sizes:
        taken += words
        if taken > own:
            break
        least = size
    common = sized.where(F.col("size") >= least).select("hash", "n").toArrow()
    entry = F.col("hash").bitwiseAND(F.lit(SHARED - 1)).alias("entry")
    rest = sized.where(F.col("size") < least).groupBy(entry).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    shared_counts, shared_words = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    at = rest.column("entry").to_numpy()
    shared_counts[at], shared_words[at] = rest.column("n").to_numpy(), rest.column("words").to_numpy()
    made = make_vocabulary(common.column("hash").to_numpy().view(_U), common.column("n").to_numpy(), shared_counts, shared_words)
    return made, sum(n for _, _, n in sizes)


def shards_of(docs: DataFrame, text: str, vocabulary: Vocabulary, shards: int, rounds: int) -> DataFrame:
    """round, shard, words, ends: the entries of each shard's texts, in an order that does not depend on where they lie.

    A text's shard is a hash of its row, so copies with ids of their own are spread; wholly equal rows
    are dealt on to the next shards as a task meets them. A row of the result holds about SHARD_WORDS words."""
    some = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = docs.select(F.xxhash64(*some).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # OWN + SHARED entries at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for part, texts in chunks(batch, 1):
                hashes, first = hashes_of(texts)
                made = shared.value.entries(hashes)
                key = part.column(0).to_numpy()
                own = np.flatnonzero(np.diff(first))
                words = [made[first[i] : first[i + 1]].tobytes() for i in own]
                turn = np.empty(len(own), np.int64)
                for i, k in enumerate(key[own].tolist()):
                    turn[i] = seen[k]
                    seen[k] += 1
                yield pa.RecordBatch.from_arrays([pa.array((key[own] % shards + turn) % shards), pa.array(key[own]), pa.array(words, pa.binary())], names=["shard", "key", "words"])
            if len(seen) > 1 << 18:
                seen.clear()

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("key").to_pylist(), table.column("words").to_pylist(), strict=True))
        ends = np.cumsum([len(w) // 4 for _, w in rows], dtype=np.int64)
        shard = table.column("shard")[0].as_py()
        return pa.table({"round": pa.array([shard % rounds], pa.int64()), "shard": pa.array([shard], pa.int64()), "words": pa.array([b"".join(w for _, w in rows)], pa.binary()), "ends": pa.array([ends.tobytes()], pa.binary())})

    made = rows.mapInArrow(cut, "shard long, key long, words binary")
    return made.groupBy("shard").applyInArrow(join, "round long, shard long, words binary, ends binary")


def train_round(shards: DataFrame, tasks: int, vocabulary: Vocabulary, table: np.ndarray, squares: np.ndarray, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """What the shards make of the table, each from the same start: a row's changes are averaged by the words
    that moved the row, so shards that never met it do not hold it back."""
    context = shards.sparkSession.sparkContext
    shared = context.broadcast((vocabulary, table, squares))  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start, start_squares = shared.value
        for rows in batches:
            for shard, words, ends in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                trainer = Trainer(start, start_squares)
                first = np.concatenate([[0], np.frombuffer(ends, np.int64)])
                trainer.learn_texts(np.frombuffer(words, np.int32), first, known, shard, batch)
                moved = np.flatnonzero(trainer.used)
                cut = np.searchsorted(moved, np.arange(0, len(start) + BLOCK, BLOCK))
                some = np.flatnonzero(np.diff(cut))
                spans = [moved[cut[k] : cut[k + 1]] for k in some]
                # weights move by little; their squares add up beyond what half floats hold
                change = [np.clip(trainer.table[m] - start[m], -6e4, 6e4).astype(np.float16).tobytes() for m in spans]
                squares_ = [(trainer.squares[m] - start_squares[m]).tobytes() for m in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int64()), pa.array([m.astype(np.int32).tobytes() for m in spans], pa.binary()), pa.array([trainer.used[m].astype(np.int32).tobytes() for m in spans], pa.binary()), pa.array(change, pa.binary()), pa.array(squares_, pa.binary())],
                    names=["block", "rows", "used", "change", "squares"],
                )

    def add(part: pa.Table) -> pa.Table:
        block = part.column("block")[0].as_py()
        used, total = np.zeros(BLOCK), np.zeros((BLOCK, WIDTH + 2))
        # summed in a set order, as floats do not add up alike in every order
        for rows, n, change, more in sorted(zip(*(part.column(c).to_pylist() for c in ("rows", "used", "change", "squares")), strict=True)):
            at, n = np.frombuffer(rows, np.int32) - block * BLOCK, np.frombuffer(n, np.int32).astype(np.float64)
            used[at] += n
            total[at, :-1] += np.frombuffer(change, np.float16).reshape(-1, WIDTH + 1).astype(np.float64) * n[:, None]
            total[at, -1] += np.frombuffer(more, np.float32) * n
        at = np.flatnonzero(used)
        mean = (total[at] / used[at, None]).astype(np.float32)
        return pa.table({"rows": pa.array([(at + block * BLOCK).astype(np.int32).tobytes()], pa.binary()), "change": pa.array([mean.tobytes()], pa.binary())})

    made = shards.repartitionByRange(tasks, "shard").select("shard", "words", "ends").mapInArrow(run, "block long, rows binary, used binary, change binary, squares binary")
    found = made.groupBy("block").applyInArrow(add, "rows binary, change binary").toArrow()  # at most the table's size reaches the driver
    table, squares = table.copy(), squares.copy()
    for rows, change in zip(found.column("rows").to_pylist(), found.column("change").to_pylist(), strict=True):
        at, change = np.frombuffer(rows, np.int32), np.frombuffer(change, np.float32).reshape(-1, WIDTH + 2)
        table[at] += change[:, :-1]
        squares[at] += change[:, -1]
    shared.destroy()
    let_go(shards.sparkSession)
    if not (np.isfinite(table).all() and np.isfinite(squares).all()):
        raise FloatingPointError("training left the finite numbers")
    return table, squares


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    table: np.ndarray

    def each(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The conditional log-probability of each word between its neighbours."""
        known, out = self.vocabulary, np.empty(len(hashes))
        entries = known.entries(hashes)
        ids, at = stream(known.inputs[entries], first)
        drawn, weight = known.fixed
        drawn = self.table[WORDS + drawn]
        others = np.zeros((2048, WIDTH + 1), np.float32)  # always as many rows, so that a product does not depend on a word's place
        for words, stretch, place in batches_of(at, len(others)):
            own = entries[words]
            hidden = hidden_layer(self.table, ids[stretch], place)
            right = np.einsum("ij,ij->i", self.table[WORDS + own], hidden)
            others[: len(own)] = hidden
            likelier = others @ drawn.T
            np.exp(likelier, out=likelier)
            out[words] = known.log_share[own] + right - np.log(likelier @ weight)[: len(own)]
        return out

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and summed conditional log-probability of each text."""
        hashes, first = hashes_of(texts)
        each = self.each(hashes, first)
        return np.diff(first), np.array([each[a:b].sum() for a, b in zip(first[:-1].tolist(), first[1:].tolist())])


def train(docs: DataFrame, text: str = "text", passes: int = 1, batch: int = BATCH) -> Model:
    """passes: how often the corpus is gone through. Of n shards about sqrt(n) train at once."""
    vocabulary, total = learn_vocabulary(word_counts(docs, text))
    table = first_table(len(vocabulary.draw))
    squares = np.full(len(table), 1e-2, np.float32)
    if total:
        shards = ceil(total / SHARD_WORDS)
        rounds = ceil(sqrt(shards))
        folder = shared_folder(docs.sparkSession)
        shards_of(docs, text, vocabulary, shards, rounds).write.partitionBy("round").parquet(folder)
        for _ in range(passes):
            for i in range(rounds):
                some = docs.sparkSession.read.schema("shard long, words binary, ends binary").parquet(f"{folder}/round={i}")
                table, squares = train_round(some, ceil(shards / rounds), vocabulary, table, squares, batch)
    return Model(vocabulary, table)


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("mean_log_likelihood", T.DoubleType())]


def score_texts(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, log_likelihood and mean_log_likelihood to each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: OWN, SHARED and INPUTS

    def make() -> Callable[[list[bytes]], list]:
        def kernel(texts: list[bytes]) -> list:
            n, total = shared.value.score(texts)
            total = np.round(total, 6)
            return [n, total, pa.array(np.round(total / np.maximum(n, 1), 6), mask=n == 0)]

        return kernel

    return map_texts(docs, text, FIELDS, make, keep)
