"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy from confirmed toxic texts and unlabelled texts. Its
risk is that of positives times the class prior, plus the part of the unlabelled texts' risk
that the positives do not explain; where that part turns negative the step goes back, so the
risk cannot fall below zero by overfitting.

Features are a text's words (lower-cased runs of letters, digits and code points from U+0080)
and their beginnings of 4, 5 and 6 bytes, by presence. Those kept occur clearly oftener in
positives than in unlabelled texts, the MAX_FEATURES clearest at most (the size of the model).
Fitting takes a bounded sample of the rows with labels: at most MAX_POSITIVE toxic ones as
positives, and at most MAX_UNLABELLED of all of them, whatever their label, as unlabelled texts, the
first by a hash of their ids. So positives, unlabelled texts and the class prior, the share of
toxic rows among all labels, speak of one population. Labels are read only for ids whose crc32
modulo FOLDS is not HELD_OUT. Scoring covers every whole text; labels, lang, source and ids
are no inputs of a score. Null and empty texts have no features and get the score of an
unremarkable text; null ids count as held out; an id counts once in fitting, with its least
text, however often it stands. A very long text is read whole, in time and memory linear in its length
(presence of a feature does not grow with it). Features as clear as one another are kept by the
order of their hashes. Equal texts get equal scores. Without positives every score is the prior, PRIOR
without labels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import PLAIN, map_texts, mix64, span_hashes, words_of

FOLDS = 5
HELD_OUT = 0
MAX_POSITIVE = 2000
MAX_UNLABELLED = 6000
MAX_FEATURES = 2048
PRIOR = 0.1
BEGINNINGS = (4, 5, 6)

_U = np.uint64


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for every word and beginning of a word, with repeats."""
    words = words_of(texts, PLAIN, fold_latin=True)
    doc = words.doc
    docs, found = [doc], [words.hashes]
    for n in BEGINNINGS:
        long = np.flatnonzero(words.ends - words.starts > n)
        docs.append(doc[long])
        found.append(mix64(span_hashes(words.data, words.starts[long], words.starts[long] + n) + _U(n)))
    return np.concatenate(docs), np.concatenate(found)


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        doc, found = features_of(texts)
        total = np.full(len(texts), self.bias)
        if len(self.features):
            known = np.zeros(1 << 16, bool)
            known[self.features & _U(0xFFFF)] = True
            maybe = np.flatnonzero(known[found & _U(0xFFFF)])
            doc, found = doc[maybe], found[maybe]
            at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
            hit = self.features[at] == found
            pairs = np.unique(doc[hit] * len(self.features) + at[hit])
            np.add.at(total, pairs // len(self.features), self.weights[pairs % len(self.features)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def select_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], most: int = MAX_FEATURES, least: float = 4.0, share: float = 0.01, lift: float = 3.0) -> np.ndarray:
    """Features of a hundredth of the positives that are `lift` times as frequent there and `least` standard errors more so."""
    p, n = np.unique(np.concatenate(positive), return_counts=True)
    common = n >= max(3, share * len(positive))
    p, n = p[common], n[common]
    u, k = np.unique(np.concatenate(unlabelled), return_counts=True)
    if not len(u):
        return p[np.argsort(-n)[:most]]
    at = np.minimum(np.searchsorted(u, p), len(u) - 1)
    other = np.where(u[at] == p, k[at], 0)
    a, b = n / len(positive), other / len(unlabelled)
    pooled = (n + other) / (len(positive) + len(unlabelled))
    z = (a - b) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / len(positive) + 1 / len(unlabelled)))
    good = np.flatnonzero((z >= least) & (a >= lift * b))
    return np.sort(p[good[np.argsort(-z[good], kind="stable")[:most]]])


def _matrix(rows: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(features)), np.float32)
    for i, row in enumerate(rows):
        at = np.minimum(np.searchsorted(features, row), len(features) - 1)
        out[i, at[features[at] == row]] = 1
    return out


def _distinct(features: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Places of the features without those that are in the same texts as an earlier one (a word and its beginnings)."""
    both = np.ascontiguousarray(np.concatenate([positive, unlabelled]).astype(bool).T)
    return np.sort(np.unique(np.packbits(both, axis=1), axis=0, return_index=True)[1])


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 500, rate: float = 0.1, decay: float = 1e-4, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk of the logistic loss (full batches, Adam)."""
    w = np.zeros(positive.shape[1], np.float32)
    bias = float(np.log(prior / (1 - prior)))
    state = np.zeros((2, len(w) + 1))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    for t in range(1, steps + 1):
        zp, zu = positive @ w + bias, unlabelled @ w + bias
        rest = loss(-zu).mean() - prior * loss(-zp).mean()
        # gradients of the three means with respect to the outputs
        up, down, fall = -sigmoid(-zp) / len(zp), sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        if rest >= -slack:
            gp, gu = prior * (up - down), fall
        else:
            gp, gu = prior * down, -fall
        grad = np.append(gp.astype(np.float32) @ positive + gu.astype(np.float32) @ unlabelled + decay * w, gp.sum() + gu.sum())
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        step = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1].astype(np.float32)
        bias -= float(step[-1])
    return w.astype(np.float64), bias


def fit_model(features: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    own = _distinct(features, positive, unlabelled)
    return Model(features[own], *fit_nnpu(positive[:, own], unlabelled[:, own], prior))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    key = F.col(f"`{doc_id}`")
    known = labels.where(fold(key) != HELD_OUT).select(key.alias("id"), F.col(f"`{label}`").alias("label")).where("label is not null")
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)), F.lit(0))).first()
    prior = float(np.clip(toxic / n, 0.005, 0.9)) if n else PRIOR
    first = lambda ids, most, kind: ids.distinct().orderBy(F.xxhash64("id"), "id").limit(most).withColumn("kind", F.lit(kind))
    chosen = first(known.where("label = 1").select("id"), max_positive, 1).unionByName(first(known.select("id"), max_unlabelled, 0))
    # a broadcast of at most max_positive + max_unlabelled ids
    texts = docs.select(key.alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen), "id").groupBy("kind", "id").agg(F.min("text").alias("text"))

    def make() -> Callable[[list[bytes]], list]:
        def kernel(parts: list[bytes]) -> list:
            doc, found = features_of(parts)
            order = np.lexsort((found, doc))
            doc, found = doc[order], found[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])])) if len(doc) else np.empty(0, np.int64)
            doc, found = doc[new], found[new]
            cut = np.searchsorted(doc, np.arange(len(parts) + 1))
            return [[found[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]]

        return kernel

    rows = map_texts(texts, "text", [T.StructField("features", T.BinaryType())], make, keep=["kind"])
    got = rows.toArrow()
    sets = [np.frombuffer(x, _U) for x in got.column("features").to_pylist()]
    kind = np.array(got.column("kind").to_pylist(), np.int64)
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][:4].tobytes()))  # rows come in any order
    positive, unlabelled = [sets[i] for i in order if kind[i] == 1], [sets[i] for i in order if kind[i] == 0]
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(np.empty(0, _U), np.empty(0), bias)
    features = select_features(positive, unlabelled)
    if not len(features):
        return Model(features, np.empty(0), bias)
    return fit_model(features, _matrix(positive, features), _matrix(unlabelled, features), prior)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5) to each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def make() -> Callable[[list[bytes]], list]:
        def kernel(texts: list[bytes]) -> list:
            made = shared.value.scores(texts)
            return [pa.array(made), pa.array((made >= 0.5).astype(np.int32))]

        return kernel

    return map_texts(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, keep)
