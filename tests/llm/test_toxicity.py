import zlib

import numpy as np
import pytest

from lattica.llm.queries import op6_toxicity
from lattica.llm.toxicity import features_of, fit_nnpu, score_toxicity, train

SF = "/root/testdata/sf0.01"


def auc(y, x):
    rank = np.argsort(np.argsort(x, kind="stable")) + 1.0
    for v in np.unique(x):
        rank[x == v] = rank[x == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op6_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    y, x = np.array([labels[r.doc_id] for r in held]), np.array([r.score for r in held])
    assert auc(y, x) > 0.8 and (x[y == 0] >= 0.5).mean() < 0.05


def test_held_out_labels_are_never_read(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = train(docs, labels), train(docs, turned)
    assert (a.features == b.features).all() and a.weights == pytest.approx(b.weights) and a.bias == pytest.approx(b.bias)


def test_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    positive = (rng.random((200, 30)) < 0.1).astype(np.float32)
    positive[:, 0] = 1
    unlabelled = (rng.random((1000, 30)) < 0.1).astype(np.float32)
    unlabelled[:, 0] = rng.random(1000) < 0.2
    w, bias = fit_nnpu(positive, unlabelled, 0.2)
    score = unlabelled @ w + bias
    assert ((score > 0) == (unlabelled[:, 0] == 1)).mean() > 0.97


def test_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    docs = docs_of([None, "", "bad word", "good word", "bad word"], [1, 2, None, 4, 4]).selectExpr("*", "1 as score", "2 as toxic")
    rows = score_toxicity(docs, train(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    for a, b in ((labels.where("false"), docs), (labels, docs.where("false")), (labels.where("toxic = 0"), docs)):
        assert score_toxicity(docs, train(b, a)).count() == 5
    assert score_toxicity(docs.where("false"), train(docs, labels)).count() == 0


def test_very_long_text_and_scores_by_hand(spark, docs_of):
    """A score is the logistic of the bias and the weights of the features that are there, once each."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    some = [r.text for r in docs.limit(40).collect()]
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    for text, score in zip(some, model.scores([t.encode() for t in some]), strict=True):
        found = {int(f) for f in features_of([text.encode()])[1]}
        assert score == pytest.approx(1 / (1 + np.exp(-(model.bias + sum(weight.get(f, 0.0) for f in found)))))
    long = " ".join(some) * 20
    rows = {r.doc_id: r.score for r in score_toxicity(docs_of([" ".join(some), long]), model).collect()}
    assert abs(rows[0] - rows[1]) < 0.2 and len(model.features) > 0
