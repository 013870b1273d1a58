import numpy as np
import pytest

from lattica.llm import lm_score as lm
from lattica.llm.queries import op9_lm_scoring


def test_query_covers_all_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = {r.doc_id: r for r in op9_lm_scoring(spark, small).collect()}
    assert {i: r.n_tokens for i, r in rows.items()} == {r.doc_id: len(r.text.encode().split()) for r in docs}
    assert all(r.log_likelihood < 0 for r in rows.values() if r.n_tokens)


def test_counts_cover_the_corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = lambda d: dict(lm.word_counts(d, "text").collect())
    once, twice = counts(docs), counts(docs.unionAll(docs))
    assert twice == {h: 2 * n for h, n in once.items()} and sum(once.values()) == sum(len(r.text.encode().split()) for r in docs.collect())


def plain_scores(model, text):
    """Each word's conditional log-probability over the whole vocabulary, one word at a time."""
    hashes, _ = lm.hashes_of([text.encode()])
    known, table = model.vocabulary, model.table.astype(np.float64)
    share = np.diff(np.concatenate([[0], known.draw]))
    index = {h: e for h, e in zip(known.known.tolist(), known.entry.tolist())}
    entries = [index.get(h, len(known.known) + h % lm.SHARED) for h in hashes.tolist()]
    out = []
    for i, e in enumerate(entries):
        hidden = table[lm.EMBEDDINGS, :-1].copy()
        for k, weight in enumerate(lm.NEARNESS, 1):
            for side, j in ((0, i - k), (1, i + k)):
                word = known.inputs[entries[j]] if 0 <= j < len(entries) else lm.INPUTS
                hidden += weight * table[2 * word + side, :-1]
        likelier = table[lm.WORDS :, :-1] @ np.tanh(hidden) + table[lm.WORDS :, -1]
        out.append(known.log_share[e] + likelier[e] - np.log((share * np.exp(likelier)).sum()))
    return out


@pytest.fixture(scope="module")
def pattern(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{w} {w}x {w}y" for w in rng.choice(list("abcdefgh"), 40)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return texts, lm.train(docs, passes=3, batch=64)


def test_score_is_the_pseudo_likelihood(pattern):
    """Against the exact sum over the vocabulary: the fixed draws may be off by a little."""
    texts, model = pattern
    some = [*texts[:3], "a", "unseen words only here", ""]
    n, total = model.score([t.encode() for t in some])
    assert n.tolist() == [len(t.split()) for t in some]
    for t, k, found in zip(some, n, total):
        assert found == pytest.approx(sum(plain_scores(model, t)), abs=0.06 * k + 1e-6)


def test_both_sides_teach_the_model(pattern):
    texts, model = pattern
    rng = np.random.default_rng(5)
    mixed = [" ".join(rng.permutation(t.split())) for t in texts[:50]]
    n, own = model.score([t.encode() for t in texts[:50]])
    _, other = model.score([t.encode() for t in mixed])
    assert own.sum() / n.sum() > other.sum() / n.sum() + 0.5
    assert own.sum() / n.sum() > -np.log(24) + 0.5  # better than word shares alone


def test_odd_rows(docs_of, pattern):
    _, model = pattern
    long = "a ax ay " * 60_000
    docs = docs_of([None, "", " \n", "a ax ay", "a ax ay", long]).selectExpr("*", "1 as n_tokens")
    rows = {r.doc_id: r for r in lm.score_texts(docs, model).collect()}
    assert [(rows[i].n_tokens, rows[i].log_likelihood, rows[i].mean_log_likelihood) for i in range(3)] == [(0, 0.0, None)] * 3
    assert rows[3].log_likelihood == rows[4].log_likelihood < 0 and rows[5].n_tokens == 180_000
    empty = docs_of(["x"]).where("false")
    assert lm.score_texts(empty, lm.train(empty)).count() == 0


def test_partitions_do_not_change_the_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_WORDS", 2000)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{w} {w}x {w}y" for w in rng.choice(list("abcdefgh"), 20)) for _ in range(150)] + [" ".join(["rare", "pair"] * 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few, many = lm.train(docs.repartition(1), batch=64), lm.train(docs.repartition(7), batch=64)
    raw = [t.encode() for t in texts]
    assert (few.score(raw)[1] == many.score(raw)[1]).all()


def test_a_row_met_in_one_shard_keeps_what_it_learned(spark):
    """The same corpus beside much other text: rows that only it moves end as far from the start."""
    rng = np.random.default_rng(4)
    own = [(i, " ".join(f"{w} {w}x {w}y" for w in rng.choice(list("abcdefgh"), 40))) for i in range(8)]
    other = [(100 + i, " ".join(f"z{w}" for w in rng.choice(list("ijklmnop"), 120))) for i in range(32)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary, _ = lm.learn_vocabulary(lm.word_counts(frame(own + other), "text"))
    table = lm.first_table(len(vocabulary.draw))
    squares = np.full(len(table), 1e-2, np.float32)

    def moved(rows):
        made = None
        for k, r in enumerate(rows):
            shard = lm.shards_of(frame(r), "text", vocabulary, 1, 1).selectExpr("round", f"shard + {k} as shard", "words", "ends")
            made = shard if made is None else made.unionAll(shard)
        return lm.train_round(made, len(rows), vocabulary, table, squares, 64)[0] - table

    alone, beside = moved([own]), moved([own, *[other[i::4] for i in range(4)]])
    hashes, first = lm.hashes_of([b"a ax ay b bx by"])
    rows = 2 * vocabulary.inputs[vocabulary.entries(hashes)] + 1
    size = np.abs(alone[rows]).sum()
    assert size > 0 and np.abs(beside[rows] - alone[rows]).sum() < 0.01 * size


def test_rare_words_share_entries_and_ties_go_together(spark):
    counts = spark.createDataFrame([(i, 10 if i < 3 else 4 if i < 6 else 1) for i in range(50)], "hash long, n long")
    known, total = lm.learn_vocabulary(counts, own=5)
    assert sorted(known.known.tolist()) == [0, 1, 2] and total == 30 + 12 + 44
    assert known.draw[-1] == pytest.approx(1)


def test_context_tells_rare_words_apart(spark):
    """150 words, each with its own neighbours."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"l{w} m{w} r{w}" for w in rng.integers(0, 150, 40)) for _ in range(300)]
    model = lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), passes=3, batch=64)
    hashes, first = lm.hashes_of([t.encode() for t in texts[:50]])
    assert model.each(hashes, first).mean() > model.vocabulary.log_share[model.vocabulary.entries(hashes)].mean() + 1


def test_full_shards_over_several_rounds_stay_finite_and_learn(spark):
    """Five shards of a million words, three rounds: the sums of squares go far beyond what half floats hold."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = lm.train(docs)
    assert np.isfinite(model.table).all()
    texts = [r.text.encode() for r in docs.where("doc_id % 40 = 0 and text is not null").collect()]
    hashes, first = lm.hashes_of(texts)
    own = model.each(hashes, first)
    assert np.isfinite(own).all()
    assert own.mean() > model.vocabulary.log_share[model.vocabulary.entries(hashes)].mean() + 0.3
    rows = lm.score_texts(docs.where("doc_id % 40 = 0"), model).collect()
    assert all(np.isfinite(r.log_likelihood) and r.log_likelihood < 0 for r in rows if r.n_tokens)


def test_wholly_equal_rows_are_dealt_to_all_shards(spark):
    docs = spark.createDataFrame([(1, "the same text again and again " * 20)] * 300, "doc_id long, text string").repartition(3)
    vocabulary, _ = lm.learn_vocabulary(lm.word_counts(docs, "text"))
    found = lm.shards_of(docs, "text", vocabulary, 4, 2).selectExpr("shard", "length(ends) as n").collect()
    assert sorted(r.shard for r in found) == [0, 1, 2, 3] and max(r.n for r in found) < 1.1 * min(r.n for r in found)
    assert sum(r.n for r in found) == 300 * 8
