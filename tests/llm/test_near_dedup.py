import random

import numpy as np
import pytest

from lattica.llm.graph import components
from lattica.llm.near_dedup import jaccards, near_duplicates, one_of_each, prob_min_hash, weighted_shingles
from lattica.llm.queries import op5_near_dedup
from tests.llm.brute import classes, shingles, similarity


def test_query_equals_brute_force(spark, small):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    want = classes(docs)
    got = {r.doc_id: r.class_id for r in op5_near_dedup(spark, small).collect()}
    assert got == {d: c for (d, _), c in zip(docs, want, strict=True)}
    assert len(set(want)) < len(want)


def family(rng, size, words=120, edits=3):
    base = [f"v{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(1, edits + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def test_families_chains_and_copies(spark):
    rng = random.Random(9)
    texts = [t for n in (40, 3, 1, 1) for t in family(rng, n)] + family(rng, 60, edits=5)
    chain = [f"c{rng.randrange(10**6)}" for _ in range(200)]
    texts += [" ".join(chain[i * 6 : i * 6 + 100]) for i in range(8)]
    texts += [texts[0]] * 30 + ["Short one", "short ONE", "short two", "", "", None, "!!!", "!!!", "???", "É tu brute", "é tu BRUTE"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [rows[3], (None, "only null"), (None, "only null"), (None, texts[0])]
    want = classes(rows)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id) for r in found), key=str) == sorted(zip((d for d, _ in rows), want, strict=True), key=str)


def test_sketch_estimates_probability_jaccard():
    a = " ".join(f"a{i}" for i in range(300)) + " x y z q r" * 6
    b = " ".join(f"a{i}" for i in range(60, 340)) + " x y z q r" * 3
    doc, shingle, weight = weighted_shingles([a.encode(), b.encode()])
    made = prob_min_hash(2, doc, shingle, weight, 4096)
    own = [(np.sort(shingle[doc == i]), weight[doc == i][np.argsort(shingle[doc == i])]) for i in (0, 1)]
    exact = jaccards(*own)
    assert max(exact) == pytest.approx(similarity(shingles(a), shingles(b)))
    assert (made[0] == made[1]).mean() == pytest.approx(exact[0], abs=0.03)


def test_one_of_each_and_clashing_columns(spark):
    rng = random.Random(1)
    texts = family(rng, 4, edits=1) + ["alone in the world of words", None, "", ""]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "nobody knows my id here"), (None, None)], "doc_id long, text string").selectExpr("*", "1 as node", "2 as class_id", "3 as bands", "4 as root")
    left = one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 0), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0), (True, 0)]
    assert one_of_each(docs.where("false")).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(300)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {v for a, b in links if a != b for v in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plain_links_between_texts_of_unequal_repetition(spark):
    rng = random.Random(2)
    rows = []
    for k in range(12):
        base, passage = ([f"{x}{rng.randrange(10**7)}" for _ in range(n)] for x, n in (("u", 300), ("p", 20)))
        rows += [(2 * k, " ".join(base + passage)), (2 * k + 1, " ".join(base + passage * 40))]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(24)}


def test_versions_join_documents(spark):
    rng = random.Random(12)
    a, b, c, d = family(rng, 3, edits=1)
    cut = " ".join(b.split()[:30])
    rows = [(1, a), (2, cut), (3, "nothing like the others at all"), (4, cut + " " + " ".join(f"n{i}" for i in range(60)))]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    found = lambda **more: {r.doc_id: r.class_id for r in near_duplicates(frame(rows), **more).collect()}
    assert found() == {1: 1, 2: 2, 3: 3, 4: 4}
    assert found(versions=frame([(2, b), (None, c), (9, d)])) == {1: 1, 2: 1, 3: 3, 4: 4}
    assert found(versions=frame([]).where("false")) == {1: 1, 2: 2, 3: 3, 4: 4}


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 5000}x{i}" for i in range(150_000))
    rows = [(1, long), (2, long + " and more"), (3, long[:5000])]
    assert {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 1, 3: 3}


def test_more_keys_than_slots(spark, monkeypatch):
    from lattica.llm import near_dedup

    rng = random.Random(3)
    texts = [t for _ in range(10) for t in family(rng, 1, edits=1)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((r.doc_id, r.class_id) for r in near_duplicates(frame).collect())
    monkeypatch.setattr(near_dedup, "SLOTS", 8)
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(frame).collect()) == want
