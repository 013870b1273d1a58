import hashlib
import random
import re

import pytest

from lattica.llm.decontaminate import drop_contaminated, find_overlaps
from lattica.llm.queries import op8_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, n=10):
    out = []
    for text in texts:
        own, hit, found = words(text), set(), set()
        for item, value in items:
            w = words(value)
            size = min(n, len(w))
            for k in range(len(w) - size + 1 if w else 0):
                for p in range(len(own) - size + 1):
                    if own[p : p + size] == w[k : k + size]:
                        hit.update(range(p, p + size))
                        found.add("null" if item is None else str(item))
        out.append((len(own), len(hit), sorted(found)))
    return out


def longest(own, by, n=10):
    """All matches of a window or more that can be extended to neither side."""
    out = []
    for item, w in by.items():
        for k in range(len(w)):
            for p in range(len(own)):
                if k and p and own[p - 1] == w[k - 1]:
                    continue
                size = 0
                while k + size < len(w) and p + size < len(own) and own[p + size] == w[k + size]:
                    size += 1
                if size >= min(n, len(w)):
                    out.append((item, p, k, size))
    return out


@pytest.fixture
def items_of(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_query_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs}
    rows = {r.doc_id: r for r in op8_decontamination(spark, small).collect()}
    ngrams = {tuple(w[k : k + 10]) for _, t in items for w in [words(t)] for k in range(max(1, len(w) - 9))}
    some = [i for i, t in texts.items() for w in [words(t)] if any(tuple(w[p : p + 10]) in ngrams for p in range(len(w)))]
    assert {i for i, r in rows.items() if r.contaminated} == set(some) and some
    for i in some + list(texts)[:10]:
        n, hit, found = brute([texts[i]], items)[0]
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest())


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_random_texts_equal_brute_force(docs_of, items_of, block_bytes):
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice("aa b C é 7".split()) for _ in range(n))
    items = [(1, make(12)), (2, make(10)), (10, make(4)), (3, make(1)), (4, ""), (5, None), (6, "... --"), (7, make(30)), (8, "A B"), (None, make(11)), (9, "a b")]
    texts = [make(n) for n in (0, 1, 3, 9, 10, 11, 30, 200, 200)] + [None, "", items[7][1].upper(), "x " + items[0][1] + " y", " ".join(f"w{i}" for i in range(50_000)) + " " + items[0][1]]
    rows = {r.doc_id: r for r in find_overlaps(docs_of(texts), items_of(items), block_bytes=block_bytes).collect()}
    for i, (n, hit, found) in enumerate(brute(texts[:-1], items)):
        assert (rows[i].n_words, rows[i].n_hit, rows[i].items) == (n, hit, found)
        own = words(texts[i])
        by = {("null" if k is None else str(k)): words(v) for k, v in items}
        for m in rows[i].matches:
            assert own[m.doc_word : m.doc_word + m.words] == by[m.item_id][m.item_word : m.item_word + m.words]
        assert sorted((m.item_id, m.doc_word, m.item_word, m.words) for m in rows[i].matches) == sorted(longest(own, by))
    assert rows[len(texts) - 1].n_hit >= 12


def test_only_clean_documents_stay(docs_of, items_of):
    item = "one two three four five six seven eight nine ten eleven"
    docs = docs_of([f"say {item} again", "one two three", None]).selectExpr("*", "1 as n_hit", "2 as items")
    left = drop_contaminated(docs, items_of([(1, item)]))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2]
    assert drop_contaminated(docs, items_of([(1, item)]).where("false")).count() == 3
    assert drop_contaminated(docs.where("false"), items_of([(1, item)])).count() == 0


def test_shards_hold_all_texts_and_repeats():
    """A shard's suffix array: texts that are nothing but one word, equal texts, and a match at both ends of a text."""
    from lattica.llm.common import PLAIN, words_of
    from lattica.llm.decontaminate import codes_of, make_block, search_shard, suffix_array

    items = [("a", b"x " * 30), ("b", b"one two three four five six seven eight nine ten"), ("c", b"")]
    texts = [b"x " * 40, b"one two three four five six seven eight nine ten", b"one two three four five six seven eight nine ten", b"one two", b"", b"y"]
    block, words = make_block(items, 10), words_of(texts, PLAIN)
    rows = [tuple(r) for r in search_shard(words, block, 10).tolist()]
    assert sorted(rows) == sorted([(d, p, {"a": 0, "b": 1}[i], k, n) for d, t in enumerate(texts) for i, p, k, n in longest(t.decode().split(), {i: v.decode().split() for i, v in items})])
    codes = codes_of(words, block)
    assert (codes == 0).sum() == 1 and codes[-1] == 0
    suffixes, keys = suffix_array(codes[:40], 10, 10, len(block.vocabulary))
    assert sorted(suffixes.tolist()) == list(range(31)) and (keys[1:] >= keys[:-1]).all()
