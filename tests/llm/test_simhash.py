from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from lattica.llm import simhash
from lattica.llm.graph import components
from lattica.llm.queries import op11_simhash
from lattica.llm.simhash import near_in_block, near_lanes, near_links, simhash_components


def plain_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius=2):
    """A number of its class for each fingerprint, from all pairs."""
    nodes = np.array(sorted(set(prints)), np.uint64)
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(nodes)):
        for j in np.flatnonzero(np.bitwise_count(nodes[i + 1 :] ^ nodes[i]) <= radius).tolist():
            root[find(i + 1 + j)] = find(i)
    return {n: find(i) for i, n in enumerate(nodes.tolist())}


def plain(rows):
    prints = [plain_print(t) for _, t in rows]
    classes = plain_classes(prints)
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[classes[p]] = min(least.get(classes[p], doc), doc)
    return sorted(((d, f"{p:016x}", least.get(classes[p])) for (d, _), p in zip(rows, prints)), key=str)


def found(frame):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in frame.collect()), key=str)


def test_query_equals_all_pairs(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert found(op11_simhash(spark, small)) == plain(rows)


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [None, "", " \t\n", "one", "One two", "one TWO", base, base + " x", base.upper(), "É é", "a\x00b c d", "w " * 3000]
    rows = [*enumerate(texts), (7, base), (None, base), (None, "alone in a null row")]
    docs = spark.createDataFrame([(d, t, "0", 1) for d, t in rows], "doc_id long, text string, fingerprint string, node int")
    assert found(simhash_components(docs)) == plain(rows)
    assert simhash_components(docs.limit(0)).count() == 0


def around(seed, n, most):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 3, dtype=np.uint64).tolist()
    made = set()
    for i in range(n):
        x = centres[i % 3] if i % 10 else int(rng.integers(0, 2**63)) * 2 + 1
        for b in rng.integers(0, 64, int(rng.integers(0, most))):
            x ^= 1 << int(b)
        made.add(x)
    return np.array(sorted(made), np.uint64)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_counters_equal_popcounts(radius):
    nodes = around(3, 400, 8)
    want = np.argwhere(np.bitwise_count(nodes[:70, None] ^ nodes[None, 33:]) <= radius)
    query, node = near_in_block(nodes[:70], nodes[33:], radius)
    assert sorted(zip(query.tolist(), node.tolist())) == sorted(map(tuple, want.tolist()))
    x = nodes[1:] ^ nodes[:-1]
    assert near_lanes(x, radius).tolist() == np.flatnonzero(np.bitwise_count(x) <= radius).tolist()


@pytest.mark.parametrize(("split", "block", "radius"), [(4096, 1024, 2), (300, 100, 2), (300, 1024, 1), (4096, 64, 3)])
def test_dense_buckets_lose_no_link(spark, monkeypatch, split, block, radius):
    monkeypatch.setattr(simhash, "SPLIT", split)
    monkeypatch.setattr(simhash, "BLOCK", block)
    nodes = around(5, 3000, 6)
    frame = spark.createDataFrame([(int(x),) for x in nodes.view(np.int64)], "node long")
    links = near_links(frame, radius)
    root = {r.node: r.root for r in components(links).collect()}
    want = plain_classes(nodes.tolist(), radius)
    have = {int(u): root.get(int(s), int(s)) for u, s in zip(nodes, nodes.view(np.int64))}
    pairs = {(want[u], have[u]) for u in want}
    assert len(pairs) == len(set(want.values())) == len(set(have.values())) < len(nodes)
