import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lattica.llm.quality import line_first_quality
from lattica.llm.queries import tokenizer_path
from tests.llm.brute import classes, removed_lines
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_decontaminate import words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    docs, made = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf).cache()
        made.append(docs)
    return sf, made


def test_stages_return_the_columns_of_documents(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert all(d.columns == COLUMNS for d in stages[1][:-1])


def test_run_equals_brute_force(spark, stages):
    sf, made = stages
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in line_first_quality(docs, keep=["doc_id"]).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    assert sorted((r.doc_id, r.text) for r in made[0].collect()) == rows
    rows = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), gone) for (d, t), gone in zip(rows, removed_lines([t for _, t in rows], 50), strict=True)]
    rows = [(d, t) for d, t, gone in rows if not gone or t.split()]
    lines = sorted((r.doc_id, r.text, r.n_chars) for r in made[1].collect())
    assert lines == [(d, t, len(t)) for d, t in rows]
    before = {r.doc_id: r.text for r in docs.collect()}
    versions = [(k, before[d]) for k, (d, t) in enumerate(rows) if before[d] != t]
    rows = [r for r, c in zip(rows, classes(rows, versions=versions), strict=True) if r[0] == c]
    assert sorted((r.doc_id, r.text) for r in made[2].collect()) == rows
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [words(t)] for k in range(max(1, len(w) - 9))}
    suspects = {d for d, t in rows for w in [words(t)] if any(tuple(w[p : p + 10]) in windows for p in range(len(w)))}
    rows = [(d, t) for d, t in rows if d not in suspects or not hits([t], items)[0][1]]
    assert sorted((r.doc_id, r.text) for r in made[3].collect()) == rows
    library = Tokenizer.from_file(tokenizer_path())
    want = {}
    for d, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in made[4].collect()} == want
    assert sorted(cp.run(spark, sf).collect()) == sorted(made[4].collect())


def test_stages_take_odd_tables(spark, stages):
    sf = stages[0]
    long = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, long, "en", "a", 1), (1, long, "en", "a", 1), (2, None, None, None, None), (None, long, "en", "a", 1), (3, "", "en", "a", 0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as kept", "2 as node", "3 as runs", "4 as n_hit", "5 as ids")
    for docs in (odd, odd.where("false")):
        out = docs
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, out, sf)
            assert out.columns == odd.columns
        out = cp.STAGES[-1][1](spark, out, sf)
        assert out.count() == (0 if docs is not odd else 1)


def test_near_copies_go_although_lines_went_before(spark, tmp_path):
    """A near copy of which line dedup leaves a part that is like nothing else, ids with several texts and a very long text."""
    names = "river town girl house night road man field stone corn glass wood iron wool salt clay".split()
    prose = [f"The {a} of number {k} went to a {b} where nobody had seen the {a} before, and it was late that day." for k, (a, b) in enumerate(zip(names, names[::-1]))]
    other = [*prose[:14], "Quite another line here, with words of its own that stand nowhere else at all.", prose[15]]
    long = "\n".join(f"Line {i} of a long text that says {i * 7919 % 10007} things, one after the other." for i in range(6000))
    rows = [(1, "\n".join(prose)), (2, "\n".join(other)), (3, "\n".join(prose[:1] * 2)), (3, "\n".join(other[14:])), (4, long), (5, long + "\nAnd an end.")]
    rows = [(d, t, "en", "s", len(t)) for d, t in rows]
    raw = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    raw.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    lines = cp.dedup_lines(spark, raw, str(tmp_path)).cache()
    left = cp.near_dedup(spark, lines, str(tmp_path))
    assert 2 in {r.doc_id for r in lines.collect()}
    assert sorted({r.doc_id for r in left.collect()}) == [1, 3, 4]
