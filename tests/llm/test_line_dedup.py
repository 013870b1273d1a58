import random

from lattica.llm import line_dedup as line_dedup_module
from lattica.llm.line_dedup import line_dedup
from lattica.llm.queries import op1_line_dedup
from tests.llm.brute import removed_lines, removed_lines_of_long_texts


def expected(texts, min_words, brute=removed_lines):
    out = []
    for text, gone in zip(texts, brute(texts, min_words), strict=True):
        lines = (text or "").split("\n")
        out.append((None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


def test_query_equals_brute_force(spark, small):
    """Every document of the table."""
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    rows = {r.doc_id: r for r in op1_line_dedup(spark, small).collect()}
    want = expected([t for _, t in docs], 50, removed_lines_of_long_texts)
    assert any(n for _, n in want) and len(rows) == len(docs)
    for (i, _), (text, n) in zip(docs, want, strict=True):
        assert (rows[i].text, rows[i].n_lines_removed) == (text, n)


def test_winnowing_keeps_few_lines_and_covers_all_windows():
    rng = random.Random(6)
    texts = ["\n".join(" ".join(str(rng.random()) for _ in range(rng.randrange(1, 14))) for _ in range(n)) for n in (2000, 3, 0, 40)]
    lines, first = line_dedup_module.lines_of([t.encode() for t in texts])
    low, high, minimum = line_dedup_module.windows_in(lines, first, 50)
    for a, b, m in zip(low, high, minimum):
        assert m == a + int(lines["a"][a : b + 1].argmin())
    assert len(set(minimum.tolist())) < 0.35 * len(low)


def test_very_long_text_and_ties(docs_of):
    line = " ".join(["same"] * 60)
    texts = ["\n".join(f"{i} " * 30 for i in range(20_000)), "\n".join([line] * 5000), line]
    rows = {r.doc_id: r for r in line_dedup(docs_of(texts)).collect()}
    assert [rows[i].n_lines_removed for i in range(3)] == [0, 4999, 1] and rows[0].text == texts[0]


def test_random_lines_equal_brute_force(docs_of):
    rng = random.Random(4)
    pool = ["a b", "c", "d e f", "g h i j k l m", "", "  ", "n\to", " a b ", "p q r s t"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) for _ in range(150)]
    assert removed_lines(texts, 5) == removed_lines_of_long_texts(texts, 5)
    for min_words in (4, 7):
        rows = {r.doc_id: r for r in line_dedup(docs_of(texts), min_words=min_words).collect()}
        for i, (text, n) in enumerate(expected(texts, min_words)):
            assert (rows[i].text, rows[i].n_lines_removed) == (text, n), (i, texts[i])


def test_runs_are_matches(docs_of):
    passage = "\n".join(f"line {i} of a passage that many share" for i in range(10))
    texts = ["first words\n" + passage + "\nend here", "other start\nand more\n" + passage, passage]
    rows = {r.doc_id: r for r in line_dedup(docs_of(texts)).collect()}
    assert rows[0].text == texts[0] and rows[0].runs is None and rows[0].n_lines_removed == 0
    assert rows[1].text == "other start\nand more" and [tuple(x) for x in rows[1].runs] == [(2, 11, 0, 1)]
    assert rows[2].text == "" and rows[2].n_lines_removed == 10


def test_nulls_copies_and_clashing_columns(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (5, long), (5, long), (7, None), (8, ""), (9, (long + "\n") * 500), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs", "2 as place", "3 as left")
    out = line_dedup(docs)
    assert out.columns == ["doc_id", "text", "place", "left", "n_lines", "n_lines_removed", "runs"]
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.text, r.n_lines_removed) for r in out.collect() if r.text is not None)
    assert got == [((False, 0), long, 0), ((True, 5), "", 1), ((True, 5), "", 1), ((True, 8), "", 0), ((True, 9), "", 500)]
    assert line_dedup(docs.where("false")).count() == 0
