import random

from lattica.llm.chat import END, TURNS, head, rotate_perspectives, whole_dialogues
from lattica.llm.queries import op4_chat_formatting


def brute(rows):
    """(conv, perspective) -> text and masked pieces, of whole conversations."""
    convs = {}
    for conv, turn, role, text in set(rows):
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "unknown", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = sorted(set(turns))
        for p in {r for _, _, r, _ in turns} - {"system"}:
            out[conv, p] = ("".join(f"{head(r, p)}{t}{END}\n" for _, _, r, t in turns), [t + END for _, _, r, t in turns if r == p])
    return out


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r.conv_id), r.perspective, r.part, r.piece)):
        text, masked = out.get((r.conv_id, r.perspective), ("", []))
        out[r.conv_id, r.perspective] = (text + r.text, masked + [r.text[m.start : m.end] for m in r.mask])
    return out


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    got = op4_chat_formatting(spark, small).collect()
    assert {(r.conv_id, r.perspective): r.text for r in got} == {k: v[0] for k, v in want.items()}
    for r in got:
        spans = [tuple(map(int, s.split(":"))) for s in r.mask.split(",")]
        assert [r.text[a:b] for a, b in spans] == want[r.conv_id, r.perspective][1]


def test_many_parties_nulls_ties_and_long_conversations(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, 0, 1, 2, 300]), rng.choice(["ann", "bob", "système", "system", None]), rng.choice(["hi", "é\n", "", None, "x" * 50])) for _ in range(300)]
    rows += [(9, i, rng.choice(["a", "b"]), f"turn {i}") for i in range(1000)] + [(8, 5, f"s{i % 3}", f"tie {i}") for i in range(600)] + [(7, 1, "system", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as cast", "3 as perspective")
    got = rotate_perspectives(turns).collect()
    assert joined(got) == brute(rows)
    assert max(r.n_turns for r in got) <= TURNS and not [r for r in got if r.conv_id == 7]
    assert rotate_perspectives(turns.where("false")).count() == 0
    # put together: one row for each conversation and perspective, but for long ones
    made = whole_dialogues(rotate_perspectives(turns)).collect()
    assert joined(made) == brute(rows) and len(made) == len(brute(rows)) and {r.part for r in made} == {None}
    made = whole_dialogues(rotate_perspectives(turns), max_chars=15_000).collect()
    assert joined(made) == brute(rows)
    assert {r.conv_id for r in made if r.part is not None} == {r.conv_id for r in got for k in [r.conv_id] if max(len(t) for (c, _), (t, _) in brute(rows).items() if c == k) > 15_000} != set()
    assert whole_dialogues(rotate_perspectives(turns.where("false"))).count() == 0


def test_query_equals_sql_with_long_and_odd_conversations(spark, tmp_path):
    """Conversations beyond the bound, gaps in turns, nulls; the SQL as it stands."""
    import duckdb

    from lattica.llm.queries import ORACLE

    rng = random.Random(5)
    rows = [(1, i, f"p{i % 3}", "x" * 2000 + str(i)) for i in range(700)] + [(2, i * 100, rng.choice(["a", "b", None]), f"é {i}") for i in range(50)] + [(None, 3, "c", None), (4, None, "d", "no turn"), (4, 1, "e", "turn"), (4, 1, "e", "turn")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    made = op4_chat_formatting(spark, str(tmp_path))
    columns = sorted(made.columns)
    other = duckdb.connect()
    other.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = other.sql(ORACLE["op4_chat_formatting"])
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r) for r in made.select(*columns).collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    assert {r.conv_id for r in made.where("part is not null").collect()} == {1}
