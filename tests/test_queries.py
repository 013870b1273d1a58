"""Every panel query equals its SQL, run by another engine on the same files."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lattica import queries as panel_queries
from lattica.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    made = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        made.sql(f"create view {path.stem} as select * from '{path}'")
    return made


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, other, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted((tuple(_plain(v) for v in r) for r in found.select(*columns).collect()), key=str)
    rel = other.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_five_buckets(spark):
    rows = entry.entry(spark).collect()
    assert [r.bucket for r in sorted(rows)] == [0, 1, 2, 3, 4] and sum(r.n for r in rows) > 100


def test_library_stands_without_the_corpus_part(tmp_path):
    code = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "lattica.llm" or name.startswith("lattica.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
assert "momentum_stack" in e.queries() and "momentum_stack" in e.oracle_sql()
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_csv_files_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(panel_queries, "_FILE_ROWS", 100)
    folder = panel_queries._as_csv(spark.range(1000).selectExpr("id as k", "id * 2 as v"), "k")
    names = sorted(p.name for p in Path(folder).glob("part-*"))
    assert len(names) == 10 and [int(x) for n in names for x in (Path(folder) / n).read_text().split()[1:]] == [2 * i for i in range(1000)]
