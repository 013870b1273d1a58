"""Folds along time, in one pass."""

import time

from lattica.operators import backtest
from lattica.operators.folds import fold_runs


def _sum(start):
    total = start

    def step(x):
        nonlocal total
        total = 0.5 * total + x
        return total, -total

    return step


def test_runs_are_folded_apart_and_in_order(spark):
    rows = [(r, t, float(t * r % 7), None if t % 3 else "s") for r in range(5) for t in range(40)]
    found = fold_runs(spark.createDataFrame(rows, "run int, t int, x double, note string").repartition(7), ["run"], ["x"], ["a", "b"], lambda: _sum(1.0)).collect()
    have = {(r.run, r.t): (r.a, r.b, r.note) for r in found}
    for run in range(5):
        step = _sum(1.0)
        for t in range(40):
            assert have[run, t] == (*step(float(t * run % 7)), None if t % 3 else "s")


def test_empty(spark):
    assert fold_runs(spark.createDataFrame([], "t int, x double"), [], ["x"], ["a", "b"], lambda: _sum(0.0)).collect() == []


def test_two_hundred_thousand_times_take_linear_time(spark):
    """Arrays that grow by a copy for each time would move 2e10 numbers."""

    def run(n):
        terms = "case when id > 0 then array(struct(int(id - 1) as taken, 1e-6D as c), struct(int(id / 2) as taken, 1e-7D as c)) else array() end as terms"
        rows = spark.range(n).selectExpr("int(id) as t", "0.001 * sin(id) as free", "1e-4 as rooted", "0D as flat", "0.01D as widest", "0D as blind", "cast(array() as array<struct<share:double,full:double>>) as large", terms)
        began = time.perf_counter()
        path = fold_runs(rows, [], ["free", "rooted", "flat", "widest", "blind", "large"], ["impact", "peak"], lambda: backtest._capital(1.0))
        found = fold_runs(path, [], ["t", "terms"], ["value", "gross"], backtest._carried).selectExpr("max(t)", "count(impact)", "max_by(value, t)", "max_by(impact, t)").first()
        return time.perf_counter() - began, found

    run(1000)
    few, _ = run(20_000)
    many, found = run(200_000)
    assert many < 20 * few + 5 and found[0] == 199_999 and found[1] == 200_000
    values, capital = [], 1.0
    for t in range(200_000):
        last = values[-1] if values else 1.0
        values.append(last + (1e-6 * values[t - 1] + 1e-7 * values[t // 2] if t else 0.0))
    assert abs(found[2] - values[-1]) < 1e-12
