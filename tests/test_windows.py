"""Sliding windows against plain ones."""

import numpy as np
import pytest

from lattica.functions.windows import Ranks, Sliding, sliding
from lattica.operators.cross_section import ts_rank
from lattica.plans.signal import add_signals, field_of

KINDS = {"sum": np.sum, "mean": np.mean, "std": np.std, "min": np.min, "max": np.max, "median": np.median, "below": lambda v: float((v < v[-1]).sum())}


def plain(kind, window, least, run, t, values, there):
    out = np.full(len(t), np.nan)
    for i in range(len(t)):
        own = [values[j] for j in range(i + 1) if run[j] == run[i] and t[i] - t[j] < window and there[j]]
        if len(own) >= least and (kind != "below" or there[i]):
            out[i] = KINDS[kind](np.array(own))
    return out


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize(("window", "least"), [(1, 1), (2, 1), (7, 3), (12, 12), (300, 2)])
def test_kernel_equals_plain_windows(kind, window, least):
    rng = np.random.default_rng(window)
    run = np.sort(rng.integers(0, 4, 200))
    t = np.concatenate([np.sort(rng.choice(400, n, replace=False)) for n in np.bincount(run)])
    values = rng.integers(0, 9, 200) + 1e6 if window % 2 else rng.normal(0, 1, 200)
    there = rng.random(200) < 0.8
    got = sliding(Sliding(kind, window, least), run, t, values.astype(float), there)
    assert np.allclose(got, plain(kind, window, least, run, t, values.astype(float), there), rtol=1e-12, atol=1e-12, equal_nan=True)


def test_moments_do_not_cancel():
    values = 1e9 + np.tile([0.0, 1.0], 5000)
    got = sliding(Sliding("std", 1000, 1000), np.zeros(10_000, np.int64), np.arange(10_000), values, np.ones(10_000, bool))
    assert np.allclose(got[999:], 0.5, rtol=1e-9)


def test_order_statistics_of_any_interval():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 500).astype(float)
    ranks = Ranks(values)
    low = rng.integers(0, 400, 300)
    high = low + rng.integers(1, 100, 300)
    k = rng.integers(0, 1000, 300) % (high - low)
    assert ranks.kth(low, high, k).tolist() == [np.sort(values[a:b])[i] for a, b, i in zip(low, high, k)]


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(4)
    rows = [(run, t, a, None if rng.random() < 0.1 else float(rng.normal())) for run in (0, 1) for a in ("A", "B", "C") for t in range(150)]
    return rows, spark.createDataFrame(rows, "run int, t int, asset string, v double").repartition(3)


@pytest.mark.parametrize("rows_of_a_batch", [10_000, 17])
def test_signals_in_small_batches_and_runs(spark, walk, rows_of_a_batch):
    rows, panel = walk
    made = {"median": field_of("v").rolling(12, "median", 4), "wide": field_of("v").rolling(100, "std", 30), "narrow": field_of("v").rolling(12, "mean"), "rank": ts_rank(field_of("v"), 5), "again": field_of("v").rolling(70, "sum", 1).rolling(3, "median", 1)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_of_a_batch)
    try:
        found = {(r.run, r.asset, r.t): r for r in add_signals(panel, made, ("run",)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows)
    for run in (0, 1):
        for a in "ABC":
            v = [x[3] for x in rows if x[0] == run and x[2] == a]
            t = np.arange(150)
            there = np.array([x is not None for x in v])
            values = np.array([np.nan if x is None else x for x in v])
            zero = np.zeros(150, np.int64)
            sums = plain("sum", 70, 1, zero, t, values, there)
            want = {
                "median": plain("median", 12, 4, zero, t, values, there),
                "wide": plain("std", 100, 30, zero, t, values, there),
                "narrow": plain("mean", 12, 12, zero, t, values, there),
                "rank": plain("below", 5, 5, zero, t, values, there) / 4,
                "again": plain("median", 3, 1, zero, t, sums, ~np.isnan(sums)),
            }
            for name, w in want.items():
                got = np.array([np.nan if found[run, a, i][name] is None else found[run, a, i][name] for i in range(150)])
                assert np.allclose(got, w, equal_nan=True), (name, a)
