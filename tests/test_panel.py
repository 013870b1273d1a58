import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.errors import CausalityViolation, PanelError
from lattica.operators import backtest, causality, diagnostics, panel, universe
from lattica.operators.cross_section import cs_demean, cs_neutralize, cs_rank, cs_scale, cs_winsorize, cs_zscore, ts_decay, ts_rank, ts_zscore
from lattica.plans.signal import add_signals, field_of
from lattica.sources import tables

V = field_of("v")


def days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def matrix(spark, rows, assets=None):
    assets = assets or [f"A{i}" for i in range(len(rows[0]))]
    return panel.from_rows(spark, rows, days(len(rows)), assets)


def values(frame, signal):
    out = {}
    for r in add_signals(frame, {"x": signal}).collect():
        out[r.t, r.asset] = r.x
    times, assets = sorted({t for t, _ in out}), sorted({a for _, a in out})
    return [[out[t, a] for a in assets] for t in times]


def column(frame, signal):
    return [row[0] for row in values(frame, signal)]


def test_along_time(spark):
    p = matrix(spark, [[10.0], [11.0], [None], [0.0], [5.0], [6.0]])
    assert column(p, V.shift(1)) == [None, 10.0, 11.0, None, 0.0, 5.0]
    assert column(p, V.shift(9)) == [None] * 6
    assert column(p, V.pct_change(1)) == [None, pytest.approx(0.1), None, None, None, pytest.approx(0.2)]
    assert column(p, V.log_return(1)) == [None, pytest.approx(math.log(1.1)), None, None, None, pytest.approx(math.log(1.2))]
    assert column(p, V.forward_returns(1)) == [pytest.approx(0.1), None, None, None, pytest.approx(0.2), None]
    assert column(p, V.rolling(2)) == [None, 10.5, None, None, 2.5, 5.5]
    assert column(p, V.rolling(3, "median", 1)) == [10.0, 10.5, 10.5, 5.5, 2.5, 5.0]
    assert column(p, V.rolling(2, "std")) == [None, 0.5, None, None, 2.5, 0.5]
    assert column(p, ts_zscore(V, 2)) == [None, 1.0, None, None, 1.0, 1.0]
    assert column(p, ts_decay(V, 2)) == [None, pytest.approx(32 / 3), None, None, pytest.approx(10 / 3), pytest.approx(17 / 3)]
    assert column(p, ts_rank(V, 2)) == [None, 1.0, None, None, 1.0, 1.0]
    assert column(p, ts_rank(V, 1)) == [0.0, 0.0, None, 0.0, 0.0, 0.0]


def test_across_assets(spark):
    p = matrix(spark, [[1.0, 2.0, 2.0, 4.0, 5.0], [1.0, None, 2.0, 3.0, 4.0], [7.0] * 5])
    assert values(p, cs_rank(V)) == [[0.0, 0.375, 0.375, 0.75, 1.0], [None] * 5, [0.5] * 5]
    assert values(p, cs_rank(V, min_breadth=1, pct=False))[1] == [1.0, None, 2.0, 3.0, 4.0]
    assert values(p, cs_demean(V))[0] == pytest.approx([-1.8, -0.8, -0.8, 1.2, 2.2])
    assert values(p, cs_zscore(V))[2] == [None] * 5
    assert sum(map(abs, values(p, cs_scale(V, 2.0))[0])) == pytest.approx(2.0)
    assert values(p, cs_winsorize(V, 0.25))[0] == [2.0, 2.0, 2.0, 4.0, 4.0]
    assert values(p, cs_winsorize(V, 0))[1] == [1.0, None, 2.0, 3.0, 4.0]
    # a constant factor leaves the demeaned signal, the signal itself leaves nothing
    assert values(p, cs_neutralize(V, V * 0.0))[0] == pytest.approx([-1.8, -0.8, -0.8, 1.2, 2.2])
    assert values(p, cs_neutralize(V, V * 3.0))[0] == pytest.approx([0.0] * 5, abs=1e-12)


def test_cells(spark):
    p = matrix(spark, [[1.0, -2.0, 0.0, None]])
    inf = float("inf")
    assert values(p, V / (V * 0.0)) == [[inf, -inf, None, None]]
    assert values(p, -V + 1.0) == [[0.0, 3.0, 1.0, None]]
    assert values(p, V.abs().clip(0.5, 1.5)) == [[1.0, 1.5, 0.5, None]]
    assert values(p, V.where(V.compare(lambda a: a > 0), -9.0)) == [[1.0, -9.0, -9.0, -9.0]]
    assert values(p, (V / (V * 0.0)).fill_na(7.0)) == [[7.0] * 4]


def test_refusals(spark):
    for wrong in (lambda: V.shift(-1), lambda: V.pct_change(0), lambda: V.forward_returns(0), lambda: V.rolling(0), lambda: V.rolling(3, "mode"), lambda: V.rolling(2, "mean", 3), lambda: cs_winsorize(V, 0.5), lambda: cs_scale(V, 0), lambda: ts_decay(V, 0)):
        with pytest.raises(PanelError):
            wrong()
    with pytest.raises(PanelError, match="duplicate"):
        matrix(spark, [[1.0, 2.0]], ["A", "A"])
    with pytest.raises(PanelError, match="increasing"):
        panel.from_rows(spark, [[1.0], [2.0]], days(2)[::-1], ["A"])
    with pytest.raises(PanelError, match="unknown"):
        panel.select_assets(matrix(spark, [[1.0]]), ["Z"])


def test_axes_and_slices(spark):
    rows = spark.createDataFrame([("2020-01-02", "b", "2"), ("2020-01-01", "a", "1"), ("2020-01-01", "a", "9"), ("2020-01-02", "a", "x")], "d string, k string, v string")
    made = panel.long_to_panel(rows.withColumn("n", F.monotonically_increasing_id()), "d", "k", "v", ["n"])
    assert sorted((r.t, r.asset, r.v) for r in made.collect() if r.v is not None) == [(0, "a", 1.0), (1, "b", 2.0)] and made.count() == 4
    p = matrix(spark, [[float(i), None] for i in range(6)])
    assert sorted(r.v for r in panel.slice_time(p, -3, -1).where("v is not null").collect()) == [3.0, 4.0]
    assert panel.between(p, days(6)[1], days(6)[2]).count() == 4
    assert panel.coverage(p, "v").first().coverage == 0.5
    assert [r.pos for r in panel.select_assets(p, ["A1", "A0"]).where("t = 0").orderBy("pos").collect()] == [0, 1]
    with pytest.raises(PanelError):
        panel.checked(p.unionAll(p))


def test_latches_equal_loops(spark):
    rng = random.Random(5)
    prices = [[None if rng.random() < 0.1 else 5 + rng.uniform(-2, 2) for _ in range(6)] for _ in range(80)]
    got = universe.price_floor_screen(matrix(spark, prices), "v", 5.0).collect()
    want = {}
    for a in range(6):
        state = False
        for t in range(80):
            v = prices[t][a]
            if v is not None:
                state = v >= 6.0 if not state else v >= 5.0
            want[t, f"A{a}"] = state and v is not None
    assert {(r.t, r.asset): r.priced for r in got} == want
    volumes = [[None if rng.random() < 0.1 else 1e6 * rng.uniform(0.8, 2) for _ in range(8)] for _ in range(60)]
    got = universe.liquidity_screen(matrix(spark, volumes), "v", top_n=4, min_dollar_volume=1e6, window=4).collect()
    state = [False] * 8
    want = {}
    for t in range(60):
        mean = {}
        for a in range(8):
            window = [volumes[s][a] for s in range(max(0, t - 3), t + 1) if volumes[s][a] is not None]
            if len(window) >= 2 and sum(window) / len(window) >= 1e6 and volumes[t][a]:
                mean[a] = sum(window) / len(window)
        order = sorted(mean, key=lambda a: (-mean[a], a))
        for a in range(8):
            rank = order.index(a) + 1 if a in mean else math.inf
            state[a] = rank <= 6 if state[a] else rank <= 2
            want[t, f"A{a}"] = state[a]
    assert {(r.t, r.asset): r.liquid for r in got} == want
    with pytest.raises(PanelError, match="inverted"):
        universe.liquidity_screen(matrix(spark, volumes), "v", entry_rank=9, exit_rank=3)
    with pytest.raises(TypeError):
        universe.liquidity_screen(matrix(spark, volumes), "v", min_price=5.0)


def test_planted_correlation_is_found(spark):
    rng = random.Random(7)
    n, width, strength, noise = 400, 60, 0.0018, 0.014
    price, hidden = [[100.0] * width], []
    for _ in range(n):
        hidden.append([rng.gauss(0, 1) for _ in range(width)])
        price.append([p * (1 + strength * h + rng.gauss(0, noise)) for p, h in zip(price[-1], hidden[-1])])
    assets = [f"A{i:02d}" for i in range(width)]
    cells = [(t, days(n)[t], a, price[t][i], hidden[t][i]) for t in range(n) for i, a in enumerate(assets)]
    p = spark.createDataFrame(cells, "t int, ts date, asset string, close double, hidden double")
    row = diagnostics.ic_summary(diagnostics.information_coefficient(p, field_of("hidden"), "close")).first()
    assert row["mean"] == pytest.approx(strength / math.hypot(strength, noise), abs=0.015) and row.verdict == "plausible" and row.t_stat > 10
    report = diagnostics.QuantileReport.of(diagnostics.quantile_spread(p, field_of("hidden"), "close"))
    assert report.monotonicity == 1.0 and report.spread > 0 and not report.driven_by_one_tail
    assert "verdict: plausible" in diagnostics.diagnose(p, field_of("hidden"), "close")
    leaked = diagnostics.ic_summary(diagnostics.information_coefficient(p, field_of("close").forward_returns(1), "close")).first()
    assert leaked.t_stat > 1e6 and "leakage" in leaked.verdict


def test_causality(spark):
    rng = random.Random(1)
    p = matrix(spark, [[rng.uniform(50, 150) for _ in range(8)] for _ in range(16)])
    chain = cs_scale(cs_demean(cs_rank(V.pct_change(2))))
    assert not chain.reads_future
    assert causality.assert_causal(chain, p, ("v",), cut_points=(5, 12), trials=1).causal
    assert V.forward_returns(1).reads_future
    with pytest.raises(CausalityViolation):
        causality.assert_causal(cs_rank(V.forward_returns(1)), p, ("v",))
    # a function that leaks is caught by perturbation alone
    leak = lambda df: df.select("t", "asset", (F.col("v") - F.lit(df.agg(F.avg("v")).first()[0])).alias("value"))
    report = causality.check_causality(leak, p, ("v",), cut_points=(8,), trials=1)
    assert not report.causal and report.first[0] < 8 and "reads the future" in report.describe()
    # so is one that takes all perturbations at once, with the same findings as one by one
    def centred(df, run=()):
        return df.withColumn("value", F.col("v") - F.avg("v").over(Window.partitionBy(*run, "asset")))

    both = [causality.check_causality(f, p, ("v",), cut_points=(5, 12), trials=2) for f in (centred, lambda df: centred(df))]
    assert both[0] == both[1] and both[0].changed == 2 * (5 + 12) * 8
    with pytest.raises(ValueError):
        causality.check_causality(chain, p.where("t < 3"), ("v",))


def test_perturbations_are_drawn_from_md5(spark):
    import hashlib

    got = spark.createDataFrame([(3, "A", 1)], "t int, asset string, seed int").select(causality.draw("t", "asset", "seed", 2)).first()[0]
    assert got == int(hashlib.md5(b"3:A:1:2").hexdigest()[:8], 16)


def test_the_grid_is_made_in_many_tasks(spark):
    rows = spark.range(4000).selectExpr("date_add(date'2020-01-01', cast(id % 40 as int)) as ts", "cast(id * 7 % 300 as string) as asset", "double(id) as v").dropDuplicates(["ts", "asset"])
    made = panel.dense_panel(rows)
    assert made.rdd.getNumPartitions() >= 4
    assert made.agg(F.count("*"), F.count_distinct("t"), F.count_distinct("asset"), F.max("t"), F.count("v")).first()[:] == (40 * 300, 40, 300, 39, rows.count())
    assert panel.dense_panel(rows.where("v < 0")).count() == 0


def test_panels_without_anything_in_common_are_refused(spark):
    one = panel.from_rows(spark, [[1.0]], days(1), ["A"], "v")
    with pytest.raises(PanelError):
        panel.align(one, panel.from_rows(spark, [[1.0]], days(1), ["B"], "w"))


def test_a_filtered_panel_broadcasts_no_grid(spark, capsys):
    rows = spark.createDataFrame([(d, a, 1.0) for d in days(3) for a in ("A", "B")], "ts date, asset string, v double")
    made = panel.dense_panel(rows).where("v is not null")  # an inner join now
    made.explain()
    assert "SortMergeJoin [ts" in capsys.readouterr().out and made.count() == 6


def test_rank_correlations_are_exact_for_large_ranks(spark):
    ranks = [(0, float(2**30 + i * 7919), float(2**30 + i * i)) for i in range(2000)]
    got = diagnostics.rank_correlations(spark.createDataFrame(ranks, "t int, a double, b double"), "a", "b", ["t"])
    x, y = ([int(2 * r[k]) for r in ranks] for k in (1, 2))
    part = lambda p, q: len(p) * sum(i * j for i, j in zip(p, q)) - sum(p) * sum(q)
    row = got.first()
    assert row.breadth == 2000 and row.ic == pytest.approx(part(x, y) / math.sqrt(part(x, x) * part(y, y)), abs=1e-12)
    assert "sum(shiftright(" in got._jdf.queryExecution().optimizedPlan().toString()  # of longs, not of decimals


def test_axes_are_dealt_to_all_tasks(spark, capsys):
    p = matrix(spark, [[1.0, 2.0, 2.0, 4.0, 5.0]] * 3)
    made = add_signals(p, {"x": cs_demean(cs_rank(V.shift(1)))})
    made.explain()
    assert capsys.readouterr().out.count("REPARTITION_BY_NUM") == 2 and made.count() == 15  # by asset, then by t


def test_grid_and_cells_are_dealt_to_all_tasks(spark, capsys):
    rows = spark.range(12).selectExpr("date_add(date'2020-01-01', cast(id div 3 as int)) as ts", "cast(id % 3 as string) as asset", "1.0D as v")
    made = panel.dense_panel(rows)
    made.explain()
    assert capsys.readouterr().out.count("REPARTITION_BY_NUM") == 3 and made.count() == 12  # the calendar, the grid, the cells


def test_large_panels_are_dealt_to_more_tasks(spark, monkeypatch):
    """Cells of a task do not grow with the panel, whatever the session shuffles to (4)."""
    rows = spark.range(4000).selectExpr("date_add(date'2020-01-01', cast(id % 40 as int)) as ts", "cast(id * 7 % 300 as string) as asset", "double(id) as v").dropDuplicates(["ts", "asset"])
    signal = {"x": cs_demean(cs_rank(V.shift(1)))}
    spread = lambda x: [r[0] for r in x.groupBy(F.spark_partition_id()).agg(F.count_distinct("t").alias("n")).select("n").collect()]
    small = add_signals(panel.dense_panel(rows), signal)
    assert small.rdd.getNumPartitions() == 4 and spread(small) == [10] * 4  # times go to the tasks in turn
    monkeypatch.setattr(panel, "CELLS", 100)
    made = panel.dense_panel(rows)
    tasks = panel.tasks_of(made)
    assert 100 <= tasks <= 145 and made.rdd.getNumPartitions() == tasks  # of 12,000 cells
    large = add_signals(made, signal)
    assert large.rdd.getNumPartitions() == tasks and spread(large) == [1] * 40
    assert backtest.cells_of(large, "x", "v").rdd.getNumPartitions() == tasks
    by_key = lambda f: sorted((r.t, r.asset, r.x) for r in f.collect())
    assert by_key(large) == by_key(small)


def test_times_of_any_kind_and_runs_are_dealt_out(spark):
    p = matrix(spark, [[1.0, 2.0, 2.0, 4.0, 5.0]] * 3)
    want = values(p, cs_rank(V))
    for other in (p.withColumn("t", F.col("t").cast("long")), p.withColumn("t", F.col("t") + 1).withColumn("t", F.col("t") - 1)):
        assert values(other, cs_rank(V)) == want
    runs = add_signals(p.withColumn("k", F.explode(F.array(F.lit("a"), F.lit("b")))), {"x": cs_rank(V)}, ("k",)).collect()
    assert len(runs) == 30 and all(r.x == want[r.t][int(r.asset[1:])] for r in runs)


def test_lines_are_dealt_out_by_cell_to_tasks_by_their_number(spark, monkeypatch):
    """Neither a split of the file nor a task the session shuffles to adds up a share of the cells that grows with them."""
    seen = []
    monkeypatch.setattr(panel, "CELLS", 600)
    monkeypatch.setattr(tables, "stored", lambda f: seen.append(f) or f)
    tables.supplier_weeks(spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert seen[0].rdd.getNumPartitions() == -(-lines // 600) > 4
